"""Queries of label quality."""

from pyspark.sql import functions as F

from turnlab.functions.labels import split_labels
from turnlab.operators import evaluate as ev
from turnlab.operators import sequence as seq
from turnlab.operators import tables as tab
from turnlab.plans.catalog.registry import on_table, on_turns, on_utterances
from turnlab.plans.catalog.relations import PREV
from turnlab.plans.catalog.tabulation import rounded
from turnlab.vocab import DA_CODES, PR_LABELS

JUDGED = "j AS (SELECT doc_id, quality AS y, 1 - toxic AS p FROM labels)"


def judged(labels):
    return labels.select("doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"))


@on_table("binary_quality", "labels", f"""
WITH {JUDGED}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp,
  count(*) FILTER (y = 1 AND p <> 1) AS fn, count(*) FILTER (y <> 1 AND p <> 1) AS tn FROM j)
SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def binary_quality(labels):
    return ev.binary_metrics(judged(labels), "y", "p")


@on_table("majority_baseline", "labels", f"""
WITH {JUDGED}, c AS (SELECT y, count(*) AS n FROM j WHERE y IS NOT NULL GROUP BY 1)
SELECT y AS label, n::DOUBLE / (SELECT sum(n) FROM c) AS accuracy FROM c ORDER BY n DESC, y DESC LIMIT 1""")
def majority_baseline(labels):
    return ev.majority_baseline(judged(labels), "y")


@on_table("wrongly_judged_documents", "labels", f"""
WITH {JUDGED} SELECT doc_id, y, p FROM j WHERE y <> p""")
def wrongly_judged(labels):
    return ev.error_rows(judged(labels), "y", "p")


GUESSED = """
j AS (SELECT idx, pr_label AS y, CASE WHEN pr_confidence < 0.1 THEN 'Compliance' WHEN pr_confidence < 0.2 THEN 'Neutral'
                                      ELSE 'Resistance' END AS p FROM turns WHERE pr_label IS NOT NULL)
"""
PER_CLASS = """
k AS (SELECT l.x AS label, count(*) FILTER (y = l.x AND p = l.x) AS tp, count(*) FILTER (y = l.x) AS support,
             count(*) FILTER (p = l.x) AS predicted
      FROM j, (SELECT unnest(['Compliance', 'Neutral', 'Resistance']) AS x) l GROUP BY 1),
report AS (SELECT label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
                  coalesce(2e0 * tp / nullif(predicted + support, 0), 0) AS f1, support, tp FROM k)
"""


def guessed(t):
    c = F.col("pr_confidence")
    guess = F.when(c < 0.1, "Compliance").when(c < 0.2, "Neutral").otherwise("Resistance")
    return t.where("pr_label is not null").select("idx", F.col("pr_label").alias("y"), guess.alias("p"), c.alias("c"))


@on_turns("outcome_confusion", f"""
WITH {GUESSED}, l AS (SELECT unnest(['Compliance', 'Neutral', 'Resistance']) AS x)
SELECT a.x AS gold, b.x AS pred, count(j.idx) AS n FROM l a CROSS JOIN l b
LEFT JOIN j ON j.y = a.x AND j.p = b.x GROUP BY 1, 2""")
def outcome_confusion(t):
    return ev.confusion(guessed(t), "y", "p", PR_LABELS)


@on_turns("outcome_class_report", f"WITH {GUESSED}, {PER_CLASS} SELECT label, precision, recall, f1, support FROM report")
def outcome_class_report(t):
    return ev.class_report(guessed(t), "y", "p")


@on_turns("outcome_quality", f"""
WITH {GUESSED}, {PER_CLASS} SELECT round(sum(tp)::DOUBLE / sum(support), 8) AS accuracy, round(avg(precision), 8) AS macro_precision,
  round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1,
  round(sum(precision * support) / sum(support), 8) AS weighted_precision, round(sum(recall * support) / sum(support), 8) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 8) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM report""")
def outcome_quality(t):
    out = ev.multiclass_metrics(guessed(t), "y", "p")
    return rounded(out, *[c for c in out.columns if c != "n"])


@on_turns("first_wrong_outcomes", f"""
WITH {GUESSED} SELECT j.idx, y, p, CASE y WHEN 'Compliance' THEN 1 - pr_confidence WHEN 'Neutral' THEN 0.5 ELSE pr_confidence END AS true_prob,
  CASE p WHEN 'Compliance' THEN 1 - pr_confidence WHEN 'Neutral' THEN 0.5 ELSE pr_confidence END AS pred_prob
FROM j JOIN turns USING (idx) WHERE y <> p ORDER BY j.idx LIMIT 5""")
def first_wrong_outcomes(t):
    scored = guessed(t).select("*", (1 - F.col("c")).alias("_c"), F.lit(0.5).alias("_n"))
    probs = {"Compliance": "_c", "Neutral": "_n", "Resistance": "c"}
    return ev.error_rows(scored, "y", "p", probs, first=5).select("idx", "y", "p", "true_prob", "pred_prob")


# Predicting an act list by the previous row's act list.
LISTS = f"""
{PREV}, j AS (SELECT string_split(da_label, ',') AS y, string_split(prev_da_label, ',') AS p FROM p
              WHERE da_label IS NOT NULL AND prev_da_label IS NOT NULL),
k AS (SELECT l.x AS label, count(*) FILTER (list_contains(y, l.x) AND list_contains(p, l.x)) AS tp,
             count(*) FILTER (NOT list_contains(y, l.x) AND list_contains(p, l.x)) AS fp,
             count(*) FILTER (list_contains(y, l.x) AND NOT list_contains(p, l.x)) AS fn, count(*) AS n
      FROM j, (SELECT unnest([{', '.join(f"'{c}'" for c in DA_CODES)}]) AS x) l GROUP BY 1),
s AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, max(n) AS n, sum(n)::DOUBLE AS cells,
             avg(coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0)) AS macro FROM k)
"""


def act_lists(t):
    rows = seq.prev_label(t.withColumn("acts", F.col("da_label")), ["acts"]).where("da_label is not null")
    return rows.select(split_labels("da_label").alias("y"), split_labels("prev_acts").alias("p"))


@on_turns("act_list_quality", f"""
WITH {LISTS} SELECT n, (SELECT count(*) FROM j WHERE list_sort(list_distinct(y)) = list_sort(list_distinct(p)))::DOUBLE / n AS exact_match,
  round(1 - (fp + fn) / cells, 8) AS label_accuracy, round(2 * tp / (2 * tp + fp + fn), 8) AS micro_f1, round(macro, 8) AS macro_f1 FROM s""")
def act_list_quality(t):
    return rounded(ev.multilabel_metrics(act_lists(t), "y", "p", DA_CODES), "label_accuracy", "micro_f1", "macro_f1")


@on_turns("act_list_report", f"""
WITH {LISTS} SELECT label, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM k""")
def act_list_report(t):
    return ev.multilabel_report(act_lists(t), "y", "p", DA_CODES)


@on_turns("act_list_agreement", f"""
WITH {LISTS}, o AS (SELECT 1 - (fp + fn) / cells AS po, (tp + fn) / cells * ((tp + fp) / cells)
                           + (1 - (tp + fn) / cells) * (1 - (tp + fp) / cells) AS pe FROM s)
SELECT round(po, 8) AS label_accuracy, round((po - pe) / (1 - pe), 8) AS cohen_kappa,
       round((po - pe) / (1 - pe), 8) AS fleiss_kappa, round(2 * po - 1, 8) AS pabak FROM o""")
def act_list_agreement(t):
    out = ev.kappa(act_lists(t), "y", "p", DA_CODES)
    return rounded(out, *out.columns)


@on_utterances("vote_distributions", """
WITH a AS (SELECT vote_2 AS label, count(*) AS n FROM utterances GROUP BY 1),
b AS (SELECT vote_3 AS label, count(*) AS n FROM utterances WHERE vote_3 IS NOT NULL GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS n_a, coalesce(a.n * 1e2 / (SELECT sum(n) FROM a), 0) AS percent_a,
       coalesce(b.n, 0) AS n_b, coalesce(b.n * 1e2 / (SELECT sum(n) FROM b), 0) AS percent_b FROM a FULL JOIN b USING (label)""")
def vote_distributions(u):
    return tab.compare_dist(u, "vote_2", "vote_3")
