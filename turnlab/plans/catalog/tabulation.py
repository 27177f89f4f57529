"""Queries of distributions, contingency tables and rates."""

from pyspark.sql import functions as F

from turnlab.functions.clean import default_stop_words
from turnlab.operators import sequence as seq
from turnlab.operators import tables as tab
from turnlab.plans import stand_ins
from turnlab.plans.catalog.registry import on_all, on_table, on_turns
from turnlab.plans.catalog.relations import (
    ALL_PAIRS, CLOSE, MATCHED, PREV, TIMED, VALID, context_sql,
)
from turnlab.vocab import PR_LABELS, VALID_PR


def rounded(df, *cols, digits=8):
    """Sums of doubles depend on their order in the last bits; compare without those."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- one column ---------------------------------------------------------------------------------

@on_turns("outcome_distribution", """
SELECT pr_label, count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS percent
FROM turns WHERE pr_label IS NOT NULL GROUP BY 1""")
def outcome_distribution(t):
    return tab.value_dist(t, "pr_label")


LABELS = """
l AS (SELECT idx, unnest(string_split(da_label, ',')) AS label FROM turns)
"""


@on_turns("act_frequency", f"""
WITH {LABELS} SELECT label, count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS percent
FROM l GROUP BY 1""")
def act_frequency(t):
    return tab.label_freq(t, "da_label")


@on_turns("acts_per_row", """
SELECT len(string_split(da_label, ','))::BIGINT AS n_labels, count(*) AS n,
       count(*) * 1e2 / sum(count(*)) OVER () AS percent
FROM turns WHERE da_label IS NOT NULL GROUP BY 1""")
def acts_per_row(t):
    return tab.labels_per_row(t, "da_label")


@on_turns("class_balance", """
WITH c AS (SELECT pr_label, count(*) AS n FROM turns WHERE pr_label IS NOT NULL GROUP BY 1)
SELECT (SELECT pr_label FROM c ORDER BY n DESC, pr_label DESC LIMIT 1) AS largest, max(n) AS n_largest,
       (SELECT pr_label FROM c ORDER BY n, pr_label LIMIT 1) AS smallest, min(n) AS n_smallest,
       max(n)::DOUBLE / min(n) AS ratio, max(n)::DOUBLE / min(n) > 3 AS imbalanced FROM c""")
def class_balance(t):
    return tab.class_balance(t, "pr_label")


@on_turns("class_feasibility", """
SELECT da_label, count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS percent,
       count(*) < 100 AS too_few FROM turns WHERE da_label IS NOT NULL GROUP BY 1""")
def class_feasibility(t):
    return tab.class_feasibility(t, "da_label")


@on_turns("top_acts", """
SELECT da_label, count(*) AS n FROM turns WHERE da_label IS NOT NULL GROUP BY 1
ORDER BY n DESC, da_label LIMIT 15""")
def top_acts(t):
    return tab.top_values(t, "da_label", 15)


TOP3 = """
top3 AS (SELECT da_label FROM turns WHERE da_label IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, da_label LIMIT 3)
"""


@on_turns("rows_of_top_acts", f"""
WITH {TOP3} SELECT idx, da_label FROM turns WHERE da_label IN (SELECT da_label FROM top3)""")
def rows_of_top_acts(t):
    return tab.where_top(t, "da_label", 3).select("idx", "da_label")


@on_turns("share_of_top_acts", f"""
WITH {TOP3} SELECT count(*) FILTER (da_label IN (SELECT da_label FROM top3)) AS kept, count(*) AS total,
  count(*) FILTER (da_label IN (SELECT da_label FROM top3)) * 1e2 / count(*) AS percent FROM turns""")
def share_of_top_acts(t):
    return tab.top_share(t, "da_label", 3)


@on_turns("rows_of_frequent_acts", """
SELECT idx, da_label FROM turns WHERE da_label IN (
  SELECT da_label FROM turns GROUP BY 1 HAVING count(*) >= 40)""")
def rows_of_frequent_acts(t):
    return tab.where_frequent(t, "da_label", 40).select("idx", "da_label")


@on_table("categorical_profile", "documents", """
WITH v AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL
           SELECT 'source', source FROM documents UNION ALL
           SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents)
SELECT "column", value, count(*) AS n,
       count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY "column") AS percent
FROM v WHERE "column" IN (SELECT "column" FROM v GROUP BY 1 HAVING count(DISTINCT value) <= 20)
GROUP BY 1, 2""")
def categorical_profile(d):
    return tab.profile_categoricals(d, ["lang", "source", "n_chars"])


@on_turns("id_label_counts", """
SELECT dialogue_id, pr_label, count(*) AS n FROM turns GROUP BY 1, 2""")
def id_label_counts(t):
    return tab.id_label_dist(t, "dialogue_id", "pr_label")


# --- two columns --------------------------------------------------------------------------------

GRID = """
c AS (SELECT {r} AS r, {c} AS c, count(*) AS n FROM {t} WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2),
g AS (SELECT r.r, k.c, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT r FROM c) r
      CROSS JOIN (SELECT DISTINCT c FROM c) k LEFT JOIN c ON c.r = r.r AND c.c = k.c)
"""


def shares_sql(row, col):
    return f"""
SELECT r AS {row}, c AS {col}, n, n * 1e2 / sum(n) OVER (PARTITION BY r) AS row_percent,
       n * 1e2 / sum(n) OVER (PARTITION BY c) AS col_percent, n * 1e2 / sum(n) OVER () AS percent FROM g"""


@on_turns("prev_eml_by_outcome", f"""
WITH {PREV}, {GRID.format(r='prev_eml_label', c='pr_label', t='p')} {shares_sql('prev_eml_label', 'pr_label')}""")
def prev_eml_by_outcome(t):
    return tab.crosstab(seq.prev_label(t), "prev_eml_label", "pr_label", PR_LABELS)


@on_turns("act_by_eml_crosstab", f"""
WITH {GRID.format(r='da_label', c='eml_label', t='turns')} {shares_sql('da_label', 'eml_label')}""")
def act_by_eml_crosstab(t):
    return tab.crosstab(t, "da_label", "eml_label")


@on_turns("timing_by_outcome", f"""
WITH {TIMED}, {GRID.format(r='timing', c='pr_label', t='timed')} {shares_sql('timing', 'pr_label')}""")
def timing_by_outcome(t):
    return tab.crosstab(seq.label_timing(t), "timing", "pr_label", PR_LABELS)


@on_turns("outcome_margins", """
SELECT coalesce(pr_label, 'All') AS pr_label, coalesce(CAST(eml_label AS VARCHAR), 'All') AS eml_label,
       count(*) AS n FROM turns WHERE pr_label IS NOT NULL GROUP BY CUBE (pr_label, eml_label)""")
def outcome_margins(t):
    return tab.crosstab_margins(t, "pr_label", "eml_label")


EVENT_RATIO = """
SELECT da_label, count(*) FILTER (eml_label = 0) AS no_event, count(*) FILTER (eml_label = 1) AS event,
       count(*) FILTER (eml_label = 0) * 1e2 / count(*) AS no_event_percent,
       count(*) FILTER (eml_label = 1) * 1e2 / count(*) AS event_percent
FROM turns WHERE da_label IS NOT NULL GROUP BY 1"""


@on_turns("eml_ratio_by_act", EVENT_RATIO)
def eml_ratio_by_act(t):
    return tab.event_ratio_by(t, "da_label", "eml_label")


@on_turns("top_acts_by_eml_ratio", EVENT_RATIO + " ORDER BY event_percent DESC, da_label LIMIT 10")
def top_acts_by_eml_ratio(t):
    return tab.top_by(tab.event_ratio_by(t, "da_label", "eml_label"), "event_percent", 10, ["da_label"])


GROUPED = f"""
{PREV}, q AS (SELECT *,
  CASE WHEN list_has_any(string_split(da_label, ','), ['pa', 'sp']) THEN 'DA+'
       WHEN list_has_any(string_split(da_label, ','), ['pr', 'sn', 'ic', 'dc']) THEN 'DA-'
       ELSE 'DAo' END AS da_group,
  CASE WHEN list_has_any(string_split(prev_da_label, ','), ['pa', 'sp']) THEN 'DA+'
       WHEN list_has_any(string_split(prev_da_label, ','), ['pr', 'sn', 'ic', 'dc']) THEN 'DA-'
       ELSE 'DAo' END AS prev_da_group
  FROM p WHERE prev_eml_label IS NOT NULL)
"""


def prob_sql(given, target, values, source, where="TRUE"):
    per_value = " UNION ALL ".join(
        f"SELECT {given}, '{v}' AS {target}, count(*) FILTER ({target} = '{v}') AS n, count(*) AS total "
        f"FROM {source} WHERE {where} GROUP BY {given}" for v in values)
    return f"SELECT *, n::DOUBLE / total AS probability FROM ({per_value})"


@on_turns("prev_eml_to_outcome_probability", f"""
WITH {PREV} {prob_sql('prev_eml_label', 'pr_label', PR_LABELS, 'p',
                      'prev_eml_label IS NOT NULL AND pr_label IS NOT NULL')}""")
def prev_eml_to_outcome(t):
    return tab.cond_prob(seq.prev_label(t), "prev_eml_label", "pr_label", PR_LABELS, dropna=True)


@on_turns("prev_eml_to_act_group_probability",
          f"WITH {GROUPED} {prob_sql('prev_eml_label', 'da_group', ['DA+', 'DA-', 'DAo'], 'q')}")
def prev_eml_to_act_group(t):
    from turnlab.functions.labels import da_group
    rows = seq.prev_label(t).withColumn("da_group", da_group("da_label"))
    return tab.cond_prob(rows, "prev_eml_label", "da_group", ["DA+", "DA-", "DAo"])


@on_turns("joint_condition_to_outcome_probability", f"""
WITH {GROUPED} {prob_sql('prev_da_group, prev_eml_label', 'pr_label', VALID_PR, 'q',
                         "prev_da_label IS NOT NULL AND prev_da_group <> 'DAo'")}""")
def joint_condition(t):
    from turnlab.functions.labels import da_group
    rows = (seq.prev_label(t, ["eml_label", "da_label"])
            .withColumn("prev_da_group", da_group("prev_da_label")).where("prev_da_group <> 'DAo'"))
    return tab.cond_prob(rows, ["prev_da_group", "prev_eml_label"], "pr_label", VALID_PR)


@on_turns("prev_act_group_to_eml_probability", f"""
WITH {GROUPED}, z AS (SELECT prev_da_group, eml_label FROM q
                      WHERE prev_da_label IS NOT NULL AND prev_da_group <> 'DAo')
SELECT prev_da_group, v.x AS eml_label, count(*) FILTER (eml_label = v.x) AS n, count(*) AS total,
       count(*) FILTER (eml_label = v.x)::DOUBLE / count(*) AS probability
FROM z, (SELECT unnest([0, 1]) AS x) v GROUP BY 1, 2""")
def prev_act_group_to_eml(t):
    from turnlab.functions.labels import da_group
    rows = (seq.prev_label(t, ["eml_label", "da_label"])
            .withColumn("prev_da_group", da_group("prev_da_label")).where("prev_da_group <> 'DAo'"))
    return tab.cond_prob(rows, "prev_da_group", "eml_label", [0, 1])


@on_turns("condition_group_sizes", f"""
WITH {GROUPED} SELECT prev_da_group || '_EML' || prev_eml_label AS group_key, count(*) AS n FROM q
WHERE prev_da_label IS NOT NULL AND prev_da_group <> 'DAo' GROUP BY 1""")
def condition_group_sizes(t):
    from turnlab.functions.labels import da_group
    rows = (seq.prev_label(t, ["eml_label", "da_label"])
            .withColumn("g", da_group("prev_da_label")).where("g <> 'DAo'"))
    return (rows.groupBy(tab.concat_key("g", "prev_eml_label").alias("group_key"))
            .agg(F.count(F.lit(1)).alias("n")))


@on_turns("act_association", f"""
WITH {PREV}, v AS (SELECT * FROM p WHERE prev_eml_label IS NOT NULL),
l AS (SELECT DISTINCT idx, prev_eml_label, unnest(string_split(da_label, ',')) AS label FROM v),
s AS (SELECT label, count(*) FILTER (prev_eml_label = 0) AS count_0,
             count(*) FILTER (prev_eml_label = 1) AS count_1,
             (SELECT count(*) FROM v WHERE prev_eml_label = 0) AS t0,
             (SELECT count(*) FROM v WHERE prev_eml_label = 1) AS t1 FROM l GROUP BY 1),
cells AS (SELECT *, (t0 - count_0)::DOUBLE AS a, count_0::DOUBLE AS b, (t1 - count_1)::DOUBLE AS c,
                 count_1::DOUBLE AS d, (t0 + t1)::DOUBLE AS n FROM s),
e AS (SELECT *, t0 * (a + c) / n AS ea, t0 * (b + d) / n AS eb, t1 * (a + c) / n AS ec,
             t1 * (b + d) / n AS ed FROM cells)
SELECT label, count_0::DOUBLE / t0 AS p_given_0, count_1::DOUBLE / t1 AS p_given_1, count_0, count_1,
       round(CASE WHEN least(a, b, c, d) > 0 THEN
         (abs(a - ea) - least(0.5, abs(a - ea))) ** 2 / ea + (abs(b - eb) - least(0.5, abs(b - eb))) ** 2 / eb
       + (abs(c - ec) - least(0.5, abs(c - ec))) ** 2 / ec + (abs(d - ed) - least(0.5, abs(d - ed))) ** 2 / ed
       END, 8) AS chi2 FROM e""")
def act_association(t):
    return rounded(tab.label_assoc(seq.prev_label(t), "da_label", "prev_eml_label"), "chi2")


@on_turns("commonest_act_per_outcome", f"""
WITH {GRID.format(r='da_label', c='pr_label', t='turns')},
s AS (SELECT *, n * 1e2 / sum(n) OVER (PARTITION BY r) AS row_percent FROM g)
SELECT c AS pr_label, r AS da_label, row_percent FROM s
QUALIFY row_number() OVER (PARTITION BY c ORDER BY row_percent DESC, r DESC) = 1""")
def commonest_act(t):
    return tab.argmax_by(t, "da_label", "pr_label")


@on_turns("timing_share_gap", f"""
WITH {TIMED}, s AS (SELECT pr_label, count(*) FILTER (timing = 'before_EML') AS b,
                           count(*) FILTER (timing = 'after_EML') AS a FROM timed GROUP BY 1)
SELECT pr_label, b * 1e2 / sum(b) OVER () AS share_a, a * 1e2 / sum(a) OVER () AS share_b,
       CAST(sum(b) OVER () AS BIGINT) AS n_a, CAST(sum(a) OVER () AS BIGINT) AS n_b,
       b * 1e2 / sum(b) OVER () - a * 1e2 / sum(a) OVER () AS gap FROM s""")
def timing_share_gap(t):
    return tab.share_gap(seq.label_timing(t), "timing", "before_EML", "after_EML", "pr_label", PR_LABELS)


# --- transitions --------------------------------------------------------------------------------

TYPES = "(SELECT unnest(['Compliance→Compliance', 'Compliance→Resistance', 'Resistance→Compliance', 'Resistance→Resistance']) AS transition)"


def table_sql(source, group):
    return f"""
k AS (SELECT g.x AS {group}, y.transition, count(m.transition) AS n
      FROM (SELECT unnest(['With_EML', 'Without_EML']) AS x) g CROSS JOIN {TYPES} y
      LEFT JOIN {source} m ON m.{group} = g.x AND m.transition = y.transition GROUP BY 1, 2),
kk AS (SELECT *, coalesce(n * 1e2 / nullif(sum(n) OVER (PARTITION BY {group}), 0), 0) AS percent FROM k)
"""


@on_turns("transition_table", f"""
WITH {ALL_PAIRS}, {table_sql('moves', 'event_group')} SELECT event_group, transition, n, percent FROM kk""")
def transition_table(t):
    return tab.transition_table(seq.transitions(t), "event_group")


@on_turns("gap_transition_table", f"""
WITH {CLOSE}, {table_sql('close', 'event_between')} SELECT event_between, transition, n, percent FROM kk""")
def gap_transition_table(t):
    return tab.transition_table(seq.gap_transitions(t), "event_between")


@on_turns("gap_transition_matrix", f"""
WITH {CLOSE}, {table_sql('close', 'event_between')}
SELECT event_between, split_part(transition, '→', 1) AS pr_prev,
       max(percent) FILTER (split_part(transition, '→', 2) = 'Compliance') AS to_compliance,
       max(percent) FILTER (split_part(transition, '→', 2) = 'Resistance') AS to_resistance
FROM kk GROUP BY 1, 2""")
def gap_transition_matrix(t):
    return tab.transition_matrix(seq.gap_transitions(t), "event_between")


@on_turns("transition_matrix", f"""
WITH {ALL_PAIRS}, {table_sql('moves', 'event_group')}
SELECT event_group, split_part(transition, '→', 1) AS pr_prev,
       max(percent) FILTER (split_part(transition, '→', 2) = 'Compliance') AS to_compliance,
       max(percent) FILTER (split_part(transition, '→', 2) = 'Resistance') AS to_resistance
FROM kk GROUP BY 1, 2""")
def transition_matrix(t):
    return tab.transition_matrix(seq.transitions(t), "event_group")


@on_turns("transition_stability", f"""
WITH {CLOSE} SELECT event_between, count(*) FILTER (pr_prev = pr_next) * 1e2 / count(*) AS stability,
  1e2 - count(*) FILTER (pr_prev = pr_next) * 1e2 / count(*) AS switch, count(*) AS transitions
FROM close GROUP BY 1""")
def transition_stability(t):
    return tab.stability(seq.gap_transitions(t), "event_between")


@on_turns("transition_summary", f"""
WITH {ALL_PAIRS} SELECT event_group, count(*) FILTER (pr_prev = pr_next) * 1e2 / count(*) AS stability,
  1e2 - count(*) FILTER (pr_prev = pr_next) * 1e2 / count(*) AS switch, count(*) AS transitions,
  count(DISTINCT dialogue_id) AS dialogues
FROM moves GROUP BY 1""")
def transition_summary(t):
    return tab.transition_summary(seq.transitions(t), "event_group")


BY_DA = """
k AS (SELECT {g} da_type, transition, count(*) AS n FROM {t} GROUP BY ALL)
SELECT {g} da_type, transition, n, CAST(sum(n) OVER (PARTITION BY {g} da_type) AS BIGINT) AS da_total,
       n * 1e2 / sum(n) OVER (PARTITION BY {g} da_type) AS probability FROM k"""


@on_turns("transitions_by_act_and_event", f"""
WITH {context_sql(False)}, {BY_DA.format(g='event_between,', t='context')}""")
def transitions_by_act_and_event(t):
    return tab.transition_by_da(seq.transitions_with_context(t), "event_between")


@on_turns("transitions_by_each_act", f"""
WITH {context_sql(False)}, each_act AS (
  SELECT event_between, transition, unnest(string_split(da_type, ',')) AS da_type FROM context),
{BY_DA.format(g='event_between,', t='each_act')}""")
def transitions_by_each_act(t):
    return tab.transition_by_da(seq.transitions_with_context(t, multi=True), "event_between")


@on_turns("transitions_by_last_event_act", f"""
WITH {context_sql(True)}, {BY_DA.format(g='', t='context')}""")
def transitions_by_last_event_act(t):
    return tab.transition_by_da(seq.transitions_with_context(t, event_only=True))


# --- matched rows -------------------------------------------------------------------------------

@on_turns("matched_outcome_probability", f"""
WITH {MATCHED}, k AS (SELECT eml_da_type, eml_result, count(*) AS n FROM matched
                      WHERE eml_da_type IS NOT NULL GROUP BY 1, 2)
SELECT *, CAST(sum(n) OVER (PARTITION BY eml_da_type) AS BIGINT) AS total,
       n * 1e2 / sum(n) OVER (PARTITION BY eml_da_type) AS probability FROM k""")
def matched_outcome_probability(t):
    return tab.prob_by(seq.nearest_labels(t), "eml_da_type", "eml_result")


@on_turns("matched_outcome_rate", f"""
WITH {MATCHED} SELECT eml_da_type, count(*) FILTER (eml_result = 'Compliance') * 1e2 / count(*) AS compliance_rate,
  count(*) FILTER (eml_result = 'Resistance') * 1e2 / count(*) AS resistance_rate, count(*) AS total
FROM matched WHERE eml_da_type IS NOT NULL GROUP BY 1""")
def matched_outcome_rate(t):
    return tab.outcome_rate(seq.nearest_labels(t), "eml_da_type")


CONVERSIONS = ", ".join(
    f"count(*) FILTER (pr_status_before = '{a}' AND eml_result = '{b}') * 1e2 / count(*) AS {a}_to_{b}".lower()
    .replace(f"'{a}'".lower(), f"'{a}'").replace(f"'{b}'".lower(), f"'{b}'")
    for a in VALID_PR for b in VALID_PR)


@on_turns("conversion_rate", f"""
WITH {MATCHED} SELECT eml_da_type, count(*) AS total, {CONVERSIONS}
FROM matched WHERE eml_da_type IS NOT NULL AND pr_status_before IS NOT NULL GROUP BY 1""")
def conversion_rate(t):
    return tab.conversion_rate(seq.nearest_labels(t))


# --- dialogues ----------------------------------------------------------------------------------

METRICS = f"""
m AS (SELECT dialogue_id, count(*) FILTER ({VALID}) AS total_pr_count,
             count(*) FILTER (eml_label = 1) AS total_eml_count FROM turns GROUP BY 1)
"""


@on_turns("dialogue_metrics", f"WITH {METRICS} SELECT * FROM m")
def dialogue_metrics(t):
    return tab.dialogue_metrics(t)


@on_turns("dialogue_summary", f"""
WITH {METRICS} SELECT count(*) AS dialogues, CAST(sum(total_pr_count) AS BIGINT) AS total_pr,
  CAST(sum(total_eml_count) AS BIGINT) AS total_eml, count(*) FILTER (total_pr_count >= 2) AS multi_pr,
  count(*) FILTER (total_eml_count > 0) AS with_eml,
  count(*) FILTER (total_pr_count >= 2 AND total_eml_count > 0) AS both,
  count(*) FILTER (total_pr_count >= 2) / count(*)::DOUBLE AS multi_pr_ratio,
  count(*) FILTER (total_eml_count > 0) / count(*)::DOUBLE AS with_eml_ratio,
  count(*) FILTER (total_pr_count >= 2 AND total_eml_count > 0) / count(*)::DOUBLE AS both_ratio FROM m""")
def dialogue_summary(t):
    return tab.dialogue_summary(t)


@on_turns("outcome_count_histogram", f"""
WITH {METRICS} SELECT total_pr_count, count(*) AS dialogues FROM m GROUP BY 1""")
def outcome_count_histogram(t):
    return tab.count_hist(tab.dialogue_metrics(t), "total_pr_count")


# --- numbers ------------------------------------------------------------------------------------

@on_turns("confidence_by_timing", f"""
WITH {TIMED} SELECT timing, round(avg(pr_confidence), 8) AS mean, round(stddev_samp(pr_confidence), 8) AS std,
  count(pr_confidence) AS n FROM timed GROUP BY 1""")
def confidence_by_timing(t):
    return rounded(tab.group_stats(seq.label_timing(t), "timing", "pr_confidence"), "mean", "std")


@on_turns("confidence_summary", """
SELECT count(pr_confidence) AS n, round(avg(pr_confidence), 8) AS mean, min(pr_confidence) AS min,
  max(pr_confidence) AS max, round(stddev_samp(pr_confidence), 8) AS std,
  round(quantile_cont(pr_confidence, 0.5), 8) AS median FROM turns""")
def confidence_summary(t):
    return rounded(tab.describe(t, "pr_confidence"), "mean", "std", "median")


@on_turns("confidence_bands", """
SELECT CASE WHEN pr_confidence < 0.5 THEN '<0.5' WHEN pr_confidence < 0.8 THEN '0.5-0.8'
            WHEN pr_confidence < 0.9 THEN '0.8-0.9' ELSE '>=0.9' END AS band,
       count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS percent
FROM turns WHERE pr_confidence IS NOT NULL GROUP BY 1""")
def confidence_bands(t):
    return tab.confidence_bins(t, "pr_confidence")


@on_turns("confidence_by_outcome", """
SELECT pr_label, count(*) AS n, round(avg(pr_confidence), 8) AS mean_confidence
FROM turns WHERE pr_label IS NOT NULL GROUP BY 1""")
def confidence_by_outcome(t):
    return rounded(tab.confidence_by_label(t, "pr_label", "pr_confidence"), "mean_confidence")


@on_turns("confidence_box_by_timing", f"""
WITH {TIMED} SELECT timing, min(pr_confidence) AS min, round(quantile_cont(pr_confidence, 0.25), 8) AS q1,
  round(quantile_cont(pr_confidence, 0.5), 8) AS median, round(quantile_cont(pr_confidence, 0.75), 8) AS q3,
  max(pr_confidence) AS max, count(*) AS n FROM timed GROUP BY 1""")
def confidence_box(t):
    return rounded(tab.box_stats(seq.label_timing(t), "timing", "pr_confidence"), "q1", "median", "q3")


@on_turns("act_frequency_by_outcome", """
SELECT pr_label, da_label, count(*) AS n,
       count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY pr_label) AS percent
FROM turns WHERE pr_label IS NOT NULL AND da_label IS NOT NULL GROUP BY 1, 2""")
def act_frequency_by_outcome(t):
    return tab.label_freq_by(t, "pr_label", "da_label")


# --- words --------------------------------------------------------------------------------------

STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words()) + "]"
WORDS = f"""
w AS (SELECT {{c}} AS category, unnest(string_split_regex(
        regexp_replace(lower({{t}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]', '', 'g'), '\\s+')) AS word FROM {{s}}),
k AS (SELECT category, word, count(*) AS n FROM w
      WHERE length(word) > 2 AND NOT list_contains({STOPS}, word) GROUP BY 1, 2),
words AS (SELECT category, word, n, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS category_words
          FROM k QUALIFY sum(n) OVER (PARTITION BY category) >= 5)
"""


@on_table("word_frequency_by_language", "documents",
          f"WITH {WORDS.format(c='lang', t='text', s='documents')} SELECT * FROM words")
def word_frequency(d):
    return tab.word_freq(d.withColumnRenamed("lang", "category"), "text", "category")


@on_table("word_frequency_by_role", "conversations",
          f"WITH {WORDS.format(c='role', t='text', s='conversations')} SELECT * FROM words")
def word_frequency_by_role(d):
    return tab.word_freq(d.withColumnRenamed("role", "category"), "text", "category")


@on_turns("study_category_words", """
WITH c AS (SELECT 'EML' AS category, sentence FROM turns WHERE eml_label = 1 UNION ALL
           SELECT pr_label, sentence FROM turns WHERE lower(trim(pr_label)) IN ('compliance', 'resistance')),
w AS (SELECT category, unnest(string_split(sentence, ' ')) AS word FROM c),
k AS (SELECT category, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2)
SELECT *, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS category_words FROM k""")
def study_category_words(t):
    return tab.word_freq(tab.word_categories(t), "text", "category")


# --- sets ---------------------------------------------------------------------------------------

@on_turns("label_set_comparison", """
WITH a AS (SELECT DISTINCT da_label AS label FROM turns WHERE eml_label = 1 AND da_label IS NOT NULL),
b AS (SELECT DISTINCT da_label AS label FROM turns WHERE pr_label = 'Compliance' AND da_label IS NOT NULL)
SELECT coalesce(a.label, b.label) AS label,
       CASE WHEN b.label IS NULL THEN 'only_a' WHEN a.label IS NULL THEN 'only_b' ELSE 'common' END AS place
FROM a FULL JOIN b ON a.label = b.label""")
def label_set_comparison(t):
    acts = t.where("da_label is not null")
    return tab.label_sets(acts.where("eml_label = 1").select("da_label"),
                          acts.where("pr_label = 'Compliance'").select("da_label"))


@on_turns("appended_results", """
SELECT pr_label AS label, count(*) AS n FROM turns WHERE pr_label IS NOT NULL GROUP BY 1 UNION ALL
SELECT da_label, count(*) FROM turns WHERE da_label IS NOT NULL GROUP BY 1""")
def appended_results(t):
    return tab.append_rows(*[
        tab.value_dist(t, c).select(F.col(c).alias("label"), "n") for c in ("pr_label", "da_label")])


@on_turns("ranked_acts", """
SELECT da_label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, da_label) AS rank
FROM turns WHERE da_label IS NOT NULL GROUP BY 1""")
def ranked_acts(t):
    counts = t.where("da_label is not null").groupBy("da_label").agg(F.count(F.lit(1)).alias("n"))
    return tab.with_rank(counts, "n", ["da_label"])


@on_all("table_row_counts", """
SELECT 'events' AS name, count(*) AS n FROM events UNION ALL
SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents""")
def table_row_counts(spark, sf_dir):
    names = ["events", "conversations", "documents"]
    return tab.append_rows(*[
        stand_ins.table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(n).alias("name"), "n") for n in names])
