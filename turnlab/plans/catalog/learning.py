"""Queries of splits, features, models, rules and batch scoring.

Models are fitted on the training part of a split and judged on its test part, with the study's numbers of trees (150
of a boosted model, 100 of a forest).
"""

from pyspark.sql import functions as F

from turnlab.functions import labels as lab
from turnlab.functions import scores as sc
from turnlab.functions.counts import rows_n
from turnlab.learning import features as feat
from turnlab.learning import models, scoring, splits
from turnlab.operators import build
from turnlab.plans.catalog.building import OUTCOMES, SHORT_SQL, short_conversations, spoken
from turnlab.plans.catalog.registry import on_table, on_texts, on_turns
from turnlab.plans.catalog.tabulation import rounded
from turnlab.session import shared_folder
from turnlab.vocab import DA_CODES, VALID_PR

TEXT_ONLY = ("text_features",)  # the stand-in's other labels come from the same source as the one to be learned


@on_turns("stratified_split_sizes", """
WITH c AS (SELECT pr_label, count(*) AS n FROM turns WHERE pr_label IS NOT NULL GROUP BY 1)
SELECT pr_label, 'test' AS split, CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) AS n FROM c UNION ALL
SELECT pr_label, 'train', n - CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) FROM c""")
def stratified_split_sizes(t):
    return splits.stratified_split(t, "pr_label", "idx").groupBy("pr_label", "split").agg(rows_n().alias("n"))


@on_turns("ordered_split", """
SELECT idx, CASE WHEN row_number() OVER (ORDER BY idx) - 1 < floor(count(*) OVER () * 0.8e0) THEN 'train' ELSE 'test' END AS split
FROM turns""")
def ordered_split(t):
    return splits.ordered_split(t).select("idx", "split")


@on_turns("random_split_sizes", """
SELECT CASE WHEN substr(md5(concat_ws(':', idx, 42)), 1, 8) < 'b3333333' THEN 'train' ELSE 'test' END AS split, count(*) AS n
FROM turns GROUP BY 1""")
def random_split_sizes(t):
    return splits.random_split(t.select("idx"), "idx").groupBy("split").agg(rows_n().alias("n"))


@on_turns("class_weights", """
WITH c AS (SELECT pr_label, count(*) AS n FROM turns WHERE pr_label IS NOT NULL GROUP BY 1)
SELECT pr_label, n, sum(n) OVER ()::DOUBLE / (count(*) OVER () * n) AS weight FROM c""")
def class_weights(t):
    return splits.class_weights(t, "pr_label")


# Five codes stand for the acts that the pattern flags look for; every element of an act list is an act.
FLAG_ACTS = {"ap": "greeting", "pa": "request", "dc": "inform", "sn": "closing", "il": "thanks"}
ACTS = f"""
parts AS (SELECT dialogue_id, idx, unnest(string_split(da_label, ',')) AS c, unnest(range(len(string_split(da_label, ',')))) AS nth
          FROM short WHERE da_label IS NOT NULL),
acts AS (SELECT dialogue_id, idx * 100 + nth AS at_, CASE c {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FLAG_ACTS.items())} ELSE c END AS d
         FROM parts)
"""
ACT_NAMES = [FLAG_ACTS.get(c, c) for c in DA_CODES]
FEATURE_SQL = ", ".join(
    [f"count(*) FILTER (d = '{c}') AS da_{c}_count" for c in ACT_NAMES]
    + [f"count(*) FILTER (d = '{c}')::DOUBLE / count(*) AS da_{c}_ratio" for c in ACT_NAMES])


def acts_of(t):
    """Every act of short conversations, recoded."""
    return feat.each_act(short_conversations(t)).replace(FLAG_ACTS, subset=["act"])


@on_turns("sequence_features", f"""
WITH {SHORT_SQL}, {ACTS}
SELECT dialogue_id, count(*) AS sequence_length, arg_min(d, at_) AS first_da, arg_max(d, at_) AS last_da,
       count(DISTINCT d)::DOUBLE / count(*) AS da_diversity, {FEATURE_SQL},
       CAST(bool_or(d = 'request') AND bool_or(d = 'inform') AS INT) AS has_request_inform,
       CAST(bool_or(d = 'greeting') AND bool_or(d = 'closing') AS INT) AS has_greeting_closing,
       CAST(arg_min(d, at_) = 'greeting' AS INT) AS starts_with_greeting, CAST(arg_max(d, at_) = 'thanks' AS INT) AS ends_with_thanks
FROM acts GROUP BY 1""")
def sequence_features(t):
    return feat.sequence_features(acts_of(t), ACT_NAMES, da="act", order="at")


@on_turns("common_acts", f"""
WITH {SHORT_SQL}, {ACTS} SELECT d AS act FROM acts GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 15""")
def common_acts(t):
    acts = feat.common_acts(acts_of(t), "act")
    return t.sparkSession.createDataFrame([(a,) for a in acts], "act string")


STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "on", "for"]


@on_table("tfidf_weights", "conversations", f"""
WITH r AS (SELECT conv_id * 100 + turn AS idx, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                  lambda w: NOT list_contains({STOP_WORDS!r}, w)) AS w FROM conversations),
t AS (SELECT idx, unnest(w) AS term FROM r UNION ALL
      SELECT idx, w[i] || ' ' || w[i + 1] FROM (SELECT idx, w, unnest(range(1, len(w))) AS i FROM r)),
c AS (SELECT idx, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT idx, term, tf * ln((SELECT count(*) + 1 FROM r)::DOUBLE / (df + 1)) AS x FROM c JOIN f USING (term))
SELECT idx, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY idx)), 9) AS weight FROM x""".replace("\\\\", "\\"))
def tfidf_weights(c):
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), F.col("text").alias("sentence"))
    return feat.tfidf_weights(rows, "idx", stop_words=STOP_WORDS).withColumn("weight", F.round("weight", 9))


@on_turns("prepared_rows", f"""
WITH m AS (SELECT pr_label AS p FROM turns WHERE pr_label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT idx, sentence, eml_label, coalesce(pr_label, p) AS pr_label,
       {", ".join(f"CAST(list_contains(string_split(coalesce(da_label, ''), ','), '{c}') AS INT) AS da_{c}" for c in DA_CODES)}
FROM turns, m""")
def prepared_rows(t):
    return feat.prepare_rows(t, categories=["pr_label"]).select("idx", "sentence", "eml_label", "pr_label", *models.DA_COLUMNS)


FIRST = """
f AS (SELECT dialogue_id, arg_min(d, at_) AS first_da FROM acts GROUP BY 1),
z AS (SELECT outcome, first_da, count(*) AS n FROM f JOIN outcomes USING (dialogue_id) WHERE outcome IS NOT NULL GROUP BY 1, 2)
"""


@on_turns("first_act_by_outcome", f"""
WITH {SHORT_SQL}, {ACTS}, {OUTCOMES.format(t='short')}, {FIRST}
SELECT outcome, first_da, n, n * 1e2 / sum(n) OVER (PARTITION BY outcome) AS percent FROM z""")
def first_act_by_outcome(t):
    from turnlab.operators.tables import label_freq_by
    first = acts_of(t).groupBy("dialogue_id").agg(F.min_by("act", "at").alias("first_da"))
    return label_freq_by(first.join(build.conversation_outcome(short_conversations(t)), "dialogue_id"), "outcome", "first_da")


@on_turns("acts_by_conversation_outcome", f"""
WITH {SHORT_SQL}, {ACTS}, {OUTCOMES.format(t='short')},
z AS (SELECT outcome, d AS act, count(*) AS n FROM acts JOIN outcomes USING (dialogue_id) WHERE outcome IS NOT NULL GROUP BY 1, 2)
SELECT outcome, act, n, n * 1e2 / sum(n) OVER (PARTITION BY outcome) AS percent FROM z""")
def acts_by_conversation_outcome(t):
    from turnlab.operators.tables import label_freq_by
    outcomes = build.conversation_outcome(short_conversations(t)).select("dialogue_id", "outcome")
    return label_freq_by(acts_of(t).join(outcomes, "dialogue_id"), "outcome", "act")


TRANSACTIONS = f"""
{SHORT_SQL}, {ACTS}, {OUTCOMES.format(t='short')},
tx AS (SELECT DISTINCT dialogue_id, d, outcome FROM acts JOIN outcomes USING (dialogue_id)
       WHERE outcome IN ('Compliance', 'Resistance'))
"""


def transactions(t):
    return models.act_transactions(acts_of(t), build.conversation_outcome(short_conversations(t)), "act")


@on_turns("act_transactions", f"""
WITH {TRANSACTIONS} SELECT dialogue_id, string_agg(d, ',' ORDER BY d) || ',' || min(outcome) AS items FROM tx GROUP BY dialogue_id""")
def act_transactions(t):
    return transactions(t).select("dialogue_id", F.array_join("items", ",").alias("items"))


RULES = f"""
RECURSIVE {TRANSACTIONS}, n AS (SELECT count(DISTINCT dialogue_id)::DOUBLE AS n FROM tx),
base AS (SELECT outcome, count(DISTINCT dialogue_id) AS k FROM tx GROUP BY 1),
sets AS (SELECT dialogue_id, outcome, d AS antecedent, d AS last FROM tx UNION ALL
         SELECT s.dialogue_id, s.outcome, s.antecedent || ',' || b.d, b.d
         FROM sets s JOIN tx b ON s.dialogue_id = b.dialogue_id AND s.last < b.d),
c AS (SELECT antecedent, count(*) AS k FROM sets GROUP BY 1),
r AS (SELECT antecedent, outcome, count(*) AS k FROM sets GROUP BY 1, 2),
rules AS (SELECT r.antecedent, r.outcome, round(r.k / n, 8) AS support, round(r.k::DOUBLE / c.k, 8) AS confidence,
                 round(r.k::DOUBLE / c.k / (base.k / n), 8) AS lift
          FROM r JOIN c USING (antecedent) JOIN base USING (outcome), n
          WHERE r.k / n >= 0.1 AND r.k::DOUBLE / c.k >= 0.4)
"""


@on_turns("outcome_rules", f"WITH {RULES} SELECT * FROM rules")
def outcome_rules(t):
    rules = models.outcome_rules(transactions(t), min_support=0.1, min_confidence=0.4)
    return rounded(rules, "support", "confidence", "lift")


@on_turns("top_outcome_rules",
          f"WITH {RULES} SELECT * FROM rules ORDER BY lift DESC, antecedent, outcome LIMIT 12")
def top_outcome_rules(t):
    return outcome_rules(t).orderBy(F.desc("lift"), "antecedent", "outcome").limit(12)


def quality_sql(label, rows="texts"):
    """What a test part must hold: its exact class sizes; that a model beats the commonest class is the claim tested."""
    return f"""
SELECT {label} AS gold, CAST(floor(count(*) * 0.2e0 + 0.5e0) AS BIGINT) AS n, true AS beats_majority
FROM {rows} WHERE {label} IS NOT NULL GROUP BY 1 HAVING floor(count(*) * 0.2e0 + 0.5e0) > 0"""


def parts(t, label):
    both = splits.stratified_split(t, label, "idx")
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


@on_texts("outcome_model_quality", quality_sql("pr_label"))
def outcome_model_quality(t):
    train, test = parts(t, "pr_label")
    model = models.fit_pr_model(train, inputs=TEXT_ONLY)
    scored = model.transform(feat.prepare_rows(test)).withColumn(
        "guess", F.element_at(F.array(*[F.lit(x) for x in model.outputs]), F.col("prediction").cast("int") + 1))
    return models.held_out_quality(scored.withColumn("gold", F.col("pr_label")), "gold", "guess")


@on_texts("eml_model_quality", quality_sql("eml_label"))
def eml_model_quality(t):
    train, test = parts(t, "eml_label")
    model = models.fit_eml_model(train, inputs=TEXT_ONLY)
    scored = model.transform(models.eml_rows(test))
    return models.held_out_quality(scored.withColumn("guess", F.col("prediction").cast("int")), "eml_label", "guess")


@on_texts("eml_model_importance", """
SELECT 1 AS rank, true AS names_known, true AS ranked FROM texts LIMIT 1""")
def eml_model_importance(t):
    found = eml_importance_table(t)
    return found.agg(F.min("rank").alias("rank"), F.every(F.col("feature").rlike("^(text_features|pr_onehot|da_)")).alias("names_known"),
                     (F.max_by("importance", -F.col("rank")) == F.max("importance")).alias("ranked"))


@on_texts("eml_importance_table", None)
def eml_importance_table(t):
    """The 20 inputs whose values matter most to the EML model on rows kept from its fit, of those that matter."""
    train, test = parts(t, "eml_label")
    model = models.fit_eml_model(train)
    return models.permuted_importance(model, models.eml_rows(test), "label", top=20).where("importance > 0")


@on_texts("act_models_quality", """
WITH c AS (SELECT string_split(da_label, ',')[1] AS f, count(*) AS k FROM texts WHERE da_label IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT unnest(string_split(da_label, ',')) AS act FROM texts WHERE da_label IS NOT NULL)
SELECT act, (SELECT CAST(sum(floor(k * 0.2e0 + 0.5e0)) AS BIGINT) FROM c) AS n, true AS beats_majority FROM a""")
def act_models_quality(t):
    train, test = parts(t.withColumn("_first", F.substring_index("da_label", ",", 1)), "_first")
    model = models.fit_da_model(train.drop("_first"), inputs=TEXT_ONLY)
    scored = model.transform(feat.prepare_rows(test, categories=["pr_label"]))
    return models.act_quality(scored, model.outputs).select("act", "n", "beats_majority")


@on_texts("act_model_report", None)
def act_model_report(t):
    """Rows, positives, accuracy and whether it beats the commonest answer, of each act on the rows kept from the fit; all inputs."""
    train, test = parts(t.withColumn("_first", F.substring_index("da_label", ",", 1)), "_first")
    model = models.fit_da_model(train.drop("_first"))
    return models.act_quality(model.transform(feat.prepare_rows(test, categories=["pr_label"])), model.outputs)


@on_texts("outcome_predictions", None)
def outcome_predictions(t):
    """Every row kept from the fit of the outcome model: what it is, what it is taken for, and how surely."""
    train, test = parts(t, "pr_label")
    model = models.fit_pr_model(train, inputs=TEXT_ONLY)
    scored = model.transform(feat.prepare_rows(test))
    guess = F.element_at(F.array(*[F.lit(x) for x in model.outputs]), F.col("prediction").cast("int") + 1)
    return scored.select("idx", F.col("pr_label").alias("gold"), guess.alias("guess"), (F.col("pr_label") == guess).alias("is_correct"),
                         F.round(F.array_max("probabilities"), 8).alias("confidence"))


@on_turns("outcome_forest_quality", f"""
WITH {SHORT_SQL}, {ACTS}, {OUTCOMES.format(t='short')},
x AS (SELECT DISTINCT dialogue_id, outcome FROM acts JOIN outcomes USING (dialogue_id) WHERE outcome IN ('Compliance', 'Resistance'))
SELECT outcome AS gold, CAST(floor(count(*) * 0.3e0 + 0.5e0) AS BIGINT) AS n FROM x GROUP BY 1""")
def outcome_forest_quality(t):
    outcomes = build.conversation_outcome(short_conversations(t)).where(F.col("outcome").isin(VALID_PR))
    table = feat.sequence_features(acts_of(t), ACT_NAMES, da="act", order="at").join(
        outcomes.select("dialogue_id", "outcome"), "dialogue_id")
    path = shared_folder(t.sparkSession, "conversation-features")  # the split, the fit and the scoring read it
    table.write.parquet(path)
    table = t.sparkSession.read.schema(table.schema).parquet(path)
    both = splits.stratified_split(table, "outcome", "dialogue_id", test_share=0.3)
    model = models.fit_outcome_forest(both.where("split = 'train'").drop("split"))
    scored = model.transform(both.where("split = 'test'").withColumn("weight", F.lit(1.0)))
    return scored.groupBy(F.col("outcome").alias("gold")).agg(F.count("prediction").alias("n"))


# --- scoring ------------------------------------------------------------------------------------

CLASS_WORDS = [["the", "and", "of"], ["de", "la", "le"], ["der", "und", "die"]]
COUNTS = ", ".join(
    f"len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: list_contains({words!r}, w)))::DOUBLE AS s{i}"
    for i, words in enumerate(CLASS_WORDS))


SCORED = f"""
WITH s AS (SELECT conv_id, turn, {COUNTS} FROM conversations),
e AS (SELECT *, exp(s0) + exp(s1) + exp(s2) AS total FROM s)
SELECT conv_id, turn, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'Compliance' WHEN s1 >= s2 THEN 'Neutral' ELSE 'Resistance' END AS pr_label,
       round(exp(greatest(s0, s1, s2)) / total, 8) AS pr_confidence FROM e"""


def labelled_by(scorer, c):
    scored = scorer(c.select("conv_id", "turn", "text"), "text", scoring.lexicon_scorer(CLASS_WORDS), "logits")
    probs = scored.select("conv_id", "turn", sc.softmax("logits").alias("p"))
    return probs.select("conv_id", "turn", sc.top_label("p", ["Compliance", "Neutral", "Resistance"]).alias("pr_label"),
                        F.round(sc.confidence("p"), 8).alias("pr_confidence"))


@on_table("scored_utterances", "conversations", SCORED)
def scored_utterances(c):
    return labelled_by(scoring.score, c)


@on_table("scored_distinct_texts", "conversations", SCORED)
def scored_distinct_texts(c):
    return labelled_by(scoring.score_distinct, c)


@on_table("prompted_labels", "conversations", """
SELECT conv_id AS dialogue_id, turn AS idx,
       CASE WHEN len(list_filter(string_split_regex('Is this manipulative? ' || text, '\\s+'), lambda w: w <> '')) > 30
            THEN 1 ELSE 0 END AS eml_label FROM conversations""")
def prompted_labels(c):
    prompts = build.build_prompt(spoken(c), "Is this manipulative? {sentence}").select("dialogue_id", "idx", "prompt")

    def load():
        # stands in for a language model: answers 1 to prompts of more than 30 words
        return lambda texts: ["Answer: 1" if len(p.split()) > 30 else "Answer: 0" for p in texts]

    replies = scoring.reply(prompts, "prompt", load)
    return replies.select("dialogue_id", "idx", lab.parse_binary_reply("reply").alias("eml_label"))
