"""The given tables seen as the study's tables, once as DataFrames and once as SQL.

``events`` stands in for labelled turns: one user is one dialogue, the event number is the file
position, a stretch of 200 positions is one turn (so a turn of a dialogue has a bounded number of
rows) and the labels come from the event's own fields. Both forms are projections of one scan.
"""

from pyspark.sql import functions as F

from turnlab.functions.labels import strings
from turnlab.sources.readers import read_turns, require_columns
from turnlab.vocab import DA_CODES

POSITIONS_PER_TURN = 200


# declared, so that no file is opened to infer them
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def _table(spark, sf_dir, name):
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return require_columns(read_turns(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name]), columns)


def _events(spark, sf_dir):
    """``events`` with the number in its properties, read once per row.

    A pattern takes a seventh of the time of a JSON parser on these one-field objects.
    """
    number = F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("long")
    return _table(spark, sf_dir, "events").withColumn("k", number)


def _code(position):
    return F.get(strings(DA_CODES), (position % 12).cast("int"))


def turns(spark, sf_dir):
    """TURNS out of ``events``."""
    e = _events(spark, sf_dir)
    k = F.col("k")
    first = F.when(F.col("value") >= 10, _code(k))
    second = F.when(F.col("value") >= 350, _code(F.floor("value")))
    outcome = (F.when(F.col("event_type") == "purchase", "Compliance")
               .when(F.col("event_type") == "signup", "Resistance")
               .when(F.col("event_type").isin("view", "error"), "Neutral"))
    return e.select(
        F.col("event_id").alias("idx"),
        F.col("user_id").alias("dialogue_id"),
        (F.col("event_id") % 2).alias("role"),
        F.floor(F.col("event_id") / POSITIONS_PER_TURN).alias("turn"),
        F.concat_ws(" ", "event_type", k).alias("sentence"),
        F.when(k < 28, 1).otherwise(0).alias("eml_label"),
        outcome.alias("pr_label"),
        (F.col("value") / 500).alias("pr_confidence"),
        F.when(first.isNotNull(), F.concat_ws(",", first, second)).alias("da_label"),
    )


def raw_utterances(spark, sf_dir):
    """Utterances with list-text labels, raters' codes and sentiment, out of ``events``."""
    e = _events(spark, sf_dir)
    k = F.col("k")
    whole = F.floor("value")
    listed = (F.when(F.col("event_type") == "error", "[]").when(F.col("event_type") != "click", F.concat(
        F.lit("['"), F.col("event_type"), F.lit("', '"), _code(k), F.lit("', '"), _code(k), F.lit("']"))))
    voted = (F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", -1)
             .when(F.col("event_type") != "error", 0))
    return e.select(
        F.col("event_id").alias("idx"), F.col("user_id").alias("dialogue_id"),
        (F.col("event_id") % 2).alias("role"),
        F.floor(F.col("event_id") / POSITIONS_PER_TURN).alias("turn"),
        F.col("event_type").alias("speaker"), F.concat_ws(" ", "event_type", k).alias("sentence"),
        listed.alias("labels"), _code(k).alias("tag"),
        F.when(F.col("value") >= 25, F.col("value") / 500).alias("neg"),
        (k % 2).cast("int").alias("rater_1"), F.when(k % 3 == 0, 1).otherwise(0).alias("rater_2"),
        F.when(F.col("value") >= 50, (whole % 2).cast("int")).alias("rater_3"),
        (k % 3 - 1).cast("int").alias("vote_1"), (whole % 3 - 1).cast("int").alias("vote_2"),
        voted.cast("int").alias("vote_3"))


# a language stands for an outcome and an act, toxicity for the EML flag, quality for a second act
OUTCOME_OF_LANG = {"en": "Compliance", "de": "Resistance", "fr": "Neutral", "es": "Neutral"}
ACT_OF_LANG = {"en": "ap", "de": "pa", "fr": "dc", "es": "sn"}


def labelled_texts(spark, sf_dir):
    """Turns whose labels must be learned from the text: documents with the labels of their language and toxicity."""
    d, l = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    pick = lambda names: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("lang"))
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("idx"), F.floor(F.col("doc_id") / 10).alias("dialogue_id"), F.col("text").alias("sentence"),
        F.col("toxic").alias("eml_label"), pick(OUTCOME_OF_LANG).alias("pr_label"),
        F.concat(pick(ACT_OF_LANG), F.when(F.col("quality") == 1, ",il").otherwise("")).alias("da_label"))


def table(spark, sf_dir, name):
    return _table(spark, sf_dir, name)


_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in DA_CODES) + "]"

TURNS_SQL = f"""
turns AS (
  SELECT event_id AS idx, user_id AS dialogue_id, event_id % 2 AS role,
         event_id // {POSITIONS_PER_TURN} AS turn,
         event_type || ' ' || k AS sentence,
         CASE WHEN k < 28 THEN 1 ELSE 0 END AS eml_label,
         CASE event_type WHEN 'purchase' THEN 'Compliance' WHEN 'signup' THEN 'Resistance'
              WHEN 'view' THEN 'Neutral' WHEN 'error' THEN 'Neutral' END AS pr_label,
         value / 500 AS pr_confidence,
         CASE WHEN value >= 10 THEN
           ({_CODE_LIST})[k % 12 + 1]
           || CASE WHEN value >= 350
                   THEN ',' || ({_CODE_LIST})[CAST(floor(value) AS BIGINT) % 12 + 1] ELSE '' END
         END AS da_label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)
"""

_cases = lambda names: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())

TEXTS_SQL = f"""
texts AS (
  SELECT doc_id AS idx, doc_id // 10 AS dialogue_id, text AS sentence, toxic AS eml_label,
         CASE lang {_cases(OUTCOME_OF_LANG)} END AS pr_label,
         CASE lang {_cases(ACT_OF_LANG)} END || CASE WHEN quality = 1 THEN ',il' ELSE '' END AS da_label
  FROM documents JOIN labels USING (doc_id)
)
"""

UTTERANCES_SQL = f"""
utterances AS (
  SELECT event_id AS idx, user_id AS dialogue_id, event_id % 2 AS role,
         event_id // {POSITIONS_PER_TURN} AS turn, event_type AS speaker,
         event_type || ' ' || k AS sentence,
         CASE event_type WHEN 'error' THEN '[]' WHEN 'click' THEN NULL
              ELSE '[''' || event_type || ''', ''' || tag || ''', ''' || tag || ''']' END AS labels,
         tag, CASE WHEN value >= 25 THEN value / 500 END AS neg,
         CAST(k % 2 AS INT) AS rater_1, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS rater_2,
         CASE WHEN value >= 50 THEN CAST(CAST(floor(value) AS BIGINT) % 2 AS INT) END AS rater_3,
         CAST(k % 3 - 1 AS INT) AS vote_1,
         CAST(CAST(floor(value) AS BIGINT) % 3 - 1 AS INT) AS vote_2,
         CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN -1 WHEN 'view' THEN 0
              WHEN 'click' THEN 0 END AS vote_3
  FROM (SELECT *, ({_CODE_LIST})[k % 12 + 1] AS tag
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
)
"""
