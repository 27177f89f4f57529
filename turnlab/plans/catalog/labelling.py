"""Queries of cleaning, parsing, mapping and combining labels."""

from pyspark.sql import functions as F

from turnlab.functions import clean
from turnlab.functions import labels as lab
from turnlab.functions import scores as sc
from turnlab.operators import mapping
from turnlab.plans.catalog.building import joined
from turnlab.plans.catalog.registry import on_table, on_turns, on_utterances
from turnlab.sources import readers
from turnlab.vocab import DA_CODES, DA_NAMES, DA_OF_TAG, OUTCOME_OF_CODE, OUTCOME_OF_LABEL, VALID_PR


def sql_map(pairs):
    keys, values = ([f"'{x}'" if isinstance(x, str) else str(x) for x in side] for side in (
        list(pairs.keys()), list(pairs.values())))
    return f"MAP([{', '.join(keys)}], [{', '.join(values)}])"


# Five of the donation labels stand for the five event types.
DONATION_OF_EVENT = {
    "purchase": "agree-donation", "signup": "disagree-donation", "view": "greeting", "error": "off-script",
}
# Eleven meeting tags stand for eleven of the codes.
TAG_OF_CODE = {
    "ap": "s", "ac": "cc", "dc": "co", "do": "cs", "il": "qy", "in": "qw", "pa": "aa", "pr": "ar",
    "sp": "ft", "sn": "fa", "o": "zz",
}


@on_utterances("number_coercion", """
SELECT idx, TRY_CAST(s AS DOUBLE) AS number, coalesce(CAST(TRY_CAST(s AS DOUBLE) AS INT), 0) AS flag,
       coalesce(TRY_CAST(regexp_replace(s, '[^0-9]', '', 'g') AS INT), 0) AS digits FROM (
  SELECT idx, CASE WHEN rater_3 IS NULL THEN sentence ELSE CAST(rater_3 AS VARCHAR) END AS s FROM utterances)""")
def number_coercion(u):
    s = F.when(F.col("rater_3").isNull(), F.col("sentence")).otherwise(F.col("rater_3").cast("string"))
    return u.select("idx", clean.to_number(s).alias("number"), clean.to_flag(s).alias("flag"),
                    clean.digits_flag(s).alias("digits"))


CLEANED = """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '^ +| +$', '', 'g')),
         '[^\\p{L}\\p{N}_\\s?!.]', '', 'g'), '\\s+', ' ', 'g'))) AS digest,
       md5(regexp_replace(text, '^ +| +$', '', 'g')) AS trimmed,
       md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS shown,
       length(regexp_replace(text, '^ +| +$', '', 'g')) >= 5 AS scored FROM documents"""


@on_table("cleaned_texts", "documents", CLEANED)
def cleaned_texts(d):
    return d.select(
        "doc_id", F.md5(clean.clean_text_keep_endmarks("text")).alias("digest"),
        F.md5(clean.clean_text("text")).alias("trimmed"), F.md5(clean.preview("text", 200)).alias("shown"),
        (clean.length_gate("text", F.lit(1), 5) == 1).alias("scored"))


@on_utterances("default_filled_rows", """
SELECT idx, coalesce(labels, '') AS labels, coalesce(neg, 0) AS neg, coalesce(trim(labels) <> '', FALSE) AS filled
FROM utterances""")
def default_filled_rows(u):
    from turnlab.sources.readers import fill_defaults
    filled = clean.non_blank("labels").alias("filled")
    return fill_defaults(u.select("idx", "labels", "neg", filled), ["labels"], ["neg"])


@on_turns("complete_label_rows", """
SELECT idx, pr_label, da_label FROM turns WHERE pr_label IS NOT NULL AND da_label IS NOT NULL""")
def complete_label_rows(t):
    from turnlab.sources.readers import drop_null
    return drop_null(t.select("idx", "pr_label", "da_label"), ["pr_label", "da_label"])


@on_turns("safe_label_comparison", """
SELECT idx, coalesce(lower(trim(pr_label)) = 'compliance', FALSE) AS complied FROM turns""")
def safe_label_comparison(t):
    return t.select("idx", clean.label_eq("pr_label", " Compliance".strip()).alias("complied"))


@on_utterances("parsed_label_lists", """
SELECT idx, CASE WHEN labels IS NULL OR labels = '[]' THEN '' ELSE regexp_replace(labels, '[\\[\\]'' ]', '', 'g') END AS labels
FROM utterances""")
def parsed_label_lists(u):
    return u.withColumn("labels", lab.parse_list("labels")).select("idx", *joined("labels"))


BINARY = ", ".join(
    f"CAST(coalesce(list_contains(string_split(da_label, ','), '{c}'), FALSE) AS INT) AS da_{c}" for c in DA_CODES)


@on_turns("act_binary_vector", f"SELECT idx, {BINARY} FROM turns")
def act_binary_vector(t):
    return t.select("idx", *lab.da_binary("da_label"))


@on_turns("act_binarizer", f"""
SELECT idx, {BINARY.replace(' AS da_', ' AS ')} FROM turns""")
def act_binarizer(t):
    return t.select("idx", *lab.binarize(lab.split_labels("da_label"), DA_CODES))


EVENT_LABEL = f"({sql_map(DONATION_OF_EVENT)})[speaker]"


def donation_labels(u):
    return u.withColumn("donation", lab.recode("speaker", DONATION_OF_EVENT))


@on_utterances("mapped_outcomes", f"""
SELECT idx, {EVENT_LABEL} AS donation,
       coalesce(({sql_map(OUTCOME_OF_LABEL)})[{EVENT_LABEL}], 'Neutral') AS outcome FROM utterances""")
def mapped_outcomes(u):
    return donation_labels(u).select("idx", "donation", lab.map_label("donation").alias("outcome"))


@on_utterances("mapped_acts", f"""
WITH g AS (SELECT idx, ({sql_map(TAG_OF_CODE)})[tag] AS meeting_tag FROM utterances),
m AS (SELECT *, coalesce(({sql_map(DA_OF_TAG)})[meeting_tag], 'o') AS code FROM g)
SELECT idx, meeting_tag, code, ({sql_map(DA_NAMES)})[code] AS full_name FROM m""")
def mapped_acts(u):
    tagged = u.withColumn("meeting_tag", lab.recode("tag", TAG_OF_CODE))
    coded = tagged.withColumn("code", lab.map_da("meeting_tag"))
    return coded.select("idx", "meeting_tag", "code", lab.da_full_name("code").alias("full_name"))


@on_utterances("mapping_coverage", f"""
WITH d AS (SELECT {EVENT_LABEL} AS donation FROM utterances)
SELECT donation AS label, count(*) AS n, donation IN ({', '.join(f"'{x}'" for x in OUTCOME_OF_LABEL)}) AS mapped
FROM d WHERE donation IS NOT NULL GROUP BY 1""")
def mapping_coverage(u):
    return mapping.mapping_coverage(donation_labels(u), "donation", OUTCOME_OF_LABEL)


@on_utterances("mapping_counts", f"""
SELECT {EVENT_LABEL} AS donation, coalesce(({sql_map(OUTCOME_OF_LABEL)})[{EVENT_LABEL}], 'Neutral') AS outcome,
       count(*) AS n FROM utterances WHERE {EVENT_LABEL} IS NOT NULL GROUP BY 1, 2""")
def mapping_counts(u):
    rows = donation_labels(u).withColumn("outcome", lab.map_label("donation"))
    return mapping.mapping_counts(rows, "donation", "outcome")


@on_utterances("mapping_documentation", f"""
WITH m AS (SELECT unnest(map_keys(x)) AS label, unnest(map_values(x)) AS outcome FROM (SELECT {sql_map(OUTCOME_OF_LABEL)} AS x)),
d AS (SELECT {EVENT_LABEL} AS label FROM utterances)
SELECT m.label, m.outcome, count(d.label) AS n FROM m LEFT JOIN d ON d.label = m.label GROUP BY 1, 2""")
def mapping_documentation(u):
    return mapping.mapping_table(donation_labels(u), "donation", OUTCOME_OF_LABEL)


@on_utterances("mapping_class_documentation", f"""
WITH m AS (SELECT unnest(map_keys(x)) AS label, unnest(map_values(x)) AS outcome, unnest(range(len(map_keys(x)))) AS place
           FROM (SELECT {sql_map(OUTCOME_OF_LABEL)} AS x)), d AS (SELECT {EVENT_LABEL} AS label FROM utterances)
SELECT outcome, string_agg(m.label, ',' ORDER BY place) AS labels, count(*) AS n,
       (SELECT count(*) FROM d JOIN m k USING (label) WHERE k.outcome = m.outcome) AS used FROM m GROUP BY outcome""")
def mapping_class_documentation(u):
    used = mapping.mapping_table(donation_labels(u), "donation", OUTCOME_OF_LABEL).groupBy("outcome").agg(
        F.sum("n").alias("used"))
    classes = mapping.mapping_classes(u.sparkSession, OUTCOME_OF_LABEL)
    return classes.join(used, "outcome").select("outcome", F.array_join("labels", ",").alias("labels"), "n", "used")


RESOLVED = """
l AS (SELECT dialogue_id, turn, list(outcome ORDER BY idx) AS outcomes FROM (
        SELECT *, CASE speaker WHEN 'purchase' THEN 'Compliance' WHEN 'signup' THEN 'Resistance' ELSE 'Neutral' END AS outcome
        FROM utterances) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN list_contains(outcomes, 'Compliance') AND list_contains(outcomes, 'Resistance') THEN 'Conflict'
                     WHEN list_contains(outcomes, 'Compliance') THEN 'Compliance'
                     WHEN list_contains(outcomes, 'Resistance') THEN 'Resistance' ELSE 'Neutral' END AS resolved FROM l)
"""


@on_utterances("resolved_turn_labels", f"""
WITH {RESOLVED} SELECT dialogue_id, turn, array_to_string(outcomes, ',') AS outcomes, resolved,
  CASE WHEN resolved = 'Conflict' THEN outcomes[1] ELSE resolved END AS persuasion_result FROM s""")
def resolved_turn_labels(u):
    # a turn has a bounded number of rows
    lists = donation_labels(u).groupBy("dialogue_id", "turn").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("idx", "donation"))), lambda r: r["donation"]).alias("raw"))
    mapped = lists.withColumn("outcomes", lab.map_labels("raw"))
    return mapped.select("dialogue_id", "turn", F.array_join("outcomes", ",").alias("outcomes"),
                         lab.resolve_label("outcomes").alias("resolved"),
                         lab.persuasion_result("outcomes").alias("persuasion_result"))


@on_turns("act_groups", """
SELECT idx, CASE WHEN list_has_any(string_split(da_label, ','), ['pa', 'sp']) THEN 'DA+'
                 WHEN list_has_any(string_split(da_label, ','), ['pr', 'sn', 'ic', 'dc']) THEN 'DA-' ELSE 'DAo' END AS da_group,
       coalesce(list_contains(string_split(da_label, ','), 'ap'), FALSE) AS has_ap FROM turns""")
def act_groups(t):
    return t.select("idx", lab.da_group("da_label").alias("da_group"),
                    lab.has_label("da_label", "ap").alias("has_ap"))


@on_utterances("recoded_votes", """
SELECT idx, CASE vote_3 WHEN 1 THEN 'Compliance' WHEN 0 THEN 'Neutral' WHEN -1 THEN 'Resistance' END AS outcome
FROM utterances""")
def recoded_votes(u):
    return u.select("idx", lab.recode("vote_3", OUTCOME_OF_CODE).alias("outcome"))


@on_turns("encoded_outcomes", """
SELECT idx, pr_label, CAST(dense_rank() OVER (ORDER BY pr_label) - 1 AS DOUBLE) AS code, pr_label AS decoded
FROM turns WHERE pr_label IS NOT NULL""")
def encoded_outcomes(t):
    return mapping.label_index(t.where("pr_label is not null"), "pr_label").select(
        "idx", "pr_label", "code", "decoded")


@on_turns("outcome_one_hot", """
SELECT idx, CAST(coalesce(pr_label = 'Compliance', FALSE) AS INT) AS "PR_Compliance",
       CAST(coalesce(pr_label = 'Resistance', FALSE) AS INT) AS "PR_Resistance" FROM turns""")
def outcome_one_hot(t):
    return t.select("idx", *lab.one_hot("pr_label", ["Neutral", *VALID_PR], "PR_", "Neutral"))


@on_utterances("rater_majority", """
WITH v AS (SELECT idx, unnest([vote_1, vote_2, vote_3]) AS x FROM utterances),
c AS (SELECT idx, x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1, 2),
m AS (SELECT idx, sum(n) AS votes, count(*) AS kinds FROM c GROUP BY 1),
w AS (SELECT idx, x FROM c QUALIFY row_number() OVER (PARTITION BY idx ORDER BY n DESC, x) = 1)
SELECT u.idx, CASE WHEN m.kinds = 3 THEN NULL ELSE w.x END AS majority,
       CASE WHEN rater_1 + rater_2 + coalesce(rater_3, 0) > 0 THEN 1 ELSE 0 END AS any_positive
FROM utterances u LEFT JOIN m USING (idx) LEFT JOIN w USING (idx)""")
def rater_majority(u):
    return u.select("idx", lab.majority(["vote_1", "vote_2", "vote_3"]).alias("majority"),
                    lab.any_positive(["rater_1", "rater_2", "rater_3"]).alias("any_positive"))


@on_utterances("rater_agreement", """
SELECT idx, CASE WHEN rater_1 IS NULL OR rater_3 IS NULL THEN NULL WHEN rater_1 = rater_3 THEN 1 ELSE 0 END AS same
FROM utterances""")
def rater_agreement(u):
    return u.select("idx", lab.agree("rater_1", "rater_3").alias("same"))


@on_utterances("legal_vote_rows", "SELECT idx, vote_3 FROM utterances WHERE vote_3 IN (1, 0, -1)")
def legal_vote_rows(u):
    return u.where(F.col("vote_3").isin(list(OUTCOME_OF_CODE))).select("idx", "vote_3")


@on_utterances("parsed_replies", """
SELECT idx, coalesce(CAST(nullif(regexp_extract(sentence, '([01])', 1), '') AS INT), 0) AS label FROM utterances""")
def parsed_replies(u):
    return u.select("idx", lab.parse_binary_reply("sentence").alias("label"))


@on_turns("packed_labels", """
SELECT idx, array_to_string(list_sort(list_distinct(string_split(da_label, ','))), ',') AS packed
FROM turns WHERE da_label IS NOT NULL""")
def packed_labels(t):
    return t.where("da_label is not null").select("idx", lab.pack_labels(lab.split_labels("da_label")).alias("packed"))


# --- score arrays -------------------------------------------------------------------------------

def score_array():
    """Three scores of a row, out of its confidence and its EML flag."""
    c = F.col("pr_confidence")
    return F.array(c * 2, F.lit(1.0) - c, F.col("eml_label") * 0.9)


SOFT = """
x AS (SELECT idx, pr_confidence * 2 AS a, 1.0::DOUBLE - pr_confidence AS b, eml_label * 0.9::DOUBLE AS c FROM turns),
m AS (SELECT *, greatest(a, b, c) AS top FROM x),
e AS (SELECT *, exp(a - top) AS ea, exp(b - top) AS eb, exp(c - top) AS ec FROM m),
s AS (SELECT *, ea / (ea + eb + ec) AS pa, eb / (ea + eb + ec) AS pb, ec / (ea + eb + ec) AS pc,
             1 / (1 + exp(-a)) AS ga, 1 / (1 + exp(-b)) AS gb, 1 / (1 + exp(-c)) AS gc FROM e)
"""
BEST = """CASE WHEN {0}a >= {0}b AND {0}a >= {0}c THEN 'Compliance'
               WHEN {0}b >= {0}c THEN 'Neutral' ELSE 'Resistance' END"""


@on_turns("softmax_labels", f"""
WITH {SOFT} SELECT idx, {BEST.format('p')} AS label, round(greatest(pa, pb, pc), 8) AS confidence,
  CASE WHEN pb > pa AND pb >= pc AND pb >= 0.5 THEN 1 ELSE 0 END AS gated,
  round(pa, 8) AS prob_compliance, round(pb, 8) AS prob_neutral, round(pc, 8) AS prob_resistance FROM s""")
def softmax_labels(t):
    names = ["Compliance", "Neutral", "Resistance"]
    rows = t.select("idx", sc.softmax(score_array()).alias("p"))
    return rows.select(
        "idx", sc.top_label("p", names).alias("label"), F.round(sc.confidence("p"), 8).alias("confidence"),
        sc.gated_label("p", 0.5).alias("gated"),
        *[F.round(c, 8).alias(f"prob_{n.lower()}")
          for c, n in zip(sc.explode_probs("p", names), names)])


@on_turns("threshold_labels", f"""
WITH {SOFT}, z AS (SELECT *, list_filter([CASE WHEN ga > 0.62 THEN 'Compliance' END, CASE WHEN gb > 0.62 THEN 'Neutral' END,
                                          CASE WHEN gc > 0.62 THEN 'Resistance' END], lambda v: v IS NOT NULL) AS above FROM s)
SELECT idx, CASE WHEN len(above) > 0 THEN array_to_string(above, ',') ELSE {BEST.format('g')} END AS labels FROM z""")
def threshold_labels(t):
    names = ["Compliance", "Neutral", "Resistance"]
    picked = sc.threshold_labels(sc.sigmoid(score_array()), names, 0.62)
    return t.select("idx", F.array_join(picked, ",").alias("labels"))


@on_table("text_column_sizes", "documents", """
SELECT 'text' AS detected, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents""")
def text_column_sizes(d):
    name = readers.detect_text_column(d)
    return d.agg(F.lit(name).alias("detected"), F.count(F.lit(1)).alias("rows"), F.sum(F.length(name)).alias("chars"))
