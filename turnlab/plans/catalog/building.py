"""Queries that build turns and conversations and join label tables."""

from pyspark.sql import functions as F

from turnlab.functions import labels as lab
from turnlab.operators import build, matching
from turnlab.operators import tables as tab
from turnlab.operators.ordering import number_within
from turnlab.plans import stand_ins
from turnlab.plans.catalog.registry import on_all, on_table, on_turns, on_utterances
from turnlab.plans.stand_ins import TURNS_SQL, UTTERANCES_SQL
from turnlab.sources import readers, writers


def joined(*columns):
    """Arrays as text, for comparison."""
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in columns]


@on_utterances("merged_turns", """
WITH m AS (SELECT dialogue_id, role, turn, min(idx) AS idx, string_agg(sentence, ' ' ORDER BY idx) AS sentence,
  coalesce(string_agg(regexp_replace(labels, '[\\[\\]'' ]', '', 'g'), ',' ORDER BY idx)
           FILTER (labels IS NOT NULL AND labels <> '[]'), '') AS labels,
  sum(CAST(printf('%.3f', coalesce(neg, 0)) AS DOUBLE)) AS neg_sum, count(*) AS utterances
  FROM utterances GROUP BY 1, 2, 3)
SELECT idx, dialogue_id, role, turn, sentence, labels, round(neg_sum, 6) AS neg_sum, utterances FROM m""")
def merged_turns(u):
    m = build.merge_turns(u, label_lists=["labels"], numbers=["neg"])
    return m.select("idx", "dialogue_id", "role", "turn", "sentence", *joined("labels"),
                    F.round(F.aggregate("neg", F.lit(0.0), lambda a, x: a + x), 6).alias("neg_sum"),
                    F.size("neg").cast("long").alias("utterances"))


@on_utterances("merged_turns_numbered", """
SELECT idx, sentence, row_number() OVER (ORDER BY idx) - 1 AS row_index FROM (
  SELECT min(idx) AS idx, string_agg(sentence, ' ' ORDER BY idx) AS sentence
  FROM utterances GROUP BY dialogue_id, role, turn)""")
def merged_turns_numbered(u):
    return build.with_row_index(build.merge_turns(u)).select("idx", "sentence", "row_index")


RUNS = """
f AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY dialogue_id ORDER BY idx)
                     THEN 1 ELSE 0 END AS change FROM utterances),
i AS (SELECT *, sum(change) OVER (PARTITION BY dialogue_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM f),
runs AS (SELECT dialogue_id, island, min(idx) AS idx, min(speaker) AS speaker,
                string_agg(sentence, ' ' ORDER BY idx) AS sentence,
                max(CASE WHEN rater_1 + rater_2 + coalesce(rater_3, 0) > 0 THEN 1 ELSE 0 END) AS flag,
                string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(*) AS utterances
         FROM i GROUP BY 1, 2)
"""


def speaker_runs(u):
    rated = u.withColumn("flag", lab.any_positive(["rater_1", "rater_2", "rater_3"]))
    return build.merge_runs(rated, "dialogue_id", "speaker", "idx", "sentence", "flag", "tag")


@on_utterances("speaker_runs", f"""
WITH {RUNS} SELECT dialogue_id, idx, speaker, sentence, flag, tags, utterances FROM runs""")
def speaker_runs_query(u):
    return speaker_runs(u).select("dialogue_id", "idx", "speaker", "sentence", "flag",
                                  lab.pack_labels("tag").alias("tags"), "utterances")


@on_utterances("numbered_speaker_runs", f"""
WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, speaker ORDER BY idx) AS nth FROM runs)
SELECT dialogue_id, idx, speaker, flag,
       max(nth) OVER (PARTITION BY dialogue_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS turn FROM n""")
def numbered_speaker_runs(u):
    runs = build.number_turns(speaker_runs(u), "dialogue_id", "speaker", "idx")
    return runs.select("dialogue_id", "idx", "speaker", "flag", "turn")


@on_utterances("run_label_frequency", f"""
WITH {RUNS}, l AS (SELECT unnest(string_split(tags, ',')) AS label FROM runs)
SELECT label, count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS percent FROM l GROUP BY 1""")
def run_label_frequency(u):
    return tab.label_freq(speaker_runs(u).select(lab.pack_labels("tag").alias("tags")), "tags")


@on_utterances("pipe_turn_lines", f"""
WITH {RUNS} SELECT speaker || '|' || sentence || '|' || tags AS value FROM runs""")
def pipe_turn_lines(u):
    return writers.pipe_lines(speaker_runs(u), "speaker", "sentence", "tag")


@on_turns("act_sequences", """
SELECT dialogue_id, string_agg(coalesce(da_label, ''), ';' ORDER BY idx) AS da_sequence
FROM turns GROUP BY 1""")
def act_sequences(t):
    return build.da_sequence(t).select("dialogue_id", F.array_join("da_sequence", ";").alias("da_sequence"))


OUTCOMES = """
o AS (SELECT dialogue_id, count(*) AS utterance_count, count(DISTINCT pr_label) AS kinds,
             count(*) FILTER (pr_label IS NULL) AS missing, min(pr_label) AS only_label,
             count(*) FILTER (pr_label = 'Compliance') AS c, count(*) FILTER (pr_label = 'Resistance') AS r,
             coalesce(string_agg(DISTINCT pr_label, ',' ORDER BY pr_label), '') AS unique_labels
      FROM {t} GROUP BY 1),
outcomes AS (SELECT dialogue_id, utterance_count, unique_labels,
  CASE WHEN kinds = 1 AND missing = 0 THEN nullif(only_label, 'Neutral')
       WHEN c > 0 AND r > 0 THEN 'Conflict' WHEN c > 0 THEN 'Compliance' WHEN r > 0 THEN 'Resistance' END AS outcome
  FROM o)
"""

# Conversations short enough to end one way: five turns of a dialogue.
SHORT_SQL = "short AS (SELECT * REPLACE (dialogue_id * 100000 + turn // 5 AS dialogue_id) FROM turns)"


def short_conversations(t):
    return t.withColumn("dialogue_id", F.col("dialogue_id") * 100000 + F.floor(F.col("turn") / 5))


@on_turns("conversation_outcomes", f"""
WITH {SHORT_SQL}, {OUTCOMES.format(t='short')} SELECT dialogue_id, outcome, utterance_count, unique_labels FROM outcomes""")
def conversation_outcomes(t):
    return build.conversation_outcome(short_conversations(t)).select(
        "dialogue_id", "outcome", "utterance_count", *joined("unique_labels"))


@on_turns("mean_length_by_outcome", f"""
WITH {SHORT_SQL}, {OUTCOMES.format(t='short')}
SELECT outcome, avg(utterance_count) AS mean FROM outcomes WHERE outcome IS NOT NULL GROUP BY 1""")
def mean_length_by_outcome(t):
    return tab.mean_by(build.conversation_outcome(short_conversations(t)), "outcome", "utterance_count")


SPOKEN = "s AS (SELECT *, regexp_replace(text, '^ +| +$', '', 'g') AS spoken FROM conversations)"


def spoken(c):
    return readers.rename(c, {"conv_id": "dialogue_id", "turn": "idx", "role": "role", "text": "sentence"})


CONTEXT = "(SELECT conv_id, string_agg(spoken, chr(10) ORDER BY turn) AS context FROM s WHERE spoken <> '' GROUP BY 1)"


@on_table("dialogue_context", "conversations", f"""
WITH {SPOKEN} SELECT conv_id AS dialogue_id, md5(context) AS digest, length(context) AS n_chars FROM {CONTEXT}""")
def dialogue_context(c):
    return build.dialogue_context(spoken(c)).select(
        "dialogue_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


ASK = "Answer 0 or 1 for each utterance, separated by commas."


def fake_reply(places):
    """What stands in for a language model's answers: 1 for every utterance at an even position."""
    return F.array_join(F.transform(places, lambda p: ((p + 1) % 2).cast("string")), ", ")


@on_table("context_prompts", "conversations", f"""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' (' || role || '): ' || text AS line
           FROM conversations)
SELECT conv_id AS dialogue_id, md5(string_agg(line, chr(10) ORDER BY turn) || chr(10) || '{ASK}') AS digest,
       count(*) AS utterances FROM p GROUP BY 1""")
def context_prompts(c):
    return build.conversation_prompts(spoken(c), ASK).select(
        "dialogue_id", F.md5("prompt").alias("digest"), F.size("places").cast("long").alias("utterances"))


@on_table("context_replies", "conversations", """
SELECT conv_id AS dialogue_id, turn AS idx, CAST((turn + 1) % 2 AS VARCHAR) AS answer FROM conversations""")
def context_replies(c):
    prompts = build.conversation_prompts(spoken(c), ASK)
    return build.replies_per_row(prompts.withColumn("reply", fake_reply(F.col("places"))))


PART_CHARS = 400


def part_sql(lines, extra=0):
    """Parts of the lines of ``lines`` (conv_id, nth, line): pieces of half a part, placed by the characters before them."""
    half = (PART_CHARS - extra) // 2
    return f"""
z AS (SELECT *, greatest(1, ceil(length(line) / {half - 1}.0))::BIGINT AS pieces FROM {lines}),
b AS (SELECT *, coalesce(sum(length(line) + pieces) OVER (PARTITION BY conv_id ORDER BY nth
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM z),
e AS (SELECT *, unnest(range(pieces)) AS piece FROM b),
parts AS (SELECT conv_id, (before + piece * {half}) // {half} AS part,
                 string_agg(substr(line, (piece * {half - 1} + 1)::BIGINT, {half - 1}), chr(10) ORDER BY nth, piece) AS body,
                 count(*) FILTER (piece = 0) AS begun FROM e GROUP BY 1, 2)"""


ASKED = """l AS (SELECT conv_id, turn AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' (' || role || '): ' || text AS line
      FROM conversations)"""


@on_table("prompt_parts", "conversations", f"""
WITH {ASKED}, {part_sql('l', len(ASK) + 1)}
SELECT conv_id AS dialogue_id, part, md5(body || chr(10) || '{ASK}') AS digest, begun FROM parts""")
def prompt_parts(c):
    return build.prompt_parts(spoken(c), ASK, most=PART_CHARS).select(
        "dialogue_id", "part", F.md5("prompt").alias("digest"), F.size("places").cast("long").alias("begun"))


@on_table("part_replies", "conversations", """
SELECT conv_id AS dialogue_id, turn AS idx, CAST((turn + 1) % 2 AS VARCHAR) AS answer FROM conversations""")
def part_replies(c):
    prompts = build.prompt_parts(spoken(c), ASK, most=PART_CHARS)
    return build.replies_per_row(prompts.withColumn("reply", fake_reply(F.col("places"))))


@on_table("context_parts", "conversations", f"""
WITH {SPOKEN}, l AS (SELECT conv_id, turn AS nth, spoken AS line FROM s WHERE spoken <> ''), {part_sql('l')}
SELECT conv_id AS dialogue_id, part, md5(body) AS digest, length(body) AS n_chars FROM parts""")
def context_parts(c):
    return build.context_parts(spoken(c), most=PART_CHARS).select(
        "dialogue_id", "part", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


@on_turns("act_sequence_rows", """
SELECT dialogue_id, idx, row_number() OVER (PARTITION BY dialogue_id ORDER BY idx) - 1 AS position,
       coalesce(da_label, '') AS value FROM turns""")
def act_sequence_rows(t):
    return build.long_form(t, F.coalesce(F.col("da_label"), F.lit("")))


@on_turns("complete_turns", """
SELECT idx, dialogue_id, turn FROM turns WHERE (dialogue_id, turn) IN (
  SELECT (dialogue_id, turn) FROM turns GROUP BY dialogue_id, turn HAVING count(DISTINCT role) = 2)""")
def complete_turns(t):
    return build.complete_turns(t).select("idx", "dialogue_id", "turn")


@on_turns("sampled_turns", """
WITH c AS (SELECT dialogue_id, turn FROM turns GROUP BY 1, 2 HAVING count(DISTINCT role) = 2),
d AS (SELECT * FROM c ORDER BY md5(concat_ws(':', dialogue_id, turn, 42)), dialogue_id, turn LIMIT 100)
SELECT idx, dialogue_id, turn, role, sentence, row_number() OVER (ORDER BY dialogue_id, turn, role, idx) - 1 AS row_index
FROM turns JOIN d USING (dialogue_id, turn)""")
def sampled_turns(t):
    drawn = build.sample_turns(t, 100).select("idx", "dialogue_id", "turn", "role", "sentence")
    return number_within(drawn, "dialogue_id", ["turn", "role", "idx"]).orderBy("row_index")


@on_turns("corpus_profile", """
SELECT count(*) AS rows, count(DISTINCT dialogue_id) AS dialogues, count(DISTINCT (dialogue_id, turn)) AS turns,
       count(*) FILTER (role = 0) AS rows_role_0, count(*) FILTER (role = 1) AS rows_role_1 FROM turns""")
def corpus_profile(t):
    return build.corpus_profile(t)


@on_turns("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS present FROM turns"
    for c in ("eml_label", "pr_label", "da_label")))
def null_profile(t):
    return readers.null_profile(t, ["eml_label", "pr_label", "da_label"])


# --- label joins --------------------------------------------------------------------------------

JOINED_SQL = f"""
WITH {TURNS_SQL.strip()}, {UTTERANCES_SQL.strip()},
k1 AS (SELECT dialogue_id, role, turn, arg_min(tag, idx) AS tag FROM utterances WHERE idx % 3 = 0 GROUP BY ALL),
k2 AS (SELECT dialogue_id, role, turn, min(idx) AS i FROM utterances WHERE vote_3 IS NOT NULL GROUP BY ALL)
SELECT t.idx, t.dialogue_id, t.role, t.turn, k1.tag, u.vote_3 FROM turns t LEFT JOIN k1 USING (dialogue_id, role, turn)
LEFT JOIN k2 USING (dialogue_id, role, turn) LEFT JOIN utterances u ON u.idx = k2.i"""


@on_all("joined_label_tables", JOINED_SQL)
def joined_label_tables(spark, sf_dir):
    u, keys = stand_ins.raw_utterances(spark, sf_dir), list(matching.KEYS)
    tags = u.where(F.col("idx") % 3 == 0).select(*keys, "idx", "tag")
    votes = u.where(F.col("vote_3").isNotNull()).select(*keys, "idx", "vote_3")
    t = stand_ins.turns(spark, sf_dir).select("idx", *keys)
    return matching.join_labels(t, tags, votes, order="idx").select("idx", *keys, "tag", "vote_3")


@on_turns("repeated_turn_keys", """
SELECT dialogue_id, role, turn, count(*) AS n FROM turns GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def repeated_turn_keys(t):
    return matching.duplicate_keys(t)


CASCADE_SQL = f"""
WITH {TURNS_SQL.strip()},
lft AS (SELECT idx, sentence, dialogue_id, CAST(role AS VARCHAR) || '-speaker' AS role, turn FROM turns),
rgt AS (SELECT idx, CASE WHEN pr_confidence > 0.2 THEN sentence || '!' ELSE sentence END AS sentence, dialogue_id,
               CASE WHEN pr_confidence > 0.4 THEN CAST(role AS VARCHAR) || '-' ELSE CAST(role AS VARCHAR) || '-speaker' END AS role,
               turn, CASE WHEN da_label IS NOT NULL THEN eml_label END AS eml_label FROM turns),
k1 AS (SELECT sentence, eml_label, row_number() OVER (PARTITION BY sentence ORDER BY idx) AS n FROM rgt),
k2 AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, role, turn ORDER BY idx) AS n FROM rgt),
k3 AS (SELECT *, left(role, 2) AS r2, row_number() OVER (PARTITION BY dialogue_id, left(role, 2), turn ORDER BY idx) AS n FROM rgt)
SELECT l.idx, coalesce(k1.eml_label, k2.eml_label, k3.eml_label) AS eml_label
FROM lft l LEFT JOIN k1 ON k1.sentence = l.sentence AND k1.n = 1
LEFT JOIN k2 ON k2.dialogue_id = l.dialogue_id AND k2.role = l.role AND k2.turn = l.turn AND k2.n = 1
LEFT JOIN k3 ON k3.dialogue_id = l.dialogue_id AND k3.r2 = left(l.role, 2) AND k3.turn = l.turn AND k3.n = 1"""


@on_all("cascade_matched_labels", CASCADE_SQL)
def cascade_matched_labels(spark, sf_dir):
    t = stand_ins.turns(spark, sf_dir)
    sure, role = F.col("pr_confidence"), F.col("role").cast("string")
    left = t.select("idx", "sentence", "dialogue_id", F.concat(role, F.lit("-speaker")).alias("role"), "turn")
    right = t.select(
        "idx", F.when(sure > 0.2, F.concat("sentence", F.lit("!"))).otherwise(F.col("sentence")).alias("sentence"),
        "dialogue_id", F.when(sure > 0.4, F.concat(role, F.lit("-"))).otherwise(
            F.concat(role, F.lit("-speaker"))).alias("role"),
        "turn", F.when(F.col("da_label").isNotNull(), F.col("eml_label")).alias("eml_label"))
    short_role = ("role2", F.substring("role", 1, 2))
    levels = [["sentence"], ["dialogue_id", "role", "turn"], ["dialogue_id", short_role, "turn"]]
    return matching.cascade_match(left, right, levels, "eml_label").select("idx", "eml_label")


@on_turns("findings_report", """
SELECT 'outcomes' AS section, pr_label AS item, 'n' AS metric, count(*)::DOUBLE AS value FROM turns
WHERE pr_label IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'outcomes', pr_label, 'percent', count(*) * 1e2 / sum(count(*)) OVER () FROM turns WHERE pr_label IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'dialogues', '', 'dialogues', count(DISTINCT dialogue_id)::DOUBLE FROM turns UNION ALL
SELECT 'acts', da_label, 'n', n::DOUBLE FROM (SELECT da_label, count(*) AS n FROM turns WHERE da_label IS NOT NULL GROUP BY 1
                                              ORDER BY n DESC, da_label LIMIT 10)""")
def findings_report(t):
    return writers.findings(
        outcomes=(tab.value_dist(t, "pr_label"), ["pr_label"], ["n", "percent"]),
        dialogues=(tab.dialogue_summary(t), [], ["dialogues"]),
        acts=(tab.top_values(t, "da_label", 10), ["da_label"], ["n"]))
