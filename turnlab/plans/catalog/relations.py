"""Queries on the relation of labels along a dialogue."""

from pyspark.sql import functions as F

from turnlab.operators import sequence as seq
from turnlab.operators.sequence import matching_rate
from turnlab.plans.catalog.registry import on_turns

VALID = "pr_label IN ('Compliance', 'Resistance')"

PREV = """
p AS (SELECT *, lag(eml_label) OVER w AS prev_eml_label, lag(da_label) OVER w AS prev_da_label
      FROM turns WINDOW w AS (PARTITION BY dialogue_id ORDER BY idx))
"""

PAIRS = f"""
v AS (SELECT *, lead(turn) OVER w AS turn_next, lead(role) OVER w AS role_next,
             lead(pr_label) OVER w AS pr_next
      FROM %s WHERE {VALID}
      WINDOW w AS (PARTITION BY dialogue_id ORDER BY turn, idx)),
pairs AS (SELECT dialogue_id, role, turn AS turn_prev, idx AS idx_prev, turn_next,
                 turn_next - turn AS turn_gap, pr_label AS pr_prev, pr_next,
                 pr_label || '→' || pr_next AS transition
          FROM v WHERE role_next = role AND turn_next - turn <= 3)
"""


@on_turns("prev_label_rows", f"""
WITH {PREV}
SELECT idx, prev_eml_label, prev_da_label FROM p
WHERE prev_eml_label IS NOT NULL AND prev_da_label IS NOT NULL""")
def prev_label_rows(t):
    return seq.prev_label(t, ["eml_label", "da_label"]).select("idx", "prev_eml_label", "prev_da_label")


@on_turns("first_event_turn", """
SELECT idx, min(CASE WHEN eml_label = 1 THEN turn END) OVER (PARTITION BY dialogue_id) AS first_event_turn
FROM turns""")
def first_event_turn(t):
    return seq.first_event_turn(t).select("idx", "first_event_turn")


TIMED = """
f AS (SELECT dialogue_id, min(turn) AS first_turn FROM turns WHERE eml_label = 1 GROUP BY 1),
timed AS (SELECT t.*, CASE WHEN first_turn IS NULL OR turn < first_turn THEN 'before_EML' ELSE 'after_EML' END AS timing
          FROM turns t LEFT JOIN f USING (dialogue_id)
          WHERE pr_label IS NOT NULL AND (first_turn IS NULL OR turn <> first_turn))
"""


@on_turns("label_timing", f"WITH {TIMED} SELECT idx, pr_label, timing FROM timed")
def label_timing(t):
    return seq.label_timing(t).select("idx", "pr_label", "timing")


@on_turns("event_group_of_dialogue", """
SELECT idx, CASE WHEN dialogue_id IN (SELECT dialogue_id FROM turns WHERE eml_label = 1)
                 THEN 'With_EML' ELSE 'Without_EML' END AS event_group FROM turns""")
def event_group(t):
    return seq.has_event(t).select("idx", "event_group")


@on_turns("qualified_dialogue_rows", f"""
SELECT idx, dialogue_id FROM turns WHERE dialogue_id IN (
  SELECT dialogue_id FROM turns GROUP BY 1
  HAVING count(*) FILTER ({VALID}) >= 25 AND count(*) FILTER (eml_label = 1) >= 18)""")
def qualified(t):
    return seq.qualify(t, min_pr=25, min_events=18).select("idx", "dialogue_id")


@on_turns("valid_outcome_rows", f"SELECT idx, pr_label FROM turns WHERE {VALID}")
def valid_rows(t):
    return seq.valid_pr(t).select("idx", "pr_label")


ALL_PAIRS = f"""
g AS (SELECT DISTINCT dialogue_id FROM turns WHERE eml_label = 1),
v AS (SELECT dialogue_id, turn AS turn_prev, pr_label AS pr_prev,
             lead(turn) OVER w AS turn_next, lead(pr_label) OVER w AS pr_next
      FROM turns WHERE {VALID} WINDOW w AS (PARTITION BY dialogue_id ORDER BY turn, idx)),
moves AS (SELECT v.*, pr_prev || '→' || pr_next AS transition,
             CASE WHEN g.dialogue_id IS NULL THEN 'Without_EML' ELSE 'With_EML' END AS event_group
          FROM v LEFT JOIN g USING (dialogue_id) WHERE pr_next IS NOT NULL)
"""


@on_turns("transitions", f"""
WITH {ALL_PAIRS} SELECT dialogue_id, turn_prev, turn_next, transition, event_group FROM moves""")
def transitions(t):
    return seq.transitions(t).select("dialogue_id", "turn_prev", "turn_next", "transition", "event_group")


CLOSE = PAIRS % "turns" + """,
close AS (SELECT p.*, CASE WHEN EXISTS (
              SELECT 1 FROM turns b WHERE b.dialogue_id = p.dialogue_id AND b.eml_label = 1
                AND b.turn > p.turn_prev AND b.turn < p.turn_next)
            THEN 'With_EML' ELSE 'Without_EML' END AS event_between
          FROM pairs p)
"""


@on_turns("gap_transitions", f"""
WITH {CLOSE}
SELECT dialogue_id, role, turn_prev, turn_next, turn_gap, transition, event_between FROM close""")
def gap_transitions(t):
    return seq.gap_transitions(t).select(
        "dialogue_id", "role", "turn_prev", "turn_next", "turn_gap", "transition", "event_between")


def context_sql(event_only):
    extra = "AND b.eml_label = 1" if event_only else ""
    return "d AS (SELECT * FROM turns WHERE da_label IS NOT NULL)," + PAIRS % "d" + f""",
last_between AS (
  SELECT p.dialogue_id, p.idx_prev, p.transition, b.da_label AS da_type,
         CASE WHEN max(b.eml_label) OVER (PARTITION BY p.idx_prev) = 1
              THEN 'With_EML' ELSE 'Without_EML' END AS event_between,
         row_number() OVER (PARTITION BY p.idx_prev ORDER BY b.turn DESC, b.idx DESC) AS r
  FROM pairs p
  JOIN d b ON b.dialogue_id = p.dialogue_id AND b.turn > p.turn_prev AND b.turn < p.turn_next {extra}),
context AS (SELECT * FROM last_between WHERE r = 1)
"""


CONTEXT_COLS = ["dialogue_id", "transition", "event_between", "da_type"]


@on_turns("transition_context_single", f"""
WITH {context_sql(False)}
SELECT dialogue_id, transition, event_between, da_type FROM context""")
def context_single(t):
    return seq.transitions_with_context(t).select(*CONTEXT_COLS)


@on_turns("transition_context_multi", f"""
WITH {context_sql(False)}
SELECT dialogue_id, transition, event_between, unnest(string_split(da_type, ',')) AS da_type FROM context""")
def context_multi(t):
    return seq.transitions_with_context(t, multi=True).select(*CONTEXT_COLS)


@on_turns("transition_context_last_event", f"""
WITH {context_sql(True)}
SELECT dialogue_id, transition, event_between, da_type FROM context""")
def context_event(t):
    return seq.transitions_with_context(t, event_only=True).select(*CONTEXT_COLS)


MATCHED = f"""
e AS (SELECT * FROM turns WHERE eml_label = 1),
r AS (SELECT * FROM turns WHERE {VALID}),
a AS (SELECT e.idx, r.pr_label AS eml_result, r.turn AS pr_turn_after,
             row_number() OVER (PARTITION BY e.idx ORDER BY r.turn, r.idx) AS n
      FROM e JOIN r ON r.dialogue_id = e.dialogue_id AND r.role <> e.role
                   AND r.turn > e.turn AND r.turn <= e.turn + 3),
b AS (SELECT e.idx, r.pr_label AS pr_status_before, r.turn AS pr_turn_before,
             row_number() OVER (PARTITION BY e.idx ORDER BY r.turn DESC, r.idx DESC) AS n
      FROM e JOIN r ON r.dialogue_id = e.dialogue_id AND r.role <> e.role
                   AND r.turn < e.turn AND r.turn >= e.turn - 3),
matched AS (SELECT e.dialogue_id, e.idx, e.turn AS eml_turn, e.role AS eml_role, e.da_label AS eml_da_type,
                   a.eml_result, a.pr_turn_after, b.pr_status_before, b.pr_turn_before
            FROM e JOIN a ON a.idx = e.idx AND a.n = 1 LEFT JOIN b ON b.idx = e.idx AND b.n = 1)
"""


@on_turns("nearest_labels", f"WITH {MATCHED} SELECT * FROM matched")
def nearest(t):
    return seq.nearest_labels(t)


@on_turns("matching_rate", f"""
WITH {MATCHED},
q AS (SELECT dialogue_id, count(*) FILTER (eml_label = 1) AS events FROM turns GROUP BY 1
      HAVING count(*) FILTER (eml_label = 1) > 0 AND count(*) FILTER ({VALID}) > 0)
SELECT CAST((SELECT sum(events) FROM q) AS BIGINT) AS total_eml, (SELECT count(*) FROM q) AS dialogues,
       (SELECT count(*) FROM matched) AS matched_eml,
       (SELECT count(*) FROM matched)::DOUBLE / (SELECT sum(events) FROM q)::DOUBLE AS matching_rate""")
def rate(t):
    return matching_rate(t)


@on_turns("rows_in_order", "SELECT idx, dialogue_id, turn FROM turns ORDER BY dialogue_id, turn, idx")
def in_order(t):
    return t.select("idx", "dialogue_id", "turn").orderBy("dialogue_id", "turn", "idx")


@on_turns("preview_rows", "SELECT idx, sentence FROM turns ORDER BY idx LIMIT 10")
def preview_rows(t):
    return t.select("idx", "sentence").orderBy(F.col("idx")).limit(10)
