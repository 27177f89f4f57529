"""Relations between labels along a dialogue: lag, timing, transitions, nearest match.

Default columns are those of ``schemas.TURNS``. ``idx`` is the stored file position and breaks ties
between rows of the same turn; ``turn`` is shared by both roles.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.functions.labels import split_labels
from turnlab.operators.blocks import (
    BLOCK, CUT, HOME, ROWS_PER_BLOCK, TURNS_PER_BLOCK, per_dialogue, previous_row, with_block, with_halo,
)
from turnlab.operators.tables import one_row
from turnlab.vocab import VALID_PR, WITH_EVENT, WITHOUT_EVENT

DIALOGUE, TURN, IDX, ROLE = "dialogue_id", "turn", "idx", "role"
EML, PR, DA = "eml_label", "pr_label", "da_label"


def valid_pr(t, pr=PR):
    return t.where(F.col(pr).isin(VALID_PR))


def prev_label(t, columns=(EML,), block=ROWS_PER_BLOCK):
    """Labels of the previous row in file order, whoever spoke; rows without them are dropped."""
    prior = previous_row(t, list(columns), DIALOGUE, [IDX], IDX, block)
    return prior.drop("has_previous").na.drop(subset=["prev_" + c for c in columns])


def first_event_turn(t, block=ROWS_PER_BLOCK):
    """Add the first turn with EML in the dialogue, NULL when there is none."""
    first = F.when(F.col(EML) == 1, F.col(TURN))
    return per_dialogue(t, {"first_event_turn": ("min", first)}, DIALOGUE, TURN, block)


def label_timing(t, block=ROWS_PER_BLOCK):
    """Outcome rows before or after the dialogue's first EML turn.

    Rows in that very turn are left out; a dialogue without EML counts as before.
    """
    labelled = (F.col(PR).isNotNull()) & (F.col(PR) != "") & F.col(TURN).isNotNull()
    first = F.col("first_event_turn")
    timing = (F.when(first.isNull() | (F.col(TURN) < first), "before_EML")
              .when(F.col(TURN) > first, "after_EML"))
    return (first_event_turn(t, block).where(labelled)
            .withColumn("timing", timing).where(F.col("timing").isNotNull()))


def has_event(t, block=ROWS_PER_BLOCK):
    """Add With_EML / Without_EML of the whole dialogue."""
    seen = F.coalesce((F.col(EML) == 1).cast("int"), F.lit(0))
    marked = per_dialogue(t, {"_seen": ("max", seen)}, DIALOGUE, TURN, block)
    group = F.when(F.col("_seen") == 1, WITH_EVENT).otherwise(WITHOUT_EVENT)
    return marked.withColumn("event_group", group).drop("_seen")


def qualify(t, min_pr=0, min_events=0, block=ROWS_PER_BLOCK):
    """Rows of the dialogues with at least so many valid outcomes and so many EML rows."""
    counts = {
        "_pr": ("sum", F.col(PR).isin(VALID_PR).cast("long")),
        "_ev": ("sum", (F.col(EML) == 1).cast("long")),
    }
    marked = per_dialogue(t, counts, DIALOGUE, TURN, block)
    enough = ((F.coalesce("_pr", F.lit(0)) >= min_pr) & (F.coalesce("_ev", F.lit(0)) >= min_events))
    return marked.where(enough).drop("_pr", "_ev")


def _arrow(before, after):
    return F.concat(F.col(before), F.lit("→"), F.col(after))


def transitions(t, block=ROWS_PER_BLOCK):
    """Consecutive valid outcomes of a dialogue by turn, across roles and at any distance."""
    marked = has_event(with_block(t, DIALOGUE, TURN, block), block)
    rows = valid_pr(marked).select(DIALOGUE, TURN, IDX, PR, "event_group", BLOCK, CUT)
    pairs = previous_row(rows, [TURN, PR], DIALOGUE, [TURN, IDX], TURN, block)
    return pairs.where("has_previous").select(
        DIALOGUE, "event_group",
        F.col("prev_turn").alias("turn_prev"), F.col(TURN).alias("turn_next"),
        F.col("prev_" + PR).alias("pr_prev"), F.col(PR).alias("pr_next"),
        _arrow("prev_" + PR, PR).alias("transition"))


def _halo_windows():
    part = W.partitionBy(DIALOGUE, BLOCK)
    return (part.orderBy(TURN).rangeBetween(W.unboundedPreceding, 0),
            part.orderBy(TURN).rangeBetween(W.unboundedPreceding, -1),
            part.orderBy(TURN, IDX))


def _gap_pairs(rows, max_gap, same_role):
    """Pairs of consecutive valid outcomes whose first row is at home in the block.

    The role and gap conditions come after the pairing: a close pair of one role is not formed
    over another role's outcome in between.
    """
    _, _, in_order = _halo_windows()
    nxt = F.lead(F.struct(ROLE, TURN, PR, "_before")).over(in_order)
    pairs = (valid_pr(rows).withColumn("_next", nxt)
             .where(F.col(HOME) & F.col("_next").isNotNull())
             .where(F.col("_next")[TURN] - F.col(TURN) <= max_gap))
    return pairs.where(F.col("_next")[ROLE] == F.col(ROLE)) if same_role else pairs


def _pair_columns():
    nxt = F.col("_next")
    return [
        F.col(DIALOGUE), F.col(ROLE), F.col(TURN).alias("turn_prev"), nxt[TURN].alias("turn_next"),
        (nxt[TURN] - F.col(TURN)).alias("turn_gap"),
        F.col(PR).alias("pr_prev"), nxt[PR].alias("pr_next"),
        F.concat(F.col(PR), F.lit("→"), nxt[PR]).alias("transition"),
    ]


def gap_transitions(t, max_gap=3, same_role=True, block=TURNS_PER_BLOCK):
    """Close transitions of one speaker, split by EML strictly between the two turns."""
    kept = t.where(F.col(DIALOGUE).isNotNull() & F.col(ROLE).isNotNull())
    rows = with_halo(kept.select(DIALOGUE, ROLE, TURN, IDX, EML, PR), TURN, ahead=max_gap, size=block)
    upto, below, _ = _halo_windows()
    event = F.coalesce((F.col(EML) == 1).cast("long"), F.lit(0))
    counted = (rows.withColumn("_upto", F.sum(event).over(upto))
               .withColumn("_before", F.coalesce(F.sum(event).over(below), F.lit(0))))
    between = F.col("_next")["_before"] - F.col("_upto") > 0
    return _gap_pairs(counted, max_gap, same_role).select(
        *_pair_columns(), F.when(between, WITH_EVENT).otherwise(WITHOUT_EVENT).alias("event_between"))


def transitions_with_context(t, da=DA, multi=False, event_only=False, max_gap=3,
                             block=TURNS_PER_BLOCK):
    """Close transitions of one speaker with the act that came last strictly between the turns.

    Rows without an act are removed before pairing. ``event_only`` looks at EML rows only; ``multi``
    gives one row per act of a comma list. Pairs with nothing in between are left out.
    """
    kept = t.where(F.col(DIALOGUE).isNotNull() & F.col(ROLE).isNotNull() & F.col(da).isNotNull())
    rows = with_halo(kept.select(DIALOGUE, ROLE, TURN, IDX, EML, PR, F.col(da).alias("_da")),
                     TURN, ahead=max_gap, size=block)
    upto, below, _ = _halo_windows()
    is_event = F.col(EML) == 1
    event = F.coalesce(is_event.cast("long"), F.lit(0))
    place = F.struct(TURN, IDX)
    candidate = F.when(is_event, place) if event_only else place
    last = F.max_by(F.struct(F.col(TURN), F.col("_da")), candidate).over(below)
    counted = (rows.withColumn("_upto", F.sum(event).over(upto))
               .withColumn("_before", F.struct(
                   last.alias("last"),
                   F.coalesce(F.sum(event).over(below), F.lit(0)).alias("events"))))
    found = F.col("_next")["_before"]["last"]
    pairs = _gap_pairs(counted, max_gap, True).where(found[TURN] > F.col(TURN))
    between = F.col("_next")["_before"]["events"] - F.col("_upto") > 0
    acts = F.explode(split_labels(found["_da"])) if multi else F.trim(found["_da"])
    return pairs.select(
        *_pair_columns(), F.when(between, WITH_EVENT).otherwise(WITHOUT_EVENT).alias("event_between"),
        acts.alias("da_type"))


def nearest_labels(t, max_gap=3, block=TURNS_PER_BLOCK):
    """EML rows with the other role's nearest valid outcome after and before, 1..max_gap turns away.

    Only rows that have an outcome after them are kept. Within a turn the first row counts after
    the EML row and the last row before it. Per turn and role one row enters the frame, so that it
    stays small however many rows a turn has.
    """
    kept = t.where(F.col(DIALOGUE).isNotNull() & F.col(ROLE).isNotNull())
    rows = with_halo(kept.select(DIALOGUE, ROLE, TURN, IDX, EML, PR, DA), TURN,
                     back=max_gap, ahead=max_gap, size=block)
    # one exchange by (dialogue, block) serves the finer window here and the frames below
    rows = rows.repartition(DIALOGUE, BLOCK)
    turn_rows = W.partitionBy(DIALOGUE, BLOCK, TURN, ROLE)
    valid = F.col(PR).isin(VALID_PR)
    edges = (rows.withColumn("_first", F.min(F.when(valid, F.col(IDX))).over(turn_rows))
             .withColumn("_last", F.max(F.when(valid, F.col(IDX))).over(turn_rows)))
    entry = F.struct(TURN, IDX, ROLE, PR)
    frame = W.partitionBy(DIALOGUE, BLOCK).orderBy(TURN)
    after = F.collect_list(F.when(valid & (F.col(IDX) == F.col("_first")), entry)).over(
        frame.rangeBetween(1, max_gap))
    before = F.collect_list(F.when(valid & (F.col(IDX) == F.col("_last")), entry)).over(
        frame.rangeBetween(-max_gap, -1))
    others = lambda arr: F.filter(arr, lambda x: x[ROLE] != F.col(ROLE))
    matched = (edges.select("*", after.alias("_after"), before.alias("_prior"))
               .where(F.col(HOME) & (F.col(EML) == 1))
               .withColumn("_a", F.array_min(others(F.col("_after"))))
               .withColumn("_b", F.array_max(others(F.col("_prior")))))
    return matched.where(F.col("_a").isNotNull()).select(
        F.col(DIALOGUE), F.col(IDX), F.col(TURN).alias("eml_turn"), F.col(ROLE).alias("eml_role"),
        F.col(DA).alias("eml_da_type"),
        F.col("_a")[PR].alias("eml_result"), F.col("_a")[TURN].alias("pr_turn_after"),
        F.col("_b")[PR].alias("pr_status_before"), F.col("_b")[TURN].alias("pr_turn_before"))


def matching_rate(t, max_gap=3, block=TURNS_PER_BLOCK):
    """Share of EML rows, in dialogues with both EML and a valid outcome, that found an outcome."""
    dialogues = (t.groupBy(DIALOGUE).agg(
        F.count_if(F.col(EML) == 1).alias("events"),
        F.count_if(F.col(PR).isin(VALID_PR)).alias("outcomes"))
        .where("events > 0 and outcomes > 0"))
    total = dialogues.agg(F.sum("events").alias("total_eml"), F.count(F.lit(1)).alias("dialogues"))
    matched = nearest_labels(t, max_gap, block).agg(F.count(F.lit(1)).alias("matched_eml"))
    return one_row(total, matched).withColumn(
        "matching_rate", F.try_divide("matched_eml", "total_eml"))
