"""Ordered work along a dialogue without ever giving one task a whole dialogue.

A dialogue may hold a large part of all rows. A dialogue of at most ``ROWS_PER_BLOCK`` rows is one block, number 0;
a longer one is cut by position into blocks of about that many rows, and windows run inside
``(dialogue, block)``. What must cross the border of a block travels in one of three ways:

* ``with_halo``      - bounded look-back or look-ahead: the few rows near a border are copied;
* ``previous_row``   - unbounded look-back: the last row of every block is summarised and handed on;
* ``per_dialogue``   - whole-dialogue aggregates: combined from one summary row per block.

Only dialogues that are cut have anything to hand on. Results are the same for every block size.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS_PER_BLOCK = 1 << 13   # of the halo, whose blocks are stretches of turns
ROWS_PER_BLOCK = 1 << 20

BLOCK = "_block"
CUT = "_cut"
HOME = "_home"


def block_of(position, size):
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("long")


def with_block(t, dialogue, position, size=ROWS_PER_BLOCK):
    """Add the row's block and whether its dialogue is cut; a table that has both stays as it is.

    First position, last position and number of rows of a dialogue are combined before the shuffle; what is joined has
    a row for each dialogue of more than ``size`` rows, so at most rows / ``size`` rows.
    """
    if BLOCK in t.columns:
        return t
    at = F.col(position)
    spans = t.groupBy(dialogue).agg(F.count(at).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_end"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_end") - F.col("_first") + 1) * F.lit(float(size)) / F.col("_n")))
    long = spans.where(F.col("_n") > size).select(dialogue, "_first", width.alias("_width"))
    block = F.floor((at - F.col("_first")) / F.col("_width")).cast("long")
    return t.join(long, dialogue, "left").select(
        *t.columns, F.coalesce(block, F.lit(0)).alias(BLOCK), F.col("_width").isNotNull().alias(CUT))


def with_halo(t, turn, back=0, ahead=0, size=TURNS_PER_BLOCK):
    """Copy rows to every block of ``size`` turns whose rows may look at them.

    A row looks at most ``back`` turns behind and ``ahead`` turns before itself. ``_home`` tells the
    row from its copies.
    """
    first = block_of(F.col(turn) - ahead, size)
    last = block_of(F.col(turn) + back, size)
    return (t.where(F.col(turn).isNotNull())
            .withColumn(BLOCK, F.explode(F.sequence(first, last)))
            .withColumn(HOME, F.col(BLOCK) == block_of(turn, size)))


def last_rows(rows, values, dialogue, order):
    """(dialogue, block, _handed): what the last row of the block before says, for dialogues that are cut."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ends = rows.where(CUT).groupBy(dialogue, BLOCK).agg(
        *[F.max_by(v, rank).alias(f"_end_{v}") for v in values])
    return ends.select(
        F.col(dialogue),
        F.lead(BLOCK).over(W.partitionBy(dialogue).orderBy(BLOCK)).alias(BLOCK),
        F.struct(*[F.col(f"_end_{v}").alias(v) for v in values]).alias("_handed"),
    ).where(F.col(BLOCK).isNotNull())


def previous_row(t, values, dialogue, order, position, size=ROWS_PER_BLOCK, prefix="prev_"):
    """Add ``prefix + value`` of the previous row of the dialogue.

    ``order`` lists the sort columns (together unique in a dialogue); ``position`` is the first of
    them and places the row in a block. The extra ``has_previous`` column is false on the first row.
    """
    rows = with_block(t, dialogue, position, size)
    w = W.partitionBy(dialogue, BLOCK).orderBy(*order)
    here = rows.select("*", F.lag(F.struct(*values)).over(w).alias("_here"))
    handed = last_rows(rows, values, dialogue, order)
    prior = F.coalesce(F.col("_here"), F.col("_handed"))
    return (here.join(handed, [dialogue, BLOCK], "left")
            .select(*t.columns, prior.isNotNull().alias("has_previous"),
                    *[prior[v].alias(prefix + v) for v in values]))


_COMBINE = {"min": F.min, "max": F.max, "sum": F.sum}


def per_dialogue(t, aggregates, dialogue, position, size=ROWS_PER_BLOCK):
    """Add whole-dialogue aggregates to every row.

    ``aggregates`` maps a new column to ``(kind, expression)`` with kind min, max or sum. Each block
    is aggregated first (with map-side combine), the block results are combined per dialogue and
    joined back on (dialogue, block), so that no join or window key is larger than a block.
    """
    rows = with_block(t, dialogue, position, size)
    blocks = rows.groupBy(dialogue, BLOCK).agg(
        *[_COMBINE[kind](expr).alias(name) for name, (kind, expr) in aggregates.items()])
    whole = W.partitionBy(dialogue)
    totals = blocks.select(dialogue, BLOCK, *[
        _COMBINE[kind](name).over(whole).alias(name) for name, (kind, _) in aggregates.items()])
    return rows.join(totals, [dialogue, BLOCK], "left").select(*t.columns, *aggregates)
