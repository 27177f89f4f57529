"""Sequence operators against plain loops, with blocks small enough to be crossed all the time."""

import random

import pytest
from pyspark.sql import functions as F

from turnlab.operators import sequence as seq
from turnlab.operators import blocks

VALID = ("Compliance", "Resistance")
COLUMNS = "idx long, dialogue_id long, role long, turn long, eml_label int, pr_label string, da_label string"


def make_turns(seed, n_dialogues=6, hot=0):
    """Dialogues interleaved in file order; dialogue 0 may hold most rows, some have no EML."""
    rng = random.Random(seed)
    plan = [(d, t, r) for d in range(n_dialogues)
            for t in range(hot if hot and d == 0 else rng.randint(1, 30)) for r in (0, 1)
            if rng.random() < 0.8]
    by_turn = sorted(plan, key=lambda x: (x[1], rng.random()))
    out = []
    for i, (d, t, r) in enumerate(by_turn):
        acts = [rng.choice("ap pa pr sn o".split()) for _ in range(rng.randint(1, 2))]
        out.append((i * 3, d, r, t, 0 if d == 1 else int(rng.random() < 0.3),
                    rng.choice(["Compliance", "Resistance", "Neutral", None]),
                    None if rng.random() < 0.15 else ",".join(acts)))
    return out


CASES = [(1, 0), (2, 0), (3, 150)]


@pytest.fixture(scope="module", params=CASES, ids=lambda c: f"seed{c[0]}hot{c[1]}")
def case(request, spark):
    data = make_turns(*[request.param[0]], hot=request.param[1])
    df = spark.createDataFrame(data, COLUMNS).repartition(5).persist()
    yield data, df
    df.unpersist()


def by_dialogue(data):
    out = {}
    for r in data:
        out.setdefault(r[1], []).append(r)
    return out


BLOCKS = [1, 4, 1 << 16]


@pytest.mark.parametrize("block", BLOCKS)
def test_previous_labels(case, rows, block):
    data, df = case
    want = []
    for ds in by_dialogue(data).values():
        ds = sorted(ds)
        want += [(b[0], a[4], a[6]) for a, b in zip(ds, ds[1:]) if a[6] is not None]
    got = rows(seq.prev_label(df, ["eml_label", "da_label"], block), "idx", "prev_eml_label", "prev_da_label")
    assert got == sorted(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_timing(case, rows, block):
    data, df = case
    want = []
    for ds in by_dialogue(data).values():
        first = min([r[3] for r in ds if r[4] == 1], default=float("inf"))
        want += [(r[0], "before_EML" if r[3] < first else "after_EML") for r in ds if r[5] and r[3] != first]
    assert rows(seq.label_timing(df, block), "idx", "timing") == sorted(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_all_transitions(case, rows, block):
    data, df = case
    want = []
    for d, ds in by_dialogue(data).items():
        group = "With_EML" if any(r[4] == 1 for r in ds) else "Without_EML"
        valid = sorted([r for r in ds if r[5] in VALID], key=lambda r: (r[3], r[0]))
        want += [(d, a[3], b[3], f"{a[5]}→{b[5]}", group) for a, b in zip(valid, valid[1:])]
    got = rows(seq.transitions(df, block), "dialogue_id", "turn_prev", "turn_next", "transition", "event_group")
    assert got == sorted(want)


def close_pairs(ds, same_role=True):
    valid = sorted([r for r in ds if r[5] in VALID], key=lambda r: (r[3], r[0]))
    return [(a, b) for a, b in zip(valid, valid[1:])
            if (a[2] == b[2] or not same_role) and b[3] - a[3] <= 3]


@pytest.mark.parametrize("block", BLOCKS)
def test_close_transitions(case, rows, block):
    data, df = case
    want = []
    for d, ds in by_dialogue(data).items():
        for a, b in close_pairs(ds):
            hit = any(r[4] == 1 and a[3] < r[3] < b[3] for r in ds)
            want.append((d, a[2], a[3], b[3], f"{a[5]}→{b[5]}", "With_EML" if hit else "Without_EML"))
    got = rows(seq.gap_transitions(df, block=block), "dialogue_id", "role", "turn_prev", "turn_next",
               "transition", "event_between")
    assert got == sorted(want)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("multi,event_only", [(False, False), (True, False), (False, True)])
def test_transition_context(case, rows, block, multi, event_only):
    data, df = case
    want = []
    for d, ds in by_dialogue([r for r in data if r[6] is not None]).items():
        for a, b in close_pairs(ds):
            between = sorted([r for r in ds if a[3] < r[3] < b[3]], key=lambda r: (r[3], r[0]))
            hit = any(r[4] == 1 for r in between)
            chosen = [r for r in between if r[4] == 1] if event_only else between
            if chosen:
                acts = chosen[-1][6].split(",") if multi else [chosen[-1][6]]
                want += [(d, a[3], f"{a[5]}→{b[5]}", "With_EML" if hit else "Without_EML", x) for x in acts]
    got = rows(seq.transitions_with_context(df, multi=multi, event_only=event_only, block=block),
               "dialogue_id", "turn_prev", "transition", "event_between", "da_type")
    assert got == sorted(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_nearest(case, rows, block):
    data, df = case
    want = []
    for ds in by_dialogue(data).values():
        for e in (r for r in ds if r[4] == 1):
            other = [r for r in ds if r[5] in VALID and r[2] != e[2]]
            after = sorted([r for r in other if 1 <= r[3] - e[3] <= 3], key=lambda r: (r[3], r[0]))
            before = sorted([r for r in other if 1 <= e[3] - r[3] <= 3], key=lambda r: (r[3], r[0]))
            if after:
                b = before[-1] if before else (None,) * 7
                want.append((e[0], after[0][5], after[0][3], b[5], b[3]))
    got = rows(seq.nearest_labels(df, block=block), "idx", "eml_result", "pr_turn_after",
               "pr_status_before", "pr_turn_before")
    assert got == sorted(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_qualified_dialogues(case, rows, block):
    data, df = case
    want = [(r[0],) for ds in by_dialogue(data).values()
            if sum(x[5] in VALID for x in ds) >= 4 and sum(x[4] == 1 for x in ds) >= 3 for r in ds]
    assert rows(seq.qualify(df, 4, 3, block), "idx") == sorted(want)


def test_many_rows_in_one_turn(spark, rows):
    data = [(i, 1, i % 2, 5 if i < 40 else 6, int(i % 4 == 0), VALID[i % 2], "ap") for i in range(80)]
    df = spark.createDataFrame(data, COLUMNS)
    got = rows(seq.nearest_labels(df, block=1), "idx", "eml_result", "pr_turn_after", "pr_turn_before")
    # EML rows have role 0, the other role's first outcome of the next turn is row 41
    assert got == [(i, "Resistance", 6, None) for i in range(0, 40, 4)]


def test_gap_of_three_counts_and_four_does_not(spark, rows):
    data = [(0, 1, 0, 0, 0, "Compliance", "ap"), (1, 1, 0, 3, 0, "Resistance", "ap"),
            (2, 1, 0, 7, 0, "Compliance", "ap")]
    df = spark.createDataFrame(data, COLUMNS)
    assert rows(seq.gap_transitions(df), "turn_prev", "turn_next") == [(0, 3)]


def test_row_in_the_turn_of_an_end_is_not_between(spark, rows):
    data = [(0, 1, 0, 1, 0, "Compliance", "ap"), (1, 1, 1, 1, 1, None, "pa"),
            (2, 1, 0, 2, 0, "Compliance", "ap"), (3, 1, 1, 2, 1, None, "pa")]
    df = spark.createDataFrame(data, COLUMNS)
    assert rows(seq.gap_transitions(df), "event_between") == [("Without_EML",)]
    assert rows(seq.transitions_with_context(df)) == []


def test_only_long_dialogues_are_cut(spark):
    """A hundred interleaved dialogues hand nothing on; a long one is cut into blocks of bounded size."""
    df = spark.range(5000).select(F.col("id").alias("idx"), (F.col("id") % 100).alias("dialogue_id"), F.lit(1).alias("v"))
    plain = blocks.with_block(df, "dialogue_id", "idx", 50)
    assert plain.where(blocks.CUT).count() == 0 and plain.where(f"{blocks.BLOCK} != 0").count() == 0
    assert blocks.last_rows(plain, ["v"], "dialogue_id", ["idx"]).count() == 0
    hot = df.withColumn("dialogue_id", F.when(F.col("idx") % 3 == 0, F.lit(-1)).otherwise(F.col("dialogue_id")))
    cut = blocks.with_block(hot, "dialogue_id", "idx", 50)
    sizes = cut.groupBy("dialogue_id", blocks.BLOCK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 51
    assert {r[0] for r in cut.where(blocks.CUT).select("dialogue_id").distinct().collect()} == {-1}
    handed = blocks.last_rows(cut, ["v"], "dialogue_id", ["idx"]).count()
    assert handed == sizes.where("dialogue_id = -1").count() - 1


def test_no_task_gets_a_whole_dialogue(spark):
    """Nine of ten rows in one dialogue: the window partitions stay at block size."""
    df = spark.range(20000).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("dialogue_id"),
        (F.col("id") % 2).alias("role"), F.floor(F.col("id") / 2).alias("turn"),
        (F.col("id") % 3 == 0).cast("int").alias("eml_label"), F.lit("Compliance").alias("pr_label"),
        F.lit("ap").alias("da_label"))
    rows = blocks.with_halo(df, "turn", back=3, ahead=3, size=500)
    largest = rows.groupBy("dialogue_id", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * (500 + 6)
    assert rows.where(blocks.HOME).count() == 20000
    plan = seq.prev_label(df)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(dialogue_id" in plan and blocks.BLOCK in plan
