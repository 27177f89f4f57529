import random

import pytest
from pyspark.sql import functions as F

from turnlab.operators import build, matching
from turnlab.operators import tables as tab
from turnlab.operators.ordering import add_range, exact_quantiles, number_within, row_index


def test_merge_turns_keeps_order_and_repeats(spark):
    data = [(3, "d", 0, 1, "three", "['b']", None), (1, "d", 0, 1, "one", "['a', 'b']", 0.12349),
            (2, "d", 1, 1, "two", "[]", 1.0)]
    u = spark.createDataFrame(data, "idx long, dialogue_id string, role int, turn int, sentence string, l string, neg double")
    got = {r["role"]: r for r in build.merge_turns(u, label_lists=["l"], numbers=["neg"]).collect()}
    assert got[0]["sentence"] == "one three" and got[0]["l"] == ["a", "b", "b"] and got[0]["neg"] == [0.123, 0.0]
    assert got[1]["l"] == [] and got[0]["idx"] == 1


def loop_runs(data):
    """Runs and turn numbers of one file, conversation by conversation."""
    out = []
    for conv in sorted({r[1] for r in data}):
        seen, last = {}, object()
        for i, _, who, text, flag in sorted(r for r in data if r[1] == conv):
            if who != last:
                seen[who] = seen.get(who, 0) + 1
                out.append([conv, i, who, [], 0, max(seen.values()) - 1])
                last = who
            out[-1][3].append(text)
            out[-1][4] = max(out[-1][4], flag)
    return sorted((c, i, w, " ".join(t), f, n) for c, i, w, t, f, n in out)


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_runs_and_turn_numbers(spark, rows, block):
    rng = random.Random(5)
    data = [(i, 0 if rng.random() < 0.7 else rng.randint(1, 3), rng.choice("ABC"), f"t{i}", int(rng.random() < 0.2))
            for i in range(150)]
    u = spark.createDataFrame(data, "idx long, conv long, who string, text string, flag int").repartition(6)
    runs = build.merge_runs(u, "conv", "who", "idx", "text", "flag", block=block)
    got = rows(build.number_turns(runs, "conv", "who", "idx", block=block),
               "conv", "idx", "who", "text", "flag", "turn")
    assert got == loop_runs(data)


@pytest.mark.parametrize("labels,want", [
    (["Neutral"], None), (["Compliance", "Neutral"], "Compliance"), (["Resistance"], "Resistance"),
    (["Compliance", "Resistance"], "Conflict"), ([None, None], None), (["Neutral", None], None)])
def test_conversation_outcome(spark, labels, want):
    t = spark.createDataFrame([("d", x) for x in labels], "dialogue_id string, pr_label string")
    row = build.conversation_outcome(t).first()
    assert row["outcome"] == want and row["utterance_count"] == len(labels)


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_sequence_and_context(spark, block):
    data = [(i, 1, c, f" s{i} " if i != 2 else "  ") for i, c in enumerate(["ap", None, "pa", "o"])]
    t = spark.createDataFrame(data, "idx long, dialogue_id long, da_label string, sentence string")
    for shift in (0, (1 << 20) - 2):
        moved = t.withColumn("idx", F.col("idx") + shift)
        assert [r["da_sequence"] for r in build.da_sequence(moved, block=block).collect()] == [["ap", "", "pa", "o"]]
        assert [r["context"] for r in build.dialogue_context(moved, block=block).collect()] == ["s0\ns1\ns3"]
        prompts = build.conversation_prompts(moved, "Which?", speaker="da_label", block=block)
        assert [tuple(r) for r in prompts.collect()] == [
            (1, "1 (ap):  s0 \n2 ():  s1 \n3 (pa):   \n4 (o):  s3 \nWhich?", [i + shift for i in range(4)])]
        rows = build.replies_per_row(prompts.withColumn("reply", F.lit("1, 0,1"))).orderBy("idx").collect()
        assert [(r["idx"] - shift, r["answer"]) for r in rows] == [(0, "1"), (1, "0"), (2, "1"), (3, None)]
    with pytest.raises(Exception, match="prompt too long"):
        build.conversation_prompts(t, "Which?", speaker="da_label", most=10).collect()
    prompt = build.build_prompt(t, "Say {sentence} as {da_label}.").orderBy("idx").collect()[1]["prompt"]
    assert prompt == "Say  s1  as ."


def test_complete_and_sampled_turns(spark, rows):
    data = [(i, i // 4, (i // 2) % 2, i % 2) for i in range(40)] + [(90, 77, 0, 0), (91, 78, 0, 1), (92, 78, 0, 1)]
    t = spark.createDataFrame(data, "idx long, dialogue_id long, turn long, role long")
    assert build.complete_turns(t).count() == 40
    one, two = (rows(build.sample_turns(t.repartition(n), 5)) for n in (1, 7))
    assert one == two and len(one) == 10
    assert len(rows(build.sample_turns(t, 500))) == 40


def test_row_index_and_quantiles(spark, rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 10 ** 12), rng.choice("xy"), 0.5 if rng.random() < 0.4 else rng.random()) for _ in range(700)]
    df = spark.createDataFrame(data, "id long, g string, v double").repartition(7)
    got = rows(row_index(df, "id", ranges=16), "id", "row_index")
    assert got == [(x, i) for i, x in enumerate(sorted(r[0] for r in data))]
    q = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "v", [0, .1, .5, 1], ["g"], ranges=16).collect()}
    for g in "xy":
        xs = sorted(r[2] for r in data if r[1] == g)
        for p in (0, .1, .5, 1):
            at = p * (len(xs) - 1)
            lo = int(at)
            want = xs[lo] + (at - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])
            assert q[g, p] == pytest.approx(want)


def test_ranges_grow_with_the_session(spark):
    df = spark.range(3000).select((F.col("id") * 37 % 3000).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            sizes = [r["count"] for r in add_range(df, "v").groupBy("_range").count().collect()]
            assert n - 1 <= len(sizes) <= n and max(sizes) < 2 * 3000 / n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_within_groups(spark):
    data = [(g, m, x) for x, (g, m) in enumerate([(3, 1), (1, 2), (1, 1), (2, 9), (3, 0), (1, 2)])]
    df = spark.createDataFrame(data, "g long, m long, x long")
    got = {r["x"]: r["row_index"] for r in number_within(df, "g", ["m", "x"]).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(data))}


def test_cascade_match(spark):
    left = spark.createDataFrame([
        (0, "hi", 1, "er", 1), (1, "new", 1, "er", 1), (2, "odd", 2, "ee-x", 5), (3, "none", 9, "er", 9), (4, None, 1, "er", 1)],
        "idx long, sentence string, dialogue_id long, role string, turn long")
    right = spark.createDataFrame([
        (0, "hi", 7, "er", 7, 1), (1, "hi", 7, "er", 8, 0), (2, "x", 1, "er", 1, None), (3, "y", 1, "er", 1, 1),
        (4, "z", 1, "er-b", 1, 0), (5, "w", 2, "ee-y", 5, 1)],
        "idx long, sentence string, dialogue_id long, role string, turn long, label int")
    short = ("r2", F.substring("role", 1, 2))
    got = matching.cascade_match(left, right, [["sentence"], ["dialogue_id", "role", "turn"],
                                               ["dialogue_id", short, "turn"]], "label")
    # rows 1 and 4: the first match by key has a NULL label, and so has the first match by short key
    assert [r["label"] for r in got.orderBy("idx").collect()] == [1, None, 1, None, None]
    assert matching.duplicate_keys(right).count() == 1


def test_hot_sentence_does_not_multiply(spark):
    left = spark.range(3000).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 > 0, "yes").otherwise(
        F.concat(F.lit("s"), "id")).alias("sentence"))
    right = left.withColumn("label", (F.col("idx") % 2).cast("int"))
    got = matching.cascade_match(left, right, [["sentence"]], "label")
    assert got.count() == 3000 and got.where("sentence = 'yes'").agg(F.min("label"), F.max("label")).first() == (1, 1)


def test_frequent_values_and_fallback(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 5 + [("c",)] * 2 + [(None,)], "x string")
    assert tab.where_frequent(df, "x", 5).count() == 11
    assert tab.where_frequent(df, "x", 6).count() == 13  # one value left: all values are used


def test_crosstab_adds_up(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("r"), (F.col("id") % 3).cast("string").alias("c"))
    cells = tab.crosstab(df.where("not (r = '1' and c = '2')"), "r", "c").collect()
    assert len(cells) == 21 and sum(c["n"] for c in cells) == 1000 - 48
    assert sum(c["percent"] for c in cells) == pytest.approx(100)
    assert [c["n"] for c in cells if c["r"] == "1" and c["c"] == "2"] == [0]


def test_empty_group_keeps_its_rows(spark):
    x = spark.createDataFrame([("With_EML", "Compliance", "Compliance", "Compliance→Compliance", 1)],
                              "g string, pr_prev string, pr_next string, transition string, dialogue_id long")
    table = {(r["g"], r["transition"]): (r["n"], r["percent"]) for r in tab.transition_table(x, "g").collect()}
    assert len(table) == 8 and table["With_EML", "Compliance→Compliance"] == (1, 100.0)
    assert table["Without_EML", "Resistance→Resistance"] == (0, 0.0)


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_parts_of_a_dialogue(spark, block):
    draw = random.Random(5)
    said = [(d, i, i % 2, "".join(draw.choice("ab c\u00e9\U0001f600") for _ in range(draw.choice([0, 3, 20, 150]))))
            for d, n in ((1, 1), (2, 40), (3, 7)) for i in range(n)] + [(4, 0, None, None)]
    t = spark.createDataFrame(said, "dialogue_id long, idx long, role int, sentence string").repartition(3)
    got = build.prompt_parts(t, "ask", most=64, block=block).orderBy("dialogue_id", "part").collect()
    assert max(len(r["prompt"]) for r in got) <= 64 and all(r["prompt"].endswith("\nask") for r in got)
    room = (64 - 4) // 2 - 1
    for d in (1, 2, 3, 4):
        mine = [s for s in said if s[0] == d]
        lines = [f"{k + 1} ({'' if r is None else r}): {x or ''}" for k, (_, _, r, x) in enumerate(mine)]
        pieces = [x[i:i + room] for x in lines for i in range(0, len(x), room)]
        parts = [r for r in got if r["dialogue_id"] == d]
        assert [r["part"] for r in parts] == list(range(len(parts)))
        assert "\n".join(r["prompt"][:-4] for r in parts) == "\n".join(pieces)
        assert [p for r in parts for p in r["places"]] == [s[1] for s in mine]
    long = build.long_form(t, F.col("sentence"), block=block).collect()
    assert sorted((r["dialogue_id"], r["idx"], r["position"]) for r in long) == sorted((d, i, i) for d, i, *_ in said)
