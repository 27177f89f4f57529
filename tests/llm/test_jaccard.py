"""Near copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_graph_ops import merged
from turnlab.llm import jaccard, simhash
from turnlab.llm.common import filter_of, is_marked


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or bool(a | b) and 10 * len(a & b) >= 8 * len(a | b)


def edited(order, words, share):
    return [f"n{order.randrange(10**6)}" if order.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    """Copies of a few texts with few and many edits, chains of edits, a common line, short and empty texts."""
    order, out = random.Random(4), ["", None, "one two", "one  TWO", "one two three four five", "a b c d e f", "a b c d e f g"]
    line = " ".join(f"licence{i}" for i in range(30))
    for _ in range(12):
        words = [f"w{order.randrange(500)}" for _ in range(order.choice([8, 60, 150, 400]))]
        for share in (0, .005, .01, .02, .03, .04, .05, .08):
            out.append(" ".join(edited(order, words, share)))
        for _ in range(4):
            words = edited(order, words, .02)
            out.append(" ".join(words))
    out += [line + " " + " ".join(f"x{order.randrange(900)}" for _ in range(n)) for n in (0, 1, 2, 4, 6, 8, 20, 40, 80) * 4]
    return out


def kept_ids(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    top, least = merged(range(len(rows)), pairs), {}
    for i, (d, _) in enumerate(rows):
        least[top[i]] = min(d, least.get(top[i], d))
    return sorted(set(least.values()))


def test_against_all_pairs(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    want = kept_ids(rows)
    assert len(want) < len({frozenset(shingles(t)) for t in texts})
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert jaccard.components(docs.limit(0)).count() == 0


def test_the_stage_of_the_pipeline(spark, tmp_path):
    """The given documents: pairs of similarity 0.83 lie 7 and 11 bits apart by the fingerprint of op8."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.simhash_dedup(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)


def test_an_id_that_repeats_with_unlike_texts(spark):
    order = random.Random(1)
    one, other = ([f"{x}{order.randrange(900)}" for _ in range(60)] for x in "ab")
    rows = [(5, " ".join(one)), (3, " ".join(one + ["more"])), (5, " ".join(other)), (5, " ".join(other)), (None, "alone here")]
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)


def test_a_common_passage_gives_no_pairs(spark, monkeypatch):
    """Texts that share most of their words and are no near copies: sketches rule their pairs out inside the tasks."""
    order, compared = random.Random(2), []
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"x{order.randrange(10**6)}" for _ in range(30))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    plain = jaccard._compared

    def counted(texts, classes, pairs, *rest):
        compared.append(pairs.count())
        return plain(texts, classes, pairs, *rest)

    monkeypatch.setattr(jaccard, "_compared", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert sum(compared) < 40  # of 80,000 pairs


def test_sketches_never_rule_out_what_is_similar():
    order = np.random.default_rng(3)
    for n in (1, 5, 60, 900, 40_000):
        base = np.unique(order.integers(0, 2**63, n).astype(np.uint64))
        for share in (0, .02, .1, .2, .5):
            other = np.unique(np.concatenate([base[order.random(len(base)) >= share],
                                              order.integers(0, 2**63, int(n * share)).astype(np.uint64)]))
            differ = jaccard.apart(jaccard.sketch(base), jaccard.sketch(other))
            assert differ <= len(np.setxor1d(base, other))
            if jaccard.similar(base, other, .8):
                assert jaccard.may_be_similar(len(base), len(other), differ, .8)


def test_fingerprints_propose_first(spark, monkeypatch):
    """Near copies a bit or two apart are found by SimHash; pairs further apart are left to shared shingles."""
    order, compared = random.Random(6), []
    rows = []
    for i in range(30):
        words = [f"w{order.randrange(5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] if i < 20 else edited(order, words, .015)))]
    bits = {d: simhash.majority(jaccard.shingle_set(t)) for d, t in rows}
    close = {i for i in range(30) if bin((bits[2 * i] ^ bits[2 * i + 1]) & (2**64 - 1)).count("1") <= jaccard.REACH}
    assert 10 <= len(close) < 30
    plain = jaccard._compared

    def counted(texts, classes, pairs, *rest):
        compared.append(pairs.count())
        return plain(texts, classes, pairs, *rest)

    monkeypatch.setattr(jaccard, "_compared", counted)
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == kept_ids(rows)
    assert compared[:2] == [len(close), 30 - len(close)] and sum(compared[2:]) <= 2


def test_a_common_shingle_does_not_meet_in_one_task(spark):
    rows = [(7, i, True) for i in range(50)] + [(8, 1, False), (8, 1, False), (9, 1, False), (9, 2, False)]
    found = jaccard._shared(spark.createDataFrame(rows, "shingle long, fp long, often boolean"))
    assert sorted(map(tuple, found.collect())) == [(7, i) for i in range(50)] + [(9, 1), (9, 2)]


def test_pairs_that_sketches_leave_open_stay_in_their_tasks(spark, monkeypatch):
    """Texts of similarity 0.78 with each other and 0.89 with one: no number of pairs leaves a task, only texts and links."""
    order, compared, opened = random.Random(8), [], []
    passage, rows = [f"p{i}" for i in range(82)], []
    for i in range(40):
        tail = [f"x{order.randrange(10**9)}" for _ in range(11)]
        rows += [(2 * i, " ".join(passage + tail)),
                 (2 * i + 1, " ".join(passage + tail[:6] + [f"y{order.randrange(10**9)}" for _ in range(5)]))]
    plain, plain_open, plain_linked = jaccard._compared, jaccard._open_across, jaccard._linked_across

    def counted(texts, classes, pairs, *rest):
        compared.append(pairs.count())
        return plain(texts, classes, pairs, *rest)

    def open_across(held, *rest):
        found = plain_open(held, *rest)
        opened.append((found.count(), found.select("fp").distinct().count(), held.count()))
        return found

    monkeypatch.setattr(jaccard, "_compared", counted)
    monkeypatch.setattr(jaccard, "_open_across", open_across)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == kept_ids(rows) == list(range(0, 80, 2))
    assert sum(compared) < 400  # of 3,160 pairs, nearly all of which sketches leave open
    (rows_out, sets, held), = opened
    assert sets > 60 and rows_out <= 8 * held  # at most once in each pair of blocks
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string").withColumn("key", F.xxhash64("text"))
    told = [(jaccard.set_name(x), len(x), bytearray(jaccard.sketch(x))) for x in (jaccard.shingle_set(t) for _, t in rows)]
    classes = spark.createDataFrame([(*c, t) for c, t in zip(told, [r.key for r in docs.collect()])],
                                    "fp long, size int, sketch binary, key long")
    group = classes.select(F.lit(1).cast("long").alias("shingle"), "fp", "size", F.col("fp").alias("component"))
    links = plain_linked(docs, classes, group, jaccard.WORDS, jaccard.LEAST).collect()
    assert {frozenset(x) for x in links} == {frozenset((a[0], b[0])) for a, b in zip(told[::2], told[1::2])}


def test_a_filter_tells_what_is_not_among_its_keys(spark):
    keys = [0, 1, 32768, 32769, (1 << 20) - 1, -1, (1 << 40) + 5]
    bits, marks = filter_of(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert bits == 1 << 20
    found = is_marked(marks.value, pa.array(np.arange(bits))).to_numpy(zero_copy_only=False)
    assert np.flatnonzero(found).tolist() == sorted({k % bits for k in keys})
    assert filter_of(spark.range(1 << 17))[0] == 1 << 22  # grows with the keys


def test_texts_that_stay_are_not_shuffled(spark):
    """Kept rows whose id isn't in the filter pass without a join; repeated, null and removed ids go through it."""
    rows = [(i, f"alone {i}") for i in range(300)] + [(7, "alone 7"), (None, "none"), (None, "none"), (500, "alone 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.smallest_rows(docs, jaccard.components(docs), lambda d, name: jaccard.named(d, name=name))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.doc_id != 0) == sorted(
        [(-1, "none")] + [(i, f"alone {i}") for i in range(1, 300)])
    assert "Union" in kept._jdf.queryExecution().toString() and "__marked" in kept._jdf.queryExecution().toString()
