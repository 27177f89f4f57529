"""Features, weights and the drawing against a plain version over split words."""

import hashlib
import math
import random
import re
import zlib

import pytest

from turnlab.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, buckets=10_000):
    found = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(found[i:i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]
    return len(found), [zlib.crc32(g.encode()) % buckets for g in grams]


def plain(rows, target, percent=5, least=20):
    held = [(i, *features(t)) for i, t in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, bs in held:
        for b in bs:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, bs in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    may = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    rank = may[:len(may) * percent // 100]
    got = [(x[0], *x[2:], k + 1) for k, x in enumerate(rank)]
    rest = [(x[0], *x[2:], None) for x in may[len(rank):] + [x for x in out if x[1] < least]]
    return sorted(got + rest, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score long, buckets string")


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_drawing_by_plain_version(spark, percent):
    order = random.Random(percent)
    words = ["the", "The", "é", "ÀB", "x1", "co\x00de", "good", "bad", "\U0001F600", "don't"]
    rows = [(i, " ".join(order.choice(words) for _ in range(order.randrange(60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "?!"), (503, "word " * 40_000), (None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1])]
    target = ["good good", None, "the good é", "the good é"]
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    found = importance.digest(importance.resample(frame(spark, rows), items, percent=percent))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, target, percent)


def test_ties_of_scores_go_to_the_smaller_id(spark):
    rows = [(i, 25, 0, 0, i % 3) for i in range(100)] + [(200, 19, 0, 0, 9)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    found = {r.doc_id: r.rank for r in importance.drawn(scored, percent=50).collect()}
    order = [r[0] for r in sorted(rows[:100], key=lambda r: (-r[4], r[0]))]
    assert found == {i: order.index(i) + 1 if i < 200 and order.index(i) < 50 else None for i in found} and len(found) == 101


def test_empty_tables(spark):
    items = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), items).count() == 0
    row = importance.resample(frame(spark, [(1, "a b")]), items).first()
    assert (row.n_features, row["rank"]) == (3, None)
