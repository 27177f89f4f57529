"""Components, vectors, fingerprints and URL filters against brute force on small fixtures."""

import numpy as np
import pytest

from turnlab.llm import simhash, url_filter, vectors
from turnlab.llm.components import connected_components


def merged(nodes, pairs):
    """Smallest node that each node reaches."""
    top = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(top[a], top[b])
            moved |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    return top


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(200, 201), (201, 202), (7, 7)],
    [(5, 3), (5, 3), (3, 9), (2, None)], []])
def test_components(spark, links):
    edges = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if None not in (a, b) and a != b]
    want = merged({n for p in real for n in p}, real)
    assert dict(map(tuple, connected_components(edges).collect())) == want


TEXTS = ["", None, "One two", "one  TWO", "one two\nthree four", "one two three four", "a b c d e f g", "É à ß x y z",
         "lorem ipsum dolor sit amet " * 400, "lorem ipsum dolor sit amet " * 400 + "x", " \t\n", "é" * 30_000]


def brute_fingerprint(text):
    import xxhash
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, TEXTS[6], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.digest(simhash.components(docs)).collect()), key=str)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    top = merged(range(len(rows)), pairs)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(d, least.get(top[i], d))
    want = sorted(((d, f"{p:016x}", least.get(top[i])) for i, ((d, _, _), p) in enumerate(zip(rows, prints))), key=str)
    assert got == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.components(docs.limit(0)).count() == 0


def test_simhash_tree_is_exact():
    order = np.random.default_rng(3)
    base = order.integers(0, 2**63, 400, dtype=np.uint64)
    near = np.repeat(base[:1], 900)
    for _ in range(4):
        near = near ^ (np.uint64(1) << order.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), near]))
    order.shuffle(fps)
    tree = simhash.VantageTree(fps[:300], 6)
    leaf, at, visiting = tree.deal(fps, 2)
    assert np.bincount(at[~visiting], minlength=len(fps)).tolist() == [1] * len(fps)
    links = [(int(p), int(q)) for n in range(tree.leaves)
             for a, b in simhash.leaf_links(fps[at[leaf == n]], visiting[leaf == n], 2) for p, q in zip(a, b)]
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    nodes = fps.tolist()
    assert merged(nodes, links) == merged(nodes, [(nodes[i], nodes[j]) for i, j in close])


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    order = np.random.default_rng(5)
    center = order.standard_normal((6, 16))
    rows = [(i, (center[i % 6] + .02 * order.standard_normal(16)).tolist(), int(i % 3 == 0)) for i in range(150)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 0), (202, [2 * x for x in rows[0][1]], 1), (0, rows[0][1], 1)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None),
             (304, [None] + rows[0][1][1:], 1), (305, rows[0][1][:8], 1), (306, [float("inf")] * 16, 1),
             (None, rows[0][1], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, x string")
    x = [np.array([np.nan if v is None else v for v in e], np.float32).astype(float) if e else np.zeros(1)
         for _, e, _ in rows]

    def linked(i, j):
        fit = all(np.isfinite(x[k]).all() and x[k].any() and rows[k][2] is not None and rows[k][0] is not None
                  for k in (i, j))
        return (fit and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
                and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= .98)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    top = merged(range(len(rows)), pairs)
    count = [sum(i in p for p in pairs) for i in range(len(rows))]
    least = [None if rows[i][0] is None else min(rows[k][0] for k in top if top[k] == top[i] and rows[k][0] is not None)
             for i in range(len(rows))]
    want = sorted(((r[0], count[i], least[i], r[0] is not None and r[0] == least[i]) for i, r in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in vectors.near_duplicates(table).collect()), key=str) == want
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_table_plan_keeps_recall():
    for n in (10, 10**4, 10**9):
        bits, tables = vectors.table_plan(n)
        assert 1 - (1 - (1 - np.arccos(.98) / np.pi) ** bits) ** tables >= vectors.RECALL


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.org/x#f", link("https://b.example.com/en/1")), (3, "http://www.example.com/en/5", link("http://c.org/y")),
            (2, "http://C.org/y", "<META http-equiv='refresh' content='0; url=http://a.org/x'>"), (4, "http://d.org/y", None),
            (5, None, None), (6, "nonsense", link("/a")), (7, "HTTP://X.NET/es/1?x://y", ""), (8, "http://q.net:80/es/1", ""),
            (9, "http://com", ""), (10, "http://k.com/es", link("/zz")), (10, "http://k.com/es", ""),
            (None, "http://e.org/p", link("//n.net/fr/1")), (11, "http://f.org/1", "<link href=/2 rel='x canonical'>"),
            (12, "http://f.org/2#a", ""), (13, "http://moved.org/", ""), (14, "http://bad.org/", link("http://[oops"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    moves = spark.createDataFrame([("http://moved.org/", "http://z.net/es/"), (None, "http://z.net/es/"),
                                   ("http://z.net/es/", "http://f.org/2")], "source string, target string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict)
           for r in url_filter.filter_urls(pages, url_filter.RULES, redirects=moves).collect()}
    assert got == {
        (1, "a.org", "/x"): (None, "block"), (2, "c.org", "/y"): (None, "block"),
        (3, "www.example.com", "/en/5"): ("www.example.com/en/", "allow"), (4, "d.org", "/y"): (None, "allow"),
        (5, "", ""): (None, "allow"), (6, "", ""): (None, "allow"), (7, "x.net", "/es/1"): ("net/es/", "block"),
        (8, "q.net:80", "/es/1"): (None, "allow"), (9, "com", ""): (None, "allow"),
        (10, "k.com", "/es"): ("com/", "allow"), (None, "e.org", "/p"): (None, "block"),
        (11, "f.org", "/1"): (None, "block"), (12, "f.org", "/2"): (None, "block"), (13, "moved.org", "/"): (None, "block"),
        (14, "bad.org", "/"): (None, "allow")}
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0
