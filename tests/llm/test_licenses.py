"""License spans against a plain search, and merged diagonals on altered notices."""

import random
import re

from turnlab.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_places(text):
    found = words(text)
    return sorted((i, label) for phrase, label in licenses.BASE
                  for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, n long")


def test_base_phrases_by_plain_search(spark):
    order = random.Random(5)
    alphabet = ["cc", "by", "CC", "By", "general", "public", "license", "all", "rights", "reserved", "İ", "é", "7"]
    texts = ["".join(order.choice(alphabet) + order.choice([" ", "\x00", "-", ". ", "\n", "é", ""])
                     for _ in range(order.randrange(40))) for _ in range(300)]
    texts += [None, "", "...", "cc by " * 3000, "all rights reserved", "x" * 50_000, "ALL\trights\x7freserved cc", "cc"]
    rows = list(enumerate(texts)) + [(None, "cc by"), (None, None), (3, "cc by cc by"), (3, "cc by cc by"), (4, texts[3])]
    got = [tuple(r) for r in licenses.digest(licenses.scan(frame(spark, rows))).drop("labels", "score").collect()]
    want = []
    for doc_id, text in rows:
        found = base_places(text)
        at = [i for i, _ in found]
        want.append((doc_id, len(words(text)), len(found), min(at, default=None), max(at, default=None),
                     ",".join(sorted({label for _, label in found}))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_altered_notices(spark):
    notice = next(t for t, label in licenses.FURTHER if label == "mit" and len(t) > 100)
    told = words(notice)
    before = ["word"] * 17
    changed, longer, torn = told[:], told[:], told[:]
    changed[20] = "other"
    longer[30:30] = ["two", "more"]
    torn = told[:len(told) // 2]
    rows = list(enumerate(" ".join(before + t + before) for t in (told, changed, longer, torn, told[:40] + told[43:])))
    found = {(r.doc_id, r.start, r.end): r.share for r in licenses.find(frame(spark, rows)).where("label = 'mit'").collect()}
    n = len(told)
    assert found == {(0, 17, 17 + n): 1.0, (1, 17, 17 + n): (n - 1) / n, (2, 17, 19 + n): 1.0, (4, 17, 14 + n): (n - 3) / n}


def test_own_templates_and_empty_table(spark):
    rows = frame(spark, [(1, "alpha beta gamma alpha")])
    found = licenses.scan(rows, [("alpha", "a"), ("", "none")], [("beta gamma", "b")]).first()
    assert (found.n_base, found.first_word, found.last_word, found.labels, found.score) == (2, 0, 3, ["a", "b"], 1.0)
    assert licenses.scan(rows.limit(0)).count() == 0
    assert licenses.scan(rows, [], []).first().n_words == 4


def test_main_path_is_native(spark):
    plan = licenses.scan(frame(spark, [(1, "cc by")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
