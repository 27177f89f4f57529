"""The pipeline, stage by stage, against brute force on a small fixture."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_graph_ops import merged
from test_jaccard import alike, shingles
from turnlab.llm import bpe, decontaminate, secrets
from turnlab.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of the given tables with odd rows added, and a benchmark."""
    folder = str(tmp_path_factory.mktemp("sf"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = " ".join(f"leaked{i}" for i in range(12))
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "123 ### 456", "en", "s", 11), (9001, None, "en", "s", 0),
           (9004, f"the and of {leak} to it", "en", "s", 90), (9005, "the token = \"abcdef123456\" of it", "en", "s", 30),
           (9006, "the copy of the one " * 3, "en", "s", 60), (9007, "THE copy of the one " * 3, "en", "s", 60),
           (9006, "the copy of the one " * 3, "en", "s", 60), (9008, "the very long one of it " * 40_000, "en", "s", 1)]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema)).withColumn("fp", F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, leak)], "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(5)):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/out{number}")
        docs = spark.read.parquet(f"{sf_dir}/out{number}")
        got = sorted((tuple(r) for r in docs.select("doc_id", "text" if number < 4 else "decoded").collect()), key=str)
        if number < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        rows = sorted(EXPECTED[number](spark, rows, sf_dir), key=str)
        assert got == rows, name
    one = docs.where("doc_id = 9005").first()
    assert one.decoded.decode() == 'the token = "[SECRET]" of it'
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def with_letters(spark, rows, sf_dir):
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def one_of_each(spark, rows, sf_dir):
    """The row of the smallest id (then of the least text) of each component of five-word Jaccard 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    top = merged(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    first = {}
    for i, (d, t) in enumerate(rows):
        first[top[i]] = min((d, t), first.get(top[i], (d, t)))
    return list(first.values())


def without_leaks(spark, rows, sf_dir):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    clean = []
    for d, t in rows:
        w = decontaminate.words_of(t)
        if not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9)):
            clean.append((d, t))
    assert 9004 not in dict(clean)
    return clean


def without_secrets(spark, rows, sf_dir):
    return [(d, secrets.redacted(t, *zip(*p)) if (p := secrets.literal_places(t)) else t) for d, t in rows]


def as_bytes(spark, rows, sf_dir):
    coder = bpe.codec(corpus_pipeline.RANKS, public_tokenizers.PATTERN)
    assert all(coder.decode(coder.encode(t)) == t.encode() for _, t in rows)
    return [(d, t.encode()) for d, t in rows]


EXPECTED = [with_letters, one_of_each, without_leaks, without_secrets, as_bytes]


def test_stages_take_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_nothing_to_learn_from(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language_id(spark, docs, sf_dir)
    want = with_letters(spark, [(r.doc_id, r.text) for r in docs.collect()], sf_dir)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
