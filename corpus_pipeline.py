"""Documents to token ids in stages, each one operator of turnlab.llm; a stage's rows are written and read again.

Every stage takes null, empty and very long texts, null and repeated ids, an empty table and further columns (which go).
"""

import public_tokenizers

from turnlab.llm import bpe, decontaminate, jaccard, language, secrets
from turnlab.llm.common import read_table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = 100_000    # that a worker of the last stage remembers, beside what the stages before it left in memory


def language_id(spark, docs, sf_dir):
    """Documents in a language learned from their own labels; those without letters (null texts too) go.

    Repeated rows each stay. Without any label to learn from, all documents with letters stay.
    """
    return language.known_language(docs, language.fit(docs)).select(*COLUMNS)


def simhash_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): that of the smallest id.

    SimHash fingerprints propose pairs, which are then compared exactly; shared shingles propose what lies more bits apart.

    Texts without words are one group. Of repeated rows one stays; an id that repeats with unlike texts keeps a row of each
    group of which it is the smallest. A group without ids keeps one row.
    """
    return jaccard.deduplicate(docs.select(*COLUMNS))


def decontaminated(spark, docs, sf_dir):
    """Documents that hold no window of ``benchmark``; null and wordless texts hold none. Repeated rows each stay."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark, docs, sf_dir):
    """Texts with every secret replaced; no document goes, a null text stays null."""
    return secrets.redact(docs).select(*COLUMNS)


def byte_bpe(spark, docs, sf_dir):
    """One row per document: doc_id, its ids, and the text decoded from them (none and empty for an empty text)."""
    return bpe.round_trip(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, kept=PIECES).drop("text")


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_dedup),
          ("benchmark decontamination", decontaminated), ("secret scans", secret_scan), ("byte-level BPE", byte_bpe)]

#: Learned language models and component searches are not SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
