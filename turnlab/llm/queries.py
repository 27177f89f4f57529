"""The registered queries of the dealt operators, and their SQL where SQL can say it."""

import public_tokenizers

from turnlab.llm import (bpe, clustering, decontaminate, importance, language, licenses, secrets, simhash, token_files,
                         url_filter, vectors, warc, wrapper)
from turnlab.llm.common import read_table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query
def op1_token_files(spark, sf_dir):
    folder = token_files.written(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return token_files.digest(token_files.read(spark, folder, as_bytes=True))


@query
def op2_wrapper_induction(spark, sf_dir):
    return wrapper.extract(read_table(spark, sf_dir, "pages"))


@query
def op3_byte_bpe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN).drop("text"))


@query
def op5_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_warc(spark, sf_dir):
    return warc.digest(spark, warc.archived(read_table(spark, sf_dir, "pages")))


SQL["op6_warc"] = warc.ORACLE


@query
def op7_vector_dedup(spark, sf_dir):
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL["op7_vector_dedup"] = vectors.ORACLE


@query
def op8_simhash(spark, sf_dir):
    return simhash.digest(simhash.components(read_table(spark, sf_dir, "documents")))


@query
def op9_secret_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs).drop("text"))


@query
def op4_winnowing(spark, sf_dir):
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


SQL["op4_winnowing"] = decontaminate.ORACLE


@query
def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.RULES)


SQL["op10_url_filter"] = url_filter.ORACLE


@query
def op11_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


SQL["op11_license_scan"] = licenses.ORACLE


@query
def op12_centroid_clusters(spark, sf_dir):
    return clustering.digest(clustering.cluster(read_table(spark, sf_dir, "embeddings")))


SQL["op12_centroid_clusters"] = clustering.ORACLE


@query
def op13_importance(spark, sf_dir):
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return importance.digest(importance.resample(docs, target))


SQL["op13_importance"] = importance.ORACLE
