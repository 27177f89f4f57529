"""Features of conversations and of text."""

from pyspark.ml.feature import (
    CountVectorizer, CountVectorizerModel, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover,
    StringIndexer, VectorAssembler,
)
from pyspark.sql import functions as F

from turnlab.functions.counts import rows_n
from turnlab.functions.labels import da_binary, split_labels


TOP_ACTS = 15


def each_act(t, da="da_label", order="idx"):
    """One row per act of every list, in the order of the rows and their lists: dialogue, ``at`` and ``act``."""
    return t.select("dialogue_id", order, F.posexplode(split_labels(da)).alias("_nth", "act")).select(
        "dialogue_id", F.struct(order, "_nth").alias("at"), "act")


def common_acts(t, da="da_label", n=TOP_ACTS):
    """The n commonest acts; at most n values come to the driver."""
    top = (t.where(F.col(da).isNotNull()).groupBy(da).agg(rows_n().alias("c"))
           .orderBy(F.desc("c"), F.asc(da)).limit(n))
    return [r[0] for r in top.collect()]


def sequence_features(t, acts, da="da_label", order="idx"):
    """Features of every conversation's act sequence.

    Length, first and last act, diversity, counts and ratios of the given acts and four pattern
    flags, all as aggregates: no sequence is built, so its length does not matter.
    """
    d = F.col(da)
    has = lambda x: F.coalesce(F.bool_or(d == x), F.lit(False))
    rows = t.where(d.isNotNull())
    # distinct acts per conversation from pre-aggregated (conversation, act) counts
    per_act = rows.groupBy("dialogue_id", da).agg(
        rows_n().alias("n"), F.min(order).alias("_from"), F.max(order).alias("_to"))
    counts = [F.coalesce(F.sum(F.when(d == a, F.col("n"))), F.lit(0)).alias(f"da_{a}_count") for a in acts]
    base = per_act.groupBy("dialogue_id").agg(
        F.sum("n").alias("sequence_length"), F.min_by(da, "_from").alias("first_da"),
        F.max_by(da, "_to").alias("last_da"), rows_n().alias("_kinds"), *counts,
        (has("request") & has("inform")).cast("int").alias("has_request_inform"),
        (has("greeting") & has("closing")).cast("int").alias("has_greeting_closing"))
    length = F.col("sequence_length")
    return base.select(
        "dialogue_id", "sequence_length", "first_da", "last_da",
        (F.col("_kinds") / length).alias("da_diversity"),
        *[f"da_{a}_count" for a in acts],
        *[(F.col(f"da_{a}_count") / length).alias(f"da_{a}_ratio") for a in acts],
        "has_request_inform", "has_greeting_closing",
        (F.col("first_da") == "greeting").cast("int").alias("starts_with_greeting"),
        F.col("last_da").isin("thanks", "greeting, thanks").cast("int").alias("ends_with_thanks"))


def tfidf_stages(text="sentence", out="text_features", vocabulary=5000):
    """One- and two-word TF-IDF without English stop words, unit length.

    The IDF differs from the usual smoothed form by a constant.
    """
    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\w\w+", gaps=False),
        StopWordsRemover(inputCol="_tokens", outputCol="_words"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        both,
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol=out, p=2.0),
    ]


def known_terms(terms, stage):
    """The model of the CountVectorizer ``stage``: the commonest terms of ``terms``, the least of equally common ones.

    Terms are counted as rows, combined before the shuffle; the stage's own fit keeps each text's terms as objects of the JVM.
    """
    counts = terms.select(F.explode(stage.getInputCol()).alias("term")).groupBy("term").agg(rows_n().alias("n"))
    common = counts.orderBy(F.desc("n"), "term").limit(stage.getVocabSize())
    found = [r[0] for r in common.collect()]  # a bounded vocabulary
    return CountVectorizerModel.from_vocabulary(found, stage.getInputCol(), stage.getOutputCol())


def tfidf_weights(t, key, text="sentence", stop_words=()):
    """(key, term, weight): the weights of ``tfidf_stages`` without a bound on the vocabulary, as a table.

    Terms are words of two characters or more and pairs of neighbouring ones, in lower case; weights have length one.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1),
                     lambda w: ~w.isin(list(stop_words)) if stop_words else F.lit(True))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(
        " ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    listed = t.select(key, words.alias("_w")).select(key, F.explode(F.concat(
        "_w", F.when(F.size("_w") > 1, pairs).otherwise(F.array()))).alias("term"))
    counts = listed.groupBy(key, "term").agg(rows_n().alias("_tf"))
    known = counts.groupBy("term").agg(rows_n().alias("_df"))
    n = t.select(rows_n()).scalar()
    raw = counts.join(known, "term").select(
        key, "term", (F.col("_tf") * F.ln((n + 1) / (F.col("_df") + 1))).alias("_x"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_l"))
    return raw.join(length, key).select(key, "term", F.try_divide("_x", "_l").alias("weight"))


def label_index_stage(col, out):
    """Alphabetical class numbers."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc")


def prepare_rows(t, numbers=("eml_label",), text="sentence", categories=()):
    """Model input rows: missing text '', missing numbers 0, missing category the commonest one (the least of
    equally common ones)."""
    out = t.na.fill("", subset=[text]).na.fill(0, subset=list(numbers))
    for c in categories:
        mode = t.where(F.col(c).isNotNull()).select(F.mode(c, True)).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), mode))
    return out.select("*", *da_binary("da_label"))


def assembler(inputs, out="features"):
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="keep")
