"""Batch scoring of text with a model the user brings."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score(t, text, load_scorer, name="probs", batch=64):
    """Add an array of class scores to every row.

    ``load_scorer()`` runs once per task and returns a function from a list of texts to a list of
    score lists. Rows reach it in Arrow batches and are scored ``batch`` at a time.
    """
    schema = T.StructType(t.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(parts):
        scorer = load_scorer()
        for pdf in parts:
            texts = pdf[text].fillna("").tolist()
            scores = [list(map(float, s)) for i in range(0, len(texts), batch)
                      for s in scorer(texts[i:i + batch])]
            yield pdf.assign(**{name: pd.Series(scores, index=pdf.index, dtype=object)})

    return t.mapInPandas(run, schema)


def score_distinct(t, text, load_scorer, name="probs", batch=64):
    """``score`` with one scoring per distinct text, whatever the number of rows that hold it.

    A repeated text is one row before anything is shuffled by it. A task's texts are put in order of length, so that a batch
    holds texts of like length. Scores are joined back by text; of a text that a large part of the rows hold,
    the rows are split by adaptive execution. A missing text is scored as an empty one.
    """
    key = F.coalesce(F.col(text), F.lit("")).alias("_text")
    texts = t.select(key).distinct().sortWithinPartitions(F.length("_text"), "_text")
    scored = score(texts, "_text", load_scorer, name, batch)
    return t.select("*", key).join(scored, "_text").select(*t.columns, name)


def reply(t, prompt, load_scorer, name="reply", batch=8):
    """Add a model's text reply to every prompt; the scorer returns one text per prompt."""
    schema = T.StructType(t.schema.fields + [T.StructField(name, T.StringType())])

    def run(parts):
        scorer = load_scorer()
        for pdf in parts:
            prompts = pdf[prompt].fillna("").tolist()
            texts = [r for i in range(0, len(prompts), batch) for r in scorer(prompts[i:i + batch])]
            yield pdf.assign(**{name: pd.Series(texts, index=pdf.index, dtype=object)})

    return t.mapInPandas(run, schema)


def lexicon_scorer(words_by_class):
    """A small scorer: the number of words of each class's list, as raw scores."""
    def load():
        lists = [set(w) for w in words_by_class]

        def run(texts):
            tokens = [t.lower().split() for t in texts]
            return [[float(sum(w in words for w in tok)) for words in lists] for tok in tokens]
        return run
    return load


def scored_only(t, text, shortest):
    """Rows long enough to be scored; the others keep their default label."""
    return t.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= shortest)
