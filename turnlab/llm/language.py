"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte n-grams of the letters. They learn from
a bounded sample of labelled rows; each machine is fitted in a Spark task of its own.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlab.llm.common import cut, small_batches, with_columns

PER_LANGUAGE = 400      # labelled rows of each language that a fit reads: the only bound on what is learned from
DIMENSIONS = 1 << 12
UNKNOWN = "und"
_PART = 1 << 22         # bytes counted at once
_SALTS = 64

#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"), "finnic": ("fi", "et"), "celtic": ("ga", "gd", "cy", "br"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"), "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("ar", "he", "mt", "am"), "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def family(language):
    return _FAMILY_OF.get(language, language)


def has_letter(text):
    return bool(text) and any(map(str.isalpha, text))


def counts(text):
    """How often each hashed n-gram of one to three bytes occurs; what is no letter is one space."""
    total = np.zeros(DIMENSIONS, np.int64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    for i in range(0, len(raw), _PART):
        codes = np.frombuffer(raw[max(0, i - 2):i + _PART], np.uint8)
        codes = np.where(_LETTER[codes], codes, 32).astype(np.uint64)
        space = codes == 32
        codes = codes[~(space & np.r_[False, space[:-1]])] if len(codes) else codes
        value = codes.copy()
        for n in range(1, 4):
            hashed = ((value + np.uint64(n << 26)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
            total += np.bincount(hashed.astype(np.int64), minlength=DIMENSIONS)
            value = (value[:-1] << np.uint64(8)) | codes[n:]
    return total


def features(text):
    """Square roots of the n-gram shares: a vector of length one, whatever the text's length."""
    x = counts(text)
    return np.sqrt(x / max(1, x.sum())).astype(np.float32)


def fit_machine(x, y, penalty=10.0, epochs=30):
    """Weights (bias last) of a linear support vector machine, by dual coordinate descent; ``y`` is 1 or -1."""
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float64)
    norms, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = (1 - y[i] * (w @ x[i])) / norms[i]
            new = min(max(alpha[i] + step, 0.0), penalty)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def machines(languages):
    """(level, one, other) of every machine that these languages need: between families, and within each."""
    families = sorted({family(x) for x in languages})
    out = [("family", *p) for p in itertools.combinations(families, 2)]
    for name in families:
        out += [("language", *p) for p in itertools.combinations(sorted(x for x in languages if family(x) == name), 2)]
    return out


class Model:
    """Fitted machines; ``predict`` gives (language, score) of a text."""

    def __init__(self, languages, weights):
        self.languages = sorted(languages)
        self.keys = sorted(weights)
        self.matrix = np.array([weights[k] for k in self.keys]).reshape(len(self.keys), DIMENSIONS + 1)

    def predict(self, text):
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        margins = dict(zip(self.keys, (self.matrix[:, :-1] @ features(text) + self.matrix[:, -1]).tolist()))
        home, sure = _winner("family", sorted({family(x) for x in self.languages}), margins)
        language, surer = _winner("language", [x for x in self.languages if family(x) == home], margins)
        return language, sure * surer


def _winner(level, names, margins):
    """The name with most votes (then the larger sum of margins, then the first) and its least certainty."""
    votes = {n: [0, 0.0] for n in names}
    least = dict.fromkeys(names, 1.0)
    for one, other in itertools.combinations(names, 2):
        margin = margins[(level, one, other)]
        for name, m in ((one, margin), (other, -margin)):
            votes[name][0] += m > 0
            votes[name][1] += m
            least[name] = min(least[name], 1 / (1 + float(np.exp(-np.clip(2 * m, -50, 50)))))
    best = max(names, key=lambda n: (*votes[n], [-ord(c) for c in n]))
    return best, least[best]


def held_out(doc_id="doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by five; true without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs, doc_id="doc_id", text="text", lang="lang", per_language=PER_LANGUAGE):
    """A Model learned from at most ``per_language`` whole texts of each language.

    Sampled are the labelled rows of least hash of the id that are not held out and have letters. Without any such row
    the model knows no language and predicts `und` for every text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"))
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))  # a language of a third of all rows is first cut down in parts
    for key in ([F.col("lang"), salt], [F.col("lang")]):
        order = Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id", "lang")
    chosen = cut(rows.distinct(), "sampled")
    languages = [r["lang"] for r in chosen.select("lang").distinct().collect()]  # the set of labels
    jobs = machines(languages)
    if not jobs:
        return Model(languages, {})

    texts = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(
        chosen, ["id", "lang"], "left_semi")

    def sides(lang):
        return [(i, one in (lang, family(lang))) for i, (level, one, other) in enumerate(jobs)
                if (family(lang) if level == "family" else lang) in (one, other)]

    def vectors(batches):
        for part in batches:
            out = []
            for lang, value in zip(part["lang"], part["text"]):
                x = features(value).astype("<f4").tobytes() if has_letter(value) else None
                out += [(i, bool(first), x) for i, first in sides(lang) if x]
            yield pd.DataFrame(out, columns=["machine", "first", "x"])

    def learn(part):
        part = part.sort_values(["first", "x"])  # so that the order of arrival doesn't count
        x = np.stack([np.frombuffer(b, "<f4") for b in part["x"]])
        w = fit_machine(x, np.where(part["first"].to_numpy(bool), 1.0, -1.0))
        return pd.DataFrame({"machine": [int(part["machine"].iloc[0])], "w": [w.tolist()]})

    fitted = (texts.mapInPandas(vectors, "machine int, first boolean, x binary").groupBy("machine")
              .applyInPandas(learn, "machine int, w array<double>").collect())
    return Model(languages, {jobs[r["machine"]]: r["w"] for r in fitted})


def identify(docs, model, text="text", names=("lang_pred", "score")):
    """``docs`` with lang_pred and score (0 to 1) of the whole text.

    A text that is null or has no letter is `und` with score 0, as is every text where nothing was learned. With one
    learned language that is the answer, with score 1. Repeated rows each get their result, an empty table stays empty,
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages squared x DIMENSIONS numbers

    def run(texts):
        found = [shared.value.predict(t) for t in texts]
        return [list(x) for x in zip(*found)] if found else [[], []]
    return with_columns(docs, [text], run, "{} string, {} double".format(*names))


def known_language(docs, model, text="text"):
    """The rows of ``docs`` in a learned language; those that are `und` go. Columns stay as they are.

    Where nothing was learned, every row with a letter stays.
    """
    if not model.languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    found = identify(docs, model, text, ("__lang", "__score"))
    return found.where(F.col("__lang") != UNKNOWN).select(*docs.columns)
