"""Parsing, mapping and combining labels, as Column expressions."""

from pyspark.sql import functions as F

from turnlab.vocab import (
    DA_CODES, DA_NAMES, DA_NEGATIVE, DA_OF_TAG, DA_POSITIVE, OUTCOME_OF_LABEL,
)


def _col(col):
    return F.col(col) if isinstance(col, str) else col


def _literal(value):
    return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def _mapping(pairs):
    """A dictionary as one constant map."""
    return F.expr("map(" + ", ".join(_literal(x) for pair in pairs.items() for x in pair) + ")")


def strings(values):
    """A list of labels as one constant array."""
    return F.expr("array(" + ", ".join(_literal(v) for v in values) + ")")


def parse_list(col):
    """``"['a', 'b']"`` -> array; NULL and ``[]`` give an empty array, order and repeats stay."""
    bare = F.regexp_replace(F.coalesce(_col(col), F.lit("")), r"[\[\]'\"]", "")
    return _trimmed(bare)


def split_labels(col):
    """``"a, b"`` -> array of trimmed labels; NULL gives an empty array."""
    return _trimmed(F.coalesce(_col(col), F.lit("")))


def _trimmed(text):
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def binarize(labels, classes):
    """One 0/1 Column per class, in the order of ``classes``."""
    return [F.array_contains(labels, c).cast("int").alias(c) for c in classes]


def da_binary(col, prefix="da_"):
    """Twelve 0/1 columns from list text or comma text; case is ignored, unknown tags too."""
    labels = F.transform(parse_list(col), lambda x: F.lower(x))
    return [F.array_contains(labels, c).cast("int").alias(prefix + c) for c in DA_CODES]


def map_label(col, mapping=None, default="Neutral"):
    """Dictionary lookup; NULL, blank and unknown labels give ``default``."""
    mapping = OUTCOME_OF_LABEL if mapping is None else mapping
    return F.coalesce(F.element_at(_mapping(mapping), _col(col)), F.lit(default))


def map_labels(arr, mapping=None, default="Neutral"):
    """The dictionary lookup over every element of an array."""
    return F.transform(_col(arr), lambda x: map_label(x, mapping, default))


def map_da(col):
    return map_label(F.trim(_col(col)), DA_OF_TAG, "o")


def da_full_name(col):
    return F.element_at(_mapping(DA_NAMES), _col(col))


def recode(col, mapping):
    """Code -> label (or back); codes outside the map give NULL."""
    return F.element_at(_mapping(mapping), _col(col))


def resolve_label(arr):
    """One outcome of a list of mapped labels: Conflict when both outcomes occur."""
    arr = _col(arr)
    complied, resisted = (F.array_contains(arr, x) for x in ("Compliance", "Resistance"))
    return (F.when(complied & resisted, "Conflict")
            .when(complied, "Compliance")
            .when(resisted, "Resistance")
            .otherwise("Neutral"))


def persuasion_result(arr):
    """Like ``resolve_label``; a conflict takes the first mapped label, which may be Neutral."""
    resolved = resolve_label(arr)
    return F.when(resolved == "Conflict", F.get(_col(arr), F.lit(0))).otherwise(resolved)


def da_group(col):
    """Polarity of a comma list of dialogue acts: DA+ first, then DA-, else DAo."""
    labels = split_labels(col)
    return (F.when(F.arrays_overlap(labels, strings(DA_POSITIVE)), "DA+")
            .when(F.arrays_overlap(labels, strings(DA_NEGATIVE)), "DA-")
            .otherwise("DAo"))


def has_label(col, label):
    """True when the comma list holds the label."""
    return F.array_contains(split_labels(col), label)


def pack_labels(arr):
    """Sorted distinct labels as comma text."""
    return F.array_join(F.array_sort(F.array_distinct(_col(arr))), ",")


def one_hot(col, values, prefix="DA_", reference=None):
    """One 0/1 Column per value except the reference value."""
    return [(F.coalesce(_col(col) == v, F.lit(False))).cast("int").alias(prefix + v)
            for v in values if v != reference]


def majority(cols):
    """Most frequent rating; NULL if no rating, or if three or more ratings all differ.

    Ratings that are missing do not vote. A tie of two takes the smaller value.
    """
    votes = F.array_compact(F.array(*[_col(c) for c in cols]))
    kinds = F.array_sort(F.array_distinct(votes))
    counted = F.transform(kinds, lambda k: F.struct(
        (-F.size(F.filter(votes, lambda v: v == k))).alias("n"), k.alias("k")))
    split = (F.size(kinds) >= 3) & (F.size(kinds) == F.size(votes))
    return F.when(~split & (F.size(votes) > 0), F.array_min(counted)["k"])


def any_positive(cols):
    """1 when the ratings add up to more than zero, missing ones counting as zero."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(_col(c), F.lit(0))
    return (total > 0).cast("int")


def agree(a, b):
    """1/0 agreement of two ratings, NULL when one is missing."""
    return (_col(a) == _col(b)).cast("int")


def parse_binary_reply(col):
    """First 0 or 1 in a free-text reply, 0 when there is none."""
    return F.coalesce(F.regexp_extract(_col(col), "([01])", 1).try_cast("int"), F.lit(0))
