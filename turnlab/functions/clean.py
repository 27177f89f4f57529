"""Column cleaning: every function takes a Column (or name) and returns a Column."""

from decimal import Decimal

from pyspark.sql import functions as F

from turnlab.vocab import EXTRA_STOP_WORDS, GENERAL_STOP_WORDS

# word characters inside a character class: letters, digits and the underscore of every script
WORD = r"\p{L}\p{N}_"


def to_number(col):
    """Number, or NULL where the value is not one."""
    return F.col(col).try_cast("double") if isinstance(col, str) else col.try_cast("double")


def round_exact(col, digits):
    """Round a double by its exact binary value, halves to even.

    ``round`` works on the shortest decimal text of a double, so 0.5035 (which is a little less)
    would go up.
    """
    text = F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))
    # below one unit the formatter drops the half itself
    unit, half = 10.0 ** -digits, 0.5 * 10.0 ** -digits
    above = Decimal(half) > Decimal(5).scaleb(-digits - 1)
    up = (F.abs(col) >= half) if above else (F.abs(col) > half)
    small = F.when(up, F.signum(col) * unit).otherwise(F.signum(col) * 0.0)
    return F.when(F.abs(col) < unit, small).otherwise(text.cast("double"))


def to_flag(col):
    """Integer flag; anything that is not a number counts as 0."""
    return F.coalesce(to_number(col), F.lit(0.0)).cast("int")


def digits_flag(col):
    """Integer left after dropping everything but digits, 0 when nothing is left.

    Meant for integer or text columns: a fractional number would keep its decimals as digits.
    """
    digits = F.regexp_replace(_text(col), "[^0-9]", "")
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def non_blank(col):
    return F.coalesce(F.trim(_text(col)) != "", F.lit(False))


def clean_text(col):
    return F.coalesce(F.trim(_text(col)), F.lit(""))


def clean_text_keep_endmarks(col):
    """Lower-case text without punctuation other than ``? ! .`` and without repeated blanks."""
    kept = F.regexp_replace(F.lower(clean_text(col)), rf"(?U)[^{WORD}\s?!.]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def bare_words(col):
    """Array of the lower-case words of a text without punctuation."""
    bare = F.regexp_replace(F.lower(F.coalesce(_text(col), F.lit(""))), rf"(?U)[^{WORD}\s]", "")
    return F.split(bare, r"(?U)\s+")


def is_content_word(word, stop_words=None):
    """At least three letters and no stop word."""
    stops = stop_words if stop_words is not None else default_stop_words()
    return (F.length(word) > 2) & ~word.isin(stops)


def content_words(col, stop_words=None):
    """Array of the content words of a text."""
    return F.filter(bare_words(col), lambda w: is_content_word(w, stop_words))


def default_stop_words():
    """General English stop words plus the study's own additions."""
    return sorted(set(GENERAL_STOP_WORDS) | set(EXTRA_STOP_WORDS))


def label_eq(col, value):
    """Label comparison that ignores case, outer blanks and the column's type."""
    return F.coalesce(F.lower(F.trim(_text(col))) == value.lower(), F.lit(False))


def length_gate(text, scored, shortest, otherwise=0):
    """``scored`` for texts of at least ``shortest`` characters, else ``otherwise``."""
    return F.when(F.length(clean_text(text)) < shortest, F.lit(otherwise)).otherwise(scored)


def preview(col, n):
    """Display form of a text: cut after ``n`` characters and marked with ``...``."""
    text = _text(col)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _text(col):
    return (F.col(col) if isinstance(col, str) else col).cast("string")
