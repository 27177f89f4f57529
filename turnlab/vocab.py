"""Label vocabularies and mapping dictionaries."""

# --- fixed values -----------------------------------------------------------
# Twelve dialogue-act codes and their full names.
DA_NAMES = {
    "ap": "Assertion_Persuasive",
    "ac": "Assertion_Committal",
    "dc": "Directive_Command",
    "do": "Directive_Offer",
    "il": "Interrogative_Leading",
    "ic": "Interrogative_Challenging",
    "in": "Interrogative_Neutral",
    "pa": "Position_Accept",
    "pr": "Position_Reject",
    "sp": "Signal_Positive",
    "sn": "Signal_Negative",
    "o": "Others",
}

# Meeting-corpus tag -> dialogue-act code. Every tag not listed means "o".
DA_OF_TAG = {
    "s": "ap",
    "df": "ap",
    "cc": "ac",
    "co": "dc",
    "cs": "do",
    "qy": "il",
    "g": "il",
    "qh": "ic",
    "qw": "in",
    "qrr": "in",
    "qr": "in",
    "qo": "in",
    "bh": "in",
    "bk": "pa",
    "aa": "pa",
    "na": "pa",
    "aap": "pa",
    "ar": "pr",
    "nd": "pr",
    "ng": "pr",
    "bsc": "pr",
    "j": "sp",
    "ft": "sp",
    "fw": "sp",
    "bd": "sn",
    "fa": "sn",
    "by": "sn",
}

# Donation-dialogue label -> outcome. Every label not listed means "Neutral".
OUTCOME_OF_LABEL = {
    "agree-donation": "Compliance",
    "confirm-donation": "Compliance",
    "positive-to-inquiry": "Compliance",
    "positive-reaction-to-donation": "Compliance",
    "disagree-donation": "Resistance",
    "disagree-donation-more": "Resistance",
    "negative-reaction-to-donation": "Resistance",
    "negative-to-inquiry": "Resistance",
    "acknowledgement": "Neutral",
    "greeting": "Neutral",
    "neutral-reaction-to-donation": "Neutral",
    "neutral-to-inquiry": "Neutral",
    "ask-donation-procedure": "Neutral",
    "ask-org-info": "Neutral",
    "ask-persuader-donation-intention": "Neutral",
    "closing": "Neutral",
    "other": "Neutral",
    "task-related-inquiry": "Neutral",
    "thank": "Neutral",
    "you-are-welcome": "Neutral",
    "provide-donation-amount": "Neutral",
    "personal-related-inquiry": "Neutral",
    "off-task": "Neutral",
}

# Polarity groups of the dialogue acts; DA+ wins over DA-, the rest is DAo.
DA_POSITIVE = ["pa", "sp"]
DA_NEGATIVE = ["pr", "sn", "ic", "dc"]

# Words left out of word frequencies on top of the general stop-word list.
EXTRA_STOP_WORDS = [
    "i", "you", "me", "my", "your", "we", "us", "it", "is", "are", "was", "were", "that", "this",
]

# General English stop words: the words of more than two letters, without apostrophe, in the list
# Spark ships (shorter words and words with an apostrophe cannot survive the cleaning anyway).
GENERAL_STOP_WORDS = """
myself our ours ourselves you your yours yourself yourselves him his himself she her hers herself its
itself they them their theirs themselves what which who whom this that these those are was were been
being have has had having does did doing the and but because until while for with about against between
into through during before after above below from down out off over under again further then once here
there when where why how all any both each few more most other some such nor not only own same than too
very can will just don should now cannot could ought would
""".split()

# Column names accepted as "the text column", in order of the table's columns.
TEXT_COLUMN_NAMES = ["sentence", "text", "content", "dialogue", "unit"]

# Outcome codes used by human raters.
OUTCOME_OF_CODE = {1: "Compliance", 0: "Neutral", -1: "Resistance"}
# --- end of fixed values ----------------------------------------------------

DA_CODES = list(DA_NAMES)
DA_GROUPS = ["DA+", "DA-", "DAo"]
VALID_PR = ["Compliance", "Resistance"]
PR_LABELS = ["Compliance", "Neutral", "Resistance"]
TRANSITIONS = [f"{a}→{b}" for a in VALID_PR for b in VALID_PR]
WITH_EVENT = "With_EML"
WITHOUT_EVENT = "Without_EML"
