import pytest
from pyspark.sql import functions as F

from turnlab.functions import clean
from turnlab.functions import labels as lab
from turnlab.functions import scores as sc


@pytest.fixture(scope="module")
def ev(spark):
    """Value of an expression over one row of named values."""
    def run(expr, schema="x string", *values):
        return spark.createDataFrame([values], schema).select(expr.alias("v")).first()[0]
    return run


@pytest.mark.parametrize("text,want", [
    ("['a', 'b']", ["a", "b"]), ("['a', 'a']", ["a", "a"]), ("[]", []), (None, []), ("", []),
    ('["a", "b c"]', ["a", "b c"]), ("['greeting, thanks']", ["greeting", "thanks"]),
])
def test_parse_list(ev, text, want):
    assert ev(lab.parse_list("x"), "x string", text) == want


def test_split_labels(ev):
    assert ev(lab.split_labels("x"), "x string", " a, b ,,a") == ["a", "b", "a"]
    assert ev(lab.split_labels("x"), "x string", None) == []


def test_mapping(ev):
    assert ev(lab.map_label("x"), "x string", "agree-donation") == "Compliance"
    for odd in ("", None, "no-such-label", "greeting"):
        assert ev(lab.map_label("x"), "x string", odd) == "Neutral"
    assert ev(lab.map_da("x"), "x string", " qy ") == "il"
    assert ev(lab.map_da("x"), "x string", "%") == "o"
    assert ev(lab.da_full_name("x"), "x string", "sn") == "Signal_Negative"


@pytest.mark.parametrize("arr,resolved,result", [
    ([], "Neutral", "Neutral"), (["Neutral"], "Neutral", "Neutral"),
    (["Neutral", "Compliance"], "Compliance", "Compliance"), (["Resistance"], "Resistance", "Resistance"),
    (["Neutral", "Compliance", "Resistance"], "Conflict", "Neutral"),
    (["Resistance", "Compliance"], "Conflict", "Resistance"),
])
def test_resolution(ev, arr, resolved, result):
    assert ev(lab.resolve_label("x"), "x array<string>", arr) == resolved
    assert ev(lab.persuasion_result("x"), "x array<string>", arr) == result


@pytest.mark.parametrize("text,want", [
    ("pa", "DA+"), ("sn", "DA-"), ("sn,sp", "DA+"), ("o, dc", "DA-"), ("ap", "DAo"), (None, "DAo"), ("pab", "DAo")])
def test_da_group(ev, text, want):
    assert ev(lab.da_group("x"), "x string", text) == want


@pytest.mark.parametrize("votes,want", [
    ((1, 1, 0), 1), ((1, 0, -1), None), ((None, None, None), None), ((None, 1, 0), 0), ((None, 1, None), 1),
    ((0, 0, 0), 0)])
def test_majority(ev, votes, want):
    assert ev(lab.majority(["a", "b", "c"]), "a int, b int, c int", *votes) == want


def test_rater_flags(ev):
    assert ev(lab.any_positive(["a", "b"]), "a int, b int", None, 1) == 1
    assert ev(lab.any_positive(["a", "b"]), "a int, b int", None, None) == 0
    assert ev(lab.agree("a", "b"), "a int, b int", 1, 1) == 1
    assert ev(lab.agree("a", "b"), "a int, b int", 1, 0) == 0
    assert ev(lab.agree("a", "b"), "a int, b int", None, 0) is None


def test_binary_vector(spark):
    row = spark.createDataFrame([("['PA', 'zz']",)], "x string").select(*lab.da_binary("x")).first().asDict()
    assert row["da_pa"] == 1 and sum(row.values()) == 1 and len(row) == 12


@pytest.mark.parametrize("text,want", [("Label: 1", 1), ("0 or 1", 0), ("yes", 0), ("", 0), (None, 0)])
def test_reply(ev, text, want):
    assert ev(lab.parse_binary_reply("x"), "x string", text) == want


def test_numbers(ev):
    assert ev(clean.to_number("x"), "x string", "1.5") == 1.5
    assert ev(clean.to_number("x"), "x string", "one") is None
    assert ev(clean.to_flag("x"), "x string", None) == 0
    assert ev(clean.digits_flag("x"), "x string", "[1]") == 1
    assert ev(clean.digits_flag("x"), "x string", "none") == 0


def test_text(ev):
    assert ev(clean.clean_text_keep_endmarks("x"), "x string", "  Hé,  how ARE you?!\n(x) ") == "hé how are you?! x"
    assert ev(clean.content_words("x"), "x string", "The cats don't sit on my chair_1, été!") == [
        "cats", "dont", "sit", "chair_1", "été"]
    assert ev(clean.preview("x", 3), "x string", "abcd") == "abc..."
    assert ev(clean.preview("x", 4), "x string", "abcd") == "abcd"
    assert ev(clean.length_gate("x", F.lit(1), 5), "x string", " abc ") == 0
    assert ev(clean.length_gate("x", F.lit(1), 5), "x string", "abcde") == 1
    assert ev(clean.label_eq("x", "Compliance"), "x string", " COMPLIANCE ") is True
    assert ev(clean.label_eq("x", "Compliance"), "x string", None) is False
    assert ev(clean.non_blank("x"), "x string", "  ") is False


def test_score_arrays(ev):
    probs = ev(sc.softmax("x"), "x array<double>", [1000.0, 1000.0])
    assert probs == [0.5, 0.5]
    assert ev(sc.top_label("x", ["a", "b"]), "x array<double>", [0.2, 0.8]) == "b"
    assert ev(sc.threshold_labels("x", ["a", "b", "c"], 0.5), "x array<double>", [0.6, 0.1, 0.7]) == ["a", "c"]
    # nothing above the threshold: the row's own best label
    assert ev(sc.threshold_labels("x", ["a", "b", "c"], 0.5), "x array<double>", [0.1, 0.4, 0.3]) == ["b"]
    assert ev(sc.gated_label("x", 0.6), "x array<double>", [0.45, 0.55]) == 0
    assert ev(sc.gated_label("x", 0.6), "x array<double>", [0.3, 0.7]) == 1


def test_rounding_follows_the_binary_value(spark):
    xs = [0.5035, 0.0625, 0.1875, 2.6755, 1234.5675, -0.0005, 0.0, 1e-9] + [i / 2000 for i in range(1, 4000, 2)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", clean.round_exact(F.col("x"), 3)).collect()
    assert [(x, round(x, 3)) for x, _ in got] == [tuple(r) for r in got]
