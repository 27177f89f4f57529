import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from turnlab.operators import evaluate as ev
from turnlab.operators import stats


def test_erfc(spark):
    xs = [0.0, 0.01, 0.5, 1.0, 1.9, 2.0, 2.1, 3.0, 5.0, 8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x"))).collect()
    for x, v in got:
        assert v == pytest.approx(math.erfc(x), rel=1e-11, abs=1e-300)


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 7, 11, 16])
def test_chi2_tail(spark, dof):
    xs = [0.0, 0.3, 2.0, 10.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", stats.chi2_sf(F.col("x"), F.lit(dof))).collect()
    for x, v in got:  # Simpson over the density in u = sqrt(x)
        n, top = 20000, math.sqrt(x)
        f = lambda u: 2 * u ** (dof - 1) * math.exp(-u * u / 2) / (2 ** (dof / 2) * math.gamma(dof / 2))
        h = top / n
        area = h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))
        assert v == pytest.approx(1 - area, abs=1e-9)


def test_chi_square_equals_spark_ml(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 4), rng.randint(0, 2) + rng.randint(0, 1)) for _ in range(900)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in data], "r double, c double")
    mine = stats.chi_square(df, "r", "c").first()
    ml = ChiSquareTest.test(VectorAssembler(inputCols=["r"], outputCol="f").transform(df), "f", "c").first()
    assert mine["chi2"] == pytest.approx(ml["statistics"][0])
    assert mine["p_value"] == pytest.approx(ml["pValues"][0], abs=1e-10)
    assert mine["dof"] == ml["degreesOfFreedom"][0]


def test_yates_and_degenerate_tables(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 15}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "r string, c string")
    got = stats.chi_square(df, "r", "c").first()
    n, rows, cols = 75, {"a": 30, "b": 45}, {"x": 40, "y": 35}
    want = sum((abs(o - rows[r] * cols[c] / n) - 0.5) ** 2 / (rows[r] * cols[c] / n) for (r, c), o in cells.items())
    assert got["chi2"] == pytest.approx(want) and got["dof"] == 1
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))
    two = df.select(stats.chi_square_2x2(F.lit(10), F.lit(20), F.lit(30), F.lit(15))).first()[0]
    assert two == pytest.approx(want)
    one_row = stats.chi_square(df.where("r = 'a'"), "r", "c").first()
    assert one_row["chi2"] is None and one_row["p_value"] is None and one_row["dof"] == 0
    # a missing cell still counts with its expected value
    missing = df.where("not (r = 'b' and c = 'y')")
    n, rows, cols = 60, {"a": 30, "b": 30}, {"x": 40, "y": 20}
    want = sum((abs(o - e) - min(.5, abs(o - e))) ** 2 / e for o, e in
               [(10, 20.0), (20, 10.0), (30, 20.0), (0, 10.0)])
    assert stats.chi_square(missing, "r", "c").first()["chi2"] == pytest.approx(want)


def test_chi_square_of_a_large_table_keeps_its_digits(spark):
    rng = random.Random(5)
    cells = [(f"r{i}", c, rng.randint(4, 9) * 10 ** rng.randint(6, 10)) for i in range(40) for c in range(2) if i % 5 or c]
    rows, cols, n = {}, {}, sum(k for *_, k in cells)
    for r, c, k in cells:
        rows[r], cols[c] = rows.get(r, 0) + k, cols.get(c, 0) + k
    seen = {(r, c): k for r, c, k in cells}
    expected = {(r, c): Fraction(rows[r] * cols[c], n) for r in rows for c in cols}
    want = float(sum((seen.get(x, 0) - e) ** 2 / e for x, e in expected.items()))
    table = spark.createDataFrame(cells, "r string, c int, n long")
    with pytest.MonkeyPatch.context() as patch:  # counted already, as no test has so many rows
        patch.setattr(stats, "cell_counts", lambda *_: table)
        assert stats.chi_square(table, "r", "c").first()["chi2"] == pytest.approx(want, rel=1e-14, abs=0)
        # nearly independent: a small statistic of large counts
        even = [(r, c, 10 ** 9 + (r == 0 and c == 0)) for r in range(3) for c in range(3)]
        total = sum(k for *_, k in even)
        sides = [sum(k for r, _, k in even if r == i) for i in range(3)]
        want = sum((k - Fraction(sides[r] * sides[c], total)) ** 2 / Fraction(sides[r] * sides[c], total) for r, c, k in even)
        table = spark.createDataFrame(even, "r int, c int, n long")
        assert stats.chi_square(table, "r", "c").first()["chi2"] == pytest.approx(float(want), rel=1e-12, abs=0)


def test_mann_whitney_against_ranks(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), round(rng.random(), 1) if rng.random() < .5 else rng.random()) for _ in range(400)]
    df = spark.createDataFrame(data + [("c", 0.1), ("a", None)], "g string, v double").repartition(6)
    got = stats.mann_whitney(df, "g", "v", "a", "b").first()
    a, b = ([v for g, v in data if g == k] for k in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (got["u_a"], got["u_b"]) == (u, len(a) * len(b) - u)
    n, values = len(data), [v for _, v in data]
    ties = sum(t ** 3 - t for t in (values.count(x) for x in set(values)))
    s = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - .5) / s
    assert got["z"] == pytest.approx(z) and got["p_value"] == pytest.approx(min(1, math.erfc(z / math.sqrt(2))))


@pytest.mark.parametrize("sizes", [(1, 1), (3, 4), (5, 2), (6, 6), (8, 5)])
def test_small_groups_have_the_exact_rank_sum_p(spark, sizes):
    """Against all choices of the first group's ranks."""
    rng = random.Random(sum(sizes))
    n = sum(sizes)
    us = [sum(ranks) - sizes[0] * (sizes[0] - 1) // 2 for ranks in itertools.combinations(range(n), sizes[0])]
    for shift in (0, .4):
        a, b = [rng.random() + shift for _ in range(sizes[0])], [rng.random() for _ in range(sizes[1])]
        u = sum(x > y for x in a for y in b)
        top = max(u, len(a) * len(b) - u)
        df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double").repartition(3)
        got = stats.mann_whitney(df, "g", "v", "a", "b").first()
        assert got["exact"] and got["p_value"] == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))
    tied = df.union(spark.createDataFrame([("a", b[0])], "g string, v double"))
    assert not stats.mann_whitney(tied, "g", "v", "a", "b").first()["exact"]


def test_exact_rank_sum_p_at_its_largest(spark):
    """8 against 500 rows: every choice of 8 ranks whose sum is as low counts, by a plain table of counts."""
    df = spark.createDataFrame([("a", i * 62 + .5) for i in range(8)] + [("b", float(i)) for i in range(500)], "g string, v double")
    got = stats.mann_whitney(df, "g", "v", "a", "b").first()
    low = int(min(got["u_a"], got["u_b"]))
    ways = {(0, 0): 1}
    for rank in range(1, 509):
        for (k, u), w in list(ways.items()):
            if k < 8 and u + rank - k - 1 <= low:
                ways[k + 1, u + rank - k - 1, rank] = w
        for key in [x for x in ways if len(x) == 3]:
            ways[key[:2]] = ways.get(key[:2], 0) + ways.pop(key)
    want = 2 * sum(w for (k, _), w in ways.items() if k == 8) / math.comb(508, 8)
    assert got["exact"] and got["p_value"] == pytest.approx(min(1, want))
    assert not stats.mann_whitney(df, "g", "v", "a", "b", exact_cells=3_999).first()["exact"]
    empty = stats.mann_whitney(df, "g", "v", "a", "none").first()
    assert empty["z"] is None and empty["p_value"] == 1 and not empty["exact"]


def test_logit_is_the_log_odds_ratio(spark):
    cells = {("ap", "Compliance"): 30, ("ap", "Resistance"): 10, ("pa", "Compliance"): 8, ("pa", "Resistance"): 12}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "act string, out string")
    closed = {r["term"]: r for r in stats.category_logit(df, "out", "Compliance", "act").collect()}
    table = {r["term"]: r for r in stats.logit_table(df, "out", "Compliance", "act", ["ap", "pa"], "ap").collect()}
    assert table["Intercept"]["coefficient"] == pytest.approx(math.log(3), abs=1e-6)
    for term, row in table.items():  # the closed form is the fit
        for c in ("coefficient", "std_error", "p_value", "odds_ratio", "pseudo_r2", "lr_p_value"):
            assert closed[term][c] == pytest.approx(row[c], abs=1e-5), (term, c)
        assert closed[term]["mark"] == row["mark"]
    one_sided = df.union(spark.createDataFrame([("sn", "Compliance")] * 3, df.schema))
    odd = {r["term"]: r for r in stats.category_logit(one_sided, "out", "Compliance", "act").collect()}
    assert odd["sn"]["coefficient"] is None and odd["pa"]["coefficient"] == pytest.approx(closed["pa"]["coefficient"])
    assert table["pa"]["odds_ratio"] == pytest.approx((8 / 12) / 3, abs=1e-6)
    assert table["pa"]["std_error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 8 + 1 / 12), abs=1e-5)
    z = math.log((8 / 12) / 3) / math.sqrt(1 / 30 + 1 / 10 + 1 / 8 + 1 / 12)
    p = math.erfc(abs(z) / math.sqrt(2))  # 0.01008, just above the limit of two stars
    assert table["pa"]["p_value"] == pytest.approx(p, abs=1e-6) and table["pa"]["mark"] == "*"
    ll = lambda *ns: sum(n * math.log(n / sum(ns)) for n in ns)
    assert table["pa"]["pseudo_r2"] == pytest.approx(1 - (ll(30, 10) + ll(8, 12)) / ll(38, 22), abs=1e-6)
    effect = stats.or_direction(spark.createDataFrame([tuple(r) for r in table.values()], schema=stats.logit_table(
        df, "out", "Compliance", "act", ["ap", "pa"], "ap").schema)).collect()
    assert [(r["term"], r["effect"]) for r in effect] == [("pa", "lowers")]


def test_category_vif_is_that_of_the_dummies(spark):
    acts = ["ap"] * 9 + ["pa"] * 5 + ["sn"] * 3
    df = spark.createDataFrame([(a, float(a == "pa"), float(a == "sn")) for a in acts], "act string, pa double, sn double")
    want = {"DA_" + r["variable"]: r["vif"] for r in stats.vif(df, ["pa", "sn"]).collect()}
    got = {r["variable"]: r["vif"] for r in stats.category_vif(df, "act").collect()}
    assert got == pytest.approx(want)


def test_vif(spark):
    data = [(float(i), float(i % 7), 2.0 * i + (i % 3)) for i in range(60)]
    got = {r["variable"]: r["vif"] for r in stats.vif(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a"] > 100 and got["b"] < 2


def test_classification_counts(spark):
    pairs = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 10
    df = spark.createDataFrame(pairs, "y int, p int")
    m = ev.binary_metrics(df, "y", "p").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (5, 3, 2, 10)
    assert m["f1"] == pytest.approx(10 / 15) and m["accuracy"] == 0.75
    table = ev.confusion(df, "y", "p", [0, 1, 2]).collect()
    assert len(table) == 9 and sum(r["n"] for r in table if r["gold"] == r["pred"]) / 20 == m["accuracy"]
    none = ev.binary_metrics(df.where("p = 0"), "y", "p").first()
    assert none["precision"] == 0 and none["f1"] == 0


def test_multilabel(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["b"]), (["c"], [])], "y array<string>, p array<string>")
    m = ev.multilabel_metrics(df, "y", "p", ["a", "b", "c"]).first()
    assert m["exact_match"] == pytest.approx(1 / 3) and m["label_accuracy"] == pytest.approx(6 / 9)
    assert m["micro_f1"] == pytest.approx(2 * 2 / (4 + 1 + 2))
    k = ev.kappa(df, "y", "p", ["a", "b", "c"]).first()
    po, pe = 6 / 9, 4 / 9 * 3 / 9 + 5 / 9 * 6 / 9
    assert k["cohen_kappa"] == pytest.approx((po - pe) / (1 - pe)) and k["pabak"] == pytest.approx(2 * po - 1)
