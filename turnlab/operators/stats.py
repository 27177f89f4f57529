"""Significance tests, regression and collinearity."""

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.functions.counts import rows_n
from turnlab.operators.ordering import cumulate
from turnlab.functions.labels import one_hot

EXACT_MOST = 8          # rows of the smaller group up to which a rank-sum test is exact, as usual in such tests
EXACT_CELLS = 4_000     # pairs of rows up to which it is: the exact count takes about their number squared


def erfc(z):
    """Complementary error function of a non-negative Column, for the few rows of a finished test.

    A power series below 2 and a continued fraction from there on, both folded over a sequence.
    """
    nth = lambda n: F.sequence(F.lit(1), F.lit(n))
    start = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(nth(60), start, lambda acc, i: F.struct(
        (acc["term"] * 2 * z * z / (2 * i + 1)).alias("term"),
        (acc["sum"] + acc["term"] * 2 * z * z / (2 * i + 1)).alias("sum")))["sum"]
    fraction = F.aggregate(nth(120), z, lambda acc, i: z + (121 - i) / 2 / acc)
    decay = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2, 1 - 2 * decay * series).otherwise(decay / fraction)


def chi2_sf(x, dof):
    """Chi-square tail probability for whole degrees of freedom, in closed form.

    The tail starts from ``exp(-x/2)`` or ``erfc(sqrt(x/2))`` and gains one term per two degrees.
    """
    half = F.greatest(x.cast("double") / 2, F.lit(0.0))
    odd = (dof % 2).cast("double")
    first = F.when(odd == 1, 2 * F.sqrt(half / math.pi)).otherwise(1.0) * F.exp(-half)
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    steps = F.when(dof >= 2, F.sequence(F.lit(1), F.floor(dof / 2).cast("int")))
    terms = F.aggregate(F.coalesce(steps, F.array().cast("array<int>")), start, lambda acc, i: F.struct(
        (acc["term"] * half / (i + odd / 2)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))
    base = F.when(odd == 1, erfc(F.sqrt(half))).otherwise(0.0)
    return F.when(dof >= 1, F.least(base + terms["sum"], F.lit(1.0)))


def normal_two_sided(z):
    """P(|Z| > z) of the standard normal distribution."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi_square_2x2(a, b, c, d):
    """Statistic of a 2x2 table with the continuity correction, as an expression of its cells."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    scale = (a + b) * (c + d) * (a + c) * (b + d)
    # |o - e| = gap / n in every cell; the correction takes at most 0.5 off it
    left = gap - F.least(n / 2, gap)
    return F.try_divide(n * left * left, scale)


def cell_counts(df, row, col):
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row, col).agg(rows_n().alias("n")))


def _with_margins(cells, row, col):
    every = W.partitionBy(F.lit(0))
    return (cells.withColumn("_r", F.sum("n").over(W.partitionBy(row)))
            .withColumn("_c", F.sum("n").over(W.partitionBy(col)))
            .withColumn("_n", F.sum("n").over(every)))


def expected_counts(df, row, col):
    """Observed and expected count of every cell that occurs."""
    expected = F.col("_r") * F.col("_c") / F.col("_n")
    return _with_margins(cell_counts(df, row, col), row, col).select(
        row, col, "n", expected.alias("expected"))


def chi_square(df, row, col, p_value=True):
    """Pearson test of independence: statistic, degrees of freedom, p.

    Cells that do not occur need no row: together they add their expected counts, (n^2 - sum(r c)) / n. Differences are
    taken between whole numbers, so that a large table loses no digits. With one degree of freedom the continuity correction
    applies, as is usual for 2x2 tables. The statistic is NULL when a table has a single row or column.
    """
    cells = _with_margins(cell_counts(df, row, col), row, col)
    r, c, n = (F.col(x).cast("double") for x in ("_r", "_c", "_n"))
    whole = {x: F.col(x).cast("decimal(18,0)") for x in ("n", "_r", "_c", "_n")}
    gap = (whole["n"] * whole["_n"] - whole["_r"] * whole["_c"]).cast("double")  # n (o - e)
    sums = cells.agg(
        F.count_distinct(row).alias("_rows"), F.count_distinct(col).alias("_cols"),
        F.max("_n").alias("n"), F.sum(gap * gap / (n * r * c)).alias("_s"),
        F.sum(whole["_r"] * whole["_c"]).alias("_e"), F.max(F.abs(gap) / n).alias("_d"),
        F.min(r).alias("_rmin"), F.min(c).alias("_cmin"))
    total, whole_n = F.col("n").cast("double"), F.col("n").cast("decimal(18,0)")
    dof = (F.col("_rows") - 1) * (F.col("_cols") - 1)
    plain = F.col("_s") + (whole_n * whole_n - F.col("_e")).cast("double") / total
    # sum of 1/e over a 2x2 table; its second row and column sum follow from the first
    inverse = total * (1 / F.col("_rmin") + 1 / (total - F.col("_rmin"))) * (
        1 / F.col("_cmin") + 1 / (total - F.col("_cmin")))
    left = F.col("_d") - F.least(F.lit(0.5), F.col("_d"))
    statistic = F.when(dof > 1, plain).when(dof == 1, left * left * inverse)
    out = sums.select(statistic.alias("chi2"), dof.cast("long").alias("dof"), "n")
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))) if p_value else out


def sig_mark(p):
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".")
            .otherwise(""))


def significant(p, level=0.05):
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < level, "significant").otherwise("not significant")


def assoc_p_values(assoc, level=0.05):
    """p value and mark of the 2x2 tests of an association table."""
    tested = assoc.withColumn("p_value", chi2_sf(F.col("chi2"), F.lit(1)))
    return tested.withColumn("sig", F.when(F.col("p_value") < level, "*").otherwise(""))


def exact_u_two_sided(low, n_a, n_b):
    """Exact two-sided p of a rank-sum statistic whose smaller side is ``low``, for groups without ties.

    Values are taken in rank order; the k-th one that falls to the smaller group leaves (rank - k) of the other group
    below it. ``ways[k][u]`` counts the choices of k values so far that leave u below, up to ``low`` only; after rank
    low + k nothing more can add to them.
    """
    low = F.round(low).cast("int")
    k_most = F.least(n_a, n_b).cast("int")
    total = (n_a + n_b).cast("int")
    below = F.sequence(F.lit(0), low)
    start = F.transform(F.sequence(F.lit(0), k_most), lambda k: F.transform(
        below, lambda u: F.when((k == 0) & (u == 0), F.lit(1.0)).otherwise(F.lit(0.0))))

    def take(ways, rank):
        return F.transform(ways, lambda row, k: F.transform(row, lambda n, u: n + F.when(
            (k > 0) & (k <= rank) & (u >= rank - k), F.get(F.get(ways, k - 1), u - rank + k)).otherwise(F.lit(0.0))))

    ranks = F.sequence(F.lit(1), F.least(total, low + k_most))
    ways = F.aggregate(ranks, start, take)
    hits = F.aggregate(F.get(ways, k_most), F.lit(0.0), lambda a, n: a + n)
    choices = F.aggregate(F.sequence(F.lit(1), k_most), F.lit(1.0), lambda a, i: a * (total - k_most + i) / i)
    return F.least(F.lit(1.0), 2 * hits / choices)


def mann_whitney(df, group, x, a, b, p_value=True, exact_cells=EXACT_CELLS):
    """Two-sided rank-sum test of x between groups a and b.

    Works on the count per distinct value and the counts below it, so no rank is ever assigned to a
    row and no task sees all values. The p value is exact (``exact`` is true) where no two values are equal, a group has
    at most EXACT_MOST rows and n_a * n_b is at most ``exact_cells``; else it is that of the normal approximation,
    corrected for ties, and 1 where there is no z (an empty group, all values equal).
    """
    counts = (df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()).groupBy(x)
              .agg(F.count_if(F.col(group) == a).alias("na"),
                   F.count_if(F.col(group) == b).alias("nb")))
    ranked = cumulate(counts, x, ["na", "nb"])
    t = (F.col("na") + F.col("nb")).cast("double")
    sums = ranked.agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"),
        F.sum(F.col("na") * (F.col("below_nb") + F.col("nb") / 2)).alias("u_a"),
        F.sum(F.col("nb") * (F.col("below_na") + F.col("na") / 2)).alias("u_b"),
        F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, mean = na + nb, na * nb / 2
    spread = F.sqrt(na * nb / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    top = F.greatest("u_a", "u_b")
    out = sums.select("n_a", "n_b", "u_a", "u_b", F.try_divide(top - mean - 0.5, spread).alias("z"), "_ties")
    if p_value:
        exact = ((F.col("_ties") == 0) & F.least("n_a", "n_b").between(1, EXACT_MOST)
                 & (F.col("n_a") * F.col("n_b") <= exact_cells))
        out = out.withColumn("exact", F.coalesce(exact, F.lit(False)))
        # Not asked for elsewhere, so that a large statistic never becomes the length of an array.
        low, n_a, n_b = (F.when(F.col("exact"), c).otherwise(F.lit(other)) for c, other in (
            (F.least("u_a", "u_b"), 0), (F.col("n_a"), 1), (F.col("n_b"), 1)))
        z = F.greatest("z", F.lit(0.0))
        out = out.withColumn("p_value", F.when(F.col("exact"), exact_u_two_sided(low, n_a, n_b)).otherwise(
            F.least(normal_two_sided(z), F.lit(1.0)))).select("n_a", "n_b", "u_a", "u_b", "z", "p_value", "exact")
    return out.drop("_ties")


def _by_category(df, label, positive, category):
    """(category, n, c, r): rows of a category, and those with and without the positive label; and the reference
    category, the commonest one (label order on ties), as a struct Column."""
    rows = df.where(F.col(label).isNotNull() & F.col(category).isNotNull())
    k = rows.groupBy(F.col(category).alias("term")).agg(
        rows_n().cast("double").alias("n"), F.count_if(F.col(label) == positive).cast("double").alias("c"))
    k = k.withColumn("r", F.col("n") - F.col("c"))
    reference = k.agg(F.min_by(F.struct("term", "n", "c", "r"), F.struct(-F.col("n"), "term"))).scalar()
    return k, reference


def category_logit(df, label, positive, category):
    """Logistic regression of ``label == positive`` on one category, in its closed form.

    The same table as ``logit_table``: coefficients are differences of log odds to the reference category, so one
    grouped table and one reference row do. A category with one outcome only has no finite coefficient: NULL.
    """
    k, ref = _by_category(df, label, positive, category)
    part = lambda x, n: F.coalesce(x * F.ln(F.try_divide(x, n)), F.lit(0.0))
    sums = k.agg(F.struct(
        F.sum(part(F.col("c"), F.col("n")) + part(F.col("r"), F.col("n"))).alias("fit"),
        (part(F.sum("c"), F.sum("n")) + part(F.sum("r"), F.sum("n"))).alias("none"),
        (rows_n() - 1).alias("terms"))).scalar()
    odds = lambda x: F.when((x["c"] > 0) & (x["r"] > 0), F.ln(x["c"] / x["r"]))
    noise = lambda x: F.try_divide(F.lit(1.0), x["c"]) + F.try_divide(F.lit(1.0), x["r"])
    own = F.struct("c", "r")
    is_ref = F.col("term") == F.col("_ref")["term"]
    rows = k.withColumn("_ref", ref).withColumn("_sums", sums).select(
        F.when(is_ref, "Intercept").otherwise(F.col("term")).alias("term"),
        F.when(is_ref, odds(own)).otherwise(odds(own) - odds(F.col("_ref"))).alias("coefficient"),
        F.sqrt(F.when(is_ref, noise(own)).otherwise(noise(own) + noise(F.col("_ref")))).alias("std_error"), "_sums")
    gain = 2 * (F.col("_sums")["fit"] - F.col("_sums")["none"])
    return (rows.withColumn("p_value", normal_two_sided(F.col("coefficient") / F.col("std_error")))
            .withColumn("odds_ratio", F.exp("coefficient")).withColumn("mark", sig_mark("p_value"))
            .withColumn("pseudo_r2", 1 - F.try_divide(F.col("_sums")["fit"], F.col("_sums")["none"]))
            .withColumn("lr_p_value", chi2_sf(gain, F.col("_sums")["terms"])).drop("_sums"))


def category_vif(df, category):
    """Variance inflation factors of a category's dummies, in closed form: a dummy regressed on the others is constant
    on its own and the reference group."""
    k, ref = _by_category(df, category, None, category)
    total = k.agg(F.sum("n")).scalar()
    rows = k.withColumn("_ref", ref).withColumn("_total", total).where(F.col("term") != F.col("_ref")["term"])
    n, m = F.col("n"), F.col("_ref")["n"]
    return rows.select(F.concat(F.lit("DA_"), "term").alias("variable"),
                       ((1 - n / F.col("_total")) * (n + m) / m).alias("vif"))


def logit_table(df, label, positive, category, values, reference):
    """Logistic regression of ``label == positive`` on dummies of given category values, by iterated fitting.

    For one category alone ``category_logit`` needs no fit and no list of values.

    One row per term (the intercept under its own name) with coefficient, standard error, p value,
    odds ratio and mark, plus the fit's pseudo R-squared and likelihood-ratio statistic. Rows with
    the same category and outcome are one weighted row of the fit.
    """
    dummies = one_hot(category, values, reference=reference)
    names = [f"DA_{v}" for v in values if v != reference]
    y = (F.col(label) == positive).cast("double")
    grouped = (df.where(F.col(label).isNotNull() & F.col(category).isNotNull())
               .groupBy(category, y.alias("y")).agg(rows_n().cast("double").alias("w")))
    data = VectorAssembler(inputCols=names, outputCol="x").transform(
        grouped.select("y", "w", *dummies))
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="x", labelCol="y", weightCol="w",
        maxIter=100, tol=1e-10).fit(data)
    summary = model.summary
    # the summary lists the intercept after the other terms
    rows = list(zip(names + ["Intercept"], [float(c) for c in model.coefficients] + [model.intercept],
                    summary.coefficientStandardErrors, summary.pValues))
    table = df.sparkSession.createDataFrame(
        [(n.replace("DA_", ""), float(c), float(s), float(p)) for n, c, s, p in rows],
        "term string, coefficient double, std_error double, p_value double")
    gain = float(summary.nullDeviance - summary.deviance)
    return (table.withColumn("odds_ratio", F.exp("coefficient"))
            .withColumn("mark", sig_mark("p_value"))
            .withColumn("pseudo_r2", F.lit(1 - float(summary.deviance / summary.nullDeviance)))
            .withColumn("lr_p_value", chi2_sf(F.lit(gain), F.lit(len(names)))))


def or_direction(table, level=0.05):
    """What each significant term does to the odds; the intercept is no term."""
    verdict = (F.when(F.col("p_value") >= level, "no effect")
               .when(F.col("odds_ratio") > 1, "raises").otherwise("lowers"))
    return table.where("term <> 'Intercept'").withColumn("effect", verdict)


def vif(df, cols):
    """Variance inflation factor per regressor, from the inverse of their correlation matrix.

    Only the matrix (one row per regressor) reaches the driver.
    """
    data = VectorAssembler(inputCols=list(cols), outputCol="x").transform(df.select(*cols))
    matrix = Correlation.corr(data, "x").first()[0].toArray()
    factors = np.diag(np.linalg.pinv(matrix))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, factors)], "variable string, vif double")
