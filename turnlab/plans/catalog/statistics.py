"""Queries of tests and regressions."""

from pyspark.sql import functions as F

from turnlab.functions.labels import da_group
from turnlab.operators import sequence as seq
from turnlab.operators import stats
from turnlab.operators import tables as tab
from turnlab.plans.catalog.registry import on_turns
from turnlab.plans.catalog.relations import MATCHED, PREV, TIMED
from turnlab.plans.catalog.tabulation import GRID, GROUPED, rounded


def test_sql(p_value, yates=False, nested=None):
    """The textbook form over the full grid; p in closed form for an even number of degrees."""
    part = "(abs(n - e) - least(0.5, abs(n - e))) ** 2 / e" if yates else "(n - e) ** 2 / e"
    base = f"""
e AS (SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE * sum(n) OVER (PARTITION BY c)::DOUBLE
             / sum(n) OVER ()::DOUBLE AS e FROM g),
x AS (SELECT sum({part}) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof,
             CAST(sum(n) AS BIGINT) AS n FROM e)
"""
    p = f", round({p_value}, 8) AS p_value" if p_value else ""
    result = f"SELECT round(chi2, 8) AS chi2, dof, n{p} FROM x"
    return f"{base}, {nested} AS ({result})" if nested else f"{base} {result}"


P2 = "exp(-chi2 / 2)"
P6 = "exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2)"


@on_turns("prev_eml_outcome_test", f"""
WITH {PREV}, {GRID.format(r='prev_eml_label', c='pr_label', t='p')}, {test_sql(P2)}""")
def prev_eml_outcome_test(t):
    return rounded(stats.chi_square(seq.prev_label(t), "prev_eml_label", "pr_label"), "chi2", "p_value")


@on_turns("timing_outcome_test", f"""
WITH {TIMED}, {GRID.format(r='timing', c='pr_label', t='timed')}, {test_sql(P2)}""")
def timing_outcome_test(t):
    return rounded(stats.chi_square(seq.label_timing(t), "timing", "pr_label"), "chi2", "p_value")


@on_turns("prev_eml_act_group_test", f"""
WITH {GROUPED}, {GRID.format(r='prev_eml_label', c='da_group', t='q')}, {test_sql(P2)}""")
def prev_eml_act_group_test(t):
    rows = seq.prev_label(t).withColumn("da_group", da_group("da_label"))
    return rounded(stats.chi_square(rows, "prev_eml_label", "da_group"), "chi2", "p_value")


JOINT = f"""{GROUPED}, j AS (SELECT prev_da_group || '_EML' || prev_eml_label AS key, pr_label, prev_da_group, eml_label
                          FROM q WHERE prev_da_label IS NOT NULL AND prev_da_group <> 'DAo')"""


@on_turns("joint_condition_test", f"""
WITH {JOINT}, {GRID.format(r='key', c='pr_label', t='j')}, {test_sql(P6)}""")
def joint_condition_test(t):
    rows = (seq.prev_label(t, ["eml_label", "da_label"]).withColumn("g", da_group("prev_da_label"))
            .where("g <> 'DAo'").withColumn("key", tab.concat_key("g", "prev_eml_label")))
    return rounded(stats.chi_square(rows, "key", "pr_label"), "chi2", "p_value")


@on_turns("prev_act_group_eml_test", f"""
WITH {JOINT}, {GRID.format(r='prev_da_group', c='eml_label', t='j')}, {test_sql('', yates=True)}""")
def prev_act_group_eml_test(t):
    rows = (seq.prev_label(t, ["eml_label", "da_label"]).withColumn("g", da_group("prev_da_label"))
            .where("g <> 'DAo'"))
    return rounded(stats.chi_square(rows, "g", "eml_label", p_value=False), "chi2")


@on_turns("act_eml_test", f"""
WITH {GRID.format(r='da_label', c='eml_label', t='turns')}, {test_sql('')}""")
def act_eml_test(t):
    return rounded(stats.chi_square(t, "da_label", "eml_label", p_value=False), "chi2")


# An odd number of degrees has no elementary tail: Simpson's rule over the density, substituted
# x = u^2 to be smooth at zero, in 4000 panels.
def odd_tail_sql(chi2, dof):
    density = f"2 * u ** ({dof} - 1) * exp(-u * u / 2) / (2 ** ({dof} / 2e0) * gamma({dof} / 2e0))"
    return f"""
1 - (SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * sqrt({chi2}) / 12000
     FROM (SELECT i, i / 4000e0 * sqrt({chi2}) AS u FROM range(4001) x(i)))"""


@on_turns("act_eml_test_with_p", f"""
WITH {GRID.format(r='da_label', c='eml_label', t='turns')}, {test_sql('', nested='y')},
z AS (SELECT *, {odd_tail_sql('chi2', 'dof')} AS p FROM y)
SELECT chi2, dof, n, round(p, 7) AS p_value,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS mark,
       CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM z""")
def act_eml_test_with_p(t):
    out = stats.chi_square(t, "da_label", "eml_label")
    marked = out.withColumn("mark", stats.sig_mark("p_value")).withColumn(
        "verdict", stats.significant("p_value"))
    return rounded(rounded(marked, "chi2"), "p_value", digits=7)


@on_turns("act_eml_expected", f"""
WITH {GRID.format(r='da_label', c='eml_label', t='turns')}
SELECT r AS da_label, c AS eml_label, n, e AS expected FROM (
  SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE * sum(n) OVER (PARTITION BY c)::DOUBLE
            / sum(n) OVER ()::DOUBLE AS e FROM g) WHERE n > 0""")
def act_eml_expected(t):
    return stats.expected_counts(t, "da_label", "eml_label")


RANKS = """
x AS (SELECT pr_confidence AS v, count(*) FILTER (timing = 'before_EML')::DOUBLE AS a,
             count(*) FILTER (timing = 'after_EML')::DOUBLE AS b FROM timed GROUP BY 1),
r AS (SELECT *, coalesce(sum(b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
s AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * (below + b / 2)) AS u,
             sum((a + b) ** 3 - (a + b)) AS ties FROM r),
w AS (SELECT CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, u AS u_a, na * nb - u AS u_b,
       (greatest(u, na * nb - u) - na * nb / 2 - 0.5)
       / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z FROM s)
"""


@on_turns("confidence_rank_test", f"""
WITH {TIMED}, {RANKS}, y AS (SELECT *, greatest(z, 0) ** 2 AS zz FROM w)
SELECT n_a, n_b, u_a, u_b, round(z, 8) AS z,
       round(CASE WHEN z <= 0 THEN 1 ELSE {odd_tail_sql('zz', '1')} END, 7) AS p_value FROM y""")
def confidence_rank_test(t):
    out = stats.mann_whitney(seq.label_timing(t), "timing", "pr_confidence", "before_EML", "after_EML")
    return rounded(rounded(out.drop("exact"), "z"), "p_value", digits=7)


def matched_acts(t):
    """Matched rows with an act text; as in the study the whole list is the category."""
    return seq.nearest_labels(t).where("eml_da_type is not null").withColumn("act", F.col("eml_da_type"))


@on_turns("frequent_matched_acts", f"""
WITH {MATCHED}, all_acts AS (SELECT idx, eml_da_type AS act FROM matched WHERE eml_da_type IS NOT NULL)
SELECT idx, act FROM all_acts WHERE act IN (SELECT act FROM all_acts GROUP BY 1 HAVING count(*) >= 5)""")
def frequent_matched_acts(t):
    return tab.where_frequent(matched_acts(t), "act", 5).select("idx", "act")


# With one category the fit has a closed form: log odds and their differences to the reference act.
LOGIT = f"""
{MATCHED}, all_acts AS (SELECT eml_result, eml_da_type AS act FROM matched WHERE eml_da_type IS NOT NULL),
k AS (SELECT act, count(*)::DOUBLE AS n, count(*) FILTER (eml_result = 'Compliance')::DOUBLE AS c,
             count(*) FILTER (eml_result = 'Resistance')::DOUBLE AS r FROM all_acts GROUP BY 1 HAVING count(*) >= 5),
ref AS (SELECT * FROM k ORDER BY n DESC, act LIMIT 1),
ll AS (SELECT sum(CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(r / n) ELSE 0 END) AS fit,
              sum(c) * ln(sum(c) / sum(n)) + sum(r) * ln(sum(r) / sum(n)) AS nul,
              count(*) - 1 AS terms FROM k),
coefs AS (SELECT 'Intercept' AS term, ln(c / r) AS coefficient, sqrt(1 / c + 1 / r) AS std_error FROM ref UNION ALL
      SELECT k.act, CASE WHEN k.c > 0 AND k.r > 0 THEN ln(k.c / k.r) - ln(ref.c / ref.r) END,
             CASE WHEN k.c > 0 AND k.r > 0 THEN sqrt(1 / k.c + 1 / k.r + 1 / ref.c + 1 / ref.r) END
      FROM k, ref WHERE k.act <> ref.act),
z AS (SELECT *, (coefficient / std_error) ** 2 AS zz, 2 * (fit - nul) AS gain FROM coefs, ll),
terms AS (SELECT term, coefficient, std_error, exp(coefficient) AS odds_ratio, 1 - fit / nul AS pseudo_r2,
                 {odd_tail_sql('zz', '1')} AS p_value, {odd_tail_sql('gain', 'terms')} AS lr_p_value FROM z)
"""
LOGIT_COLS = """term, round(coefficient, 5) AS coefficient, round(std_error, 5) AS std_error,
  round(p_value, 5) AS p_value, round(odds_ratio, 5) AS odds_ratio, round(pseudo_r2, 5) AS pseudo_r2,
  round(lr_p_value, 5) AS lr_p_value,
  CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*'
       WHEN p_value < 0.1 THEN '.' ELSE '' END AS mark"""
LOGIT_NUMBERS = ["coefficient", "std_error", "p_value", "odds_ratio", "pseudo_r2", "lr_p_value"]


def fitted(t):
    rows = tab.where_frequent(matched_acts(t), "act", 5)
    return stats.category_logit(rows, "eml_result", "Compliance", "act")


@on_turns("act_outcome_regression", f"WITH {LOGIT} SELECT {LOGIT_COLS} FROM terms")
def act_outcome_regression(t):
    return rounded(fitted(t), *LOGIT_NUMBERS, digits=5)


@on_turns("act_outcome_effect", f"""
WITH {LOGIT} SELECT {LOGIT_COLS}, CASE WHEN p_value >= 0.05 THEN 'no effect' WHEN odds_ratio > 1 THEN 'raises' ELSE 'lowers' END AS effect
FROM terms WHERE term <> 'Intercept'""")
def act_outcome_effect(t):
    return rounded(stats.or_direction(fitted(t)), *LOGIT_NUMBERS, digits=5)


# A dummy regressed on the other dummies is constant on its own and the reference group.
@on_turns("act_collinearity", f"""
WITH {MATCHED}, all_acts AS (SELECT eml_da_type AS act FROM matched WHERE eml_da_type IS NOT NULL),
k AS (SELECT act, count(*)::DOUBLE AS n FROM all_acts GROUP BY 1), ref AS (SELECT * FROM k ORDER BY n DESC, act LIMIT 1)
SELECT 'DA_' || k.act AS variable, round((1 - k.n / (SELECT sum(n) FROM k)) * (k.n + ref.n) / ref.n, 6) AS vif
FROM k, ref WHERE k.act <> ref.act""")
def act_collinearity(t):
    return rounded(stats.category_vif(matched_acts(t), "act"), "vif", digits=6)


@on_turns("act_association_significance", f"""
WITH {PREV}, v AS (SELECT * FROM p WHERE prev_eml_label IS NOT NULL),
l AS (SELECT DISTINCT idx, prev_eml_label, unnest(string_split(da_label, ',')) AS label FROM v),
s AS (SELECT label, count(*) FILTER (prev_eml_label = 0)::DOUBLE AS b, count(*) FILTER (prev_eml_label = 1)::DOUBLE AS d,
             (SELECT count(*) FROM v WHERE prev_eml_label = 0)::DOUBLE AS t0,
             (SELECT count(*) FROM v WHERE prev_eml_label = 1)::DOUBLE AS t1 FROM l GROUP BY 1),
x AS (SELECT label, CASE WHEN least(t0 - b, b, t1 - d, d) > 0 THEN
        (t0 + t1) * greatest(abs((t0 - b) * d - b * (t1 - d)) - (t0 + t1) / 2, 0) ** 2
        / (t0 * t1 * (t0 - b + t1 - d) * (b + d)) END AS chi2 FROM s),
y AS (SELECT label, chi2, CASE WHEN chi2 IS NOT NULL THEN {odd_tail_sql('coalesce(chi2, 0)', '1')} END AS p FROM x)
SELECT label, round(p, 7) AS p_value, CASE WHEN p < 0.05 THEN '*' ELSE '' END AS sig FROM y""")
def act_association_significance(t):
    assoc = tab.label_assoc(seq.prev_label(t), "da_label", "prev_eml_label")
    return rounded(stats.assoc_p_values(assoc), "p_value", digits=7).select("label", "p_value", "sig")
