"""Distributions, contingency tables and conditional rates.

Counts are hash aggregates with map-side combine, so a label that holds most rows costs one row per
map task. Shares are taken over the finished counts of a label vocabulary, which is small; tables
whose rows are unbounded (words, dialogues) take their totals from a second aggregate instead.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.functions.clean import bare_words, is_content_word, label_eq
from turnlab.functions.counts import rows_n
from turnlab.functions.labels import split_labels
from turnlab.operators.ordering import exact_quantiles
from turnlab.vocab import TRANSITIONS, VALID_PR, WITH_EVENT, WITHOUT_EVENT


def _over(keys):
    return W.partitionBy(*(list(keys) or [F.lit(0)]))


def add_share(counts, by=(), n="n", name="percent", scale=100.0):
    """Share of a count in the total of its group."""
    return counts.withColumn(name, F.try_divide(F.col(n) * F.lit(scale), F.sum(n).over(_over(by))))


def _lookup(table, key, value):
    """A finished label table as one map value: rows look it up without being shuffled by label.

    For label vocabularies only; a key column that may have any number of values needs a join.
    """
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def literal_table(spark, *names, rows):
    """A fixed list of label tuples as a table, made on the JVM side."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def one_row(*parts):
    """Put one-row tables side by side."""
    stacked = append_rows(*parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


# --- one column ---------------------------------------------------------------------------------

def value_dist(df, col, keep_null=False):
    """Count and percent of every value."""
    kept = df if keep_null else df.where(F.col(col).isNotNull())
    return add_share(kept.groupBy(col).agg(rows_n().alias("n")))


def label_freq(df, col):
    """Count of every label of a comma list; percent of the label occurrences."""
    return value_dist(df.select(F.explode(split_labels(col)).alias("label")), "label")


def labels_per_row(df, col):
    """How many rows carry how many labels; percent of rows."""
    sized = df.select(F.size(split_labels(col)).cast("long").alias("n_labels"))
    return value_dist(sized.where("n_labels > 0"), "n_labels")


def class_balance(df, col, limit=3.0):
    """Largest and smallest class, their ratio and a flag for ratios above the limit."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(rows_n().alias("n"))
    found = counts.agg(
        F.max_by(col, F.struct("n", col)).alias("largest"), F.max("n").alias("n_largest"),
        F.min_by(col, F.struct("n", col)).alias("smallest"), F.min("n").alias("n_smallest"))
    ratio = F.col("n_largest") / F.col("n_smallest")
    return found.withColumn("ratio", ratio).withColumn("imbalanced", ratio > limit)


def class_feasibility(df, col, smallest=100):
    """Value distribution with a flag for classes too small to train on."""
    return value_dist(df, col).withColumn("too_few", F.col("n") < smallest)


def top_values(df, col, n):
    """The n commonest values, label order on ties."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(rows_n().alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(n)


def top_by(df, metric, n, ties=()):
    return df.orderBy(F.desc(metric), *[F.asc(c) for c in ties]).limit(n)


def where_top(df, col, n):
    """Rows of the n commonest values."""
    return df.join(top_values(df, col, n).select(col), col, "left_semi")


def top_share(df, col, n):
    """Rows kept by the n commonest values and their share of all rows."""
    counts = df.groupBy(col).agg(rows_n().alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(
        _over(()).orderBy(F.col(col).isNull(), F.desc("n"), F.asc(col))))
    kept = F.sum(F.when(F.col("_r") <= n, F.col("n")).otherwise(0))
    return ranked.agg(kept.alias("kept"), F.sum("n").alias("total")).withColumn(
        "percent", F.try_divide(F.col("kept") * 100.0, "total"))


def where_frequent(df, col, min_n=5):
    """Rows of the labels seen at least min_n times; all labelled rows if fewer than two qualify.

    The kept labels reach the filter as one array, so the table is not shuffled by its label.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(rows_n().alias("n"))
    enough = F.count_if(F.col("n") >= min_n)
    kept = F.when(enough >= 2, F.collect_list(F.when(F.col("n") >= min_n, F.col(col)))).otherwise(
        F.collect_list(col))
    return df.where(F.array_contains(counts.agg(kept).scalar(), F.col(col)))


def profile_categoricals(df, cols, limit=20):
    """Distribution of every listed column that has at most ``limit`` different values.

    The exact distinct counts are taken over the grouped values, one aggregate for all columns.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = (df.select(pairs.alias("p")).select("p.*").where("value is not null")
              .groupBy("column", "value").agg(rows_n().alias("n")))
    narrow = counts.groupBy("column").agg(rows_n().alias("_d"), F.sum("n").alias("_total")).where(
        F.col("_d") <= limit)
    total = F.element_at(_lookup(narrow, "column", "_total"), F.col("column"))
    # naming n keeps the filter above the aggregate, so that both uses share its exchange
    return (counts.withColumn("_total", total).where("_total >= n")
            .select("column", "value", "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent")))


def id_label_dist(df, id_col, label_col):
    return df.groupBy(id_col, label_col).agg(rows_n().alias("n"))


# --- two columns --------------------------------------------------------------------------------

def crosstab(df, row, col, col_levels=None):
    """Long contingency table: counts with zero cells, percent of the row, of the column and of all.

    Rows with a NULL in either column are left out. ``col_levels`` fixes the columns; without it
    they are the values that occur.
    """
    cells = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(row, col).agg(rows_n().alias("n")))
    if col_levels is None:
        levels = F.collect_set(col).over(_over(()))
        cells = cells.withColumn("_levels", levels)
    else:
        cells = cells.withColumn("_levels", F.array(*[F.lit(v) for v in col_levels]))
    wide = cells.groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.struct(col, "n"))).alias("_n"),
        F.first("_levels").alias("_levels"))
    full = wide.select(row, "_n", F.explode("_levels").alias(col)).select(
        row, col, F.coalesce(F.col("_n")[F.col(col)], F.lit(0)).cast("long").alias("n"))
    full = add_share(full, [row], name="row_percent")
    full = add_share(full, [col], name="col_percent")
    return add_share(full, [], name="percent")


def crosstab_margins(df, row, col, label="All"):
    """Contingency counts with row, column and grand totals."""
    kept = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cube = kept.cube(row, col).agg(rows_n().alias("n"), F.grouping_id().alias("_g"))
    return cube.select(
        F.when(F.col("_g").bitwiseAND(2) > 0, label).otherwise(F.col(row).cast("string")).alias(row),
        F.when(F.col("_g").bitwiseAND(1) > 0, label).otherwise(F.col(col).cast("string")).alias(col),
        "n")


def event_ratio_by(df, row, flag):
    """Counts without and with the event per row label, and the event's percentage."""
    kept = df.where(F.col(row).isNotNull() & F.col(flag).isNotNull())
    return (kept.groupBy(row).agg(
        F.count_if(F.col(flag) == 0).alias("no_event"), F.count_if(F.col(flag) == 1).alias("event"))
        .withColumn("no_event_percent",
                    F.try_divide(F.col("no_event") * 100.0, F.col("no_event") + F.col("event")))
        .withColumn("event_percent",
                    F.try_divide(F.col("event") * 100.0, F.col("no_event") + F.col("event"))))


def cond_prob(df, given, target, values, dropna=False):
    """P(target = value | given) with the size of the condition, one row per condition and value.

    Rows whose target is NULL count in the denominator unless ``dropna``.
    """
    given = [given] if isinstance(given, str) else list(given)
    kept = df.na.drop(subset=given + ([target] if dropna else []))
    counts = kept.groupBy(*given).agg(
        rows_n().alias("total"), *[F.count_if(F.col(target) == v).alias(f"_v{i}")
                            for i, v in enumerate(values)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(v).alias(target), F.col(f"_v{i}").alias("n")) for i, v in enumerate(values)]))
    return (counts.select(*given, "total", cells.alias("c")).select(*given, "c.*", "total")
            .withColumn("probability", F.try_divide("n", "total")))


def concat_key(group, flag, between="_EML"):
    return F.concat(F.col(group), F.lit(between), F.col(flag).cast("int").cast("string"))


def label_assoc(df, labels, flag):
    """Per label of a comma list: share and count among rows with flag 0 and 1, and a 2x2 test.

    The four cells of a label follow from its two counts and the two row totals, so one pass over
    the exploded labels serves all labels. The statistic is NULL when a cell is zero.
    """
    from turnlab.operators.stats import chi_square_2x2

    rows = df.where(F.col(flag).isNotNull())
    # a NULL label in every row counts the rows themselves
    found = F.array_append(F.array_distinct(split_labels(labels)), F.lit(None).cast("string"))
    seen = rows.select(flag, F.explode(found).alias("label")).groupBy("label").agg(
        F.count_if(F.col(flag) == 0).alias("count_0"), F.count_if(F.col(flag) == 1).alias("count_1"))
    of_all = lambda c: F.max(F.when(F.col("label").isNull(), F.col(c))).over(_over(()))
    both = (seen.withColumn("total_0", of_all("count_0")).withColumn("total_1", of_all("count_1"))
            .where("label is not null"))
    a, b = F.col("total_0") - F.col("count_0"), F.col("count_0")
    c, d = F.col("total_1") - F.col("count_1"), F.col("count_1")
    testable = F.least(a, b, c, d) > 0
    return both.select(
        "label", F.coalesce(F.try_divide("count_0", "total_0"), F.lit(0.0)).alias("p_given_0"),
        F.coalesce(F.try_divide("count_1", "total_1"), F.lit(0.0)).alias("p_given_1"),
        "count_0", "count_1",
        F.when(testable, chi_square_2x2(a, b, c, d)).alias("chi2"))


def argmax_by(df, row, col):
    """For every column label the row label with the largest row percentage."""
    cells = crosstab(df, row, col)
    best = F.max_by(F.struct(row, "row_percent"), F.struct(F.col("row_percent"), F.col(row)))
    return cells.groupBy(col).agg(best.alias("b")).select(col, "b.*")


def share_gap(df, group, a, b, target, values):
    """Difference of each value's share between two groups, in percentage points, with sizes."""
    kept = df.where(F.col(group).isin(a, b) & F.col(target).isNotNull())
    sums = [F.count_if(F.col(group) == g).alias(f"n_{i}") for i, g in enumerate((a, b))]
    hits = [F.count_if((F.col(group) == g) & (F.col(target) == v)).alias(f"_h{i}_{j}")
            for i, g in enumerate((a, b)) for j, v in enumerate(values)]
    cells = F.explode(F.array(*[
        F.struct(F.lit(v).alias(target),
                 F.try_divide(F.col(f"_h0_{j}") * 100.0, "n_0").alias("share_a"),
                 F.try_divide(F.col(f"_h1_{j}") * 100.0, "n_1").alias("share_b"))
        for j, v in enumerate(values)]))
    return (kept.agg(*sums, *hits).select("n_0", "n_1", cells.alias("c"))
            .select(f"c.{target}", "c.share_a", "c.share_b",
                    F.col("n_0").alias("n_a"), F.col("n_1").alias("n_b"))
            .withColumn("gap", F.col("share_a") - F.col("share_b")))


def compare_dist(df, a, b):
    """Value counts and percents of two columns side by side, zeros where a value is missing."""
    left = value_dist(df, a).select(F.col(a).alias("label"), F.col("n").alias("n_a"),
                                    F.col("percent").alias("percent_a"))
    right = value_dist(df, b).select(F.col(b).alias("label"), F.col("n").alias("n_b"),
                                     F.col("percent").alias("percent_b"))
    return left.join(right, "label", "full_outer").na.fill(
        0, subset=["n_a", "percent_a", "n_b", "percent_b"])


# --- transitions --------------------------------------------------------------------------------

def transition_table(x, group, groups=(WITH_EVENT, WITHOUT_EVENT)):
    """All four transition types of every group with count and percent of the group, zeros too."""
    counts = x.groupBy(group).agg(
        *[F.count_if(F.col("transition") == t).alias(f"_t{i}") for i, t in enumerate(TRANSITIONS)])
    frame = literal_table(x.sparkSession, group, rows=[(g,) for g in groups])
    cells = F.explode(F.array(*[
        F.struct(F.lit(t).alias("transition"),
                 F.coalesce(F.col(f"_t{i}"), F.lit(0)).cast("long").alias("n"))
        for i, t in enumerate(TRANSITIONS)]))
    full = (frame.join(counts, group, "left").select(group, cells.alias("c")).select(group, "c.*"))
    return add_share(full, [group]).withColumn("percent", F.coalesce("percent", F.lit(0.0)))


def transition_matrix(x, group, groups=(WITH_EVENT, WITHOUT_EVENT)):
    """One row per group and earlier outcome; percents of the group's grand total."""
    parts = F.split(F.col("transition"), "→")
    cells = transition_table(x, group, groups).select(
        group, F.get(parts, F.lit(0)).alias("pr_prev"), F.get(parts, F.lit(1)).alias("pr_next"),
        "percent")
    return (cells.groupBy(group, "pr_prev").pivot("pr_next", VALID_PR).agg(F.max("percent"))
            .withColumnsRenamed({v: "to_" + v.lower() for v in VALID_PR}))


def stability(x, group, empty_switch=0.0, *more):
    """Percent of transitions that keep the outcome and percent that change it."""
    same = F.count_if(F.col("pr_prev") == F.col("pr_next"))
    kept = F.try_divide(same * 100.0, rows_n())
    return x.groupBy(group).agg(
        F.coalesce(kept, F.lit(0.0)).alias("stability"),
        F.coalesce(100.0 - kept, F.lit(empty_switch)).alias("switch"),
        rows_n().alias("transitions"), *more)


def transition_summary(x, group):
    """Stability, switch, number of transitions and of dialogues per group."""
    return stability(x, group, 0.0, F.count_distinct("dialogue_id").alias("dialogues"))


def transition_by_da(x, group=None):
    """Count, act total and probability of each transition after an act; empty cells left out."""
    by = ([group] if group else []) + ["da_type"]
    counts = x.where("da_type is not null").groupBy(*by, "transition").agg(rows_n().alias("n"))
    return (counts.withColumn("da_total", F.sum("n").over(_over(by)))
            .withColumn("probability", F.col("n") * 100.0 / F.col("da_total")))


# --- matched rows -------------------------------------------------------------------------------

def prob_by(x, given, target):
    """Count, total of the condition and percent per pair."""
    kept = x.where(F.col(given).isNotNull() & F.col(target).isNotNull())
    counts = kept.groupBy(given, target).agg(rows_n().alias("n"))
    return (counts.withColumn("total", F.sum("n").over(_over([given])))
            .withColumn("probability", F.col("n") * 100.0 / F.col("total")))


def outcome_rate(x, given, target="eml_result"):
    """Compliance and resistance percentages per act."""
    rate = lambda v: F.count_if(F.col(target) == v) * 100.0 / rows_n()
    return x.where(F.col(given).isNotNull()).groupBy(given).agg(
        rate("Compliance").alias("compliance_rate"), rate("Resistance").alias("resistance_rate"),
        rows_n().alias("total"))


def conversion_rate(x, given="eml_da_type", before="pr_status_before", after="eml_result"):
    """Percentages of the four before/after outcome pairs per act."""
    kept = x.where(F.col(before).isin(VALID_PR) & F.col(given).isNotNull())
    rate = lambda a, b: (F.count_if((F.col(before) == a) & (F.col(after) == b)) * 100.0 / rows_n())
    return kept.groupBy(given).agg(
        rows_n().alias("total"), *[rate(a, b).alias(f"{a}_to_{b}".lower())
                            for a in VALID_PR for b in VALID_PR])


# --- dialogues ----------------------------------------------------------------------------------

def dialogue_metrics(t):
    """Valid outcomes and EML rows of every dialogue."""
    return t.groupBy("dialogue_id").agg(
        F.count_if(F.col("pr_label").isin(VALID_PR)).alias("total_pr_count"),
        F.count_if(F.col("eml_label") == 1).alias("total_eml_count"))


def dialogue_summary(t):
    """Totals and shares over dialogues: two or more outcomes, any EML, both."""
    many, some = F.col("total_pr_count") >= 2, F.col("total_eml_count") > 0
    return dialogue_metrics(t).agg(
        rows_n().alias("dialogues"), F.sum("total_pr_count").alias("total_pr"),
        F.sum("total_eml_count").alias("total_eml"),
        F.count_if(many).alias("multi_pr"), F.count_if(some).alias("with_eml"),
        F.count_if(many & some).alias("both"),
        (F.count_if(many) / rows_n()).alias("multi_pr_ratio"), (F.count_if(some) / rows_n()).alias("with_eml_ratio"),
        (F.count_if(many & some) / rows_n()).alias("both_ratio"))


def count_hist(metrics, col):
    """How many dialogues have each count."""
    return metrics.groupBy(col).agg(rows_n().alias("dialogues"))


# --- numbers ------------------------------------------------------------------------------------

def group_stats(df, group, x):
    """Mean, sample standard deviation and number of values per group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))


def describe(df, x):
    """n, mean, exact median, min, max and sample standard deviation of a column."""
    base = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"),
                  F.max(x).alias("max"), F.stddev_samp(x).alias("std"))
    median = exact_quantiles(df, x, [0.5]).select(F.col("value").alias("median"))
    return one_row(base, median)


def confidence_bins(df, x):
    """Rows per confidence band with percent of all scored rows."""
    band = (F.when(F.col(x) < 0.5, "<0.5").when(F.col(x) < 0.8, "0.5-0.8")
            .when(F.col(x) < 0.9, "0.8-0.9").when(F.col(x) >= 0.9, ">=0.9"))
    return value_dist(df.select(band.alias("band")), "band")


def confidence_by_label(df, label, x):
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(
        rows_n().alias("n"), F.avg(x).alias("mean_confidence"))


def box_stats(df, group, x):
    """Exact minimum, quartiles and maximum per group (group: a label column)."""
    cuts = exact_quantiles(df.where(F.col(group).isNotNull()), x, [0, 0.25, 0.5, 0.75, 1], [group])
    at = lambda q, name: F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
    return cuts.groupBy(group).agg(at(0.0, "min"), at(0.25, "q1"), at(0.5, "median"),
                                   at(0.75, "q3"), at(1.0, "max"), F.max("n").alias("n"))


def mean_by(df, group, x):
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(x).alias("mean"))


def label_freq_by(df, group, label):
    """Count of every label per group and percent of the group's label occurrences."""
    kept = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    return add_share(kept.groupBy(group, label).agg(rows_n().alias("n")), [group])


# --- words --------------------------------------------------------------------------------------

def word_freq(df, text, category, smallest=5, stop_words=None):
    """Words per category with their counts; categories with fewer than ``smallest`` words drop out.

    Category totals come from their own aggregate: the vocabulary of one category is unbounded.
    """
    words = (df.where(F.col(category).isNotNull())
             .select(category, F.explode(bare_words(text)).alias("word"))
             .where(is_content_word(F.col("word"), stop_words)))
    counts = words.groupBy(category, "word").agg(rows_n().alias("n"))
    rich = counts.groupBy(category).agg(F.sum("n").alias("_total")).where(F.col("_total") >= smallest)
    total = F.element_at(_lookup(rich, category, "_total"), F.col(category))
    # naming n keeps the filter above the aggregate, so that both uses share its exchange
    return counts.withColumn("category_words", total).where("category_words >= n")


def word_categories(t, text="sentence"):
    """Rows under each study category they belong to: EML, Compliance, Resistance."""
    flags = [("EML", F.col("eml_label") == 1), ("Compliance", label_eq("pr_label", "Compliance")),
             ("Resistance", label_eq("pr_label", "Resistance"))]
    picked = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags]))
    return t.select(F.explode(picked).alias("category"), F.col(text).alias("text"))


# --- label sets and row sets --------------------------------------------------------------------

def label_sets(a, b):
    """Every label of two one-column tables, marked common, only_a or only_b."""
    name = a.columns[0]
    marked = (a.select(F.col(name).alias("label"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(F.col(b.columns[0]).alias("label"), F.lit(0).alias("_a"),
                                    F.lit(1).alias("_b"))))
    place = (F.when((F.max("_a") == 1) & (F.max("_b") == 1), "common")
             .when(F.max("_a") == 1, "only_a").otherwise("only_b"))
    return marked.groupBy("label").agg(place.alias("place"))


def append_rows(first, *others):
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), others, first)


def ordered(df, *keys):
    return df.orderBy(*keys)


def head(df, n, order="idx"):
    return df.orderBy(order).limit(n)


def with_rank(df, metric, ties=(), name="rank"):
    """1-based rank after a descending sort of a small result table."""
    w = _over(()).orderBy(F.desc(metric), *[F.asc(c) for c in ties])
    return df.withColumn(name, F.row_number().over(w).cast("long"))
