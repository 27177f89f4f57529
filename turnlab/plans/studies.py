"""The study's analyses as bundles of named result tables, ready for ``sources.writers.write_report``.

Each function takes a turn table and returns lazy DataFrames; nothing runs before they are written.
"""

from pyspark.sql import functions as F

from turnlab.functions.labels import da_group
from turnlab.learning import features, models
from turnlab.operators import build, evaluate, stats
from turnlab.operators import sequence as seq
from turnlab.operators import tables as tab
from turnlab.vocab import DA_GROUPS, PR_LABELS, VALID_PR


def timing(t):
    """Outcomes and confidence before and after a dialogue's first EML turn."""
    rows = seq.label_timing(t)
    return {
        "missing": _missing(t),
        "outcome_by_timing": tab.crosstab(rows, "timing", "pr_label"),
        "outcome_test": stats.chi_square(rows, "timing", "pr_label"),
        "confidence": tab.group_stats(rows, "timing", "pr_confidence"),
        "confidence_box": tab.box_stats(rows, "timing", "pr_confidence"),
        "confidence_test": stats.mann_whitney(rows, "timing", "pr_confidence", "before_EML", "after_EML"),
        "share_gap": tab.share_gap(rows, "timing", "before_EML", "after_EML", "pr_label", PR_LABELS),
    }


def _missing(t):
    from turnlab.sources.readers import null_profile
    return null_profile(t, ["eml_label", "pr_label", "pr_confidence"])


def dialogue_transitions(t):
    """Outcome transitions of dialogues with and without EML."""
    moves = seq.transitions(t)
    return {
        "transitions": tab.transition_table(moves, "event_group"),
        "matrix": tab.transition_matrix(moves, "event_group"),
        "summary": tab.transition_summary(moves, "event_group"),
    }


def close_transitions(t, max_gap=3):
    """One speaker's close transitions, with the EML and the acts between their ends."""
    moves = seq.gap_transitions(t, max_gap)
    acts = {mode: seq.transitions_with_context(t, multi=mode == "multi", max_gap=max_gap)
            for mode in ("single", "multi")}
    last = seq.transitions_with_context(t, event_only=True, max_gap=max_gap)
    return {
        "moves": moves,
        "transitions": tab.transition_table(moves, "event_between"),
        "matrix": tab.transition_matrix(moves, "event_between"),
        "stability": tab.stability(moves, "event_between"),
        "acts_single": tab.transition_by_da(acts["single"], "event_between"),
        "acts_multi": tab.transition_by_da(acts["multi"], "event_between"),
        "acts_share": tab.crosstab(acts["single"], "transition", "da_type"),
        "last_eml_acts": tab.transition_by_da(last),
    }


def matching(t, max_gap=3):
    """EML rows matched to the other speaker's next and previous outcome."""
    matched = seq.nearest_labels(t, max_gap)
    return {
        "matched": matched,
        "matching_rate": seq.matching_rate(t, max_gap),
        "probability": tab.prob_by(matched, "eml_da_type", "eml_result"),
        "rates": tab.outcome_rate(matched, "eml_da_type"),
        "conversion": tab.conversion_rate(matched),
    }


def regression(matched, category="eml_da_type", min_n=5):
    """Which acts raise or lower the odds of compliance."""
    rows = tab.where_frequent(matched.where(F.col("eml_result").isin(VALID_PR)), category, min_n)
    terms = stats.category_logit(rows, "eml_result", "Compliance", category)
    return {"terms": terms.orderBy("p_value"), "effects": stats.or_direction(terms),
            "collinearity": stats.category_vif(rows, category)}


def association(t):
    """EML by act: counts, percentages and the test."""
    kept = t.where("da_label is not null and eml_label is not null")
    ratios = tab.event_ratio_by(kept, "da_label", "eml_label")
    return {"ratios": ratios.orderBy(F.desc("event_percent")),
            "test": stats.chi_square(kept, "da_label", "eml_label"),
            "top": tab.top_by(ratios, "event_percent", 10, ["da_label"])}


def lagged(t):
    """What the previous row's EML and act say about this row's outcome, act and EML."""
    eml = seq.prev_label(t).withColumn("da_group", da_group("da_label"))
    both = seq.prev_label(t, ["eml_label", "da_label"]).withColumn("prev_da_group", da_group("prev_da_label"))
    clear = both.where(F.col("prev_da_group") != "DAo").withColumn(
        "condition", tab.concat_key("prev_da_group", "prev_eml_label"))
    return {
        "eml_to_outcome": tab.cond_prob(eml, "prev_eml_label", "pr_label", PR_LABELS, dropna=True),
        "eml_to_outcome_test": stats.chi_square(eml, "prev_eml_label", "pr_label"),
        "eml_to_act_group": tab.cond_prob(eml, "prev_eml_label", "da_group", DA_GROUPS),
        "eml_to_act_group_test": stats.chi_square(eml, "prev_eml_label", "da_group"),
        "eml_to_each_act": stats.assoc_p_values(
            tab.label_assoc(eml, "da_label", "prev_eml_label")),
        "act_and_eml_to_outcome": tab.cond_prob(
            clear, ["prev_da_group", "prev_eml_label"], "pr_label", VALID_PR),
        "act_and_eml_to_outcome_test": stats.chi_square(clear, "condition", "pr_label"),
        "act_to_eml": tab.cond_prob(clear, "prev_da_group", "eml_label", [0, 1]),
        "act_to_eml_test": stats.chi_square(clear, "prev_da_group", "eml_label"),
    }


def dialogues(t):
    """Counts per dialogue and their distribution."""
    metrics = tab.dialogue_metrics(t)
    return {"metrics": metrics, "summary": tab.dialogue_summary(t),
            "outcome_histogram": tab.count_hist(metrics, "total_pr_count").orderBy("total_pr_count"),
            "eml_histogram": tab.count_hist(metrics, "total_eml_count").orderBy("total_eml_count"),
            "corpus": build.corpus_profile(t)}


def conversations(t, min_support=0.2, min_confidence=0.6):
    """Outcomes, act frequencies and rules of whole conversations; mines the rules at once."""
    outcomes = build.conversation_outcome(t)
    clear = outcomes.where(F.col("outcome").isin(VALID_PR))
    each = features.each_act(t)  # one row per act of a list, as in the catalog
    acts = each.join(clear.select("dialogue_id", "outcome"), "dialogue_id")
    first = each.groupBy("dialogue_id").agg(F.min_by("act", "at").alias("first_da"))
    rules = models.outcome_rules(models.act_transactions(each, outcomes, "act"), min_support, min_confidence)
    return {
        "outcomes": outcomes,
        "outcome_distribution": tab.value_dist(outcomes, "outcome"),
        "mean_length": tab.mean_by(outcomes, "outcome", "utterance_count").orderBy(F.desc("mean")),
        "acts_by_outcome": tab.label_freq_by(acts, "outcome", "act"),
        "first_acts": tab.label_freq_by(first.join(clear, "dialogue_id"), "outcome", "first_da"),
        "rules": rules.orderBy(F.desc("lift")),
        "top_rules": tab.top_by(rules, "lift", 12, ["antecedent"]),
    }


def words(t, text="sentence"):
    """Content words of EML rows and of either outcome."""
    counts = tab.word_freq(tab.word_categories(t, text), "text", "category")
    return {"counts": counts, "top": counts.orderBy(F.desc("n"), "category", "word").limit(20)}


def label_quality(df, gold, pred, labels):
    """Confusion, class report, metrics, baseline and label shares of predicted against gold labels."""
    return {
        "confusion": evaluate.confusion(df, gold, pred, labels),
        "report": evaluate.class_report(df, gold, pred),
        "metrics": evaluate.multiclass_metrics(df, gold, pred),
        "baseline": evaluate.majority_baseline(df, gold),
        "distribution": tab.compare_dist(df, gold, pred),
        "errors": evaluate.error_rows(df, gold, pred),
    }
