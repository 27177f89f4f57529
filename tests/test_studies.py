from pyspark.sql import functions as F

from test_sequence import COLUMNS, make_turns
from turnlab.plans import studies
from turnlab.sources.writers import write_report


def test_every_study_writes_its_tables(spark, tmp_path):
    t = spark.createDataFrame(make_turns(4, n_dialogues=25), COLUMNS).withColumn(
        "pr_confidence", (F.col("idx") % 17) / 17).withColumn("sentence", F.concat_ws(" ", F.lit("some words"), "idx"))
    bundles = {
        "timing": studies.timing(t), "moves": studies.dialogue_transitions(t),
        "close": studies.close_transitions(t), "matching": studies.matching(t),
        "association": studies.association(t), "lagged": studies.lagged(t),
        "dialogues": studies.dialogues(t), "words": studies.words(t),
        "conversations": studies.conversations(t.withColumn("dialogue_id", F.col("idx") % 400), 0.02, 0.1),
        "quality": studies.label_quality(t, "pr_label", "da_label", ["Compliance", "ap"]),
        "regression": studies.regression(studies.matching(t)["matched"].withColumn(
            "eml_da_type", F.substring("eml_da_type", 1, 2)), min_n=3),
    }
    for name, tables in bundles.items():
        write_report(tables, str(tmp_path / name))
        for table in tables:
            assert spark.read.parquet(str(tmp_path / name / table)).columns
    lag = spark.read.parquet(str(tmp_path / "lagged" / "eml_to_outcome"))
    sums = lag.groupBy("prev_eml_label").agg(F.sum("probability")).collect()
    assert all(abs(s - 1) < 1e-12 for _, s in sums)
