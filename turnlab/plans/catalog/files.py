"""Queries that write files to the shared folder and read them back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnlab.functions import labels as lab
from turnlab.operators import tables as tab
from turnlab.operators.ordering import cumulate
from turnlab.plans.catalog.building import RUNS, speaker_runs
from turnlab.plans.catalog.registry import on_turns, on_utterances
from turnlab.session import shared_folder
from turnlab.sources import readers, writers

CSV_COLUMNS = "idx long, dialogue_id long, sentence string, pr_confidence double"


@on_turns("mixed_encoding_csv", """
SELECT idx, dialogue_id, 'd\u00e9j\u00e0 ' || sentence AS sentence, pr_confidence FROM turns""")
def mixed_encoding_csv(t):
    """One folder of CSV files, those of one role in UTF-8 and those of the other in Latin-1."""
    folder = shared_folder(t.sparkSession, "csv")
    rows = t.withColumn("sentence", F.concat(F.lit("d\u00e9j\u00e0 "), "sentence"))
    schema = StructType.fromDDL(CSV_COLUMNS)
    for role, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        writers.write_csv(rows.where(F.col("role") == role).select(*schema.names), f"{folder}/role={role}", encoding)
    return readers.read_csv_fallback(t.sparkSession, f"{folder}/*", schema)


@on_turns("text_csv", "SELECT idx::VARCHAR AS idx, dialogue_id::VARCHAR AS dialogue_id, sentence FROM turns")
def text_csv(t):
    folder = shared_folder(t.sparkSession, "csv")
    kept = t.select("idx", "dialogue_id", "sentence")
    writers.write_csv(kept, folder)
    return readers.read_csv(t.sparkSession, folder, kept.schema, as_text=True)


@on_utterances("pipe_utterance_lines", """
SELECT idx, speaker, sentence AS utterance, tag AS da, row_number() OVER (ORDER BY idx) - 1 AS row_index FROM utterances""")
def pipe_utterance_lines(u):
    """Lines in file order over many files; a line's number and the lines of the files before give its place."""
    spark, folder = u.sparkSession, shared_folder(u.sparkSession, "pipe")
    line = F.concat_ws("|", "speaker", "sentence", F.col("idx").cast("string"), F.lit("."), "tag")
    ordered = u.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.select(line.alias("value")).write.text(folder)
    read = readers.read_pipe_utterances(spark, folder)
    files = read.groupBy("source").agg((F.max("line_no") + 1).alias("_n"), F.min(F.col("f2").cast("long")).alias("_first"))
    before = cumulate(files, "_first", ["_n"]).select("source", "below__n")
    return read.join(before, "source").select(
        F.col("f2").cast("long").alias("idx"), "speaker", "utterance", "da",
        (F.col("line_no") + F.col("below__n")).alias("row_index"))


@on_utterances("pipe_turn_files", f"""
WITH {RUNS} SELECT speaker, sentence AS utterance, tags AS da_labels FROM runs""")
def pipe_turn_files(u):
    folder = shared_folder(u.sparkSession, "pipe")
    writers.write_pipe_turns(speaker_runs(u), folder, labels="tag", text="sentence")
    return readers.read_pipe_turns(u.sparkSession, folder).withColumn("da_labels", lab.pack_labels("da_labels"))


@on_turns("report_bundle", """
SELECT 'outcomes' AS section, pr_label AS item, 'n' AS metric, count(*)::DOUBLE AS value FROM turns
WHERE pr_label IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'outcomes', pr_label, 'percent', count(*) * 1e2 / sum(count(*)) OVER () FROM turns WHERE pr_label IS NOT NULL
GROUP BY 2 UNION ALL SELECT 'dialogues', '', 'dialogues', count(DISTINCT dialogue_id)::DOUBLE FROM turns""")
def report_bundle(t):
    """Two bundles in one directory: the second, complete one is read."""
    spark, folder = t.sparkSession, shared_folder(t.sparkSession, "report")
    writers.write_bundle({"outcomes": tab.value_dist(t.limit(0), "pr_label")}, folder)
    writers.write_bundle({"outcomes": tab.value_dist(t, "pr_label"), "dialogues": tab.dialogue_summary(t)}, folder)
    read = lambda name: readers.read_bundle(spark, folder, name)
    return writers.findings(outcomes=(read("outcomes"), ["pr_label"], ["n", "percent"]),
                            dialogues=(read("dialogues"), [], ["dialogues"]))
