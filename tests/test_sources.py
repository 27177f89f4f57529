import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnlab import schemas
from turnlab.sources import readers, writers


def test_csv_round_trip_with_encodings(spark, tmp_path):
    path = tmp_path / "turns.csv"
    path.write_bytes('idx,speaker,text\n1,a,"caf\xe9, two\nlines"\n2,b,x\n'.encode("latin-1"))
    schema = StructType.fromDDL("seq long, speaker string, text string")
    df = readers.read_csv(spark, str(path), schema, encoding="ISO-8859-1", multi_line=True)
    assert [tuple(r) for r in df.orderBy("seq").collect()] == [(1, "a", "café, two\nlines"), (2, "b", "x")]
    assert readers.read_csv_fallback(spark, str(path), schema, multi_line=True).collect() == df.collect()
    valid = tmp_path / "valid.csv"
    valid.write_bytes("idx,speaker,text\n1,a,caf\u00e9 \ufffd\n".encode())
    assert readers.read_csv_fallback(spark, str(valid), schema).first()["text"] == "caf\u00e9 \ufffd"
    text = readers.read_csv(spark, str(path), schema, "ISO-8859-1", as_text=True)
    assert {t for _, t in text.dtypes} == {"string"}
    writers.write_csv(df, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out"), df.schema, multi_line=True).count() == 2


def test_csv_folder_of_mixed_encodings(spark, tmp_path, rows):
    schema = StructType.fromDDL("seq long, text string, more string")
    lines = {"a.csv": ("utf-8", "1,caf\u00e9,\n2,\ufffd,x"), "b.csv": ("latin-1", "3,caf\u00e9,y\n4,plain,\u00fc"),
             "c.csv": ("utf-8", "5,\u4e2d,z")}
    for name, (encoding, text) in lines.items():
        (tmp_path / name).write_bytes(("seq,text,more\n" + text + "\n").encode(encoding))
    assert rows(readers.read_csv_fallback(spark, str(tmp_path), schema)) == [
        (1, "caf\u00e9", None), (2, "\ufffd", "x"), (3, "caf\u00e9", "y"), (4, "plain", "\u00fc"), (5, "\u4e2d", "z")]
    assert readers.read_csv_fallback(spark, str(tmp_path / "c.csv"), StructType.fromDDL("seq long")).count() == 1


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_line_numbers_of_split_files(spark, tmp_path, rows, size):
    texts = {f"f{k}.txt": ["x" * (i * 7 % 23) + str(i) if i % 5 else "" for i in range(40 + 30 * k)] for k in range(3)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r["source"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in got) == sorted(
        (name, i, line) for name, lines in texts.items() for i, line in enumerate(lines))


def test_failed_bundle_leaves_the_old_one(spark, tmp_path, rows):
    folder = str(tmp_path / "b")
    good = spark.createDataFrame([("x", 1)], "label string, n int")
    writers.write_bundle({"counts": good, "again": good}, folder)
    bad = good.withColumn("n", F.raise_error(F.lit("no table")).cast("int"))
    with pytest.raises(Exception, match="no table"):
        writers.write_bundle({"counts": good.withColumn("n", F.lit(2)), "again": bad}, folder)
    assert rows(readers.read_bundle(spark, folder, "counts")) == [("x", 1)]
    writers.write_bundle({"counts": good.withColumn("n", F.lit(3))}, folder, "csv")
    assert rows(readers.read_bundle(spark, folder, "counts")) == [("x", "3")]
    with pytest.raises(KeyError, match="again"):
        readers.read_bundle(spark, folder, "again")


def test_turn_table_in_parquet(spark, tmp_path):
    data = [(1, "d", 0, 1, "hi", 1, "Compliance", 0.5, "ap", ["ap"])]
    spark.createDataFrame(data, schemas.TURNS).write.parquet(str(tmp_path / "t"))
    assert readers.read_turns(spark, str(tmp_path / "t"), schemas.TURNS).first()["multi_da_labels"] == ["ap"]


def test_pipe_files(spark, tmp_path, rows):
    raw = tmp_path / "raw.txt"
    raw.write_text("A|hello|1|2|s\n\n A | there |1|2| qy \nbroken|line\nB|yes|1|2|aa\nA|so|1|2|??\n")
    from turnlab.functions.labels import map_da
    from turnlab.operators.build import merge_runs
    u = readers.read_pipe_utterances(spark, str(raw))
    assert u.count() == 4
    runs = merge_runs(u.withColumn("tag", map_da("da")), "source", "speaker", "line_no", "utterance", label="tag")
    writers.write_pipe_turns(runs, str(tmp_path / "merged"), labels="tag", text="utterance")
    merged = readers.read_pipe_turns(spark, str(tmp_path / "merged"))
    assert rows(merged) == [("A", "hello there", ["ap", "il"]), ("A", "so", ["o"]), ("B", "yes", ["pa"])]


def test_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", 2.0)], "Id int, Content string, n double")
    assert readers.detect_text_column(df) == "Content"
    assert readers.detect_text_column(df.select("n")) == "n"
    with pytest.raises(readers.MissingColumns, match="Id"):
        readers.require_columns(df, ["nope"])
    got = {r["column"]: r["nulls"] for r in readers.null_profile(df, ["Id", "Content", "n"]).collect()}
    assert got == {"Id": 0, "Content": 1, "n": 1}
    assert readers.fill_defaults(df, ["Content"], ["n"]).orderBy("Id").first()[1:] == ("", 0.0)
    assert readers.rename(df, {"Id": "id"}).columns == ["id"]


def test_report_bundle(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, 2.0)], "label string, n int, share double")
    writers.write_report({"counts": a, "again": a}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "again")).count() == 1
    got = writers.findings(labels=(a, ["label"], ["n", "share"]), totals=(a, [], ["n"])).collect()
    assert {tuple(r) for r in got} == {("labels", "x", "n", 1.0), ("labels", "x", "share", 2.0), ("totals", "", "n", 1.0)}
