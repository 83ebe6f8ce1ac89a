import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalake.sources import readers, writers
from sonalake.streaming import incremental


def nsp(samples, rate=50000):
    data = np.asarray(samples, "<i2").tobytes()
    body = b"HEDR" + struct.pack("<I", 32) + b" " * 20 + struct.pack("<II", rate, len(samples)) + b"\0" * 4 + b"SDA_" + struct.pack("<I", len(data)) + data
    return b"FORMDS16" + struct.pack("<I", len(body)) + body


@pytest.fixture
def tree(tmp_path):
    for cls, rec in (("healthy", "1"), ("Laryngitis", "2"), ("Laryngitis", "x")):
        folder = tmp_path / cls / rec / "vowels"
        folder.mkdir(parents=True)
        (folder / f"{rec}-a_n.nsp").write_bytes(nsp([0, 100, -200, 50]) if rec != "2" else b"broken")
        (folder / f"{rec}-a_n-egg.egg").write_bytes(b"x")
    return str(tmp_path)


def test_manifest(spark, tree):
    overview = spark.createDataFrame([("1", "s1"), ("1", "s0"), ("9", "s9")], "recording_id string, speaker_id string")
    got = {r["recording_id"]: r for r in readers.manifest(spark, tree, overview).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["token"] == "a_n" and got["1"]["has_egg"] and got["1"]["speaker_id"] == "s0" and got["1"]["is_healthy"]
    assert got["2"]["overview_match_status"] == "missing" and got["2"]["speaker_id"] == "missing_Laryngitis_2"


def test_decoding_gives_statuses(spark, tree):
    got = {r["conversion_status"]: r for r in readers.decoded(readers.recordings(spark, tree)).collect()}
    assert got["converted"]["sample_rate"] == 50000 and got["converted"]["samples"] == [0.0, 0.5, -1.0, 0.25]
    assert "DS16" in got["failed"]["error"]
    rate, data = readers.read_wav(readers.to_wav(8000, np.array([[1], [2]], "<i2")))
    assert rate == 8000 and data.ravel().tolist() == [1, 2]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
def test_overview_in_any_encoding(spark, tmp_path, encoding):
    text = "AufnahmeID,AufnahmeTyp,AufnahmeDatum,Diagnose,SprecherID,Geburtsdatum,Geschlecht,Pathologien\n 7 ,n,2000-02-30,Ödem, 3,1970-05-01,W ,Ödem\n"
    (tmp_path / "overview.csv").write_bytes(text.encode(encoding))
    r = readers.overview(spark, str(tmp_path)).first()
    assert (r["recording_id"], r["sex"], r["diagnosis_de"], r["recording_date"], r["birth_date"].year) == ("7", "w", "Ödem", None, 1970)


def test_bundle_round_trip(spark, tmp_path):
    df = spark.range(3)
    writers.save_bundle({"core": df}, str(tmp_path / "b"), {"q": 1})
    assert writers.load_bundle(spark, ["core"], str(tmp_path / "b"), {"q": 1})["core"].count() == 3
    assert writers.load_bundle(spark, ["core"], str(tmp_path / "b"), {"q": 2}) is None
    assert writers.load_bundle(spark, ["core"], str(tmp_path / "none"), {"q": 1}) is None
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "x.txt"))


def test_stream_grows_a_table_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    run = lambda: incremental.grow(spark.readStream.schema("id long").parquet(source), table, "id", lambda m: m.withColumn("x", F.col("id") * 2), str(tmp_path / "cp")).awaitTermination()
    spark.range(3).write.parquet(source)
    run()
    spark.range(1, 5).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(k, 2 * k) for k in range(5)]


def test_windowed_counts(spark, data, tmp_path):
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(data)
    counts = incremental.windowed_counts(stream, "ts", "1 day", "10 days", "event_type")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
