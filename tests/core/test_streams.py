"""Streams against their batch twins, up to the final watermark, and one late row."""

import datetime
import time

from pyspark.sql import functions as F
from wavemill.sources import tables
from wavemill.streaming import live


def _run(spark, frame, name):
    q = frame.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_equal_their_twin(spark, sf):
    twin = live.stream_windows(live.as_events(spark.read.parquet(f"{sf}/events.parquet")), "1 day", "1 hour")
    got = _run(spark, live.stream_windows(live.event_stream(spark, sf), "1 day", "1 hour"), "w1")
    assert got.exceptAll(twin).count() == 0 and 0.9 * twin.count() < got.count() <= twin.count()


def test_verify_and_gaps_equal_their_twins(spark, sf):
    batch = live.as_events(spark.read.parquet(f"{sf}/events.parquet"))
    twin = live.stream_verify(batch, "click", "view", "1 hour", "12 hours", "1 hour")
    got = _run(spark, live.stream_verify(live.event_stream(spark, sf), "click", "view", "1 hour", "12 hours", "1 hour"), "v1")
    assert got.exceptAll(twin).count() == 0
    assert got.where("pulse is not null").count() == twin.where("pulse is not null").count()
    gaps = _run(spark, live.stream_beat_gap(live.event_stream(spark, sf), "click", "48 hours", "1 hour"), "g1")
    assert gaps.exceptAll(live.stream_beat_gap(batch, "click", "48 hours", "1 hour")).count() == 0 and gaps.count() > 0
    growing = _run(spark, live.stream_growing(live.event_stream(spark, sf), "3 days", "1 day", "1 hour"), "g2")
    assert growing.exceptAll(live.stream_growing(batch, "3 days", "1 day", "1 hour")).count() == 0 and growing.count() > 0


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for k, rows in enumerate([[(1, at(1), 1, "click", 1.0, None)], [(2, at(100), 1, "click", 1.0, None)], [(5, at(101), 1, "click", 1.0, None)], [(3, at(2), 1, "click", 5.0, None), (4, at(200), 1, "click", 1.0, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        time.sleep(1.1)  # files are taken in order of their modification time, in seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    got = _run(spark, live.stream_windows(live.as_events(stream), "1 day", "1 hour"), "late")
    assert got.agg(F.sum("n")).first()[0] == 3 and got.agg(F.max("mean")).first()[0] == 1.0


def test_sources_and_resume(spark, tmp_path):
    (tmp_path / "a.csv").write_text("r1,Asystole,1\nr2,Bradycardia,0\n")
    assert tables.read_alarms(spark, str(tmp_path / "a.csv")).where("label = 1").first().record_id == "r1"
    (tmp_path / "list").write_text(" r1 \n\nr2\n")
    assert [r.record for r in tables.read_record_list(spark, str(tmp_path / "list")).collect()] == ["r1", "r2"]
    (tmp_path / "e.csv").write_text("event,record,decision\ne1,r1, True\ne2,r1,false\n")
    assert [r.decision for r in tables.read_event_labels(spark, str(tmp_path / "e.csv")).collect()] == [True, False]
    for label, names in ((0, "Time,PPG,ECG"), (1, "Time,pleth,ekg")):
        (tmp_path / f"c{label}").mkdir()
        (tmp_path / f"c{label}" / f"subject_{label}.csv").write_text(f"{names}\n0.0,1.5,NaN\n0.008,2.5,3.5\n")
    got = tables.read_subject_csv(spark, {k: str(tmp_path / f"c{k}") for k in (0, 1)}).orderBy("subject", "t").collect()
    assert [(r.subject, r.label, r.ecg, r.ppg) for r in got] == [("subject_0", 0, None, 1.5), ("subject_0", 0, 3.5, 2.5), ("subject_1", 1, None, 1.5), ("subject_1", 1, 3.5, 2.5)]
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "x1.txt").write_text("Export\nOriginal Subject ID: p77\n")
    assert tuple(tables.subject_id_map(spark, str(tmp_path / "side")).first()) == ("x1", "p77")
    rows = spark.createDataFrame([("A", 1, 0.5), ("B", 1, 0.4)], "variant string, seed int, prob double")
    path = str(tmp_path / "p")
    assert tables.unfinished(rows, path, ["variant", "seed"]).count() == 2
    tables.sink_table(rows.where("variant = 'A'"), path, ["variant"])
    assert [r.variant for r in tables.unfinished(rows, path, ["variant", "seed"]).collect()] == ["B"]
