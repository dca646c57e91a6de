"""Sources and sinks: typed readers of alarm, vote, split and subject files, partitioned tables with resume."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted column names of a subject file, by channel.
NAMES = {"ecg": ("ecg", "ekg"), "ppg": ("ppg", "pleth")}


_FOLDERS: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir, deleted when the driver ends; without the setting only a local master has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavemill-files-")
    if not _FOLDERS:
        atexit.register(_delete_folders)
    _FOLDERS.append(f"{base.rstrip('/')}/wavemill-files-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def _delete_folders() -> None:
    context = SparkContext._active_spark_context
    while _FOLDERS and context is not None and context._jsc is not None:
        folder = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def stored(rows: DataFrame) -> DataFrame:
    """rows written to a scratch table and read back: computed once, and a lost executor costs no recomputation."""
    path = scratch_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; without it they stay until the driver's JVM collects their plans."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of record, alarm type and label."""
    return spark.read.schema("record_id string, alarm_type string, label int").csv(path)


def read_record_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("record")).where("record <> ''")


def read_event_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema("event string, record string, decision string").csv(path)
    return rows.withColumn("decision", F.lower(F.trim("decision")) == "true")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("event string, split string").csv(path)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema("event string, decision string, is_adjudication string").csv(path)
    return rows.select("event", *((F.lower(F.trim(c)) == "true").alias(c) for c in ("decision", "is_adjudication")))


def resolve_signal_columns(columns: list[str]) -> dict[str, str]:
    """Channel -> the first column whose lower-cased name contains one of the channel's names; an error if one is absent."""
    out = {}
    for channel, names in NAMES.items():
        found = next((c for c in columns if any(n in c.lower() for n in names)), None)
        if found is None:
            raise ValueError(f"no {channel} column among {columns}")
        out[channel] = found
    return out


def read_subject_csv(spark: SparkSession, directories: dict[int, str], name: str = r"([^/]+)\.csv$", subject: str | None = None) -> DataFrame:
    """CSVs of several class directories: subject, label, t, ecg, ppg; columns may differ between classes.

    The subject comes from the path of a file of its own, or from the column ``subject`` of files that hold many subjects.
    """
    out = None
    for label, path in directories.items():
        rows = spark.read.option("header", True).csv(path)
        found = resolve_signal_columns(rows.columns)
        time = next(c for c in rows.columns if c.lower() == "time")
        one = rows.select(
            (F.col(subject) if subject else F.regexp_extract(F.col("_metadata.file_path"), name, 1)).alias("subject"), F.lit(label).alias("label"), F.col(time).try_cast("double").alias("t"),
            *(F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(channel) for channel, c in found.items()),
        )
        out = one if out is None else out.unionByName(one)
    return out


def subject_id_map(spark: SparkSession, path: str, name: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Export name -> original subject, read from sidecar texts."""
    rows = spark.read.text(path, wholetext=True)
    return original_subjects(rows.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("export"), "value"))


def original_subjects(texts: DataFrame) -> DataFrame:
    """(export, subject) of sidecar texts (export, value), from files of their own or from a table that packs very many of them."""
    original = F.nullif(F.regexp_extract("value", r"Original Subject ID:\s*(\S+)", 1), F.lit(""))
    return texts.select("export", F.coalesce(original, "export").alias("subject"))


def sink_table(rows: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Columnar files below one folder per key value, so readers prune by path."""
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def unfinished(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the stored table yet: what a resumed run still has to do."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return rows
    done = spark.read.parquet(path).select(*keys).distinct()
    return rows.join(done, keys, "left_anti")
