"""Stand-in views over the supplied tables, as DataFrames and as the same views in ANSI SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VARIANTS = ("A", "B", "C")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a task puts in order at most; only tables beyond this times the shuffle partitions are dealt by it.
TASK_LINES = 500_000


def base(spark: SparkSession, d: str) -> DataFrame:
    """One line per (order, line number). A large table is dealt by order into parts of bounded size, which what follows keeps."""
    lines = read(spark, d, "lineitem")
    parts = -(-lines.count() // TASK_LINES)  # from the files' footers
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(parts, "l_orderkey")
    first = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def alarms(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("seed"), F.col("o_orderpriority").alias("alarm_type"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.lit(1.0) - F.lit(5.0) * F.col("l_discount")).alias("quality"), F.col("o_orderstatus").alias("lead_signature"), "l_quantity", "l_extendedprice",
    )


def probs() -> dict[str, Column]:
    """Each variant's score of an alarm, from the columns of ``alarms``."""
    y = F.col("y").cast("double")
    a, b = (F.col("l_quantity") + 20.0 * y) / F.lit(70.0), (F.lit(51.0) - F.col("l_quantity") + 10.0 * y) / F.lit(61.0)
    return dict(zip(VARIANTS, (a, b, F.least(F.lit(1.0), F.col("l_extendedprice") / F.lit(210000.0) + 0.3 * y))))


def scores(spark: SparkSession, d: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(variant).alias("variant"), prob.alias("prob")) for variant, prob in probs().items()))
    return alarms(spark, d).select("record_id", "seed", "y", F.inline(made))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions: variant, seed, fold, role, record_id, prob, y."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    rows = scores(spark, d).select("*", folds)
    role = F.when(F.col("record_id") % 5 == F.col("fold"), "test").when((F.col("record_id") % 5 == (F.col("fold") + 1) % 5) & (F.floor(F.col("record_id") / 5) % 2 == 0), "val")
    return rows.withColumn("role", role).where("role is not null").select("variant", "seed", "fold", "role", "record_id", "prob", "y")


def samples(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("x"))


def beats(spark: SparkSession, d: str) -> DataFrame:
    """record_id, kind (ecg, pulse, ecg2), t_h in hours, x."""
    kind = F.when(F.col("event_type") == "click", "ecg").when(F.col("event_type") == "view", "pulse").when(F.col("event_type") == "error", "ecg2")
    rows = read(spark, d, "events").select(F.col("user_id").alias("record_id"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t_h"), F.col("value").alias("x"), "event_id")
    return rows.where("kind is not null")


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Long form: window_id, i, x (64 samples), record_id, y, alarm_type."""
    return read(spark, d, "embeddings").select(
        F.col("vec_id").alias("window_id"), F.floor(F.col("vec_id") / 2).alias("record_id"), (F.col("label") % 2).alias("y"), (F.col("label") % 5).alias("alarm_type"), F.posexplode("embedding").alias("i", "x")
    ).withColumn("x", F.col("x").cast("double"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.inline(F.array(F.struct(F.lit("quality").alias("annotator"), F.col("quality").alias("decision")), F.struct(F.lit("toxic").alias("annotator"), F.col("toxic").alias("decision")))), (F.col("doc_id") % 10 == 0).alias("is_adjudication"))


def split(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id") % 10
    return read(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.when(r < 7, "train").when(r == 7, "val").otherwise("test").alias("split"))


# The same views for the oracle; each names the views it stands on.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_base": ((), "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1"),
    "fx_alarms": (("fx_base",), "SELECT l_orderkey AS record_id, l_linenumber AS seed, o_orderpriority AS alarm_type, (l_returnflag = 'R')::INT AS y, 1.0::DOUBLE - 5.0::DOUBLE * l_discount AS quality, o_orderstatus AS lead_signature, l_quantity, l_extendedprice FROM fx_base JOIN orders ON l_orderkey = o_orderkey"),
    "fx_scores": (("fx_alarms",), "SELECT record_id, seed, y, 'A' AS variant, (l_quantity + 20.0::DOUBLE * y) / 70.0::DOUBLE AS prob FROM fx_alarms UNION ALL SELECT record_id, seed, y, 'B', (51.0::DOUBLE - l_quantity + 10.0::DOUBLE * y) / 61.0::DOUBLE FROM fx_alarms UNION ALL SELECT record_id, seed, y, 'C', least(1.0::DOUBLE, l_extendedprice / 210000.0::DOUBLE + 0.3::DOUBLE * y) FROM fx_alarms"),
    "fx_predictions": (("fx_scores",), "SELECT variant, seed, fold, CASE WHEN record_id % 5 = fold THEN 'test' ELSE 'val' END AS role, record_id, prob, y FROM fx_scores CROSS JOIN (SELECT unnest(range(5))::INT AS fold) WHERE record_id % 5 = fold OR (record_id % 5 = (fold + 1) % 5 AND (record_id // 5) % 2 = 0)"),
    "fx_samples": ((), "SELECT user_id AS record_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events"),
    "fx_beats": ((), "SELECT user_id AS record_id, CASE event_type WHEN 'click' THEN 'ecg' WHEN 'view' THEN 'pulse' ELSE 'ecg2' END AS kind, epoch_us(ts) / 3.6e9::DOUBLE AS t_h, value AS x, event_id FROM events WHERE event_type IN ('click', 'view', 'error')"),
    "fx_windows": ((), "SELECT vec_id AS window_id, vec_id // 2 AS record_id, label % 2 AS y, label % 5 AS alarm_type, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"),
    "fx_votes": ((), "SELECT doc_id AS event_id, 'quality' AS annotator, quality AS decision, doc_id % 10 = 0 AS is_adjudication FROM labels UNION ALL SELECT doc_id, 'toxic', toxic, doc_id % 10 = 0 FROM labels"),
    "fx_split": ((), "SELECT doc_id AS event_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM documents"),
    # test predictions with their attributes, and confusion counts at one half
    "fx_oof": (("fx_predictions", "fx_alarms"), "SELECT p.variant, p.seed, p.fold, p.record_id, p.prob, p.y, a.alarm_type, a.quality, a.lead_signature FROM fx_predictions p JOIN fx_alarms a ON p.record_id = a.record_id AND p.seed = a.seed WHERE p.role = 'test'"),
}


def with_views(body: str) -> str:
    """body with the views it names put in front as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name not in wanted:
            for below in SQL[name][0]:
                add(below)
            wanted.append(name)

    for name in SQL:
        if name in body:
            add(name)
    head = ",\n".join(f"{name} AS MATERIALIZED ({SQL[name][1]})" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a plan under its inventory name, with its oracle where SQL can express it."""

    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return plan

    return register
