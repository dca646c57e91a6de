"""Split plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as s
from . import fixtures as fx
from .fixtures import query

_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


def _records(spark, d):
    return fx.alarms(spark, d).groupBy("record_id").agg(F.max("y").alias("y"))


_REC = "r AS (SELECT record_id, max(y) AS y FROM fx_alarms GROUP BY record_id)"


@query("group_folds", f"WITH {_REC} SELECT record_id, ((row_number() OVER (ORDER BY {_H.format(chr(39) + '0:' + chr(39) + ' || record_id')}, record_id) - 1) % 5)::INT AS fold FROM r")
def group_folds(spark, d):
    return s.group_folds(_records(spark, d), "record_id", 5)


@query("group_holdout", f"WITH {_REC}, f AS (SELECT record_id, (record_id % 5)::INT AS fold FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {_H.format(chr(39) + '1:' + chr(39) + ' || record_id')}, record_id) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM f) SELECT fold, record_id, CASE WHEN rn <= greatest(1, round_even(0.15::DOUBLE * n, 0)) THEN 'val' ELSE 'fit' END AS role FROM k")
def group_holdout(spark, d):
    return s.group_holdout(_records(spark, d).withColumn("fold", (F.col("record_id") % 5).cast("int")), "record_id", 0.15, ["fold"])


_ITER = f"""WITH {_REC}, sd AS (SELECT unnest(range(2))::INT AS seed), o AS (SELECT seed, record_id, ((row_number() OVER (PARTITION BY seed ORDER BY {_H.format("seed || ':' || record_id")}, record_id) - 1) % 5)::INT AS own FROM r CROSS JOIN sd),
  x AS (SELECT o.*, fold FROM o CROSS JOIN (SELECT unnest(range(5))::INT AS fold)),
  k AS (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY {_H.format("seed || '-' || fold || ':' || record_id")}, record_id) AS rn, count(*) OVER (PARTITION BY seed, fold) AS n FROM x WHERE own <> fold),
  sp AS (SELECT seed, fold, record_id, 'test' AS role FROM x WHERE own = fold UNION ALL SELECT seed, fold, record_id, CASE WHEN rn <= greatest(1, round_even(0.15::DOUBLE * n, 0)) THEN 'val' ELSE 'fit' END FROM k)"""


@query("iter_splits", _ITER + " SELECT * FROM sp")
def iter_splits(spark, d):
    return s.iter_splits(_records(spark, d), "record_id", 2, 5, 0.15)


@query("leak_check", _ITER + " SELECT seed, record_id, 'two roles' AS problem FROM sp GROUP BY seed, fold, record_id HAVING count(DISTINCT role) > 1 UNION ALL SELECT seed, record_id, 'tested not once' FROM sp GROUP BY seed, record_id HAVING count(*) FILTER (role = 'test') <> 1")
def leak_check(spark, d):
    most = 2 * 5 * fx.read(spark, d, "orders").count()  # a row per seed, fold and record; from the file's footers
    return s.leak_check(s.iter_splits(_records(spark, d), "record_id", 2, 5, 0.15), "record_id", most)


@query("strat_group_folds", f"WITH {_REC} SELECT record_id, y, ((row_number() OVER (ORDER BY y DESC, {_H.format(chr(39) + '0:' + chr(39) + ' || record_id')}, record_id) - 1) % 5)::INT AS fold FROM r")
def strat_group_folds(spark, d):
    return s.strat_group_folds(fx.alarms(spark, d), "record_id", "y", 5)


@query("strat_group_holdout", f"WITH {_REC}, k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_H.format(chr(39) + '0:' + chr(39) + ' || record_id')}, record_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM r) SELECT y, record_id, CASE WHEN rn <= greatest(1, round_even(0.2::DOUBLE * n, 0)) THEN 'val' ELSE 'fit' END AS role FROM k")
def strat_group_holdout(spark, d):
    return s.strat_group_holdout(fx.alarms(spark, d), "record_id", "y", 0.2)


@query("strat_window_folds", f"WITH w AS (SELECT record_id || '-' || seed AS window_id, y FROM fx_alarms) SELECT window_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {_H.format(chr(39) + '0:' + chr(39) + ' || window_id')}, window_id) - 1) % 5)::INT AS fold FROM w")
def strat_window_folds(spark, d):
    return s.strat_window_folds(fx.alarms(spark, d).withColumn("window_id", F.concat_ws("-", "record_id", "seed")), "window_id", "y", 5)


@query("label_budget", f"WITH {_REC}, k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_H.format(chr(39) + '0:' + chr(39) + ' || record_id')}, record_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM r) SELECT record_id, seed, y FROM fx_alarms WHERE record_id IN (SELECT record_id FROM k WHERE rn <= greatest(2, round_even(0.1::DOUBLE * n, 0)))")
def label_budget(spark, d):
    return s.label_budget(fx.alarms(spark, d).select("record_id", "seed", "y"), "record_id", "y", 0.1)


@query("soft_labels", "WITH v AS (SELECT event_id, avg(decision) AS frac_true FROM fx_votes WHERE NOT is_adjudication GROUP BY event_id) SELECT a.record_id, a.seed, a.y, round(coalesce(v.frac_true, a.y::DOUBLE), 6) AS target FROM fx_alarms a LEFT JOIN v ON v.event_id = a.record_id")
def soft_labels(spark, d):
    v = fx.votes(spark, d).where("not is_adjudication").groupBy(F.col("event_id").alias("record_id")).agg(F.avg("decision").alias("frac_true"))
    return s.soft_labels(fx.alarms(spark, d).select("record_id", "seed", "y"), v, "record_id", "y").select("record_id", "seed", "y", F.round("target", 6).alias("target"))
