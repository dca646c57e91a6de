"""Training copies and mix-up pairs: partners, shares, labels and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.operators import perturb as pb

SCHEMA = "fold int, w long, y int, i int, x double"


def _windows(spark, n, folds=2, length=4):
    rows = spark.range(n).withColumnRenamed("id", "w").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds)))).where(F.col("w") % (folds + 1) != F.col("fold"))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select(F.col("fold").cast("int"), "w", (F.col("w") % 2).cast("int").alias("y"), F.col("i").cast("int"), (F.col("w") * 10.0 + F.col("i")).alias("x"))


def test_partners_are_a_permutation_within_the_fold(spark):
    got = pb.mixup(_windows(spark, 900), "w", "fold", "y", per=50).toPandas()
    pairs = got[got.i == 0]
    assert len(pairs) == 1800
    for fold, mine in pairs.groupby("fold"):
        assert (mine.w % 3 != fold).all() and (mine.partner % 3 != fold).all()  # nothing of the fold's test part
        assert sorted(mine.partner) == sorted(mine.w) and (mine.partner != mine.w).mean() > 0.95
        assert abs(np.corrcoef(mine.w, mine.partner)[0, 1]) < 0.15
    x = got.share * (got.w * 10 + got.i) + (1 - got.share) * (got.partner * 10 + got.i)
    assert np.allclose(x, got.x)
    assert np.allclose(pairs.share * (pairs.w % 2) + (1 - pairs.share) * (pairs.partner % 2), pairs.y)


@pytest.mark.parametrize("alpha", [0.2, 0.4, 1.0])
def test_shares_follow_the_beta_law(spark, alpha):
    share = np.array([r[0] for r in spark.range(20000).select(pb.beta_share(alpha, "t", F.col("id"))).collect()])
    assert ((share >= 0) & (share <= 1)).all()
    assert abs(share.mean() - 0.5) < 0.01
    assert abs(share.var() - 1 / (4 * (2 * alpha + 1))) < 0.005


def test_parts_do_not_grow_with_the_table(spark):
    drawn = _windows(spark, 3000, folds=1, length=1)
    plan = pb.mixup(drawn, "w", "fold", "y", per=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(fold" in plan and "_p" in plan
    assert "CartesianProduct" not in plan


def test_odd_windows_have_defined_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pb.mixup(empty, "w", "fold", "y").count() == 0
    alone = pb.mixup(spark.createDataFrame([(0, 5, 1, 0, 2.0), (0, 5, 1, 1, None)], SCHEMA), "w", "fold", "y").orderBy("i").collect()
    assert [(r.partner, r.y, r.x) for r in alone] == [(5, 1.0, 2.0), (5, 1.0, 0.0)]
    blank = pb.mixup(spark.createDataFrame([(0, 1, None, 0, 2.0), (0, 2, 1, 0, 4.0), (None, 3, 1, 0, 4.0)], SCHEMA), "w", "fold", "y").collect()
    assert len(blank) == 3 and [r.y for r in blank if r.fold == 0] == [None, None]
    with pytest.raises(ValueError):
        pb.beta_share(1.5, "t", F.col("id"))


def test_copies_keep_the_window_and_have_the_asked_spread(spark):
    rows = spark.range(1500).select(F.col("id").alias("w"), F.posexplode(F.array_repeat(F.lit(1.0), 16)).alias("i", "x"))
    got = pb.augment(rows, "w", 16, 1).toPandas()
    assert (got[got["copy"] == 0].x == 1.0).all()
    made = got[got["copy"] == 1]
    assert (made.groupby("w").i.nunique() == 16).all()
    lost = made.groupby("w").x.apply(lambda x: (x == 0).sum())
    assert set(lost) == {0, 2} and abs((lost == 2).mean() - 0.3) < 0.04
    middle = made[made.x != 0].groupby("w").x.median()
    assert abs(np.log(middle).std() - 0.15) < 0.02
