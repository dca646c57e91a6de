import numpy as np
from pyspark.sql import functions as F
from wavemill.llm import cotraining


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = _docs(spark, "/root/testdata/sf0.01")
    seen = labels.where("doc_id % 4 <> 0")
    model = cotraining.fit_quality(docs, seen)
    scored = cotraining.score_quality(docs, model, keep=["doc_id"]).join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = scored.select("score", "p_content", "p_metadata", "quality").toPandas()
    assert len(rows) > 60
    for column in ("score", "p_content", "p_metadata"):
        assert ((rows[column] >= 0.5) == (rows["quality"] == 1)).mean() > 0.9
    assert (rows.loc[rows["quality"] == 1, "score"] >= 0.5).mean() > 0.96


def test_exchange_teaches_from_few_labels(spark):
    docs, labels = _docs(spark, "/root/testdata/sf0.01")
    few = labels.where("doc_id % 6 = 1")
    loss = {}
    for rounds in (0, 3):
        model = cotraining.fit_quality(docs, few, rounds=rounds)
        rows = cotraining.score_quality(docs, model, keep=["doc_id"]).join(labels.where("doc_id % 6 <> 1"), "doc_id").toPandas()
        p = rows["p_metadata"].clip(1e-6, 1 - 1e-6)
        loss[rounds] = -np.mean(np.where(rows["quality"] == 1, np.log(p), np.log(1 - p))), rows["p_metadata"].to_numpy()
    assert not np.allclose(loss[0][1], loss[3][1])  # what the other view has told changes the scores
    assert loss[3][0] < loss[0][0] + 0.02


def test_score_of_single_documents(spark, odd):
    """The scoring pass against the formula, word by word, for every odd text (repeated rows and ties included)."""
    rng = np.random.default_rng(2)
    views = tuple(cotraining.View(rng.normal(size=n), 0.3, 0.7, -0.2) for n in (cotraining.CONTENT, cotraining.METADATA))
    got = cotraining.score_quality(odd.withColumn("lang", F.col("source")), cotraining.Quality(views, 0.5), keep=["doc_id", "text", "source"]).collect()
    assert len(got) == odd.count()
    import pyarrow as pa

    for r in got:
        x, m = cotraining._features(pa.record_batch([pa.array([c], pa.string()) for c in (r.text, r.source, r.source)], ["t", "l", "s"]))
        odds = [0.7 * (sum(a * b for a, b in zip(f[0], v.weights)) + 0.3) - 0.2 for f, v in zip((x, m), views)]
        for name, z in (("p_content", odds[0]), ("p_metadata", odds[1]), ("score", sum(odds) / 2)):
            assert abs(r[name] - 1 / (1 + np.exp(-z))) < 1e-9
        words = [w for w in (r.text or "").replace("\x0b", " ").split(" ") if w] if r.text and r.text.isascii() and "\n" not in r.text and "\t" not in r.text else None
        if words:  # two figures by hand: the share of words equal to the one before, and of different words
            low = [w.lower() for w in words]
            assert abs(x[0][cotraining.LEXICAL] - sum(a == b for a, b in zip(low, low[1:])) / len(low)) < 1e-9
            assert abs(x[0][cotraining.LEXICAL + 1] - len(set(low)) / len(low)) < 1e-9


def test_features_equal_one_by_one(spark, odd):
    import pyarrow as pa

    rows = [(r.text, r.source, r.source) for r in odd.collect()]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], ["t", "l", "s"])
    together = cotraining._features(batch)
    for k in range(len(rows)):
        alone = cotraining._features(batch.slice(k, 1))
        assert all(np.allclose(a[k], b[0]) for a, b in zip(together, alone))
    assert all(np.isfinite(x).all() for x in together)


def test_defined_results_without_two_classes(spark, odd, nothing):
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("clash"))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    good = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None)], "doc_id long, quality int")
    for labels in (empty, good):
        model = cotraining.fit_quality(docs, labels)
        scored = cotraining.score_quality(docs, model)
        assert {r.score for r in scored.collect()} == {1.0} and scored.count() == docs.count()
    model = cotraining.fit_quality(nothing, good)
    assert cotraining.score_quality(nothing, model).count() == 0
