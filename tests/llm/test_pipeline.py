import re

import corpus_pipeline
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F
from wavemill.llm.common import materialize

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = materialize(docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000)))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf))
        before, after = docs.collect(), out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        seen[name] = len(after)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [r for r in before if labels.get(r.doc_id) == 1]
            assert len({r.doc_id for r in good} & {r.doc_id for r in after}) >= 0.97 * len(good)
        elif name == "exact dedup":
            texts = {}
            for r in before:
                texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(min(v) for v in texts.values())
        elif name == "n-gram Jaccard join":
            sets = {r.doc_id: _shingles(r.text) for r in before}
            up = {i: i for i in sets}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
            assert sorted(r.doc_id for r in after) == sorted(i for i in sets if root(i) == i)
        elif name == "mixing sources":
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
            assert abs(words(before) - words(after)) <= 20
        else:
            texts = {}
            for r in before:
                texts.setdefault(r.doc_id, []).append([*SP.encode(r.text or ""), SP.eos_id()])
            assert sorted((r.doc_id, list(r.ids)) for r in after) == sorted((i, ids) for i, lists in texts.items() for ids in lists)
        docs = out
    assert seen["quality classifier"] > seen["exact dedup"] >= seen["n-gram Jaccard join"] > 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
