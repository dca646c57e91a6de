"""Every Baum-Welch round of the registered query reads every training text."""

import zlib

from wavemill.llm import hmm, queries


def test_all_rounds_read_all_training_texts(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 11} end") for i in range(1800)]
    training = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    assert training > 1500
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, fitted = [], hmm.baum_welch

    def counted(train, chain, lexicon, rounds):
        seen.extend([train.count()] * rounds)
        return fitted(train, chain, lexicon, rounds)

    monkeypatch.setattr(hmm, "baum_welch", counted)
    assert queries.QUERIES["op8_hidden_markov"](spark, str(tmp_path)).count() == len(rows)
    assert seen == [training] * 10
