import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from wavemill.llm import queries, sentencepiece_codec, token_files
from wavemill.llm.chunk_table import ChunkTable, corpus_table
from wavemill.llm.common import span_hashes, text_slices, word_bounds

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _sp(text):
    ids = [*SP.encode(text or ""), SP.eos_id()]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_sentencepiece_equals_library(spark, odd, sf):
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    got = sorted(map(tuple, sentencepiece_codec.encode(odd.select("doc_id", "text"), outputs=outputs).collect()))
    assert got == sorted((r.doc_id, *_sp(r.text)) for r in odd.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:4] for r in queries.op2_sentencepiece_codec(spark, sf).collect()}
    assert got == {r.doc_id: _sp(r.text) for r in docs}


def test_sentencepiece_ids_round_trip(odd):
    coded = sentencepiece_codec.encode(odd)
    assert coded.columns == ["doc_id", "source", "ids", "n_tokens"]
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in sentencepiece_codec.decode(coded).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")


def test_codecs_on_nothing(nothing):
    assert sentencepiece_codec.encode(nothing).count() == 0
    assert token_files.write_and_index(nothing).count() == 0


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files_equal_library(spark, odd, sf, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = sorted(((r.doc_id, _ids(tokenizer, r.text)) for r in docs.collect()), key=lambda x: x[0])
        expected, start = [], 0
        for i, ids in rows:
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, token_files.write_and_index(docs).collect())) == sorted(expected)


def test_token_files_prune(spark, sf, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), path)
    one = token_files.read_token_files(spark, path).where("doc_id = 7")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("bits", [0, 61])  # 61: three bits of hash are left, most chunks meet another's hash
def test_small_tables_and_weak_hashes_give_the_same(odd, bits):
    column = pa.array([r.text for r in odd.collect()], pa.string())
    weak = lambda data, a, b: span_hashes(data, a, b) >> np.uint64(bits)
    encode, given = lambda c: [list(x.encode()) for x in c], ([b"word", b"lorem"], [list(b"word"), list(b"lorem")], ["word", "lorem"])
    whole = ChunkTable(encode, lambda c, ids: c, limit=1000)
    small = ChunkTable(encode, lambda c, ids: c, limit=12, hashes=weak, given=given)
    for _, _, data, offsets in text_slices(column, 40):
        starts, ends, _ = word_bounds(data, offsets)
        a, b = (t.look_up(data, starts, ends) for t in (whole, small))
        assert (whole.gather(a)[0] == small.gather(b)[0]).all()
        assert [whole.decimals[k] for k in a] == [small.decimals[k] for k in b] and [whole.extras[k] for k in a] == [small.extras[k] for k in b]
        assert [whole.raw[k] for k in a] == [data.tobytes()[x:y] for x, y in zip(starts, ends)]


@pytest.mark.parametrize("limit", [0, 3, 50])
def test_corpus_table_is_bounded_and_gives_the_same(odd, limit):
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    got = sorted(map(tuple, sentencepiece_codec.encode(odd.select("doc_id", "text"), outputs=outputs, table_chunks=limit).collect()))
    assert got == sorted((r.doc_id, *_sp(r.text)) for r in odd.collect())
    if limit:
        made = corpus_table(odd.select("text"), sentencepiece_codec._cuts, lambda chunks: [([1], c) for c in chunks], limit).collect()
        assert 0 < len(made) <= limit and len({r.chunk for r in made}) == len(made)
