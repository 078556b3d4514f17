import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tagsift.llm.packing import pack
from tagsift.llm.queries_tokens import op1_packing
from tagsift.llm.tokens import PieceEncoder
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOK = Tokenizer.from_file(PATH)
TOK.encode_special_tokens = True


def plain_ids(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, texts):
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        ids = np.frombuffer(b"".join(own.ids), dtype="<u4").tolist()
        assert ids == plain_ids(texts[doc])
        assert (own.start.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all()
        assert (own.doc_tokens == len(ids)).all()


def check_sequences(pieces, seq_len):
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all()
        assert own.length.sum() <= seq_len


def test_every_id_once_and_little_padding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = pack(docs.repartition(5), PATH).toPandas()
    texts = docs.toPandas().set_index("doc_id").text.to_dict()
    assert set(pieces.doc_id) == set(texts)
    check_pieces(pieces, texts)
    check_sequences(pieces, 2048)
    fill = pieces.groupby("sequence_id").length.sum()
    assert (fill < 2048).sum() <= 0.05 * len(fill) + 1


def test_query_digests(spark):
    out = op1_packing(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id").text
    for r in out.itertuples():
        ids = plain_ids(docs[r.doc_id])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "null key", "c"), (4, "same", "d"), (4, "same", "d"),
            (5, "long word " * 5000, "e"), (6, "  a\n\n b\t\x1c <|endoftext|> it's 12² مر ", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pack(docs, PATH, seq_len=64, open_windows=3).toPandas()
    assert len(out[out.doc_id == 1]) == 1 and out[out.doc_id == 1].length.item() == 1
    assert out.doc_id.isna().sum() >= 1
    assert sum(out.length) == sum(len(plain_ids(t)) for _, t, _ in rows)
    check_pieces(out[out.doc_id.isin([1, 2, 5, 6])], {k: t for k, t, _ in rows})
    check_sequences(out, 64)
    fill = out.groupby("sequence_id").length.sum()
    assert fill.max() <= 64 and (fill < 64).sum() <= 1
    assert pack(docs.limit(0), PATH).count() == 0


def test_encoder_with_small_caches(monkeypatch):
    monkeypatch.setattr("tagsift.llm.tokens.CACHE_PARTS", 3)
    enc = PieceEncoder(PATH)
    for text in ["a b c d e f", " a  b\n c", "a b c d e f g h", "a", "", "don't 'start we'll,ok e\u0301t\u0301e abc\u043c\u0438\u0440 x12 !,a."]:
        assert np.frombuffer(enc.encode([text])[0], dtype="<u4").tolist() == plain_ids(text)[:-1]


def test_special_strings_get_the_ids_of_the_file(spark, tmp_path):
    import corpus_pipeline
    plain = Tokenizer.from_file(PATH)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "ab<|endoftext|>cd ef  <|endoftext|>\n\n<|endoftext|><|endoftext|>'s x", "\u00e9<|endoftext|>1 <|endoftext",
             " <|endoftext|>", "no such string", "\u4e2d<|endoftext|> \t <|endoftext|>  "]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_packing(spark, str(tmp_path)).collect():
        own = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
    for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want[r.doc_id][r.start:r.start + r.length]
    known = PieceEncoder(PATH, special_ids=True)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in known.encode(texts)] == [w[:-1] for w in want]
