import hashlib
import base64
import math
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tagsift.llm import sharding, warc
from tagsift.llm.queries_basic import op5_sharding
from tests.conftest import SMALL


def plain_shard(key, weights):
    def draw(i, w):
        h = xxhash.xxh64(struct.pack("<i", i), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
        return -math.log(((h >> 11) + 0.5) * 2.0 ** -53) / w
    return min((draw(i, w), i) for i, w in enumerate(weights))[1]


def test_sharding_query(spark):
    out = op5_sharding(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(out) == len(docs)
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.shard == plain_shard(str(r.doc_id), [1.0] * 40)
        assert r.grown_shard == plain_shard(str(r.doc_id), [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_sharding_cases(spark):
    rows = [(None, None, 1), (None, None, 1), (7, "", 2), (7, "", 2), (8, "é", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.assign_shards(df, "doc_id", "text", [1.0, 2.0], slices=2).toPandas()
    assert len(out) == 5 and out["size"].tolist().count(16) == 4 and out["size"].max() == 18
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.assign_shards(df.limit(0), "doc_id", "text", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(None, [1.0, 0.0])


def test_weights_decide_shares(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    out = sharding.assign_shards(df, "doc_id", "text", [1.0, 3.0], new_weight=4.0).toPandas()
    assert abs((out["shard"] == 1).mean() - 0.75) < 0.02
    assert abs((out["grown_shard"] == 2).mean() - 0.5) < 0.02
    assert ((out["grown_shard"] == out["shard"]) | (out["grown_shard"] == 2)).all()


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/%41", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (9, "u", ""),
            (None, "n", "same"), (5, "e", "WARC-Type: x\r\n\r\nÉ"), (5, "e", "WARC-Type: x\r\n\r\nÉ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = warc.read_archive(spark, path)
    got = {(r.key, r.url, r.record_type, r.refers_to, bytes(r.payload)) for r in records.collect()}
    assert got == {("3", "http://a/%41", "revisit", "1", b"same"), ("1", "http://b\r\nX: y", "response", None, b"same"),
                   (None, "n", "revisit", "1", b"same"), ("2", None, "response", None, b""),
                   ("9", "u", "revisit", "2", b""), ("5", "e", "response", None, "WARC-Type: x\r\n\r\nÉ".encode()),
                   ("5", "e", "revisit", "5", "WARC-Type: x\r\n\r\nÉ".encode())}
    for r in records.collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    ids, refers = set(), set()
    for r in warc.record_bytes(records).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        ids.add(re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", head)[1])
        refers |= set(re.findall(rb"WARC-Refers-To: (\S+)\r\n", head))
        assert (b"\r\nWARC-Profile: http" in head) == (b"WARC-Type: revisit" in head) == (b"\r\nWARC-Refers-To: " in head)
        assert body.endswith(b"\r\n\r\n") and int(head.rsplit(b"Content-Length: ", 1)[1]) == len(body) - 4


    assert len(ids) == len(rows) and len(refers) == 3 and refers < ids
    warc.write_archive(pages, f"file://{tmp_path}/other", date=F.concat(F.lit("2024-01-0"), F.col("page_id") % 9, F.lit("T00:00:00Z")))
    more = warc.read_archive(spark, f"file://{tmp_path}/other").collect()
    assert not ids & {re.search("<urn:uuid:[^>]*>", r.header)[0].encode() for r in more}
    assert {re.search("WARC-Date: (.*)\r", r.header)[1] for r in more if r.key == "3"} == {"2024-01-03T00:00:00Z"}


def test_archive_short_payloads_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "ab"), (2, "b", "ab"), (3, "c", "long enough"), (4, "d", "long enough")],
                                  "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/b", min_bytes=5)
    kinds = {r.key: r.record_type for r in warc.read_archive(spark, f"file://{tmp_path}/b").collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read_archive(spark, f"file://{tmp_path}/c").count() == 0


def test_archive_finds_damage(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    warc.write_archive(spark.createDataFrame([(1, "a", "ab")], "page_id long, url string, html string"), path)
    rows = spark.read.parquet(f"{path}/payloads").selectExpr("address", "encode('no', 'UTF-8') AS payload").collect()
    spark.createDataFrame(rows, "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()
