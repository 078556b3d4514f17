"""Query op1 (packing)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tagsift.llm.packing import pack
from tagsift.llm.shared import table


def op1_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                  special_ids=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
ORACLE = {}
