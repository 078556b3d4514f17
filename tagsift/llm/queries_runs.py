"""Queries op12 (runs of repeated words) and op13 (Merkle manifest)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.merkle import manifest, proof
from tagsift.llm.periodicity import find_runs
from tagsift.llm.shared import space_words, table


def _crc(key: str) -> Column:
    return F.crc32(F.col(key).cast("string"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by hash, the words from ``a`` on become a repetition of ``p`` words."""
    g = F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", _crc("doc_id").alias("h"))
    hit = rows.withColumn("w", F.when(F.col("h") % 10 == 0, space_words(F.col("text"))))
    hit = hit.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    hit = hit.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform("w", lambda w, i: F.get(F.col("w"), place(i).cast("int")))
    return hit.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    out = find_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))))
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.withColumn("best", F.get(best, F.lit(0)))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.b").alias("start"), (-F.col("best.a")).alias("length"),
        F.col("best.c").alias("period"), F.floor(-1000 * F.col("best.a") / F.col("best.c")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark, sf_dir):
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves, _ = manifest(table(spark, sf_dir, "documents"), "source", "doc_id",
                         ["doc_id", "source", "lang", "n_chars", "text"], _crc("doc_id") % 5 == 0, {"text": lower})
    return leaves.select("doc_id", "leaf", "subroot", "root", proof(F.col("siblings")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, levels: int) -> str:
    """Levels name0, name1, ... (tree, pos, d, c: nodes of the tree's level) and siblings name0s, ... of the table ``name``."""
    out = []
    for k in range(levels + 1):
        rows = (f"SELECT tree, pos, d FROM {name}" if not k else
                f"SELECT tree, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k - 1} WHERE c > 1 GROUP BY ALL")
        out.append(f"{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM ({rows}))")
        out.append(f"""{name}{k}s AS (
  SELECT tree, pos, array_to_string(l[1:pos % 16], '') AS a, array_to_string(l[pos % 16 + 2:], '') AS b
  FROM {name}{k} JOIN (SELECT tree, pos // 16 AS g, list(d ORDER BY pos) AS l FROM {name}{k} GROUP BY ALL) USING (tree)
  WHERE c > 1 AND g = pos // 16)""")
    return ",\n".join(out)


def _fold_sql(first: str, name: str, levels: int, into: str) -> str:
    """``into``0, ... : ``proof`` and ``f`` carried from the table ``first`` (tree, pos) up the levels of ``name``."""
    out = []
    for k in range(levels):
        out.append(f"""{into}{k} AS (
  SELECT x.* REPLACE (x.proof || coalesce(s.a || s.b, '') AS proof, CASE WHEN s.a IS NULL THEN x.f ELSE sha256(s.a || x.f || s.b) END AS f)
  FROM {first if not k else f'{into}{k - 1}'} x LEFT JOIN {name}{k}s s ON s.tree = x.tree AND s.pos = x.pos // {16 ** k})""")
    return ",\n".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_LEVELS = 6                      # of the SQL: up to 16 ** 6 rows a source
_FIELDS = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, c: list_reduce(list_concat([xor(acc, c)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({_FIELDS} || {_field_sql("text")}) AS d,
         CASE WHEN xor({_CRC}, 4294967295) % 5 = 0
              THEN sha256({_FIELDS} || {_field_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")}) END AS own
  FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM d),
{_tree_sql("leaf", _LEVELS)},
top AS (SELECT 0 AS tree, tree AS pos, d FROM ({" UNION ALL ".join(f"SELECT tree, d FROM leaf{k} WHERE c = 1" for k in range(_LEVELS + 1))})),
{_tree_sql("top", _LEVELS)},
root AS ({" UNION ALL ".join(f"SELECT d AS root FROM top{k} WHERE c = 1" for k in range(_LEVELS + 1))}),
own AS (SELECT *, '' AS proof, coalesce(own, d) AS f FROM leaf),
{_fold_sql("own", "leaf", _LEVELS, "low")},
mid AS (SELECT doc_id, d AS leaf, 0 AS tree, tree AS pos, proof, f FROM low{_LEVELS - 1}),
{_fold_sql("mid", "top", _LEVELS, "high")}
SELECT doc_id, leaf, d AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM high{_LEVELS - 1} x JOIN (SELECT pos AS p, d FROM top) t ON t.p = x.pos, root
"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs, "op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {"op13_merkle_manifest": OP13_SQL}
