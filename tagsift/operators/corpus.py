"""Corpus and match preparation (Q-DOC, Q-MATCH, Q-SPECIES, SNK-01).

Arrival order matters for de-duplication in the reference (first copy of a
document wins; first match of a span wins).  Text sources have no line
number, so callers pass an explicit order (source rank, file, line).  The
"first row per key" operators are hash aggregates with ``min_by`` over that
order: partial aggregation runs map-side, so a document id repeated in many
files shuffles one row per map task, not every copy, and no per-key sort is
needed (a window with row_number would sort every copy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.functions.text import TAB_ESCAPE


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """WIN-01/02, SRC-04: one row per key, the first (or last) in ``order``."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    g = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def split_corpus_line(line: Column) -> Column:
    """Fields of a raw corpus line, with backslashes doubled (FN-01) and trailing empty fields dropped.

    A trailing CR is removed first.  Dropping trailing empty fields is what
    splitting in the reference does (Q-12), and it equals removing trailing TABs.
    """
    s = F.regexp_replace(line, "\r$", "")
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.split(F.regexp_replace(s, "\t+$", ""), "\t")


def build_documents(lines: DataFrame, excluded: DataFrame | None = None,
                    order: Sequence[str] = ("source_rank", "line_no")) -> DataFrame:
    """Q-DOC: raw corpus lines -> document table.

    FLT-01: keys must start with PMID:<digits>; the digits are the id.
    WIN-01: the first copy of an id in arrival order claims it, even when it
    is then dropped as incomplete.  JN-03: ids on the exclusion list are
    dropped.  FLT-02: authors, publication and year must be present.
    Output: doc_id, keys, authors, journal, year, text (parts joined by a
    literal backslash-t).
    """
    f = lines.select(*order, split_corpus_line(F.col("line")).alias("f"))
    f = f.withColumn("doc", F.regexp_extract(F.col("f")[0], r"^PMID:([0-9]+)", 1)).where(F.col("doc") != "")
    first = first_by(f, ["doc"], list(order))
    if excluded is not None:
        first = first.join(excluded.select(F.col("doc_id").cast("string").alias("doc")), "doc", "left_anti")
    first = first.where(F.size("f") >= 4)
    return first.select(
        F.col("doc").cast("bigint").alias("doc_id"),
        F.col("f")[0].alias("keys"), F.col("f")[1].alias("authors"),
        F.col("f")[2].alias("journal"), F.col("f")[3].alias("year"),
        F.array_join(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), TAB_ESCAPE).alias("text"))


def resolve_matches(raw: DataFrame, entities: DataFrame, entity_order: str | None = None) -> DataFrame:
    """Q-MATCH (JN-01 + SRC-04): raw matches -> database matches via the serial.

    The dictionary type replaces the match type.  With ``entity_order`` the
    last entity row per serial wins.  Inner join: serials missing from the
    dictionary drop their matches.  Output keeps any ``line_no`` of the raw
    rows (the arrival order the species branch needs).
    """
    ent = entities
    if entity_order is not None:
        ent = first_by(entities, ["serial"], [entity_order], last=True).drop(entity_order)
    ent = ent.select("serial", "type", "identifier")
    keep = [c for c in ("doc_id", "line_no", "start", "stop") if c in raw.columns]
    return raw.select(*keep, "serial").join(ent, "serial", "inner").drop("serial")


def add_rank(matches: DataFrame, ranks: DataFrame, default: str = "unknown") -> DataFrame:
    """JN-02: rank of each match's taxonomy id (its identifier), ``unknown`` when missing."""
    r = ranks.select(F.col("taxid").alias("identifier"), "rank")
    return matches.join(r, "identifier", "left").withColumn("rank", F.coalesce("rank", F.lit(default)))


def missed_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-02 / JN-06, misses: key values of ``rows`` that ``table`` lacks, and the number of rows each of them leaves out.

    Rows are counted per key before the join, so a hot key meets the table as one row.  A null never meets a
    partner and is reported as null.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(table.select(*keys), list(keys), "left_anti")


def species_matches(matches: DataFrame, ranks: DataFrame, organism_type: int = -2,
                    order: Sequence[str] = ("doc_id", "line_no")) -> DataFrame:
    """Q-SPECIES: organism matches (FLT-03), first per span (WIN-02), ranked (JN-02), species only (FLT-04)."""
    org = matches.where(F.col("type") == organism_type)
    first = first_by(org, ["doc_id", "start", "stop", "type"], list(order))
    ranked = add_rank(first, ranks)
    return ranked.where(F.col("rank") == "species").select("doc_id", "start", "stop", "type", "identifier")


def documents_with(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """JN-04: documents that have at least one of the given matches (semi join on doc_id)."""
    return docs.join(matches.select("doc_id"), "doc_id", "left_semi")


def shard_column(doc_id: Column, n: int = 300) -> Column:
    """SNK-01: zero-padded shard number doc_id mod n (width of n-1)."""
    return F.lpad(F.pmod(doc_id, F.lit(n)).cast("string"), len(str(n - 1)), "0")


def write_sharded(df: DataFrame, path: str, n: int = 300, fmt: str = "parquet") -> None:
    """SNK-01: write partitioned by shard, one directory per shard.

    Rows are brought together by shard and then rebalanced: tasks follow the written sizes, so small shards
    share a task and a large shard is split over several (one file each).
    """
    rows = df.withColumn("shard", shard_column(F.col("doc_id"), n))
    rows.hint("rebalance", F.col("shard")).write.mode("overwrite").partitionBy("shard").format(fmt).save(path)


def shard_range(df: DataFrame, lo: int, hi: int, n: int = 300) -> DataFrame:
    """FLT-14: shards lo..hi of a sharded table (pruned to those directories when read from disk)."""
    width = len(str(n - 1))
    return df.where(F.col("shard").between(str(lo).zfill(width), str(hi).zfill(width)))
