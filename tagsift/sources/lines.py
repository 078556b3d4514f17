"""Lines of text files with their true place, however Spark cuts and packs the files (SRC-01, SRC-18).

A task reads the lines of a split in order, so ``monotonically_increasing_id`` counts them; of every split only its
file, start, first id and number of lines are gathered (one row a split), summed up in file order and joined back.
Filters are not pushed below that id, so both readings cut the files alike; if they ever didn't, the rows
raise instead of getting a wrong number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], descending: bool = False) -> DataFrame:
    """file, line_no (in its file, from 1), place (in all files, from 1), line; files by path, or from the last to the first.

    Lines end at a line feed; one carriage return before it is dropped.  Compressed files are one split each.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_file = Window.partitionBy("file").orderBy("_block")
    # One row a split of the input, one file's splits or all: the numbers are small and of a size set by the reader.
    in_all = Window.orderBy(F.col("file").desc() if descending else F.col("file").asc(), "_block")
    splits = splits.withColumns({"_f": F.sum("_n").over(in_file) - F.col("_n"), "_a": F.sum("_n").over(in_all) - F.col("_n")})
    at = F.col("_id") - F.col("_first")
    ok = F.when((at >= 0) & (at < F.col("_n")), at).otherwise(F.raise_error(F.concat(F.lit("the splits changed while reading "), "file")).cast("long"))
    return raw.join(splits, ["file", "_block"]).select("file", (F.col("_f") + ok + 1).alias("line_no"), (F.col("_a") + ok + 1).alias("place"), "line")


def scan_numbered(spark: SparkSession, paths, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """SRC-18: file, line_no and exactly ``fields`` (name, type) of tab-separated lines.

    A line with another number of fields, or a value that isn't of its type, raises with file, line number and text.
    """
    n = len(fields)
    rows = numbered_lines(spark, paths).withColumn("f", F.split("line", "\t"))

    def wrong(what: Column, kind: str) -> Column:
        return F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "),
                                      what, F.lit(": "), F.col("line"))).cast(kind)

    count = F.concat(F.size("f").cast("string"), F.lit(f" fields, not {n}"))
    rows = rows.withColumn("f", F.when(F.size("f") == n, F.col("f")).otherwise(wrong(count, "array<string>")))
    out = []
    for i, (name, kind) in enumerate(fields):
        v = F.get("f", F.lit(i))
        made = v if kind == "string" else F.coalesce(v.try_cast(kind), wrong(F.lit(f"{name} is not a {kind}"), kind))
        out.append(made.alias(name))
    return rows.select("file", "line_no", *out)


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str], columns: Sequence[str], num_files: int | None = None) -> None:
    """ORD-02/03: tab-separated lines in a total order over many files: the files by name, and the rows in each, are in ``order``.

    Rows are range-partitioned and sorted in their partition; no task sees them all.  Doubles are written so that
    they read back the same, infinities as ``inf`` and ``-inf``.
    """
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.replace(v, F.lit("Infinity"), F.lit("inf")) if kinds[c] == "double" else F.coalesce(v, F.lit(""))

    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows.select(F.concat_ws("\t", *[text(c) for c in columns]).alias("value")).write.text(path)


def read_ordered(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(place, fields) of what ``write_ordered`` wrote: place counts the rows of all files in order."""
    rows = numbered_lines(spark, path).withColumn("f", F.split("line", "\t"))
    return rows.select("place", *[F.get("f", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
