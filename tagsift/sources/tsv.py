"""Readers of the text formats that the stages exchange (SRC-01..19).

All are scans of ``spark.read.text``: splitting, checking and typing are column expressions, so any
number of files is read in parallel.  A row that breaks its format raises with the file's name and the
row's text.  Formats whose records are divided by blank lines (sentences, token tags) are read with the
blank line as the record separator, so no order between rows is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.functions.text import bind
from tagsift.sources.lines import numbered_lines

TAB = "\t"


def _lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, sep: str | None = None,
           whole: bool = False) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=whole, lineSep=sep, recursiveFileLookup=recursive).select(
        F.col("_metadata.file_path").alias("_file"), "value")


def _raise(what: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what} in "), F.col("_file"), F.lit(": "), F.col("value"))).cast(kind)


def _typed(value: Column, kind: str) -> Column:
    """The value cast to ``kind``; a text that isn't one raises."""
    if kind == "string":
        return value
    made = value.try_cast(kind)
    return F.when(made.isNotNull(), made).otherwise(_raise(f"not a {kind}", kind))


def scan_fields(spark: SparkSession, paths, fields: Sequence[tuple[str, str]], mode: str = "strict") -> DataFrame:
    """Tab-separated rows as typed columns.

    ``mode``: ``strict`` wants exactly the fields (SRC-06, SRC-18), ``prefix`` at least them and ignores the
    rest (SRC-09, SRC-19), ``last`` takes the last ones of a row that may begin with others (SRC-11).
    """
    n = len(fields)
    rows = _lines(spark, paths).select("_file", "value", F.split("value", TAB).alias("f"))
    bad = {"strict": F.size("f") != n, "prefix": F.size("f") < n, "last": F.size("f") < n}[mode]
    rows = rows.withColumn("f", F.when(bad, _raise(f"not {n} fields", "array<string>")).otherwise(
        F.slice("f", -n, n) if mode == "last" else F.slice("f", 1, n)))
    return rows.select(*[_typed(F.get("f", F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(fields)])


def scan_corpus(spark: SparkSession, sources: Sequence, descending: Sequence[bool] = ()) -> DataFrame:
    """SRC-01: corpus lines (also of .gz files) of sources in order of precedence: source_rank, line_no, line.

    A source is one or more paths; its files count by path, or from the last to the first where ``descending`` says so.
    ``line_no`` is the place of a line in its whole source, whatever splits Spark makes of the files.
    """
    out = None
    for rank, paths in enumerate(sources):
        down = rank < len(descending) and descending[rank]
        one = numbered_lines(spark, paths, down).select(F.lit(rank).alias("source_rank"), F.col("place").alias("line_no"), "line")
        out = one if out is None else out.unionByName(one)
    return out


def scan_exclusions(spark: SparkSession, paths) -> DataFrame:
    """SRC-02: doc_id (text), one a line."""
    return _lines(spark, paths).select(F.regexp_replace("value", "\r$", "").alias("doc_id"))


def scan_raw_matches(spark: SparkSession, paths) -> DataFrame:
    """SRC-03: of the 8 columns of a match row: doc_id, start, stop, type and serial; line_no is the arrival order."""
    f = F.split("line", TAB)
    rows = numbered_lines(spark, paths).select(F.col("place").alias("line_no"), F.when(F.size(f) == 8, f).otherwise(F.raise_error(
        F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"), F.lit(": not 8 fields: "), F.col("line"))
    ).cast("array<string>")).alias("f"))
    return rows.select("line_no", *[F.get("f", F.lit(i)).cast("long").alias(c) for i, c in ((0, "doc_id"), (3, "start"), (4, "stop"), (6, "type"), (7, "serial"))])


def scan_entities(spark: SparkSession, paths) -> DataFrame:
    """SRC-04: serial, type, identifier and line_no, by which the last row of a serial counts."""
    f = F.split("line", TAB)
    return numbered_lines(spark, paths).select(F.get(f, F.lit(0)).cast("long").alias("serial"), F.get(f, F.lit(1)).cast("int").alias("type"),
                                               F.get(f, F.lit(2)).alias("identifier"), F.col("place").alias("line_no"))


def scan_ranks(spark: SparkSession, paths) -> DataFrame:
    """SRC-05: exactly taxid, name, rank."""
    return scan_fields(spark, paths, [("taxid", "string"), ("name", "string"), ("rank", "string")])


PREDICTION_FIELDS = [("doc_id", "long"), ("ann_ids", "string"), ("s_type", "string"), ("before", "string"), ("name", "string"),
                     ("after", "string"), ("p_type", "string"), ("probs", "string")]


def scan_predictions(spark: SparkSession, paths) -> DataFrame:
    """SRC-08: prediction rows, strictly 8 fields; the last is a dictionary text of class probabilities -> MAP."""
    p = scan_fields(spark, paths, PREDICTION_FIELDS)
    probs = F.from_json(F.replace(F.col("probs"), F.lit("'"), F.lit('"')), "map<string,double>")
    return p.withColumn("probs", F.when(probs.isNotNull(), probs).otherwise(
        F.raise_error(F.concat(F.lit("not a dictionary of probabilities: "), F.col("probs"))).cast("map<string,double>")))


def scan_examples(spark: SparkSession, paths) -> DataFrame:
    """SRC-11: labelled examples, the last four columns of a row."""
    return scan_fields(spark, paths, [(c, "string") for c in ("label", "left", "span", "right")], mode="last")


def scan_sentences(spark: SparkSession, paths) -> DataFrame:
    """SRC-14: one sentence per line, a blank line between documents: _file, doc (sentences of a document as an array)."""
    d = _lines(spark, paths, sep="\n\n").select("_file", F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "").alias("sentences"))
    return d.where(F.size("sentences") > 0)


def scan_token_sentences(spark: SparkSession, paths) -> DataFrame:
    """SRC-16: token lines with white-space fields, the last two gold and predicted tag; blank lines end sentences.

    One row a sentence: sent_id (file and place in it), tags (token, gold, pred of its tokens in order).
    """
    s = _lines(spark, paths, sep="\n\n").withColumn("sent_id", F.monotonically_increasing_id())

    def token(line: Column) -> Column:
        return bind(F.split(F.trim(line), r"\s+"), lambda f: F.when(F.size(f) >= 3, F.struct(
            F.get(f, F.lit(0)).alias("token"), F.get(f, F.size(f) - 2).alias("gold"), F.get(f, F.size(f) - 1).alias("pred"))).otherwise(
            _raise("not a token line", "struct<token:string,gold:string,pred:string>")))

    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return s.select("sent_id", F.transform(lines, token).alias("tags")).where(F.size("tags") > 0)


def scan_token_tags(spark: SparkSession, paths) -> DataFrame:
    """SRC-16, one row a token: sent_id (file and place in it), pos, token, gold, pred."""
    t = scan_token_sentences(spark, paths).select("sent_id", F.posexplode("tags").alias("pos", "t"))
    return t.select("sent_id", (F.col("pos") + 1).alias("pos"), "t.*")


# The line before each log of a bundle, as ``tail`` prints it for several files.
BUNDLE_OPEN, BUNDLE_CLOSE = "==> ", " <=="


def scan_logs(spark: SparkSession, folder: str, bundles: bool = False) -> DataFrame:
    """SRC-17: lines of all log files below a folder: file_name, line_no, line (a log is read as one text).

    ``bundles``: the files hold many logs each (``sinks.write_log_bundles``), file_name is the name in the line before a log.
    Small logs by the hundred thousand are read so, as a file of their own costs each of them far more than its lines.
    """
    if bundles:
        # A record is a log, its first line ends the heading; the first record of a file still has the heading's beginning.
        logs = _lines(spark, folder, recursive=True, sep=f"\n{BUNDLE_OPEN}")
        head = F.substring_index("value", "\n", 1)
        name = F.regexp_replace(head, f"^{BUNDLE_OPEN}|{BUNDLE_CLOSE}$", "")
        logs = logs.select(F.when(head.endswith(BUNDLE_CLOSE), name).otherwise(_raise("no heading of a log", "string")).alias("_file"),
                           F.substr("value", F.length(head) + 2).alias("value"))
    else:
        logs = _lines(spark, folder, recursive=True, whole=True)
    return logs.select(F.col("_file").alias("file_name"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def scan_pairs(spark: SparkSession, paths) -> DataFrame:
    """SRC-15: ``a ||| b`` (the last separator divides) or ``a`` per line: unique_id (line number from 0), text_a, text_b (null without)."""
    pair = r"^(.*) [|]{3} (.*)$"
    line = F.trim("line")
    two = line.rlike(pair)
    return numbered_lines(spark, paths).select(
        (F.col("place") - 1).alias("unique_id"), F.when(two, F.regexp_extract(line, pair, 1)).otherwise(line).alias("text_a"),
        F.when(two, F.regexp_extract(line, pair, 2)).alias("text_b"))
