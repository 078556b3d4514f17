"""Quality rules on documents and on their hosts, in SQL functions only.

Documents: counts of a text (words, symbols, repeated lines, words inside repeated 8-word windows) and
rules on them.  Two rules are hard: a document that fails one is rejected.  Three are soft.

Hosts: failures (of any rule) are aggregated by host, and each host's rate is shrunk towards the rate
of all hosts by a beta prior fitted to the hosts' rates (by moments), so a host with few documents is
not judged by them alone.  A host whose shrunk rate is over ``max_host_rate`` gets a verdict, which is
joined back: there, a document that fails a soft rule is rejected too.  A document that fails no rule
is kept whatever its host.

Scale: the counts are one expression per row, written once (a few numbers a document); hosts are
aggregated with partial sums before the shuffle, so a host with a third of all rows is no hot spot; the
verdicts join as a plain equi-join of two shuffled sides (a hot host's rows are split by AQE).  Only
hosts with a bad verdict are joined.

Cases: a null or empty text has no words and fails the rule on length; a null host has no verdict;
repeated rows are judged each on its own; an empty table gives no rows.  ``judge`` hands back
columns of its input inside one struct, so that names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import SPACE_CHARS, bind, space_words, written

WINDOW = 8
MIN_WORDS = 20                  # hard
MAX_REPEAT_PERCENT = 30         # hard: words in repeated windows
MAX_SYMBOL_PERCENT = 20         # soft: symbols against words
MAX_DUP_LINE_PERCENT = 30       # soft: repeated lines against words * lines
MEAN_WORD_CHARS = (2, 12)       # soft
MAX_HOST_RATE = 0.5
BROADCAST_BYTES = 16 * 1024 * 1024   # of names of bad hosts
SALTS = 64
LEAST_PRIOR = 10.0              # the prior weighs as much as so many documents, at least


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are hashed; only when the distinct hashes are fewer than the windows are they sorted with
    their positions.  Equal neighbours are the repeated windows; between two of them that start d words
    apart the earlier one adds min(d, 8) words, the last one 8.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_sorted(rows: Column) -> Column:
        def place(r: Column, j: Column) -> Column:
            near = [F.get(rows, k)["h"] == r["h"] for k in (j - 1, j + 1)]
            return F.when(near[0] | near[1], r["i"])
        pos = F.sort_array(F.filter(F.transform(rows, place), lambda p: p.isNotNull()))
        return bind(pos, covered)

    def counted(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(rows, of_sorted))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(bind(hashes, counted))


def text_counts(words: Column, text: Column) -> dict[str, Column]:
    """Counts of a text whose words are given as an array column; all are longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CHARS}]")))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE_CHARS}]")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(words),
    }
    return {k: v.cast("long") for k, v in counts.items()}


def _rules(c: dict[str, Column]) -> tuple[Column, Column]:
    """(hard, soft) failures."""
    n = c["n_words"]
    hard = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    low, high = MEAN_WORD_CHARS
    soft = ((100 * c["n_symbols"] > MAX_SYMBOL_PERCENT * n) | (100 * c["n_dup_lines"] > MAX_DUP_LINE_PERCENT * c["n_lines"])
            | (c["word_chars"] < low * n) | (c["word_chars"] > high * n))
    return hard, soft


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, keep: list[Column], text: str, host: str) -> DataFrame:
    """One row per document: the columns ``keep``, _host and a struct _counts."""
    base = docs.select(*keep, F.col(host).cast("string").alias("_host"), F.col(text).alias("_text"),
                       space_words(F.col(text)).alias("_words"))
    counts = text_counts(F.col("_words"), F.col("_text"))
    rest = [c for c in base.columns if c not in ("_text", "_words")]
    return base.select(*rest, F.struct(*[v.alias(k) for k, v in counts.items()]).alias("_counts"))


def bad_hosts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_host of the hosts whose shrunk failure rate is over ``max_rate``.

    The prior's two parameters are scalar aggregates over the hosts' table: with mean m and variance v
    of the rates, alpha + beta = m (1 - m) / v - 1 (at least LEAST_PRIOR), alpha = m (alpha + beta).
    """
    hard, soft = _rules({k: F.col(f"_counts.{k}") for k in COUNTS})
    hosts = measured.where(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hard | soft).alias("failed"))
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.sum("failed") / F.sum("n"), F.coalesce(F.var_pop(rate), F.lit(0.0))).first()
    m = m or 0.0
    strength = max(LEAST_PRIOR, m * (1 - m) / v - 1) if v else LEAST_PRIOR
    shrunk = (F.col("failed") + m * strength) / (F.col("n") + strength)
    return hosts.where(shrunk > max_rate).select("_host")


def _with_verdicts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` with _bad (null: not bad).  Bad hosts are few; beyond BROADCAST_BYTES of names a host's rows are spread by a salt."""
    size = verdicts.agg(F.sum(F.octet_length("_host") + F.lit(32))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return measured.join(F.broadcast(verdicts), "_host", "left")
    salted = measured.withColumn("_salt", F.pmod(F.hash("_counts"), F.lit(SALTS)))
    each = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, ["_host", "_salt"], "left").drop("_salt")


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", host: str = "source",
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The columns ``keep`` (default: all) in a struct ``doc``, n_words ... n_repeat_words, base_failed, host_failed, kept.

    The measured rows are written to the shared folder (the host table and the verdicts both need them).
    """
    measured = written(measure(docs, [F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc")],
                               text, host),
                       "quality")
    hard, soft = _rules({k: F.col(f"_counts.{k}") for k in COUNTS})
    out = _with_verdicts(measured, written(bad_hosts(measured, max_rate).withColumn("_bad", F.lit(True)), "bad-hosts"))
    host_failed = F.coalesce(F.col("_bad"), F.lit(False)) & soft
    return out.select("doc", *[F.col(f"_counts.{k}").alias(k) for k in COUNTS], hard.alias("base_failed"),
                      host_failed.alias("host_failed"), (~hard & ~host_failed).alias("kept"))
