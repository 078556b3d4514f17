"""Benchmark decontamination by winnowing, in SQL functions only.

Of every GUARD - K + 1 consecutive word K-grams of a text the one with the least hash is kept, so any
span of GUARD words that a document shares with a benchmark item leaves at least one common K-gram at
the same place of the span.  Kept K-grams (fingerprints) of documents and items are joined; a match
gives the two texts' offset (diagonal), and along it the words are compared: every run of GUARD or more
equal words is hit.  Items of fewer than GUARD words are matched whole, by the hash of all their words.

Repetitive texts: where one fingerprint comes again and again at a step of at most K words, the words repeat with that
period, and its places are one run.  Two runs don't need all their diagonals: a window that leaves the repeated
stretch on either side lies on a diagonal that lines up the runs' beginnings or their ends (a few steps around are
taken, as the ends of a stretch may lose a fingerprint), and windows inside are covered by diagonals an item's stretch apart.
So a text of one word against such an item costs about their lengths, not the product.

Scale: documents are exploded into fingerprints (two in seven words) and met in the same stage with the
hashes of the items' fingerprints, which are broadcast only when their counted rows are under
``broadcast_rows``; above it the join shuffles both sides.  Only fingerprints that an item has are shuffled after that; they
are gathered by document and hash into runs, then by document and item into diagonals, and joined back to the
texts, where each document with matches is split into words once more.  Items' words join once per document and item, and are
broadcast only if they have at most ``BROADCAST_BYTES`` together.

Cases: a null text has no words; a text of any length is read whole; rows with equal key and text share
one result; a null item id counts as the id "null", equal item ids as one; an empty table on either
side leaves every document clean.  The documents' columns come back inside a struct, so that names
can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import bind, written

GUARD = 10                      # words of a window
K = 5                           # words of a K-gram
BROADCAST_ROWS = 500_000        # item fingerprints (24 bytes each) that may be broadcast
BROADCAST_BYTES = 32 * 1024 * 1024
_PLACE_BITS = 28                # of a numbered hash: more places than a text can have words
# Fixed value: word characters, all but ASCII's controls, signs and blanks.
_WORD = "\\p{Alnum}\\P{ASCII}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    # lower() touches A-Z alone in a text of ASCII, and is much cheaper than translate().
    whole = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.filter(F.split(low, f"[^{_WORD}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{_WORD}]+"))


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-word windows (an empty array if there is none)."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(k))))
                  ).otherwise(F.array().cast("array<long>"))


def _windowed(values: Column, n: int, join) -> Column:
    """``join`` of the values of every n neighbours, from windows of half the size that may overlap."""
    def grow(v: Column, size: int) -> Column:
        step = min(size, n - size)
        if step == 0:
            return v
        left = F.greatest(F.size(v) - step, F.lit(0))
        return bind(F.zip_with(F.slice(v, F.lit(1), left), F.slice(v, F.lit(1 + step), left), join), lambda w: grow(w, size + step))
    return grow(values, 1)


def fingerprints(words: Column, guard: int, k: int) -> Column:
    """array<struct(h, at)>: the first least K-gram hash of every guard - k + 1 neighbours.

    A hash's upper bits and its place make one number, so a window's least number says which place it keeps, and of
    equal ones the first.
    """
    span, place = guard - k + 1, (1 << _PLACE_BITS) - 1

    def keep(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, _PLACE_BITS), _PLACE_BITS) + i)
        least = bind(placed, lambda v: _windowed(v, span, lambda a, b: F.least(a, b)))
        at = F.transform(F.array_distinct(least), lambda v: v.bitwiseAND(F.lit(place)).cast("int"))
        return F.transform(at, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("at")))

    none = F.array().cast("array<struct<h:bigint,at:int>>")
    hashes = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda v: _windowed(v, k, lambda a, b: F.xxhash64(a, b)))
    return F.when(F.size(words) >= guard, bind(hashes, keep)).otherwise(none)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
                            item_words(F.col(text)).alias("item_words"))
    return written(rows.where(F.size("item_words") > 0).distinct()
                   .withColumn("item_no", F.monotonically_increasing_id()), "items")


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a written table only if its counted rows are within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def _runs(places: Column, k: int) -> Column:
    """array<struct(at, n, q)> of the sorted places of one fingerprint: n of them at steps of q <= k words (one: q = 0)."""
    def made(p: Column) -> Column:
        step = lambda i: F.get(p, i) - F.get(p, i - 1)
        linked = lambda i: (i > 0) & (step(i) <= k)
        begins = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: ~linked(i) | (linked(i - 1) & (step(i) != step(i - 1))))
        return bind(begins, lambda h: F.transform(h, lambda i, no: bind(
            F.coalesce(F.get(h, no + 1), F.size(p)) - i, lambda n: F.struct(
                F.get(p, i).alias("at"), n.alias("n"), F.when(n > 1, step(i + 1)).otherwise(0).alias("q")))))
    return bind(places, made)


def _diagonals(own: Column, item: Column, guard: int, k: int) -> Column:
    """Diagonals on which a run of the document and one of the same fingerprint of an item can have windows."""
    q = F.greatest(own["q"], item["q"])
    base = own["at"] - item["at"]
    # A stretch's last K-grams may be kept in one text and not in the other, guard - k + 1 words of them at most.
    near = (F.ceil(F.lit(guard - k + 1) / F.greatest(q, F.lit(1))) + 1).cast("int")
    around = F.sequence(-near, near)
    # The item's stretch is at least this long; diagonals this many steps apart have every window inside it.
    apart = F.greatest(F.floor(((item["n"] - 1) * q + (k - guard + 1)) / F.greatest(q, F.lit(1))), F.lit(1))
    steps = F.concat(around, F.transform(around, lambda x: x + own["n"] - item["n"]),
                     F.when(own["n"] > 1, F.sequence(F.lit(0), own["n"] - 1, apart.cast("int"))).otherwise(F.array().cast("array<int>")))
    regular = F.transform(F.array_distinct(steps), lambda t: base + t * q)
    # Runs of unlike steps: every pair of places.
    each = F.flatten(F.transform(F.sequence(F.lit(0), own["n"] - 1), lambda x: F.transform(
        F.sequence(F.lit(0), item["n"] - 1), lambda y: base + x * own["q"] - y * item["q"])))
    return (F.when((own["n"] == 1) & (item["n"] == 1), F.array(base))
            .when((own["n"] > 1) & (item["n"] > 1) & (own["q"] != item["q"]), each).otherwise(regular))


def matches(docs: DataFrame, items: DataFrame, guard: int, k: int, broadcast_rows: int) -> DataFrame:
    """_key, _sum, item_no, diagonals of every document (_key, _sum, _text) and item that share a fingerprint."""
    words = docs.select("_key", "_sum", item_words(F.col("_text")).alias("_words"))
    runs = items.where(F.size("item_words") >= guard).select(
        "item_no", F.explode(fingerprints(F.col("item_words"), guard, k)).alias("f")).groupBy("f.h", "item_no").agg(
        F.array_sort(F.collect_list("f.at")).alias("places"))
    runs = written(runs.select("h", "item_no", F.explode(_runs(F.col("places"), k)).alias("item_run")), "item-fingerprints")
    hashes = written(runs.select("h").distinct(), "item-hashes")
    own = (words.select("_key", "_sum", F.explode(fingerprints(F.col("_words"), guard, k)).alias("f"))
           .select("_key", "_sum", F.col("f.h").alias("h"), F.col("f.at").alias("at"))
           .join(_sized(hashes, broadcast_rows), "h", "left_semi"))
    own = own.groupBy("_key", "_sum", "h").agg(F.array_sort(F.collect_set("at")).alias("places")).select(
        "_key", "_sum", "h", F.explode(_runs(F.col("places"), k)).alias("run"))
    found = own.join(_sized(runs, broadcast_rows), "h").select(
        "_key", "_sum", "item_no", F.explode(_diagonals(F.col("run"), F.col("item_run"), guard, k)).alias("diagonal"))
    # Short items: one pass for each length that occurs (at most guard - 1 of them).
    short = items.where(F.size("item_words") < guard)
    for n in sorted(r[0] for r in short.select(F.size("item_words")).distinct().collect()):
        own = short.where(F.size("item_words") == n).select(F.xxhash64("item_words").alias("h"), "item_no")
        grams = words.select("_key", "_sum", F.posexplode(_grams(F.col("_words"), n)).alias("diagonal", "h"))
        found = found.unionByName(grams.join(_sized(own, broadcast_rows), "h").select("_key", "_sum", "item_no", "diagonal"))
    return found.groupBy("_key", "_sum", "item_no").agg(F.collect_set(F.col("diagonal").cast("int")).alias("diagonals"))


def _hit_positions(words: Column, own: Column, diagonal: Column, guard: int) -> Column:
    """Positions of the document's words that lie in runs of ``guard`` (or all the item's words ``own``) equal words on a diagonal."""
    need = F.least(F.lit(guard), F.size(own))
    same = F.array_join(F.transform(own, lambda w, i: F.when(F.get(words, diagonal + i) == w, "1").otherwise("0")), "")
    runs = F.array_join(F.transform(F.split(same, "0"), lambda r: F.when(F.length(r) >= need, r).otherwise(
        F.repeat(F.lit("0"), F.length(r)))), "0")
    places = F.transform(F.split(runs, ""), lambda c, i: F.when(c == "1", diagonal + i))
    return F.filter(places, lambda p: p.isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, key: str = "doc_id",
                  text: str = "text", item: str = "item_id", item_text: str = "text", guard: int = GUARD, k: int = K,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: struct ``doc`` of the columns ``keep`` (default: all), n_words, hits (sorted positions
    of the words that are hit), items (sorted ids of the items with occurring windows)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
                       F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"),
                       F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("_sum"), F.col(text).alias("_text"))
    items = _items(benchmark, item, item_text)
    found = matches(rows.select("_key", "_sum", "_text"), items, guard, k, broadcast_rows)
    size = items.agg(F.sum(F.octet_length(F.array_join("item_words", " ")) + 16 * F.size("item_words"))).first()[0] or 0
    own = (found.join(F.broadcast(items) if size <= BROADCAST_BYTES else items, "item_no").groupBy("_key", "_sum")
           .agg(F.collect_list(F.struct("item", "item_words", "diagonals")).alias("_matches")))
    joined = rows.join(own, ["_key", "_sum"], "left")

    def judged(words: Column) -> Column:
        each = F.transform("_matches", lambda m: F.struct(m["item"].alias("item"), F.array_distinct(F.flatten(F.transform(
            m["diagonals"], lambda d: _hit_positions(words, m["item_words"], d, guard)))).alias("at")))
        real = F.filter(each, lambda e: F.size(e["at"]) > 0)
        return bind(real, lambda r: F.struct(
            F.array_sort(F.array_distinct(F.flatten(F.transform(r, lambda e: e["at"])))).alias("hits"),
            F.array_sort(F.array_distinct(F.transform(r, lambda e: e["item"]))).alias("items")))

    result = F.when(F.col("_matches").isNotNull(), bind(item_words(F.col("_text")), judged))
    joined = joined.select("doc", count_words(F.col("_text")).cast("long").alias("n_words"), result.alias("_r"))
    return joined.select("doc", "n_words", F.coalesce("_r.hits", F.array().cast("array<int>")).alias("hits"),
                         F.coalesce("_r.items", F.array().cast("array<string>")).alias("items"))
