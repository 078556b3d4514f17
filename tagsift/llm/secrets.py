"""Secret scans, in SQL functions only: fixed patterns, and character Markov models.

Patterns (base spans): ``assign`` (a key word, ``:`` or ``=``, a value of 12 or more characters),
``access`` (AKIA and upper-case letters or digits, 18 or more) and ``hex`` (16 or more hex digits),
each kind leftmost and non-overlapping, ends exclusive, in code points.

Models: first-order character chains of random strings and of ordinary identifiers, compared by their
log-likelihood ratio per transition.  Both are trained on labelled samples: the values that the
patterns found are labelled random; all runs of CHARACTER that no base span touches, digits and
separators included, are labelled ordinary (of one hash value in ``sample_share``, by default of all).
Each distinct string counts once.  Tokens long enough to be scored may be unlabelled keys, so those that the
chains find nearer to random by the shorter ones alone don't train the ordinary chain.  Every row of a chain leans on
a fixed base (random: all characters alike; ordinary: mostly the class of the character before) and keeps a
fixed share of it however large the counts are, so a character that never occurred costs the same at every
size of the input.  The chains have ``len(ALPHABET) ** 2`` cells, which is all that reaches the driver.  A run of
TOKEN_CHARS or more of CHARACTER outside the base spans (also what such a span leaves of a longer run) adds a span of kind
``markov`` if its ratio is over ``min_ratio``; for runs of fewer than FULL_CHARS, whose mean says less, the limit is higher.

Scale: one pass over the texts finds the patterns (three regular expressions, split and extract, only
where the text has a match); the training pass takes distinct tokens of each text, then of all texts, by a
hash aggregate, and sums transitions before it shuffles, of which there are at most a few thousand distinct
ones; scoring is one expression against a literal array.  Everything about a text is linear in its length and spans:
running sums are made in blocks, and pieces of a text are read from chunks of CHUNK characters.

Cases: a null text is empty and has no spans; long texts are read whole; repeated rows are scanned each
on its own; without labelled samples on both sides the models say nothing and only base spans are
found; an empty table gives no rows.  Columns of the input come back inside a struct, so that names
can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import bind, written

# The patterns of the three kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"           # of maximal runs, those of 16 and more: the same as "+" and a test
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CHARACTER = "[A-Za-z0-9+/_-]"
TOKEN_CHARS = 12                # shorter tokens aren't scored
FULL_CHARS = 20                 # from this length on the limit is min_ratio itself
TOKEN = f"{CHARACTER}{{{TOKEN_CHARS},}}"
HIT = "\uffff"                  # stands for a base span when tokens are cut
SAMPLE_SHARE = 1                # of the hash values of ordinary tokens, one in so many is sampled: all
PRIOR_WEIGHT = 20.0             # smoothing of a chain's rows, in observations
CLASS_SIZES = [26, 26, 10, 4]   # of ALPHABET: lower case, upper case, digits, separators
CLASS_STEPS = [[0.80, 0.05, 0.05, 0.10], [0.40, 0.40, 0.05, 0.15], [0.05, 0.05, 0.70, 0.20], [0.40, 0.20, 0.35, 0.05]]
CLASS_SHARE = 0.4               # of the ordinary base, so much follows CLASS_STEPS, the rest the single characters
KEPT = {"random": 0.5, "ordinary": 0.05}    # share of its base that every row of a chain keeps
MIN_RATIO = 1.0                 # nats per transition
CHUNK = 1024                    # characters of a piece of a long text
_BLOCK = 128                    # values of a block of running sums
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _running(values: Column, op) -> Column:
    """``op`` of every value of a not empty array and all before it, in blocks: appending to one accumulator would copy it every time."""
    def along(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(
            acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), x)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
                         lambda b: along(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    return bind(blocks, lambda inner: bind(along(F.transform(inner, lambda r: F.element_at(r, -1))), lambda tops: F.flatten(
        F.transform(inner, lambda r, b: F.transform(r, lambda x: F.when(b == 0, x).otherwise(op(F.get(tops, b - 1), x)))))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct(start, end, value)> of all matches of a pattern; the text between them gives their places."""
    def located(all_: Column) -> Column:
        sizes = bind(F.split(text, pattern, -1), lambda gaps: F.transform(all_, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return bind(bind(sizes, lambda n: _running(n, _sum)), lambda ends: F.transform(all_, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"))))

    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.when(F.rlike(text, F.lit(pattern)), bind(all_, located)).otherwise(F.array().cast(_SPAN))
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least)


def base_spans(text: Column) -> Column:
    """array<struct(start, kind, end, value)>, by start, then kind as listed."""
    def of_kind(no: int, pattern: str, group: int, least: int) -> Column:
        return F.transform(_found(text, pattern, group, least), lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind"), s["end"].alias("end"),
            F.regexp_extract(s["value"], pattern, group).alias("value")))

    parts = [of_kind(0, ASSIGN, 2, 12), of_kind(1, ACCESS, 0, 18), of_kind(2, HEX, 0, 16)]
    return F.array_sort(F.concat(*parts))


def scan_base(docs: DataFrame, keep: list[str] | None, text: str) -> DataFrame:
    """Struct ``doc``, ``text`` (null: empty) and ``spans`` of the patterns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("spans", base_spans(F.col("text")))


def _pairs(s: Column) -> Column:
    """All neighbouring characters of a string, in order."""
    return F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1))


def _transitions(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of the samples, by label."""
    known = F.rlike("pair", F.lit(f"^{CHARACTER}{{2}}$"))
    pairs = samples.select("label", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("label", "pair")
    return pairs.agg(F.count(F.lit(1)).alias("n")).where(known)


def _collected(counted: DataFrame, table: dict[str, list[int]]) -> None:
    """Add the counts to those of their label."""
    for r in counted.collect():                  # at most 2 * n * n rows
        table[r["label"]][ALPHABET.index(r["pair"][0]) * len(ALPHABET) + ALPHABET.index(r["pair"][1])] += r["n"]


def _base(counts: list[int], label: str) -> list[float]:
    """The fixed distribution that a chain's rows lean on, row by row (of ordinary tokens in part the characters' shares)."""
    n = len(ALPHABET)
    if label == "random":
        return [1 / n] * (n * n)
    of = [k for k, size in enumerate(CLASS_SIZES) for _ in range(size)]
    total = sum(counts) + n / 2
    single = [(sum(counts[j::n]) + 0.5) / total for j in range(n)]
    return [CLASS_SHARE * CLASS_STEPS[of[i]][of[j]] / CLASS_SIZES[of[j]] + (1 - CLASS_SHARE) * single[j]
            for i in range(n) for j in range(n)]


def _chain(counts: list[int], label: str) -> list[float]:
    """Log probabilities of a chain: each row leans on its base with weight PRIOR_WEIGHT, and keeps a share of it."""
    n, base, kept = len(ALPHABET), _base(counts, label), KEPT[label]
    out = []
    for i in range(n):
        row = slice(i * n, (i + 1) * n)
        whole = sum(counts[row]) + PRIOR_WEIGHT
        out += [math.log((1 - kept) * (c + PRIOR_WEIGHT * b) / whole + kept * b) for c, b in zip(counts[row], base[row])]
    return out


def _samples(scanned: DataFrame, sample_share: int) -> DataFrame:
    """Distinct strings ``s`` by label: what the patterns found, and runs of two and more of CHARACTER that no base span touches."""
    runs = F.regexp_extract_all(redact(F.col("text"), F.col("spans"), HIT), F.lit(f"[{HIT}{CHARACTER[1:]}{{2,}}"), F.lit(0))
    free = F.filter(F.array_distinct(runs), lambda r: ~F.contains(r, F.lit(HIT)))
    if sample_share > 1:
        free = F.filter(free, lambda r: F.pmod(F.xxhash64(r), F.lit(sample_share)) == 0)
    both = F.map_from_arrays(F.array(F.lit("random"), F.lit("ordinary")), F.array(F.col("spans.value"), free))
    return scanned.select(F.explode(both).alias("label", "all")).select("label", F.explode("all").alias("s")).distinct()


def train(scanned: DataFrame, sample_share: int = SAMPLE_SHARE) -> list[float] | None:
    """Log-likelihood ratios of all transitions (row by row of ALPHABET), or None without samples of both kinds."""
    table = {label: [0] * len(ALPHABET) ** 2 for label in KEPT}

    def ratios() -> list[float]:
        logs = {k: _chain(v, k) for k, v in table.items()}
        return [r - o for r, o in zip(logs["random"], logs["ordinary"])]

    samples = written(_samples(scanned, sample_share), "samples")
    scored = (F.col("label") == "ordinary") & (F.length("s") >= TOKEN_CHARS)
    _collected(_transitions(samples.where(~scored)), table)
    if not any(table["random"]):
        return None
    plain = mean_ratio(F.col("s"), F.lit(ratios())) <= 0
    _collected(_transitions(samples.where(scored).where(plain)), table)
    return ratios() if any(table["ordinary"]) else None


def mean_ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per transition of a token over ALPHABET."""
    n = len(ALPHABET)

    def place(pair: Column, i: int) -> Column:
        return F.position(F.substring(pair, i, 1), F.lit(ALPHABET)) - 1

    each = F.transform(_pairs(token), lambda p: F.get(model, place(p, 1) * n + place(p, 2)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.length(token) - 1)


def find_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text", min_ratio: float = MIN_RATIO,
                 sample_share: int = SAMPLE_SHARE) -> DataFrame:
    """Per row: struct ``doc`` of the columns ``keep`` (default: all), text, and spans by start, then kind:
    array<struct(start, kind, end, value)>, kind a place in KINDS."""
    scanned = scan_base(docs, keep, text)
    ratios = train(scan_base(docs, [text], text), sample_share)
    if ratios is None:
        return scanned
    model = F.lit(ratios)
    markov = KINDS.index("markov")

    def over(t: Column) -> Column:
        short = F.lit(float(FULL_CHARS)) / F.least(F.length(t["value"]), F.lit(FULL_CHARS))
        return mean_ratio(t["value"], model) > F.lit(min_ratio) * short

    def added(spans: Column) -> Column:
        # Base spans are blotted out character by character, so the places stay.
        free = covered(F.col("text"), spans, lambda fresh, n: F.repeat(F.lit(HIT), n))
        tokens = bind(free, lambda t: F.filter(_found(t, TOKEN, 0, TOKEN_CHARS), over))
        extra = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(markov).alias("kind"),
                                                       t["end"].alias("end"), t["value"].alias("value")))
        return F.array_sort(F.concat(spans, extra))

    return scanned.withColumn("spans", bind(F.col("spans"), added))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def covered(text: Column, spans: Column, instead) -> Column:
    """The text with every span replaced by ``instead(fresh, n)``: n characters of it that no earlier span covers, fresh if it
    begins after or where the earlier ones end."""
    def built(chunks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """Characters a to b of the text."""
            def part(c: Column) -> Column:
                low = F.greatest(a - c * CHUNK, F.lit(0))
                return F.substring(F.get(chunks, c), low + 1, F.least(b - c * CHUNK, F.lit(CHUNK)) - low)
            whole = F.transform(F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")), part)
            return F.when(b > a, F.array_join(whole, "")).otherwise("")

        def joined(reach: Column) -> Column:
            def each(s: Column, i: Column) -> Column:
                before = F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
                fresh = s["start"] >= before
                return F.concat(F.when(fresh, piece(before, s["start"])).otherwise(""),
                                instead(fresh, F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0))))
            # What follows the last span is what the text ends in.
            return F.concat(F.array_join(F.transform(spans, each), ""), piece(F.element_at(reach, -1), F.length(text)))

        return bind(_running(F.transform(spans, lambda s: s["end"]), F.greatest), joined)

    return F.when(F.size(spans) > 0, bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), built)).otherwise(text)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    return covered(text, spans, lambda fresh, n: F.when(fresh, F.lit(mark)).otherwise(""))
