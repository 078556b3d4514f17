"""Tokenisation and fixed-length features (TOK-01..08, FEAT-01..06, SRC-12/13).

WordPiece runs as a corpus job over DISTINCT words, never per occurrence:
every substring of a word (up to the longest vocabulary entry) is joined to
the vocabulary, the longest match per start position is kept, and a short
walk over that per-word map (bounded by the word length) yields the pieces.
Texts are then tokenised by joining their basic tokens to the word -> pieces
table; each example's pieces are gathered back per example (bounded by the
example's length) and laid out into fixed-length arrays.

A vocabulary of at most ``SENT_VOCAB`` entries is sent to the texts instead (``piece_finder``): their words are divided where they are, each
once per task, and no word is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tagsift.functions.text import bind, texts_of

# Special tokens of the classifier vocabulary.
CLS, SEP, PAD, UNK, MASK = "[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"
SPAN_MARKER = "[unused1]"

# CJK ideograph blocks that get spaces around each character.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
              (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
# Punctuation: the four ASCII symbol ranges plus Unicode category P.
PUNCT_CLASS = r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\p{P}]"
TOKEN_WS_CLASS = r"[\t\n\r\p{Zs}]"
CONTROL_CLASS = r"[\x{0}\x{FFFD}\p{C}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def strip_accents(s):
    """TOK-03: NFD-decompose and drop combining marks (Arrow-batched; no SQL built-in does NFD)."""
    import unicodedata

    def one(x):
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn")
    return s.map(one)


def spaced_text(text, lower: bool = False) -> Column:
    """TOK-01..04: clean, space CJK, (lower + strip accents), split punctuation: the tokens with one space between them."""
    t = F.regexp_replace(_c(text), TOKEN_WS_CLASS, " ")           # whitespace -> space (TOK-01)
    t = F.regexp_replace(t, CONTROL_CLASS, "")                     # drop NUL, U+FFFD, controls
    cjk = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
    t = F.regexp_replace(t, f"({cjk})", " $1 ")                    # TOK-02
    if lower:
        t = strip_accents(F.lower(t))                              # TOK-03
    t = F.regexp_replace(t, f"({PUNCT_CLASS})", " $1 ")            # TOK-04
    return F.trim(F.regexp_replace(t, " +", " "))


def spaced_lines(text, lower: bool = False) -> Column:
    """``spaced_text`` of every line of a text (line ends are kept; more than one blank may stand between tokens)."""
    t = F.regexp_replace(F.translate(_c(text), "\t\r", "  "), r"\p{Zs}", " ")
    t = F.regexp_replace(t, CONTROL_CLASS[:-1] + r"&&[^\n]]", "")
    cjk = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
    t = F.regexp_replace(t, f"({cjk})", " $1 ")
    if lower:
        t = strip_accents(F.lower(t))
    return F.regexp_replace(t, f"({PUNCT_CLASS})", " $1 ")


def basic_tokens(text, lower: bool = False) -> Column:
    """TOK-01..04: the tokens of ``spaced_text``."""
    t = spaced_text(text, lower)
    return F.when(t == "", F.array().cast(ArrayType(StringType()))).otherwise(F.split(t, " "))


def load_vocab(lines: DataFrame, token: str = "token", line_no: str = "line_no") -> DataFrame:
    """SRC-13: token -> id, id = line number; a later duplicate line overwrites an earlier one."""
    return lines.groupBy(F.col(token).alias("token")).agg(F.max(line_no).cast("int").alias("id"))


def wordpiece(words: DataFrame, vocab: DataFrame, max_chars: int = 100, max_piece_chars: int | None = None,
              word: str = "word") -> DataFrame:
    """TOK-05: greedy longest-match-first WordPiece of distinct words -> (word, pieces).

    A word longer than ``max_chars`` or with an unmatched remainder becomes
    [UNK].  ``max_piece_chars`` bounds the substrings tried (the longest
    vocabulary entry; read from the vocabulary when not given).
    """
    w = words.select(F.col(word).alias("word")).distinct().withColumn("n", F.length("word"))
    # A word's first piece and its later ones are tried up to the longest entry of their own kind.
    later = F.col("token").startswith("##")
    most = [max_piece_chars] * 2 if max_piece_chars is not None else [x or 1 for x in vocab.agg(
        F.max(F.length("token")), F.max(F.when(later, F.length("token") - 2))).first()]   # two scalars
    sub = w.where((F.col("n") > 0) & (F.col("n") <= max_chars)) \
        .select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    sub = sub.select("word", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least(
        F.col("n"), F.col("start") + F.when(F.col("start") == 0, most[0]).otherwise(most[1])))).alias("end"))
    piece = F.col("word").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    sub = sub.withColumn("token", F.when(F.col("start") == 0, piece).otherwise(F.concat(F.lit("##"), piece)))
    hits = sub.join(vocab.select("token"), "token", "left_semi")
    best = hits.groupBy("word", "start").agg(F.max("end").alias("end"))
    j = w.join(best.groupBy("word").agg(F.collect_list(F.struct("start", "end")).alias("_hits")), "word", "left")
    # One expression a word: the walk over its matches is made once, whoever reads the pieces.
    longest = F.aggregate(F.array_sort("_hits"), F.array(F.lit(0)), lambda cuts, x: F.when(
        F.element_at(cuts, -1) == x["start"], F.concat(cuts, F.array(x["end"]))).otherwise(cuts))
    cut = lambda c: F.when(F.element_at(c, -1) == F.col("n"), F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, i: F.concat(
        F.when(i == 0, "").otherwise("##"), F.substr("word", x + 1, F.get(c, i + 1) - x))))
    return j.select("word", F.coalesce(bind(longest, cut), F.array(F.lit(UNK))).alias("pieces"))


def piece_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """TOK-06 on the distinct-word table: add ``ids`` (vocabulary id of each piece, in order).

    Every piece is a vocabulary entry or [UNK] by construction; a piece
    without an id raises.
    """
    e = pieces.select("word", F.posexplode("pieces").alias("i", "token"))
    j = e.join(vocab.select("token", "id"), "token", "left")
    j = j.withColumn("id", F.coalesce(F.col("id"), F.raise_error(F.concat(F.lit("no id for "), F.col("token")))))
    g = j.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("_p"))
    return pieces.join(g.select("word", F.transform("_p", lambda s: s["id"]).alias("ids")), "word", "left")


# So many vocabulary entries at most are sent to every worker.
SENT_VOCAB = 1_000_000
# So many divided words a task keeps at most.
KEPT_WORDS = 200_000


class Pieces:
    """TOK-05/06 of single words by a vocabulary (token -> id): greedy longest match first, each word divided once."""

    def __init__(self, vocab: dict[str, int], max_chars: int = 100):
        self.vocab, self.max_chars, self.known = vocab, max_chars, {}
        self.first = max(map(len, vocab), default=1)
        self.later = max((len(t) - 2 for t in vocab if t.startswith("##")), default=1)

    def cut(self, word: str) -> list[str] | None:
        out, at, n = [], 0, len(word)
        if not 0 < n <= self.max_chars:
            return None
        while at < n:
            for end in range(min(n, at + (self.later if at else self.first)), at, -1):
                piece = f"##{word[at:end]}" if at else word[:end]
                if piece in self.vocab:
                    break
            else:
                return None
            out.append(piece)
            at = end
        return out

    def __call__(self, spaced: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
        """(pieces, ids) of the tokens of a text, which have blanks between them."""
        got = self.known.get(spaced)
        if got is None:
            pieces = tuple(p for w in spaced.split(" ") if w for p in self.cut(w) or (UNK,))
            if UNK in pieces and UNK not in self.vocab:
                raise ValueError(f"no id for {UNK}")
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            got = self.known[spaced] = pieces, tuple(self.vocab[p] for p in pieces)
        return got


def piece_finder(vocab: DataFrame) -> Broadcast | None:
    """The vocabulary (token, id; written by the caller) for ``Pieces`` in every worker; None if it has too many entries."""
    if vocab.count() > SENT_VOCAB:
        return None
    return vocab.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect() if r["token"] is not None})


def lists_of(flat: Sequence, ends: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow array of lists: the values one after the other, cut at ``ends``."""
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, kind))


def _in_order(copies: Sequence[Sequence[list[int]]]) -> list[int]:
    """The ids of several token lists of one key: those of the first tokens, then of the second ones ..., as ``gather_pieces`` has them."""
    return [i for n in range(max(map(len, copies))) for ids in sorted(c[n] for c in copies if len(c) > n) for i in ids]


def example_ids(examples: DataFrame, finder: Broadcast, key: str, cols: Sequence[str], doc: str = "doc_id", copies: str = "copies",
                carry: Sequence[str] = ()) -> DataFrame:
    """Piece ids of the tokens of text columns: (key, *carry, <col>_ids); nothing is shuffled.

    ``copies``: how many rows share a key.  Where it isn't 1, the rows of a ``doc`` must follow each other in their partition (as those of
    ``contexts`` do); those of a key become one row.
    """
    plain, width = [key, *carry], len(cols)

    def run(batches):
        ids_of = Pieces(finder.value)
        held, of = {}, None          # rows of one document whose keys repeat
        names, flat, ends = [[] for _ in plain], [[] for _ in cols], [[] for _ in cols]

        def flush():
            for k, (rest, texts) in held.items():
                for to, x in zip(names, (k, *rest)):
                    to.append(x)
                for j in range(width):
                    flat[j].extend(_in_order([t[j] for t in texts]))
                    ends[j].append(len(flat[j]))
            held.clear()

        def made():
            out = [*[pa.array(c, pa.string()) for c in names], *[lists_of(f, e, pa.int32()) for f, e in zip(flat, ends)]]
            for c in (*names, *flat, *ends):
                c.clear()
            return pa.RecordBatch.from_arrays(out, [*plain, *[f"{c}_ids" for c in cols]])

        for batch in batches:
            rows = zip(*[texts_of(batch.column(c)) for c in plain], batch.column(doc).to_pylist(), batch.column(copies).to_pylist(),
                       texts_of(batch.column("_spaced")))
            for *own, d, n, spaced in rows:
                if held and d != of:
                    flush()
                lines = spaced.split("\n")
                if n == 1:
                    for to, x in zip(names, own):
                        to.append(x)
                    for to, end, line in zip(flat, ends, lines):
                        for w in line.split(" "):
                            to.extend(ids_of(w)[1])
                        end.append(len(to))
                else:
                    of = d
                    held.setdefault(own[0], (own[1:], []))[1].append([[ids_of(w)[1] for w in line.split(" ") if w] for line in lines])
            if names[0]:
                yield made()
        if held:
            flush()
            yield made()

    schema = ", ".join([f"{n} string" for n in plain] + [f"{c}_ids array<int>" for c in cols])
    # One text of all columns, a line each: the expressions run once a row.
    lines = F.concat_ws("\n", *[F.coalesce(F.translate(c, "\n", " "), F.lit("")) for c in cols])
    return examples.select(*plain, doc, copies, spaced_lines(lines).alias("_spaced")).mapInArrow(run, schema)


def token_rows(texts: DataFrame, key: str, cols, lower: bool = False, carry=()) -> DataFrame:
    """Basic tokens of several text columns as rows: (key, *carry, part, pos, word); part = column number."""
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).alias("txt")) for i, c in enumerate(cols)])
    x = texts.select(key, *carry, F.explode(parts).alias("_p"))
    return x.select(key, *carry, F.col("_p.part").alias("part"),
                    F.posexplode(basic_tokens(F.col("_p.txt"), lower)).alias("pos", "word"))


def gather_pieces(rows: DataFrame, pieces: DataFrame, key: str, cols, value: str = "ids", carry=()) -> DataFrame:
    """Join token rows to the word -> pieces table and gather each key's pieces per column, in order.

    One shuffle on the word for the join and one on the key for the gather.
    """
    j = rows.join(pieces.select("word", value), "word", "left")
    g = j.groupBy(key).agg(*[F.first(c).alias(c) for c in carry],
                           F.array_sort(F.collect_list(F.struct("part", "pos", value))).alias("_p"))
    out = [key, *carry]
    for i, c in enumerate(cols):
        sel = F.filter("_p", _part_is(i))
        out.append(F.flatten(F.transform(sel, _field(value))).alias(f"{c}_{value}"))
    return g.select(*out)


def _part_is(i):
    return lambda x: x["part"] == i


def _field(v):
    return lambda x: x[v]


def span_layout(left, span, right, max_seq_length: int, replace_span=None,
                cls=CLS, sep=SEP, pad=PAD) -> Column:
    """FEAT-01: [CLS] + left cut / padded to L/2-1 + span (or marker) + right, chopped to L-1, [SEP], padded.

    Works on token arrays or on id arrays (pass the special tokens' ids).
    """
    center = max_seq_length // 2
    keep = center - 1
    lt = _c(left)
    lt = F.when(F.size(lt) > keep, F.slice(lt, F.size(lt) - keep + 1, F.lit(keep))) \
          .otherwise(F.concat(F.array_repeat(F.lit(pad), F.lit(keep) - F.size(lt)), lt))
    mid = F.array(F.lit(replace_span)) if replace_span is not None else _c(span)
    toks = F.concat(F.array(F.lit(cls)), lt, mid, _c(right))
    toks = F.slice(toks, F.lit(1), F.lit(max_seq_length - 1))
    toks = F.concat(toks, F.array(F.lit(sep)))
    return F.concat(toks, F.array_repeat(F.lit(pad), F.lit(max_seq_length) - F.size(toks)))


def input_mask(tokens, pad=PAD) -> Column:
    """FEAT-02: 1 for every token except [PAD] (token or id)."""
    return F.transform(_c(tokens), lambda t: F.when(t == F.lit(pad), 0).otherwise(1))


def pair_layout(a, b, max_seq_length: int) -> tuple[Column, Column]:
    """FEAT-03/04: [CLS] a [SEP] (b [SEP]) after truncating the longer side first (ties cut b).

    Returns (tokens, type_ids), both unpadded; pad with ``pad_to``.
    """
    a, b = _c(a), _c(b)
    budget = max_seq_length - 3
    la, lb = F.size(a), F.size(b)
    # Popping one token at a time from the longer list (b on a tie) leaves
    # min(la, ceil(budget/2)) / min(lb, floor(budget/2)) when both are long.
    half_b = F.lit(budget // 2)
    half_a = F.lit(budget - budget // 2)
    over = la + lb > budget
    na = F.when(~over, la).when(la <= half_a, la).when(lb <= half_b, F.lit(budget) - lb).otherwise(half_a)
    nb = F.when(~over, lb).otherwise(F.lit(budget) - na)
    ta = F.slice(a, F.lit(1), na)
    tb = F.slice(b, F.lit(1), nb)
    toks = F.concat(F.array(F.lit(CLS)), ta, F.array(F.lit(SEP)), tb, F.array(F.lit(SEP)))
    types = F.concat(F.array_repeat(F.lit(0), na + 2), F.array_repeat(F.lit(1), nb + 1))
    return toks, types


def single_layout(a, max_seq_length: int) -> tuple[Column, Column]:
    """FEAT-03 single: [CLS] a [SEP], a cut to L-2."""
    ta = F.slice(_c(a), F.lit(1), F.lit(max_seq_length - 2))
    toks = F.concat(F.array(F.lit(CLS)), ta, F.array(F.lit(SEP)))
    return toks, F.array_repeat(F.lit(0), F.size(toks))


def label_id(label, classes: Sequence[str]) -> Column:
    """SRC-12 / FEAT-05: index of a label in the sorted label list (a parameter); an unknown label raises."""
    names = sorted(classes)
    if len(set(names)) != len(names):
        raise ValueError("repeated label")
    ids = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    return F.coalesce(F.try_element_at(ids, F.col(label)), F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("int"))
