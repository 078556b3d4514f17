"""Fixture views: the driver's parquet tables given the shapes our operators read.

Each view is one SQL text.  The Spark text names tables as ``{table}``
placeholders and is run with ``spark.sql(text, table=DataFrame)``; the DuckDB
text (used by the oracle queries) names the pre-registered views directly.
Where one text serves both engines the DuckDB form is derived by filling each
placeholder with the plain table name.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tagsift.functions.text import code_points, texts_of
from tagsift.operators.ordered import global_running
from tagsift.session import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PLACEHOLDER = re.compile(r"\{(" + "|".join(TABLES) + r")\}")

# --- shared texts ----------------------------------------------------------

# One read of the mentions; names hold protected pairs and phrases with determiners too.
_PREDICTION_MENTION = """
WITH m AS (
  SELECT l_suppkey AS doc_id, l_orderkey*10 + l_linenumber AS ann_id,
         CASE l_partkey % 40 WHEN 2 THEN 'insulin' WHEN 10 THEN 'INSULIN' WHEN 7 THEN 'the N7' WHEN 13 THEN 'these other N13'
              WHEN 21 THEN 'alpha N21' ELSE 'N' || CAST(l_partkey % 40 AS STRING) END AS name,
         CASE (l_partkey % 40) % 4 WHEN 0 THEN 'che' WHEN 1 THEN 'dis' WHEN 2 THEN 'ggp' ELSE 'org' END AS s_type,
         CASE WHEN (l_suppkey*3 + l_partkey % 40) % 10 <= (l_partkey % 40) % 9
              THEN 20.0e0 + l_linenumber ELSE 0.5e0 + l_linenumber/8.0e0 END AS w_target,
         1.0e0 + (l_partkey % 7)/2.0e0 AS w_a, 1.0e0 + l_linenumber/4.0e0 AS w_b,
         1.0e0 + (l_orderkey % 5)/3.0e0 AS w_c, 2.0e0 AS w_out
  FROM {lineitem}),
t AS (SELECT *, w_target + w_a + w_b + w_c + w_out AS tot FROM m)
"""
_OTHER_A = "CASE WHEN s_type = 'che' THEN 'dis' ELSE 'che' END"
_OTHER_B = "CASE WHEN s_type IN ('che','dis') THEN 'ggp' ELSE 'dis' END"
_OTHER_C = "CASE WHEN s_type = 'org' THEN 'ggp' ELSE 'org' END"
_SHARES = (("s_type", "w_target"), (_OTHER_A, "w_a"), (_OTHER_B, "w_b"), (_OTHER_C, "w_c"), ("'out'", "w_out"))
_PREDICTION_LONG_SPARK = _PREDICTION_MENTION + (
    "SELECT doc_id, ann_id, name, s_type, class, p FROM t LATERAL VIEW inline(array("
    + ", ".join(f"named_struct('class', {c}, 'p', {w}/tot)" for c, w in _SHARES) + ")) e AS class, p")
# The same rows, one per mention with a map of its probabilities (as a prediction file has them).
_PREDICTION_ROW_SPARK = _PREDICTION_MENTION + (
    "SELECT doc_id, ann_id, name, s_type, map(" + ", ".join(f"{c}, {w}/tot" for c, w in _SHARES) + ") AS probs FROM t")
_PREDICTION_LONG_DUCK = _PREDICTION_MENTION.replace("{lineitem}", "lineitem") + " UNION ALL ".join(
    f"SELECT doc_id, ann_id, name, s_type, {c} AS class, {w}/tot AS p FROM t" for c, w in _SHARES)

# The lines of a text are the text fields of its corpus line.  Every 7th document arrives a second time
# in the other source.
_CORPUS_LINE = """
WITH a AS (
  SELECT doc_id, source, text, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS source_rank, 'J' AS mark FROM {documents}
  UNION ALL
  SELECT doc_id, source, text, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, 'K' FROM {documents} WHERE doc_id % 7 = 0)
SELECT source_rank, doc_id AS line_no,
       CASE WHEN doc_id % 11 = 0 THEN 'DOI:' ELSE 'PMID:' END || CAST(doc_id AS STRING) || chr(9) || 'Author' || CAST(doc_id % 5 AS STRING)
       || chr(9) || mark || CASE WHEN doc_id % 7 = 0 THEN chr(92) ELSE '' END || source || chr(9)
       || CASE WHEN doc_id % 13 = 0 THEN '' ELSE '20' || CAST(10 + doc_id % 10 AS STRING) || chr(9) || replace(text, chr(10), chr(9)) END AS line
FROM a
"""

_EXCLUDED_DOC = "SELECT CAST(doc_id AS STRING) AS doc_id FROM {documents} WHERE doc_id % 29 = 0"

_RAW_MATCH = """
SELECT l_orderkey AS doc_id, l_linenumber AS line_no, (l_linenumber % 2)*10 AS start, (l_linenumber % 2)*10 + 5 AS stop,
       0 AS type, l_partkey AS serial FROM {lineitem}
"""

# Some serials stand twice; the later line counts.
_ENTITY = """
SELECT p_partkey AS serial, CASE p_partkey % 4 WHEN 0 THEN -2 WHEN 1 THEN 9606 WHEN 2 THEN -1 ELSE -26 END AS type,
       CAST(p_size AS STRING) AS identifier, 2*p_partkey AS line_no FROM {part} WHERE p_partkey % 10 <> 0
UNION ALL
SELECT p_partkey, -2, CAST(p_size + 1 AS STRING), 2*p_partkey + 1 FROM {part} WHERE p_partkey % 10 = 3
"""

_RANK = """
SELECT DISTINCT CAST(p_size AS STRING) AS taxid, 'name' || CAST(p_size AS STRING) AS name,
       CASE p_size % 3 WHEN 0 THEN 'species' ELSE 'genus' END AS rank FROM {part} WHERE p_size % 3 <> 2
"""

_EVAL_TEXT = """
SELECT vec_id AS row_id, label % 5 AS label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 5 ELSE label % 5 END AS prediction,
       CASE WHEN vec_id % 50 = 0 THEN 0.0e0 ELSE 1.0e0 END AS weight, {open}(1 + vec_id % 7)/40.0e0, (1 + vec_id % 5)/40.0e0,
       (1 + vec_id % 3)/40.0e0, (1 + vec_id % 6)/40.0e0, (36 - vec_id % 7 - vec_id % 5 - vec_id % 3 - vec_id % 6)/40.0e0{close} AS probs
FROM {{embeddings}}
"""
_EVAL_SPARK = _EVAL_TEXT.format(open="array(", close=")")
_EVAL_DUCK = _EVAL_TEXT.format(open="[", close="]").replace("{embeddings}", "embeddings")

_SCORE = "SELECT doc_id AS row_id, quality AS y_true, ((doc_id*37) % 101)/101.0e0 AS score FROM {labels}"

_LOG_LINE = """
SELECT 'run' || CAST((event_id - event_id % 2) AS STRING) || '.out' AS file_name, event_id AS line_no,
       CASE WHEN event_type = 'view' THEN 'INFO ' ELSE '' END || 'TEST-RESULT' || chr(9) || 'init_checkpoint' || chr(9) || 'm' || CAST(user_id % 2 AS STRING)
       || chr(9) || 'data_dir' || chr(9) || 'd' || chr(9) || 'max_seq_length' || chr(9) || '256' || chr(9) || 'train_batch_size' || chr(9)
       || CASE WHEN user_id % 3 = 0 THEN '64' ELSE '32' END || chr(9) || 'learning_rate' || chr(9) || CASE event_type WHEN 'error' THEN '5e-5' WHEN 'click' THEN '3e-5' ELSE '2e-5' END
       || chr(9) || 'num_train_epochs' || chr(9) || CAST(2 + user_id % 3 AS STRING) || chr(9) || 'f-score' || chr(9) || '9' || CAST(event_id % 10 AS STRING) || '.' || CAST(10 + event_id % 90 AS STRING)
       || chr(9) || 'accuracy' || chr(9) || '8' || CAST(event_id % 10 AS STRING) || '.' || CAST(10 + event_id % 90 AS STRING) AS line
FROM {events}
"""

_BATCH_TIME = "SELECT event_id AS batch_no, value AS elapsed_ms FROM {events}"

# Curated lists for the list merge (Q-MERGE).  The reference reads curated
# lists from its dictionary bundle; here they are derived from `part` so that
# they name the same 40 part-group names as the prediction fixture.
_CURATED_GLOBAL = """
SELECT DISTINCT 'N' || CAST(p_partkey % 40 AS STRING) AS name,
       CASE WHEN (p_partkey % 40) % 10 = 0 THEN 'f' ELSE 't' END AS flag
FROM {part} WHERE (p_partkey % 40) % 5 = 0
"""

_CURATED_LOCAL = """
SELECT 'N' || CAST((s_suppkey * 7) % 40 AS STRING) AS name, s_suppkey AS doc_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 't' END AS flag
FROM {supplier} WHERE s_suppkey % 3 = 0
"""

# --- engine-specific texts -------------------------------------------------

# Tags over whole documents: every space token with
# (token number + doc_id) % 5 = 0 is a mention; spans of documents with
# doc_id % 17 = 0 run one character too far at every 10th token, so the
# quality gate has work.
_PLACES = ArrayType(StructType().add("i", IntegerType()).add("n", IntegerType()).add("s", LongType()))


def _space_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, length and place of every space token of a document's texts; those of several texts follow each other in turns."""
    if len(texts) == 1:
        gaps = np.flatnonzero(code_points(texts[0]) == 32)
        first = np.concatenate(([0], gaps + 1))
        return np.arange(1, len(first) + 1), np.concatenate((gaps, [len(texts[0])])) - first, first
    turns = [(i, len(w)) for i, t in enumerate(itertools.zip_longest(*[x.split(" ") for x in texts]), 1) for w in t if w is not None]
    number, size = (np.array(x, np.int64) for x in zip(*turns))
    return number, size, np.cumsum(size + 1) - size - 1


@arrow_udf(_PLACES)
def _tagged_places(texts: pa.Array, doc_ids: pa.Array) -> pa.Array:
    """The space tokens whose number plus doc_id is a multiple of 5, without empty ones."""
    at, own = texts.offsets.to_numpy(), texts_of(texts.values)
    offsets, parts = [0], []
    for j, doc_id in enumerate(doc_ids.to_pylist()):
        i, n, s = _space_tokens(own[at[j]:at[j + 1]])
        keep = ((i + doc_id) % 5 == 0) & (n > 0) if doc_id is not None else np.zeros(len(i), bool)
        parts.append((i[keep], n[keep], s[keep]))
        offsets.append(offsets[-1] + len(parts[-1][0]))
    i, n, s = (np.concatenate(x) for x in zip(*parts)) if parts else [np.array([], np.int64)] * 3
    places = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.int64())], ["i", "n", "s"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places)


def _tag_full(docs: DataFrame) -> DataFrame:
    d = dealt(docs.select("doc_id", "text").where("text IS NOT NULL"), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("ts"))
    t = _tagged_places("ts", F.col("doc_id").cast("long"))
    return d.select("doc_id", F.explode(t).alias("t")).selectExpr(
        "doc_id", "t.i AS tok_no", "CAST(t.s AS INT) AS start",
        "CAST(t.s + t.n - 1 + CASE WHEN doc_id % 17 = 0 AND t.i % 10 = 0 THEN 1 ELSE 0 END AS INT) AS stop",
        "CASE t.i % 6 WHEN 0 THEN 9606 WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 3 THEN -26 WHEN 4 THEN -21 ELSE 0 END AS type",
        "'id' || CAST(t.i % 50 AS STRING) AS identifier")


_TAG_FULL_DUCK = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
z AS (SELECT doc_id, i, word,
             coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM t)
SELECT doc_id, CAST(i AS INT) AS tok_no, CAST(s AS INT) AS start,
       CAST(s + length(word) - 1 + CASE WHEN doc_id % 17 = 0 AND i % 10 = 0 THEN 1 ELSE 0 END AS INT) AS stop,
       CASE i % 6 WHEN 0 THEN 9606 WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 3 THEN -26 WHEN 4 THEN -21 ELSE 0 END AS type,
       'id' || CAST(i % 50 AS STRING) AS identifier
FROM z WHERE (i + doc_id) % 5 = 0 AND length(word) > 0
"""

# Vocabulary lines for WordPiece (TOK-05): special tokens, a..z, ##a..##z, the
# words seen at least 20 times, and '##' + the last two letters of those words.
# line_no is the line number; duplicate lines are possible (a later one wins).
_VOCAB_SPARK = """
WITH t AS (SELECT explode(split(regexp_replace(lower(text), '[^a-z]+', ' '), ' ')) AS word FROM {documents}),
w AS (SELECT word, count(*) AS n FROM t WHERE word <> '' GROUP BY word),
l AS (SELECT 0 AS grp, pos AS ord, tok AS token FROM (SELECT posexplode(array('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '[unused1]')) AS (pos, tok))
      UNION ALL SELECT 1, c, chr(c) FROM (SELECT explode(sequence(97, 122)) AS c)
      UNION ALL SELECT 2, c, '##' || chr(c) FROM (SELECT explode(sequence(97, 122)) AS c)
      UNION ALL SELECT 3, 0, word FROM w WHERE n >= 20
      UNION ALL SELECT DISTINCT 4, 0, '##' || right(word, 2) FROM w WHERE n >= 20 AND length(word) >= 2)
SELECT grp, ord, token FROM l
"""
_VOCAB_DUCK = """
WITH t AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents),
w AS (SELECT word, count(*) AS n FROM t WHERE word <> '' GROUP BY word),
l AS (SELECT 0 AS grp, CAST(i - 1 AS INTEGER) AS ord, ['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '[unused1]'][i] AS token FROM range(1, 7) r(i)
      UNION ALL SELECT 1, CAST(c AS INTEGER), chr(CAST(c AS INTEGER)) FROM range(97, 123) r(c)
      UNION ALL SELECT 2, CAST(c AS INTEGER), '##' || chr(CAST(c AS INTEGER)) FROM range(97, 123) r(c)
      UNION ALL SELECT 3, 0, word FROM w WHERE n >= 20
      UNION ALL SELECT DISTINCT 4, 0, '##' || right(word, 2) FROM w WHERE n >= 20 AND length(word) >= 2)
SELECT token, CAST(row_number() OVER (ORDER BY grp, ord, token) - 1 AS INT) AS line_no FROM l
"""

_TOKEN_TAG_DUCK = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, CASE (i + doc_id) % 7 WHEN 0 THEN 'B-ggp' WHEN 1 THEN 'I-ggp' WHEN 2 THEN 'B-che' WHEN 3 THEN 'I-dis' ELSE 'O' END AS gold FROM t)
SELECT doc_id AS sent_id, i AS pos, gold, CASE WHEN (i*(doc_id + 1)) % 5 = 0 THEN 'O' WHEN (i*(doc_id + 1)) % 9 = 0 THEN 'I-che' ELSE gold END AS pred FROM g
"""
_TOKEN_TAG_SPARK = """
WITH w AS (SELECT doc_id, split(text, ' ') AS ws FROM {documents}),
t AS (SELECT doc_id, pos + 1 AS i FROM w LATERAL VIEW posexplode(ws) p AS pos, word),
g AS (SELECT doc_id, i, CASE (i + doc_id) % 7 WHEN 0 THEN 'B-ggp' WHEN 1 THEN 'I-ggp' WHEN 2 THEN 'B-che' WHEN 3 THEN 'I-dis' ELSE 'O' END AS gold FROM t)
SELECT doc_id AS sent_id, i AS pos, gold, CASE WHEN (i*(doc_id + 1)) % 5 = 0 THEN 'O' WHEN (i*(doc_id + 1)) % 9 = 0 THEN 'I-che' ELSE gold END AS pred FROM g
"""



def token_tag_sentences(docs: DataFrame) -> DataFrame:
    """The rows of ``fx_token_tag``, those of a sent_id in one row: sent_id, s (pos, gold, pred by place).

    Texts are dealt out by doc_id and tagged where they are; no token is shuffled.
    """
    d = dealt(docs.select("doc_id", "text").where("text IS NOT NULL"), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("ts"))
    gold = "coalesce(get(array('B-ggp', 'I-ggp', 'B-che', 'I-dis'), CAST((j + 1 + doc_id) % 7 AS INT)), 'O')"
    pred = f"CASE WHEN ((j + 1)*(doc_id + 1)) % 5 = 0 THEN 'O' WHEN ((j + 1)*(doc_id + 1)) % 9 = 0 THEN 'I-che' ELSE {gold} END"
    tagged = f"transform(split(t, ' '), (w, j) -> named_struct('pos', j + 1, 'gold', {gold}, 'pred', {pred}))"
    d = d.select(F.col("doc_id").alias("sent_id"), F.expr(f"transform(ts, t -> {tagged})").alias("c"))
    return d.select("sent_id", F.when(F.size("c") == 1, F.get("c", F.lit(0))).otherwise(F.array_sort(F.flatten("c"))).alias("s"))


_WORD_DUCK = """
WITH t AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM t WHERE word <> '' GROUP BY word
"""
_WORD_SPARK = """
WITH t AS (SELECT explode(split(regexp_replace(lower(text), '[^a-z]+', ' '), ' ')) AS word FROM {documents})
SELECT word, count(*) AS n FROM t WHERE word <> '' GROUP BY word
"""

_LOGIT_DUCK = """
WITH t AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
SELECT vec_id AS example_id, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS start_logit, CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) AS end_logit FROM t
"""
_LOGIT_SPARK = """
WITH t AS (SELECT vec_id, embedding, explode(sequence(1, size(embedding))) AS i FROM {embeddings})
SELECT vec_id AS example_id, i - 1 AS pos, CAST(embedding[i-1] AS DOUBLE) AS start_logit, CAST(embedding[size(embedding) - i] AS DOUBLE) AS end_logit FROM t
"""

_SHARED = {
    "fx_corpus_line": _CORPUS_LINE,
    "fx_excluded_doc": _EXCLUDED_DOC,
    "fx_raw_match": _RAW_MATCH,
    "fx_entity": _ENTITY,
    "fx_rank": _RANK,
    "fx_score": _SCORE,
    "fx_log_line": _LOG_LINE,
    "fx_batch_time": _BATCH_TIME,
    "fx_curated_global": _CURATED_GLOBAL,
    "fx_curated_local": _CURATED_LOCAL,
}

SPARK_SQL = dict(_SHARED)
SPARK_SQL.update({
    "fx_eval": _EVAL_SPARK,
    "fx_prediction_long": _PREDICTION_LONG_SPARK,
    "fx_prediction_row": _PREDICTION_ROW_SPARK,
    "fx_vocab_line": _VOCAB_SPARK,
    "fx_token_tag": _TOKEN_TAG_SPARK,
    "fx_word": _WORD_SPARK,
    "fx_logit": _LOGIT_SPARK,
})

DUCK_SQL = {k: _PLACEHOLDER.sub(lambda m: m.group(1), v) for k, v in _SHARED.items()}
DUCK_SQL.update({
    "fx_eval": _EVAL_DUCK,
    "fx_prediction_long": _PREDICTION_LONG_DUCK,
    "fx_tag_full": _TAG_FULL_DUCK,
    "fx_vocab_line": _VOCAB_DUCK,
    "fx_token_tag": _TOKEN_TAG_DUCK,
    "fx_word": _WORD_DUCK,
    "fx_logit": _LOGIT_DUCK,
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read from parquet (scan prunes columns and pushes filters)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "fx_tag_full":
        return _tag_full(table(spark, sf_dir, "documents"))
    text = SPARK_SQL[name]
    used = sorted(set(_PLACEHOLDER.findall(text)))
    rows = spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
    if name == "fx_vocab_line":                  # numbered without a single-task window
        rows = global_running(rows, ["grp", "ord", "token"], with_rank=True).select("token", (F.col("rank") - 1).cast("int").alias("line_no"))
    return rows


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCK_SQL[n]})" for n in names)
