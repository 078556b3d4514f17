"""Queries over the places of lines, ordered files, exact decimals, lemmas and records (SRC-01..05, 15, 18; ORD-02/03; FN-18/24; PRJ-04;
SNK-03/06; FEAT-06; JN-16) and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagsift import sinks
from tagsift.functions.decimals import decimal_text, metric_percent
from tagsift.operators import corpus as cp
from tagsift.operators import features as ft
from tagsift.operators import textstats as ts
from tagsift.plans import corpus, lists
from tagsift.plans import passages as pp
from tagsift.plans.features import _tok_sql
from tagsift.session import checkpoint_path, materialized
from tagsift.sources import lines, tsv
from tagsift.sources.fixtures import duck_with, fixture, table


def _path(spark, name):
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def _landed(rows, path, n_files=5, by="file", order="n", value="value", codec="none", part_rows=None, backwards=False):
    """Lines in a known place: one folder per ``file``, each line after the other by ``order``.

    With ``part_rows`` a folder is written by as many tasks as its rows need; its parts follow each other by name, or with
    ``backwards`` (for a reader that takes files from the last to the first) from the last name to the first.
    """
    if part_rows is None:
        rows = rows.repartition(n_files, by)
    else:
        n = max(n_files, -(-rows.count() // part_rows))
        rows = rows.repartitionByRange(n, *[F.desc(c) if backwards else F.asc(c) for c in (by, order)])
    rows = rows.sortWithinPartitions(by, order).select(by, value)
    rows.write.partitionBy(by).option("compression", codec).text(path)


def q_arrival(spark, sf):
    """SRC-01 -> Q-DOC: sources of five files each with copies across files and sources; the first in file order counts."""
    c = fixture(spark, sf, "fx_corpus_line").select("source_rank", F.col("line_no").alias("n"), "line")
    again = c.where("n % 3 = 0").select("source_rank", "n", F.regexp_replace("line", "\tAuthor", "\tAgain").alias("line"))
    c = c.withColumn("file", F.col("n") % 5).unionByName(again.withColumn("file", (F.col("n") * 7 + 2) % 5))
    paths = [_path(spark, f"arrival-{k}") for k in (0, 1)]
    for k, codec in ((0, "none"), (1, "gzip")):
        own = c.where(F.col("source_rank") == k).withColumn("at", F.struct("n", "line"))
        _landed(own, paths[k], order="at", value="line", codec=codec, part_rows=16_384, backwards=k == 1)
    docs = cp.build_documents(tsv.scan_corpus(spark, paths, descending=(False, True)))
    return docs.select("doc_id", "authors", "journal")


def q_numbered(spark, sf):
    """SRC-18: rows of exactly three fields with their file and line number."""
    path = _path(spark, "numbered")
    d = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("file"), F.col("doc_id").alias("n"),
                                             F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", F.col("n_chars").cast("string")).alias("value"))
    _landed(d, path)
    got = lines.scan_numbered(spark, path, [("doc_id", "long"), ("lang", "string"), ("n_chars", "long")])
    return got.withColumn("file", F.regexp_extract("file", "file=([0-9]+)", 1).cast("int"))


def q_match_files(spark, sf):
    """SRC-02..05 -> Q-SPECIES: match, entity, rank and exclusion files read; species matches of documents not excluded."""
    raw, ent, rank, out = (_path(spark, n) for n in ("matches", "entities", "ranks", "excluded"))
    m = fixture(spark, sf, "fx_raw_match")
    fields = [F.col(c).cast("string") for c in ("start", "stop")]
    m.select((F.col("doc_id") % 7).alias("file"), F.struct("doc_id", "line_no", "serial").alias("n"), F.concat_ws(
        "\t", F.col("doc_id").cast("string"), F.lit("p"), F.lit("s"), *fields, F.lit("x"), F.col("type").cast("string"),
        F.col("serial").cast("string")).alias("value")).transform(lambda r: _landed(r, raw, 7, part_rows=250_000) or r)
    e = fixture(spark, sf, "fx_entity")
    e.select((F.col("line_no") % 2).alias("file"), F.col("line_no").alias("n"), F.concat_ws(
        "\t", F.col("serial").cast("string"), F.col("type").cast("string"), "identifier").alias("value")).transform(lambda r: _landed(r, ent, 2) or r)
    sinks.write_tsv(fixture(spark, sf, "fx_rank").select("taxid", "name", "rank"), rank)
    fixture(spark, sf, "fx_excluded_doc").select(F.col("doc_id").alias("value")).write.text(out)
    matches = cp.resolve_matches(tsv.scan_raw_matches(spark, raw), tsv.scan_entities(spark, ent), entity_order="line_no")
    gone = tsv.scan_exclusions(spark, out).select(F.col("doc_id").cast("long").alias("doc_id"))
    return cp.species_matches(matches.join(gone, "doc_id", "left_anti"), tsv.scan_ranks(spark, rank), order=("line_no",))


def q_ordered_evidence(spark, sf):
    """ORD-02: evidence rows in files by value, from the largest (infinities first), read back with their place."""
    path = _path(spark, "ordered")
    r = lists.q_local(spark, sf)
    value = F.when(F.col("doc_id") % 50 == 0, float("inf")).otherwise(F.col("count") / (1 + F.col("doc_id") % 13))
    r = r.select(value.alias("value"), "count", "doc_id", "name", "type")
    lines.write_ordered(r, path, [F.col("value").desc(), F.col("doc_id"), F.col("name"), F.col("type")], r.columns)
    return lines.read_ordered(spark, path, r.dtypes)


def q_ordered_lists(spark, sf):
    """ORD-03: the automatic local list as sorted lines, read back with their place."""
    path = _path(spark, "sorted")
    r = lists.q_auto_local(spark, sf)
    line = F.concat_ws("\t", "name", F.col("doc_id").cast("string"), "flag")
    lines.write_ordered(r.withColumn("line", line), path, [F.col("line")], ["name", "doc_id", "flag"])
    return lines.read_ordered(spark, path, r.select("name", "doc_id", "flag").dtypes)


def q_decimals(spark, sf):
    """FN-24: prices and ties with 2, 4 and 5 decimals."""
    t = table(spark, sf, "lineitem").withColumn("x", F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double"))
    tie = (F.col("l_orderkey") % 1000 - 500) / F.lit(8.0)
    return t.select("l_orderkey", "l_linenumber", decimal_text("x", 2).alias("t2"), decimal_text(F.col("x") / 1e6, 5).alias("t5"),
                    decimal_text(tie, 2).alias("tie2"), decimal_text(F.col("l_linenumber") / F.lit(32.0), 4).alias("tie4"))


def q_evidence_text(spark, sf):
    """AGG-04: local evidence with its probability as text of five decimals."""
    r = lists.q_local(spark, sf)
    return r.select(decimal_text(F.pow(F.lit(10.0), "log_prob"), 5).alias("prob"), "count", "doc_id", "name", "type")


def _metric_lines(spark, sf):
    e = table(spark, sf, "events")
    shown = F.concat(F.lit("0."), F.expr("substr('98765432', cast(event_id % 6 AS int) + 1, cast(event_id % 7 AS int))"), (F.col("event_id") % 10).cast("string"))
    name = F.when(F.col("user_id") % 2 == 0, "eval_accuracy").otherwise("f1-score")
    return e.select("event_id", F.concat(F.lit("INFO:tensorflow:  "), name, F.lit(" = "), shown).alias("line"))


def q_metric_percent(spark, sf):
    """PRJ-04: truncated percentages from log lines."""
    return _metric_lines(spark, sf).select("event_id", metric_percent(metric_percent("line", "accuracy"), "f1-score").alias("percent"))


def q_lemma_ratios(spark, sf):
    """FN-18 -> AGG-09: error ratios of three-word phrases by their lemmas."""
    w = materialized(fixture(spark, sf, "fx_word"), "words")
    part = F.element_at(F.array(F.lit("n"), F.lit("v"), F.lit("a"), F.lit(None).cast("string")), (F.length("word") % 4 + 1).cast("int"))
    parts = w.select("word", part.alias("part")).where("part IS NOT NULL")
    known = w.where("n >= 20 AND length(word) > 3").select("word", part.alias("part"), F.expr("substr(word, 1, length(word) - 1)").alias("lemma"))
    rules = [("er", "n", ""), ("ed", "v", ""), ("ing", "v", ""), ("ing", "v", "e"), ("en", "a", ""), ("n", "a", ""), ("s", "n", "")]
    endings = spark.createDataFrame(rules, "ending string, part string, base string")
    runs = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"), runs.alias("w")).where(F.size("w") > 0)
    p = d.select("doc_id", "type", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3)),
                                                         lambda i: F.array_join(F.slice("w", (i * 3 + 1).cast("int"), F.lit(3)), " "))).alias("phrase"))
    # A phrase is counted once per type, with its errors, before it meets its lemmas.
    p = p.groupBy("type", "phrase").agg(F.count(F.when(F.col("doc_id") % 3 == 0, 1)).alias("errors"), F.count(F.lit(1)).alias("gold"))
    p = materialized(p, "phrases")
    p = p.join(ts.lemmatize(p, parts, known, endings), "phrase").groupBy("type", F.col("lemma_phrase").alias("phrase"))
    p = materialized(p.agg(F.sum("errors").alias("errors"), F.sum("gold").alias("gold")), "lemmas")
    count = lambda c: p.where(F.col(c) > 0).select("type", "phrase", F.col(c).alias("count"))
    return ts.error_ratios(count("errors"), count("gold"), min_count=2)


def _pairs(spark, sf):
    """Conversation turns as text pairs, in files."""
    path = _path(spark, "pairs")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.translate("text", "\n\r", "  ").alias("t"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    c = c.join(after, ["conv_id", "turn"], "left").withColumn("n", F.struct("conv_id", "turn"))
    line = F.when((F.col("turn") % 3 == 0) & F.col("u").isNotNull(), F.concat_ws(" ||| ", "t", F.lit("and"), "u")).otherwise(F.concat_ws(" ||| ", "t", "u"))
    _landed(c.select((F.col("conv_id") % 3).alias("file"), "n", line.alias("value")), path, 3)
    return tsv.scan_pairs(spark, path)


def q_pairs(spark, sf):
    """SRC-15: text pairs; the last separator divides."""
    return _pairs(spark, sf)


def q_layers(spark, sf):
    """SNK-06 + JN-16: token vectors of two layers as JSON lines, read back, one row per token and layer."""
    f = _pairs(spark, sf).select("unique_id", F.slice(ft.basic_tokens("text_a"), 1, 12).alias("tokens"))
    number = lambda i, k: ((F.col("unique_id") * 31 + i * 7 + k * 3 + F.col("place") * 11) % 1000 - 500) / F.lit(64.0) / F.lit(7.0)
    r = f.select("unique_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    r = r.select("unique_id", "place", (-1 - F.col("place")).alias("index"), F.transform(
        F.sequence(F.lit(0), F.lit(13)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: number(i, k))).alias("vectors"))
    path = _path(spark, "layers")
    sinks.write_layers(f, r, path)
    back = spark.read.schema(sinks.LAYER_SCHEMA).json(path)
    t = back.select("linex_index", F.posexplode("features").alias("token_no", "f"))
    return t.select("linex_index", "token_no", "f.token", F.explode("f.layers").alias("l")).select("linex_index", "token_no", "token", "l.index", "l.values")


N_FILES, BATCH = 4, 32


def q_records(spark, sf):
    """SNK-03 + FEAT-06: the last windows' features with padding rows, dealt to four files in turn, read back."""
    path = _path(spark, "records")
    f = pp.q_window_features_last(spark, sf).select("doc_id", "input_ids")
    sinks.write_records(sinks.padded_rows(f, ["doc_id"], BATCH), path, N_FILES)
    return spark.read.parquet(path).select("row_no", F.col("file").cast("int").alias("file"), "doc_id", "input_ids", "is_real_example")


QUERIES = {
    "files_arrival": q_arrival,
    "files_numbered": q_numbered,
    "files_species": q_match_files,
    "ordered_evidence": q_ordered_evidence,
    "ordered_auto_local": q_ordered_lists,
    "decimal_texts": q_decimals,
    "local_evidence_text": q_evidence_text,
    "metric_percents": q_metric_percent,
    "error_ratios_lemma": q_lemma_ratios,
    "text_pairs": q_pairs,
    "layer_vectors": q_layers,
    "feature_records": q_records,
}

_PAIRS = """
c AS (SELECT conv_id, turn, translate(text, chr(10) || chr(13), '  ') AS t,
             lead(translate(text, chr(10) || chr(13), '  ')) OVER (PARTITION BY conv_id ORDER BY turn) AS u, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
      FROM conversations),
p AS (SELECT conv_id, turn, t, CASE WHEN nt = turn + 1 THEN u END AS u FROM c),
l AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 AND u IS NOT NULL THEN t || ' ||| and ||| ' || u ELSE concat_ws(' ||| ', t, u) END) AS line FROM p),
pairs AS (SELECT row_number() OVER (ORDER BY conv_id % 3, conv_id, turn) - 1 AS unique_id,
                 CASE WHEN regexp_matches(line, '^(.*) [|]{3} (.*)$') THEN regexp_extract(line, '^(.*) [|]{3} (.*)$', 1) ELSE line END AS text_a,
                 CASE WHEN regexp_matches(line, '^(.*) [|]{3} (.*)$') THEN regexp_extract(line, '^(.*) [|]{3} (.*)$', 2) END AS text_b FROM l)
"""
# Of the rows of one span the first in the files counts, that with the lower serial on equal line numbers.
_SPECIES = corpus.ORACLE["species_matches"].replace("e.identifier FROM fx_raw_match", "e.identifier, r.serial FROM fx_raw_match").replace(
    "ORDER BY doc_id, line_no, identifier", "ORDER BY doc_id, line_no, serial")

ORACLE = {
    "files_arrival": duck_with("fx_corpus_line") + """,
c AS (SELECT source_rank, line_no AS n, line, line_no % 5 AS file FROM fx_corpus_line
      UNION ALL SELECT source_rank, line_no, replace(line, chr(9) || 'Author', chr(9) || 'Again'), (line_no * 7 + 2) % 5 FROM fx_corpus_line WHERE line_no % 3 = 0),
f AS (SELECT *, string_split(regexp_replace(replace(line, chr(92), chr(92) || chr(92)), chr(9) || '+$', ''), chr(9)) AS f FROM c WHERE regexp_matches(line, '^PMID:[0-9]')),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY f[1] ORDER BY source_rank, CASE WHEN source_rank = 0 THEN file ELSE -file END, n, line) = 1)
SELECT CAST(substr(f[1], 6) AS BIGINT) AS doc_id, f[2] AS authors, f[3] AS journal FROM one WHERE len(f) >= 4""",
    "files_numbered": """SELECT CAST(doc_id % 5 AS INTEGER) AS file, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS line_no,
       doc_id, lang, n_chars FROM documents""",
    "files_species": f"""WITH s AS ({_SPECIES}) SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 29 = 0)""",
    "ordered_evidence": f"""WITH e AS ({lists.ORACLE["local_evidence"]}),
v AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'inf'::DOUBLE ELSE "count" / (1 + doc_id % 13) END AS value, "count", doc_id, name, type FROM e)
SELECT row_number() OVER (ORDER BY value DESC, doc_id, name, type) AS place, * FROM v""",
    "ordered_auto_local": f"""WITH a AS ({lists.ORACLE["auto_local"]})
SELECT row_number() OVER (ORDER BY name || chr(9) || doc_id::VARCHAR || chr(9) || flag) AS place, name, doc_id, flag FROM a""",
    "decimal_texts": """
WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE * l_discount::DOUBLE AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%.2f', x) AS t2, printf('%.5f', x / 1e6) AS t5,
       printf('%.2f', (l_orderkey % 1000 - 500) / 8.0e0) AS tie2, printf('%.4f', l_linenumber / 32.0e0) AS tie4 FROM t""",
    "local_evidence_text": f"""WITH e AS ({lists.ORACLE["local_evidence"]})
SELECT printf('%.5f', pow(10.0e0, log_prob)) AS prob, "count", doc_id, name, type FROM e""",
    "metric_percents": r"""
WITH m AS (SELECT event_id, 'INFO:tensorflow:  ' || CASE WHEN user_id % 2 = 0 THEN 'eval_accuracy' ELSE 'f1-score' END || ' = 0.'
                  || substr('98765432', CAST(event_id % 6 AS INTEGER) + 1, CAST(event_id % 7 AS INTEGER)) || CAST(event_id % 10 AS VARCHAR) AS line FROM events)
SELECT event_id, regexp_replace(line, '^.*(?:accuracy|f1-score) = (\d)\.(\d{2})(\d{2})\d+$', '\2.\3') AS percent FROM m""",
    "error_ratios_lemma": duck_with("fx_word") + """,
part AS (SELECT word, n, ['n', 'v', 'a', NULL][length(word) % 4 + 1] AS part FROM fx_word),
known AS (SELECT word, part, substr(word, 1, length(word) - 1) AS lemma FROM part WHERE n >= 20 AND length(word) > 3 AND part IS NOT NULL),
rules(ending, part, base) AS (VALUES ('er', 'n', ''), ('ed', 'v', ''), ('ing', 'v', ''), ('ing', 'v', 'e'), ('en', 'a', ''), ('n', 'a', ''), ('s', 'n', '')),
made AS (SELECT p.word, substr(p.word, 1, length(p.word) - length(r.ending)) || r.base AS made, length(r.ending) AS k
         FROM part p JOIN rules r ON p.part = r.part AND ends_with(p.word, r.ending) AND length(p.word) > length(r.ending)
         WHERE (substr(p.word, 1, length(p.word) - length(r.ending)) || r.base, p.part) IN (SELECT (lemma, part) FROM known)),
best AS (SELECT word, made FROM made QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC, made) = 1),
lem AS (SELECT p.word, coalesce(k.lemma, b.made, p.word) AS lemma FROM part p LEFT JOIN known k ON k.word = p.word AND k.part = p.part LEFT JOIN best b ON b.word = p.word),
w AS (SELECT doc_id, lang AS type, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, type, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
ph AS (SELECT doc_id, type, string_agg(lemma, ' ' ORDER BY i) AS phrase FROM x JOIN lem USING (word) GROUP BY doc_id, type, i // 3),
g AS (SELECT type, phrase, count(*) AS gold, count(*) FILTER (doc_id % 3 = 0) AS errors FROM ph GROUP BY ALL)
SELECT type, phrase, errors, gold, errors / gold AS ratio FROM g WHERE errors >= 2""",
    "text_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
}

_TOKENS_A = _tok_sql("text_a")
ORACLE["layer_vectors"] = f"""WITH {_PAIRS},
t AS (SELECT unique_id, ({_TOKENS_A})[1:12] AS ts FROM pairs),
e AS (SELECT unique_id, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM t)
SELECT unique_id AS linex_index, CAST(i AS INTEGER) AS token_no, token, CAST(-1 - pl AS INTEGER) AS "index",
       list_transform(range(4), lambda k: CAST(printf('%.6f', ((unique_id * 31 + i * 7 + k * 3 + pl * 11) % 1000 - 500) / 64.0e0 / 7.0e0) AS DOUBLE)) AS "values"
FROM e, range(2) AS r(pl)"""
ORACLE["feature_records"] = f"""WITH f AS ({pp.ORACLE["qa_window_features_last"]}),
r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, input_ids, true AS is_real_example FROM f),
m AS (SELECT count(*) AS n FROM r),
spare AS (SELECT row_no, 0 AS doc_id, list_transform(range({pp.MAX_SEQ}), lambda x: 0::INTEGER) AS input_ids, false AS is_real_example
          FROM (SELECT unnest(range(n, ((n + {BATCH - 1}) // {BATCH}) * {BATCH})) AS row_no FROM m))
SELECT row_no, CAST(row_no % {N_FILES} AS INTEGER) AS file, doc_id, input_ids, is_real_example FROM (SELECT * FROM r UNION ALL SELECT * FROM spare)"""
