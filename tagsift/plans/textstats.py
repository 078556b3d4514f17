"""Word statistics and dictionary-tagging queries (AGG-06..09, TOP-01, JN-10, JN-14) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.operators import textstats as ts
from tagsift.sources.fixtures import duck_with, fixture, table

_SPACES = r"[ \t\n\r\f\x{0B}]+"


def _doc_words(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.explode(F.split(F.col("text"), _SPACES)).alias("word"))


def q_word_freq(spark, sf):
    """AGG-06: frequency of every lower-cased whitespace token of the corpus (empty token dropped)."""
    return ts.word_frequencies(_doc_words(spark, sf))


def q_top_words(spark, sf):
    """TOP-01: the top 20 (+1, as the reference takes) words by count, then word, descending."""
    return ts.top_words(ts.word_frequencies(_doc_words(spark, sf)), 20)


def q_word_lines(spark, sf):
    """AGG-07 + JN-10: for the top 50 (+1) letter words, the number of document lines containing each."""
    words = ts.top_words(fixture(spark, sf, "fx_word").withColumnRenamed("n", "count"), 50)
    return ts.lines_with_words(ts.lines_of(table(spark, sf, "documents")), words)


def _mentions(spark, sf):
    p = fixture(spark, sf, "fx_prediction_long")
    return p.where(F.col("class") == F.col("s_type")).select(F.col("s_type").alias("type"),
                                                              F.col("name").alias("phrase"), "p")


def q_phrase_counts(spark, sf):
    """AGG-08: mentions per (type, cleaned phrase)."""
    return ts.phrase_counts(_mentions(spark, sf))


def q_error_ratios(spark, sf):
    """AGG-09: mentions the classifier rejects (target p < 0.5) over all mentions, per (type, phrase), >= 2 errors."""
    m = _mentions(spark, sf)
    return ts.error_ratios(ts.phrase_counts(m.where(F.col("p") < 0.5)), ts.phrase_counts(m), min_count=2)


def _names(spark, sf):
    """Frequent words, the two- and three-word runs of the benchmark texts, and second identifiers of very frequent words."""
    w = fixture(spark, sf, "fx_word").where(F.col("n") >= 50)
    ws = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    b = table(spark, sf, "benchmark").select(ws.alias("ws"))
    phrases = [b.where(F.size("ws") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1),
               lambda i: F.array_join(F.slice("ws", i, F.lit(k)), " "))).alias("name")) for k in (2, 3)]
    names = w.select(F.col("word").alias("name")).unionByName(phrases[0]).unionByName(phrases[1]).distinct()
    code = F.element_at(F.array(F.lit(-1), F.lit(-2), F.lit(-26), F.lit(9606)), (F.length("name") % 4 + 1).cast("int"))
    again = w.where(F.col("n") >= 200).select(F.col("word").alias("name"), F.lit(-21).alias("type"),
                                              F.concat(F.lit("syn:"), "word").alias("identifier"))
    return names.select("name", code.alias("type"), F.col("name").alias("identifier")).unionByName(again)


def q_dictionary_tags(spark, sf):
    """JN-14: tag every document with names of one to three words (case-insensitive), longest match per start."""
    return ts.tag_documents(table(spark, sf, "documents").select("doc_id", "text"), _names(spark, sf), max_words=3)


QUERIES = {
    "word_frequencies": q_word_freq,
    "top_words": q_top_words,
    "word_line_counts": q_word_lines,
    "phrase_counts": q_phrase_counts,
    "error_ratios": q_error_ratios,
    "dictionary_tags": q_dictionary_tags,
}

_WF = rf"""
WITH t AS (SELECT unnest(regexp_split_to_array(text, '{_SPACES}')) AS word FROM documents),
wf AS (SELECT lower(word) AS word, count(*) AS "count" FROM t WHERE lower(word) <> '' GROUP BY lower(word))
"""

_MEN = duck_with("fx_prediction_long") + """,
m AS (SELECT s_type AS type, name AS phrase, p FROM fx_prediction_long WHERE class = s_type),
cl AS (SELECT type, replace(replace(replace(replace(replace(replace(replace(lower(phrase), 'this ', ''), 'that ', ''),
          'those ', ''), 'these ', ''), 'the ', ''), 'a ', ''), 'other ', '') AS phrase, p FROM m),
gold AS (SELECT type, phrase, count(*) AS "count" FROM cl GROUP BY type, phrase),
err AS (SELECT type, phrase, count(*) AS "count" FROM cl WHERE p < 0.5 GROUP BY type, phrase)
"""

ORACLE = {
    "word_frequencies": _WF + " SELECT * FROM wf",
    "top_words": _WF + ' SELECT * FROM wf ORDER BY "count" DESC, word DESC LIMIT 21',
    "word_line_counts": duck_with("fx_word") + r""",
tw AS (SELECT word FROM fx_word ORDER BY n DESC, word DESC LIMIT 51),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
rw AS (SELECT DISTINCT doc_id, line_no, unnest(string_split_regex(lower(line), '[^\p{L}\p{N}_]+')) AS word FROM ln)
SELECT word, count(*) AS "count" FROM rw JOIN tw USING (word) GROUP BY word""",
    "phrase_counts": _MEN + " SELECT * FROM gold",
    "error_ratios": _MEN + """
SELECT e.type, e.phrase, e."count" AS errors, g."count" AS gold, e."count" / g."count" AS ratio
FROM err e JOIN gold g ON e.type = g.type AND e.phrase = g.phrase WHERE e."count" >= 2""",
    "dictionary_tags": duck_with("fx_word") + """,
bw AS (SELECT list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM benchmark),
ph AS (SELECT unnest([array_to_string(ws[i:i + 1], ' ') for i in range(1, len(ws))]
                     || [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) AS name FROM bw),
nn AS (SELECT word AS name FROM fx_word WHERE n >= 50 UNION SELECT name FROM ph),
nm AS (SELECT name, [-1, -2, -26, 9606][length(name) % 4 + 1] AS type, name AS identifier FROM nn
       UNION ALL SELECT word, -21, 'syn:' || word FROM fx_word WHERE n >= 200),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+|[^A-Za-z]+)', 1)) AS run,
             unnest(range(len(regexp_extract_all(text, '([A-Za-z]+|[^A-Za-z]+)', 1)))) AS i FROM documents),
o AS (SELECT doc_id, i, run, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
rw AS MATERIALIZED (SELECT doc_id, lower(run) AS run, start, start + length(run) - 1 AS stop,
              row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx FROM o WHERE regexp_matches(run, '^[A-Za-z]+$')),
gr AS (SELECT doc_id, idx, start, stop, 1 AS k, run AS name FROM rw
       UNION ALL SELECT a.doc_id, a.idx, a.start, b.stop, 2, a.run || ' ' || b.run
                 FROM rw a JOIN rw b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1
       UNION ALL SELECT a.doc_id, a.idx, a.start, c.stop, 3, a.run || ' ' || b.run || ' ' || c.run
                 FROM rw a JOIN rw b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1
                           JOIN rw c ON c.doc_id = a.doc_id AND c.idx = a.idx + 2),
mt AS MATERIALIZED (SELECT gr.* FROM gr WHERE name IN (SELECT name FROM nm)),
lg AS MATERIALIZED (SELECT m.* FROM mt m ANTI JOIN mt o ON o.doc_id = m.doc_id AND o.idx = m.idx AND o.k > m.k),
k1 AS (SELECT l.* FROM lg l ANTI JOIN lg e ON e.doc_id = l.doc_id AND e.idx = l.idx - 1 AND e.k > 1),
kp AS (SELECT l.* FROM k1 l ANTI JOIN lg e ON e.doc_id = l.doc_id AND e.idx = l.idx - 2 AND e.k > 2)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, type, identifier FROM kp JOIN nm USING (name)""",
}
