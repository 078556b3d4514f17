"""Query op8 (preference formatting)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm.preferences import format_preferences, swapped_last_reply
from tagsift.llm.shared import table


def op8_preferences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return format_preferences(chosen, swapped_last_reply(turns))


OP8_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn::BIGINT AS turn, role, text FROM conversations),
l AS (SELECT pair_id, max(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY pair_id),
r AS (SELECT l.pair_id, l.turn, max(coalesce(t.text, '')) AS reply
      FROM l JOIN t ON t.pair_id = l.pair_id AND t.turn = l.turn AND t.role = 'assistant' GROUP BY ALL),
o AS (SELECT r.pair_id, r.turn, p.reply AS other FROM r LEFT JOIN r p ON p.pair_id = xor(r.pair_id, 1)),
j AS (SELECT t.pair_id, t.turn, t.role, CASE WHEN o.pair_id IS NULL THEN t.text ELSE other END AS text
      FROM t LEFT JOIN o ON o.pair_id = t.pair_id AND o.turn = t.turn AND t.role = 'assistant'
      WHERE o.pair_id IS NULL OR other IS NOT NULL),
s AS (SELECT 'a' AS side, * FROM t UNION ALL SELECT 'b', * FROM j),
c AS (SELECT side, pair_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role,
             replace(coalesce(text, ''), '<|', '< |') AS text FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
m AS (SELECT pair_id, min(i) - 1 AS n_common
      FROM (SELECT pair_id, i FROM n GROUP BY pair_id, i
            HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY pair_id),
q AS (SELECT n.*, coalesce(n_common, 1000000000) AS cut, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
      FROM n LEFT JOIN m USING (pair_id)),
w AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY side, pair_id, i > cut ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS start FROM q)
SELECT pair_id, count(*) FILTER (side = 'a' AND i <= cut) AS n_common,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i <= cut), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i > cut), '') AS chosen,
       coalesce(string_agg(start::BIGINT || ':' || (start + length(text))::BIGINT, ',' ORDER BY i)
                FILTER (side = 'a' AND i > cut AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'b' AND i > cut), '') AS rejected,
       coalesce(string_agg(start::BIGINT || ':' || (start + length(text))::BIGINT, ',' ORDER BY i)
                FILTER (side = 'b' AND i > cut AND role = 'assistant'), '') AS rejected_mask
FROM w GROUP BY pair_id
"""

QUERIES = {"op8_preferences": op8_preferences}
ORACLE = {"op8_preferences": OP8_SQL}
