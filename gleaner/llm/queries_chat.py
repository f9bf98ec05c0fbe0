"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.llm import chat
from gleaner.llm.common import bounded_batches, table
from gleaner.llm.registry import query

#: A conversation whose texts hold the template's own control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op5_chat", r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
      SELECT *, length(regexp_replace(t, '(\\|</?s>|\[/?INST\]|<</?SYS>>|<<ROLE:|<</ROLE>>|>>)', '\1x', 'g'))
                + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 20 + length(role) END AS n FROM c
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, role, t)) AS loss_sha256,
           CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
""")
def op5_chat(spark, folder):
    bounded_batches(spark, 1000)
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_chats(turns))
