"""Preference pairs as prompt and masked completions, in DataFrame functions alone.

Of a chosen and a rejected conversation the longest common prefix of turns (role and text alike) is rendered
once, as the prompt; what follows on either side is a completion. A mask lists the stretches of a completion
that are learnt: of every assistant turn its text and closing mark, as begin:end in characters of that
completion, end exclusive, comma-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and ``turns``: each conversation's (turn, role, text) in order; equal turns by role and text.

    Rows with a null key are left out; a null role or text is an empty one, a null turn comes last.
    """
    one = F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(2**63 - 1)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), one.alias("one")).groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Begins and ends by running length."""

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t.role) + len(OPEN) + 1
        end = begin + F.length(t.text) + len(CLOSE)
        learnt = F.when(t.role == LEARNT, F.array(F.concat_ws(":", begin, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).cast("int").alias("at"), F.concat(acc["spans"], learnt).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``.

    Both inputs as :func:`conversations` gives them. A pair of which one side is missing has an empty one;
    equal conversations are all prompt, with two empty completions.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a = chosen.select("key", F.col("turns").alias("a"))
    b = rejected.select("key", F.col("turns").alias("b"))
    both = a.join(b, "key", "full_outer").select("key", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("a")).cast("int")
    both = both.withColumn("n", n)
    rest = {c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))) for c in "ab"}
    return both.select(
        F.col("key").alias("pair_id"), F.col("n").alias("n_prompt_turns"), _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest["a"]).alias("chosen"), _mask(rest["a"]).alias("chosen_mask"), _rendered(rest["b"]).alias("rejected"), _mask(rest["b"]).alias("rejected_mask"),
    )


def swapped_answers(told: DataFrame) -> DataFrame:
    """Rejected counterparts: the last assistant turn's text becomes that of the neighbour (2k and 2k + 1).

    Without a neighbour, or if it has no assistant turn, the text becomes empty. Conversations without an
    assistant turn stay as they are.
    """
    replies = F.filter("turns", lambda t: t.role == LEARNT)
    last = F.when(F.size(replies) > 0, F.element_at(replies, -1)["text"])
    other = told.select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("key"), last.alias("answer"))
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t.role == LEARNT, i)))
    swapped = F.transform("turns", lambda t, i: F.struct(t.turn.alias("turn"), t.role.alias("role"), F.when(i == F.col("at"), F.coalesce("answer", F.lit(""))).otherwise(t.text).alias("text")))
    return told.join(other, "key", "left").withColumn("at", at).select("key", swapped.alias("turns"))


PAIRS_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 9223372036854775807), coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(i) AS i, arg_max(text, i) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id
), r AS (
  SELECT t.conv_id, t.role, CASE WHEN t.i = l.i THEN coalesce(o.answer, '') ELSE t.text END AS text, t.i
  FROM t LEFT JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = xor(t.conv_id, 1)
), n AS (
  SELECT t.conv_id, coalesce(min(CASE WHEN t.text <> r.text THEN t.i END) - 1, count(*)) AS n FROM t JOIN r USING (conv_id, i) GROUP BY t.conv_id
), c AS (
  SELECT s.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said
  FROM (SELECT 'a' AS side, * FROM t UNION ALL SELECT 'b', * FROM r) s JOIN n USING (conv_id)
), m AS (
  SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY conv_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS begins FROM c
)
SELECT conv_id AS pair_id, any_value(n)::INTEGER AS n_prompt_turns,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 'a' AND i <= n), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 'a' AND i > n), '') AS chosen,
  coalesce(string_agg(begins::BIGINT || ':' || (begins + length(text) + 10)::BIGINT, ',' ORDER BY i) FILTER (side = 'a' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 'b' AND i > n), '') AS rejected,
  coalesce(string_agg(begins::BIGINT || ':' || (begins + length(text) + 10)::BIGINT, ',' ORDER BY i) FILTER (side = 'b' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY conv_id
"""
