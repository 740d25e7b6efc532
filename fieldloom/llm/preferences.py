"""Preference formatting in DataFrame functions: shared prompt once, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written; {role} and {text} are filled in.
BEFORE, AFTER_ROLE, AFTER = "<|", "|>\n", "<|end|>\n"
NO_ROLE = "unknown"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEFORE), F.coalesce(turn["role"], F.lit(NO_ROLE)), F.lit(AFTER_ROLE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit(AFTER))), "")


def _spans(turns: Column) -> Column:
    """Character spans 'start-end' of the trained turns' texts and end marks within the rendered turns, in order."""
    size = lambda t: F.length(_head(t)) + F.length(F.coalesce(t["text"], F.lit(""))) + len(AFTER)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        first, last = s["at"] + F.length(_head(t)), s["at"] + size(t)
        one = F.concat(first.cast("string"), F.lit("-"), (last - 1).cast("string"))
        more = F.when(t["role"] == TRAINED, F.concat(s["spans"], F.array(one))).otherwise(s["spans"])
        return F.struct(last.alias("at"), more.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of conversations: prompt, both completions, and the spans of each to train on.

    ``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text. The longest
    common prefix of turns (equal role and text, nulls equal) is rendered once as prompt;
    what follows is the completion of each side, and its mask covers the text and end
    mark of assistant turns. Null text renders as empty, null role as 'unknown'. Repeated
    rows count once; turns of one number go by role, then text, nulls first. Conversations
    without a partner give no row; identical ones have two empty completions. Extra
    columns are ignored; rows without pair_id or side are left out; an empty table gives
    an empty result. A pair is collected as one row, which is what it is written as.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda s: F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("side") == s, turn)))).alias(s)
    pairs = turns.filter("pair_id is not null").groupBy("pair_id").agg(side("chosen"), side("rejected"))
    pairs = pairs.filter((F.size("chosen") > 0) & (F.size("rejected") > 0))
    both = lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])
    same = F.zip_with("chosen", "rejected", both)
    differs = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("prefix_turns", F.when(differs == 0, F.size("chosen")).otherwise(differs - 1).cast("int"))
    prompt = F.slice("chosen", F.lit(1), F.col("prefix_turns"))
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.size(c))
    return pairs.select(
        "pair_id",
        "prefix_turns",
        _render(prompt).alias("prompt"),
        *[f(rest(c)).alias(name) for c in ("chosen", "rejected") for f, name in ((_render, c), (_spans, f"{c}_spans"))],
    )


def paired_turns(conversations: DataFrame) -> DataFrame:
    """Turns of both sides of a pair per conversation, from ``conversations`` (conv_id, turn, role, text).

    A table without preferences gets them thus: a conversation is the chosen side of the
    pair of its number; the rejected side has the same turns up to its last assistant
    turn, and there the last assistant turn of the partner, conversation 2 k + 1 for 2 k
    and the other way round. A conversation without assistant turn or partner gives no
    pair. Rows without conv_id are left out.
    """
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    answer = F.max(F.struct("turn", "role", "text")).alias("answer")
    last = rows.filter(F.col("role") == TRAINED).groupBy("pair_id").agg(answer)
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other"))
    pairs = last.join(other, "pair_id")
    turns = rows.join(pairs, "pair_id")
    chosen = turns.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    shared = turns.filter(F.coalesce(F.col("turn") < F.col("answer.turn"), F.lit(True))).select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    answers = pairs.select("pair_id", F.lit("rejected").alias("side"), F.col("answer.turn").alias("turn"), F.col("other.role").alias("role"), F.col("other.text").alias("text"))
    return chosen.unionByName(shared).unionByName(answers)


ORACLE_SQL = rf"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT pair_id, turn, text FROM given WHERE role = '{TRAINED}'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1
), partners AS (
  SELECT l.pair_id, l.turn, o.text FROM last l JOIN last o ON xor(o.pair_id, 1) = l.pair_id
), turns AS (
  SELECT DISTINCT * FROM (
    SELECT pair_id, true AS chosen, turn, role, text FROM given SEMI JOIN partners USING (pair_id)
    UNION ALL SELECT g.pair_id, false, g.turn, g.role, g.text FROM given g JOIN partners p ON p.pair_id = g.pair_id AND coalesce(g.turn < p.turn, true)
    UNION ALL SELECT pair_id, false, turn, '{TRAINED}', text FROM partners)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    '{BEFORE}' || coalesce(role, '{NO_ROLE}') || '|>' || chr(10) AS head,
    coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM turns
), pairs AS (
  SELECT pair_id FROM placed GROUP BY pair_id HAVING count(DISTINCT chosen) = 2
), prefix AS (
  SELECT pair_id, coalesce(min(place) - 1, max(n)) AS prefix_turns FROM (
    SELECT pair_id, CASE WHEN c.place IS NOT NULL AND r.place IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text
        THEN NULL ELSE coalesce(c.place, r.place) END AS place, coalesce(c.place, r.place) AS n
    FROM (SELECT * FROM placed WHERE chosen) c FULL JOIN (SELECT * FROM placed WHERE NOT chosen) r USING (pair_id, place)
    WHERE pair_id IN (SELECT pair_id FROM pairs)) GROUP BY pair_id
), tails AS (
  SELECT pair_id, chosen, place, role, head || body AS whole,
    sum(length(head) + length(body)) OVER (PARTITION BY pair_id, chosen ORDER BY place) AS last,
    sum(length(head) + length(body)) OVER (PARTITION BY pair_id, chosen ORDER BY place) - length(body) AS first
  FROM placed JOIN prefix USING (pair_id) WHERE place > prefix_turns
), sides AS (
  SELECT pair_id, chosen, string_agg(whole, '' ORDER BY place) AS completion,
    string_agg(CASE WHEN role = '{TRAINED}' THEN CAST(CAST(first AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(last - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY place) AS spans
  FROM tails GROUP BY pair_id, chosen
), prompts AS (
  SELECT pair_id, string_agg(head || body, '' ORDER BY place) AS prompt FROM placed JOIN prefix USING (pair_id) WHERE chosen AND place <= prefix_turns GROUP BY pair_id
)
SELECT p.pair_id, CAST(p.prefix_turns AS INTEGER) AS prefix_turns, coalesce(q.prompt, '') AS prompt,
  coalesce(c.completion, '') AS chosen, coalesce(c.spans, '') AS chosen_spans, coalesce(r.completion, '') AS rejected, coalesce(r.spans, '') AS rejected_spans
FROM prefix p LEFT JOIN prompts q USING (pair_id)
LEFT JOIN (SELECT * FROM sides WHERE chosen) c USING (pair_id) LEFT JOIN (SELECT * FROM sides WHERE NOT chosen) r USING (pair_id)
"""
