"""Preference formatting: a shared prompt and the masked completions of a chosen and a rejected conversation.

The longest common prefix of turns (equal roles and texts) is rendered once as the prompt; what follows it in either
conversation is its completion, and the mask of a completion lists the spans (code points, end exclusive) of the
assistant's words and their end marks, which are what a loss counts.

Defined cases: turns are ordered by number (null last), role and text, and repeated turns count once; a null role is
"unknown" and a null text empty; a pair with one conversation has status "unpaired", no prompt and that conversation as
its completion; equal conversations have status "equal" and empty completions; a null conversation id is left out.

The query makes pairs of single conversations by swapped(), so that they share a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime

END = "<|end|>\n"
LAST = (1 << 63) - 1


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """start:end of what the assistant says in the rendered turns, joined by commas."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_header(turn))
        end = start + F.length(turn["text"]) + len(END)
        said = F.when(turn["role"] == "assistant", F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], said).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: F.array_join(s["spans"], ","))


def _said(turn: str, role: str, text: str) -> Column:
    return F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def swapped(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, a, b and alone of each conversation: as it is, and with its last turn replaced by that of its partner.

    Conversations 2 i and 2 i + 1 are partners; without a partner the other side ends before the last turn.
    """
    whole = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.array_sort(F.collect_set(_said(turn, role, text))).alias("a"))
    other = whole.select(F.col("pair_id").bitwiseXOR(1).alias("pair_id"), F.element_at("a", -1).alias("last"))
    both = whole.join(other, "pair_id", "left")
    before = F.slice("a", F.lit(1), F.size("a") - 1)
    return both.select("pair_id", "a", F.when(F.col("last").isNull(), before).otherwise(F.concat(before, F.array("last"))).alias("b"), F.col("last").isNull().alias("alone"))


def preferences(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, status, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask of each pair.

    pair and chosen are expressions over the turns: the id of a row's pair, and whether it belongs to the chosen side.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("side"), _said(turn, role, text).alias("said")).where("pair_id is not null and side is not null")
    both = rows.groupBy("pair_id").agg(F.array_sort(F.collect_set(F.when(F.col("side"), F.col("said")))).alias("a"), F.array_sort(F.collect_set(F.when(~F.col("side"), F.col("said")))).alias("b"))
    return formatted(both, F.least(F.size("a"), F.size("b")) == 0)


def formatted(both: DataFrame, alone: Column) -> DataFrame:
    """preferences() of rows pair_id, a and b (the turns of the chosen and the rejected side); alone tells which lack a side."""
    least = F.least(F.size("a"), F.size("b"))
    same = lambda i: (F.element_at("a", i)["role"] == F.element_at("b", i)["role"]) & (F.element_at("a", i)["text"] == F.element_at("b", i)["text"])
    differ = F.array_min(F.filter(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i)))
    both = both.withColumn("n", F.when(least > 0, F.coalesce(differ - 1, least)).otherwise(0))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    status = F.when(alone, "unpaired").when((F.col("n") == F.size("a")) & (F.col("n") == F.size("b")), "equal").otherwise("paired")
    return both.select(
        "pair_id",
        status.alias("status"),
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"),
        rendered(rest("b")).alias("rejected"),
        mask(rest("a")).alias("chosen_mask"),
        mask(rest("b")).alias("rejected_mask"),
    )


def op9_preference_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation is chosen over itself with its partner's last turn: what comes before is their prompt."""
    both = swapped(runtime.table(spark, sf_dir, "conversations"))
    return formatted(both, F.col("alone"))


_RENDER = "array_to_string(list_transform({0}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')"
_MASK = """array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i:
  (coalesce(list_sum(list_transform({0}[1:i - 1], lambda x: length(x.role) + length(x.text) + 13)), 0) + length({0}[i].role) + 5)::BIGINT::VARCHAR || ':' ||
  (list_sum(list_transform({0}[1:i], lambda x: length(x.role) + length(x.text) + 13)))::BIGINT::VARCHAR), ',')"""
SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS a FROM turns GROUP BY conv_id),
sides AS (
  SELECT c.conv_id AS pair_id, c.a, CASE WHEN o.a IS NULL THEN c.a[1:len(c.a) - 1] ELSE list_concat(c.a[1:len(c.a) - 1], [o.a[len(o.a)]]) END AS b, o.a IS NULL AS alone
  FROM whole c LEFT JOIN whole o ON o.conv_id = xor(c.conv_id, 1)),
split AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n
  FROM sides),
parts AS (SELECT *, a[1:n] AS p, a[n + 1:] AS c, b[n + 1:] AS r FROM split)
SELECT pair_id, CASE WHEN alone THEN 'unpaired' WHEN n = len(a) AND n = len(b) THEN 'equal' ELSE 'paired' END AS status,
  n::BIGINT AS n_prompt_turns, {_RENDER.format('p')} AS prompt, {_RENDER.format('c')} AS chosen, {_RENDER.format('r')} AS rejected,
  {_MASK.format('c')} AS chosen_mask, {_MASK.format('r')} AS rejected_mask
FROM parts
"""
