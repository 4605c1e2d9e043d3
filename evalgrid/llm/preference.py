"""Preference formatting with DataFrame functions only: the longest common turn prefix of a chosen and a rejected
conversation becomes the prompt, rendered once; what follows becomes two completions, each with a loss mask.

All turns of a pair, of both sides, meet in one exchange; the prefix, the texts and the masks are expressions over the two
ordered lists. The result is a row for each pair, so a pair has to fit in a row, as it has to as a training example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, stored, table

#: How a turn is rendered, and the role whose turns in a completion count for the loss.
TEMPLATE = ("<|", "|>\n", "\n")
LEARNED = "assistant"


def _header(x: Column) -> Column:
    return F.concat(F.lit(TEMPLATE[0]), F.coalesce(x["role"], F.lit("")), F.lit(TEMPLATE[1]))


def _body(x: Column) -> Column:
    return F.concat(F.coalesce(x["text"], F.lit("")), F.lit(TEMPLATE[2]))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), _body(x))), "")


def _mask(turns: Column) -> Column:
    """Runs of code points (n, learn) that make up the rendered turns: each turn's header, then its text."""
    learn = lambda x: F.coalesce((x["role"] == LEARNED).cast("int"), F.lit(0))
    runs = lambda x: F.array(F.struct(F.char_length(_header(x)).alias("n"), F.lit(0).alias("learn")), F.struct(F.char_length(_body(x)).alias("n"), learn(x).alias("learn")))
    return F.flatten(F.transform(turns, runs))


def preference_format(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen and rejected (pair_id, turn, role, text) -> a row for each pair that either has:

    pair_id, prompt_turns (length of the common prefix), prompt, chosen and rejected (the rendered prefix and what each side
    has after it; empty for nothing), chosen_mask and rejected_mask (runs (n, learn) of the completion's code points; learn
    is 1 for the texts of the assistant, with their end; else 0).

    Turns are taken in the order of turn, role and text, nulls first, so repeated rows stay and ties are settled. They are
    equal if turn, role and text are (null equals null); the prefix ends before the first turn that differs or that one
    side lacks. A pair with one side only has no prompt. Rows without a pair id are left out, having no partner. Empty
    texts are rendered as such; very long ones are copied whole. Empty tables give no rows; other columns are ignored.
    """
    sides = []
    for name, df in (("c", chosen), ("r", rejected)):
        turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        sides.append(df.where("pair_id IS NOT NULL").select(F.col("pair_id").cast("long").alias("pair_id"), F.lit(name).alias("side"), turn.alias("x")))
    collected = [F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("x")))).alias(name) for name in ("c", "r")]
    both = sides[0].unionByName(sides[1]).groupBy("pair_id").agg(*collected)
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")
    both = both.withColumn("k", F.when(first > 0, first - 1).otherwise(n))
    rest = {side: F.slice(side, F.col("k") + 1, F.size(side)) for side in ("c", "r")}
    return both.select(
        "pair_id", F.col("k").cast("long").alias("prompt_turns"), _rendered(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        _rendered(rest["c"]).alias("chosen"), _rendered(rest["r"]).alias("rejected"), _mask(rest["c"]).alias("chosen_mask"), _mask(rest["r"]).alias("rejected_mask"),
    )


def derived_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) -> chosen and rejected for preference_format, as the table has no preferences: each
    conversation is chosen; its rejected form is cut at its last assistant turn (at its first turn if it has none) and
    goes on from there with the turns of its neighbour, the conversation whose id differs in the last bit."""
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    cuts = own.groupBy("pair_id").agg(F.coalesce(F.max(F.when(F.col("role") == LEARNED, F.col("turn"))), F.min("turn")).alias("cut"))
    cuts = by_size(stored(cuts, "cuts"))
    before = own.join(cuts, "pair_id").where("turn < cut").drop("cut")
    after = own.withColumn("pair_id", F.col("pair_id").bitwiseXOR(F.lit(1))).join(cuts, "pair_id").where("turn >= cut").drop("cut")
    return own, before.unionByName(after)


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of conversations, with the pairs of derived_pairs(); the masks as text, such as 14*0,120*1."""
    out = preference_format(*derived_pairs(table(spark, sf_dir, "conversations")))
    for side in ("chosen_mask", "rejected_mask"):
        out = out.withColumn(side, F.array_join(F.transform(side, lambda x: F.concat(x["n"].cast("string"), F.lit("*"), x["learn"].cast("string"))), ","))
    return out


ORACLE = """
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
cuts AS (SELECT pair_id, coalesce(max(turn) FILTER (WHERE role = 'assistant'), min(turn)) AS cut FROM t GROUP BY pair_id),
s AS (SELECT 0 AS side, * FROM t
      UNION ALL SELECT 1, t.* FROM t JOIN cuts ON t.pair_id = cuts.pair_id AND turn < cut
      UNION ALL SELECT 1, cuts.pair_id, turn, role, text FROM t JOIN cuts ON xor(t.pair_id, 1) = cuts.pair_id AND turn >= cut),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
             '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || chr(10) AS body FROM s),
p AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i, c.i AS ci, r.i AS ri, c.head AS c_head, c.body AS c_body, r.head AS r_head, r.body AS r_body, c.role AS c_role, r.role AS r_role,
             c.i IS NOT NULL AND r.i IS NOT NULL AND c.turn IS NOT DISTINCT FROM r.turn AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
      FROM (SELECT * FROM n WHERE side = 0) c FULL OUTER JOIN (SELECT * FROM n WHERE side = 1) r ON c.pair_id = r.pair_id AND c.i = r.i),
m AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING) = 0 AS common FROM p)
SELECT pair_id, count(*) FILTER (WHERE common) AS prompt_turns,
  coalesce(string_agg(c_head || c_body, '' ORDER BY i) FILTER (WHERE common), '') AS prompt,
  coalesce(string_agg(c_head || c_body, '' ORDER BY i) FILTER (WHERE NOT common AND ci IS NOT NULL), '') AS chosen,
  coalesce(string_agg(r_head || r_body, '' ORDER BY i) FILTER (WHERE NOT common AND ri IS NOT NULL), '') AS rejected,
  coalesce(string_agg(length(c_head) || '*0,' || length(c_body) || '*' || CASE WHEN c_role = 'assistant' THEN 1 ELSE 0 END, ',' ORDER BY i) FILTER (WHERE NOT common AND ci IS NOT NULL), '') AS chosen_mask,
  coalesce(string_agg(length(r_head) || '*0,' || length(r_body) || '*' || CASE WHEN r_role = 'assistant' THEN 1 ELSE 0 END, ',' ORDER BY i) FILTER (WHERE NOT common AND ri IS NOT NULL), '') AS rejected_mask
FROM m GROUP BY pair_id
"""
