"""Preference formatting of conversations, with DataFrame functions only.

``format_preferences(chosen, rejected)`` takes two tables of turns with the columns pair_id, turn, role, text. For each
pair_id found in both it finds the longest common prefix of turns, renders that once as ``prompt`` and the rest of
either side as ``chosen`` and ``rejected``, with character spans (0-based start, length; the role header left out, the
end marker inside) of the text to train on: the turns of ``trained_role`` in the completions, nothing in the prompt.

Turns are compared by turn number, so the prefix is an aggregation of digests by (pair_id, turn): no conversation is ever
gathered for it, and no text moves. Then the turns that are rendered (of the common prefix, the chosen side's only) meet once,
by pair. A pair is one row, ``part`` 0, however its turns are numbered. Only pairs of more than ``part_turns`` turns (of
both sides together) come in several rows, each holding the next such number of them, so that no group grows without bound.

Defined results. Null pair_id: the row takes no part. Null turn: -1, before all others. Null role: "unknown"; null
text: "". Rows repeated exactly within a side count once. Different rows with one turn number are kept, ordered by
role and text, and must agree as a whole. A pair found on one side only gives no row. Equal sides give empty
completions. Empty tables give no rows. Other columns are ignored. Text is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize

PART_TURNS = 4096
#: Turn numbers that are counted together.
STEP = 256
END = "<|end|>\n"


def _turns(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        F.col("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    ).where(F.col("pair_id").isNotNull())


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """start:length of each trained turn, joined by ';'."""

    def step(acc, t):
        head, body = F.length(_header(t["role"])), F.length(t["text"]) + F.lit(len(END))
        span = F.concat_ws(":", (acc["at"] + head).cast("string"), body.cast("string"))
        return F.struct(
            (acc["at"] + head + body).cast("long").alias("at"),
            F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ";"))


def _prefixes(rows: DataFrame, part_turns: int) -> DataFrame:
    """For each pair found on both sides: cut (the first turn that differs), repeats (whether rows are repeated exactly), and parts, the
    number of the part that holds the turns from each multiple of STEP on, where it changes."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    slim = rows.select("pair_id", "turn", "side", digest.alias("d"))
    side = lambda s: F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("d")))).alias(s)
    by_turn = slim.groupBy("pair_id", "turn").agg(side("c"), side("r"), F.count("*").alias("n"))
    steps = by_turn.groupBy("pair_id", F.floor(F.col("turn") / STEP).alias("step")).agg(
        F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("cut"), F.sum(F.size("c")).alias("c"), F.sum(F.size("r")).alias("r"), F.sum("n").alias("n")
    )
    pairs = steps.groupBy("pair_id").agg(
        F.min("cut").alias("cut"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("step", (F.col("c") + F.col("r")).alias("turns")))).alias("steps")
    )
    kind = "struct<before:bigint,parts:array<struct<step:bigint,part:bigint>>>"

    def step(acc, x):
        part = F.floor(acc["before"] / part_turns)
        new = (F.size(acc["parts"]) == 0) | (F.element_at(acc["parts"], -1)["part"] != part)
        parts = F.when(new, F.concat(acc["parts"], F.array(F.struct(x["step"].alias("step"), part.alias("part"))))).otherwise(acc["parts"])
        return F.struct((acc["before"] + x["turns"]).alias("before"), parts.alias("parts")).cast(kind)

    start = F.struct(F.lit(0).alias("before"), F.array().alias("parts")).cast(kind)
    return pairs.where("c > 0 and r > 0").select("pair_id", "cut", (F.col("n") > F.col("c") + F.col("r")).alias("repeats"), F.aggregate("steps", start, step)["parts"].alias("parts"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant", part_turns: int = PART_TURNS) -> DataFrame:
    """pair_id, part, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    rows = _turns(chosen, "c").unionByName(_turns(rejected, "r"))
    pairs = materialize(_prefixes(rows, part_turns), "chat-pairs")
    n, again = pairs.agg(F.count("*"), F.count_if("repeats")).first()
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    placed = rows.join(broadcast_if_small(pairs, n), "pair_id").where(~(common & (F.col("side") == "r")))
    part = F.element_at(F.filter("parts", lambda p: p["step"] <= F.floor(F.col("turn") / STEP)), -1)["part"]
    place = ["pair_id", part.alias("part"), F.when(common, "p").otherwise(F.col("side")).alias("side"), "turn", "role", "text"]
    if again:
        placed = placed.where("not repeats").select(*place).unionByName(placed.where("repeats").select(*place).distinct())
    else:
        placed = placed.select(*place)
    if n > BROADCAST_ROWS:  # joined by shuffle: dealt anew, so that a hot pair can be split in the join
        placed = placed.repartition("pair_id", "part")
    turn = F.struct("turn", "role", "text")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s)
    out = placed.groupBy("pair_id", "part").agg(side("p"), side("c"), side("r"))
    return out.select(
        "pair_id", "part", F.size("p").cast("long").alias("n_common"), _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _spans(F.col("c"), trained_role).alias("chosen_spans"), _spans(F.col("r"), trained_role).alias("rejected_spans"),
    )


def preference_sides(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference data from plain conversations: chosen is the conversation as it is; rejected is the same up to its last assistant
    turn, which is replaced by the first assistant turn of the next conversation that has one, whatever the gap between the ids;
    the last one takes the first's. Every conversation with an assistant turn gives a pair. A conversation that is the only one
    with an answer meets its own first answer. Rows without conv_id or turn take no part."""
    conv = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("conv_id is not null and turn is not null")
    said = conv.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last_turn"), F.min("turn").alias("first_turn"))
    # runs of ids by range; the next id is in the same run, or the first of the next run
    ids = materialize(said.repartitionByRange("pair_id").withColumn("run", F.spark_partition_id()), "chat-ids")
    heads = ids.groupBy("run").agg(F.min("pair_id").alias("head"))  # as many as shuffle partitions
    order = W.orderBy("run")
    heads = heads.select("run", F.coalesce(F.lead("head").over(order), F.min("head").over(W.partitionBy(F.lit(0)))).alias("after"))
    within = F.lead("pair_id").over(W.partitionBy("run").orderBy("pair_id"))
    pairs = ids.withColumn("next", within).join(F.broadcast(heads), "run").select("pair_id", "last_turn", F.coalesce("next", "after").alias("next"))
    answer = ids.select(F.col("pair_id").alias("next"), "first_turn").join(pairs.select("pair_id", "next", "last_turn"), "next")
    answer = materialize(answer, "chat-next")
    n = answer.count()
    kept = conv.join(broadcast_if_small(answer.select("pair_id", "last_turn"), n), "pair_id").where("turn < last_turn").drop("last_turn")
    other = conv.where("role = 'assistant'").withColumnRenamed("pair_id", "next").join(broadcast_if_small(answer.select("next", F.col("first_turn").alias("turn"), "pair_id", "last_turn"), n), ["next", "turn"])
    put = other.groupBy("pair_id", "last_turn").agg(F.min("text").alias("text"))
    put = put.select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return conv, kept.unionByName(put)


def op8_preference_formatting(spark, sf_dir):
    chosen, rejected = preference_sides(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return format_preferences(chosen, rejected)


ORACLE = rf"""
WITH conv AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT * FROM conv WHERE role = 'assistant'),
last AS (SELECT conv_id, max(turn) AS last_turn FROM said GROUP BY 1),
first AS (SELECT conv_id AS next, text AS other FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM said) WHERE k = 1),
swap AS (SELECT conv_id, last_turn, other FROM (SELECT *, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next FROM last) JOIN first USING (next)),
rows AS (
  SELECT DISTINCT 'c' AS side, conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conv
  UNION ALL SELECT DISTINCT 'r', conv_id, turn, coalesce(role, 'unknown'), coalesce(text, '') FROM conv JOIN swap USING (conv_id) WHERE turn < last_turn
  UNION ALL SELECT 'r', conv_id, last_turn, 'assistant', coalesce(other, '') FROM swap),
by_turn AS (
  SELECT pair_id, turn, coalesce(list((role, text) ORDER BY role, text) FILTER (side = 'c'), []) AS c, coalesce(list((role, text) ORDER BY role, text) FILTER (side = 'r'), []) AS r
  FROM rows GROUP BY 1, 2),
cut AS (SELECT pair_id, min(turn) FILTER (c <> r) AS cut FROM by_turn GROUP BY 1 HAVING max(len(c)) > 0 AND max(len(r)) > 0),
steps AS (SELECT pair_id, step, ((sum(n) OVER (PARTITION BY pair_id ORDER BY step) - n) // {PART_TURNS})::BIGINT AS part FROM (SELECT pair_id, floor(turn / {STEP})::BIGINT AS step, count(*) AS n FROM rows GROUP BY 1, 2)),
placed AS (
  SELECT pair_id, turn, part, role, text, CASE WHEN cut IS NULL OR turn < cut THEN 'p' ELSE side END AS piece,
         '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM rows JOIN cut USING (pair_id) JOIN steps USING (pair_id) WHERE step = floor(turn / {STEP}) AND NOT (side = 'r' AND (cut IS NULL OR turn < cut))),
spanned AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, piece ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM placed)
SELECT pair_id, part, count(*) FILTER (piece = 'p') AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (piece = 'p'), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (piece = 'c'), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (piece = 'r'), '') AS rejected,
  coalesce(string_agg((pos + length(head)) || ':' || length(body), ';' ORDER BY turn, role, text) FILTER (piece = 'c' AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((pos + length(head)) || ':' || length(body), ';' ORDER BY turn, role, text) FILTER (piece = 'r' AND role = 'assistant'), '') AS rejected_spans
FROM spanned GROUP BY 1, 2
"""
