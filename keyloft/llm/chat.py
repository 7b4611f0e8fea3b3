"""Perspective rotation of dialogues, in column expressions only.

For each participant the dialogue is rendered once with that speaker as assistant and all others as named users; the loss
mask covers what the assistant says. Dialogues come in chunks of CHUNK_TURNS neighbouring turns, so a dialogue of any length
is never gathered in one task; the chunks of a dialogue and perspective, joined in order by ``joined``, are its full
rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import let, table
from keyloft.operators.chunking import ordered_numbers

#: Turns of a chunk; the role that takes no part and is never the assistant.
CHUNK_TURNS, SYSTEM = 64, "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Text in which the markers of the format can't occur."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<|im start|>")), F.lit("<|im_end|>"), F.lit("<|im end|>"))


def name_of(role: Column) -> Column:
    """A speaker's name without white space or markers: percent-encoded UTF-8, so that different speakers have different names."""
    return F.replace(F.replace(F.replace(F.url_encode(role), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def rotate(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, text, spans: one row per dialogue, participant and chunk of turns.

    Turns are ordered by turn number (null first), then role (null first), then text; repeated turns stay. Chunk k holds the
    turns from place k * chunk_turns on, whatever their numbers, so null, equal and sparse numbers make no large or small
    chunks. A null role is a speaker of its own without a name (perspective null), a null text is empty, system turns are
    rendered as such for everyone. A dialogue of system turns alone has no participant and no row. Rows of a null conv_id are
    dialogues of their own, equal ones together. spans are (start, end) character ranges of the assistant's words and end
    markers in text. A very long text stays whole in its chunk. Other columns are ignored; an empty table gives an empty
    result.
    """
    role, said = F.col("role").cast("string"), _safe(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("speaker"), said.alias("said"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "speaker", "said")).otherwise(F.lit(0)))
    dialogue = ["conv_id", "alone"]
    rows = ordered_numbers(rows, dialogue, ["turn", "speaker", "said"]).withColumn("chunk", F.floor(F.col("row_in_subset") / chunk_turns).cast("long"))
    rows = rows.withColumnsRenamed({"conv_id": "c", "alone": "a"})
    chunks = rows.groupBy("c", "a", "chunk").agg(F.sort_array(F.collect_list(F.struct("row_in_subset", "speaker", "said"))).alias("turns"))
    people = rows.filter(~F.col("speaker").eqNullSafe(F.lit(SYSTEM))).select("c", "a", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumnsRenamed({"c": "c2", "a": "a2"})
    views = chunks.join(people, F.col("c").eqNullSafe(F.col("c2")) & (F.col("a") == F.col("a2")))

    own = lambda t: t["speaker"].eqNullSafe(F.col("perspective"))
    other = lambda t: F.concat(F.lit(f"{OPEN}user"), F.coalesce(F.concat(F.lit(" name="), name_of(t["speaker"])), F.lit("")), F.lit("\n"))
    head = lambda t: F.when(own(t), F.lit(f"{OPEN}assistant\n")).when(t["speaker"] == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(other(t))
    body = lambda t: F.concat(t["said"], F.lit(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), own(t).alias("own")))
    made = let(parts, lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"), F.aggregate(ps, start, step)["spans"].alias("spans")))
    out = views.select(F.col("c").alias("conv_id"), "perspective", "chunk", F.size("turns").cast("long").alias("n_turns"), made.alias("made"), "a")
    return out.select("conv_id", "perspective", "chunk", "n_turns", "made.text", "made.spans")


def joined(fragments: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, text, spans: the rows of ``rotate`` with the chunks of a dialogue joined in order.

    spans are ranges of the whole text. Each dialogue and perspective is gathered in one row, so the longest has to fit one.
    Rows of a null conv_id, whose turns are not told apart by it, stay as they are. An empty table gives an empty result.
    """
    columns = ("conv_id", "perspective", "n_turns", "text", "spans")
    rows = fragments.filter("conv_id is not null").groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("chunk", "n_turns", "text", "spans"))).alias("parts"), F.sum("n_turns").alias("n_turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(p["text"])).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    whole = rows.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "")).withColumn("spans", F.aggregate("parts", start, step)["spans"])
    return whole.select(*columns).unionByName(fragments.filter("conv_id is null").select(*columns))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the view of each participant; masks as "start-end" lists."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "perspective", "chunk", "n_turns", "text", spans.alias("loss_spans"))


OP1_SQL = """
WITH n AS (
  SELECT conv_id, role AS speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<|im start|>'), '<|im_end|>', '<|im end|>') || '<|im_end|>' AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations
), t AS (SELECT *, (place // 64)::BIGINT AS chunk FROM n),
v AS (
  SELECT t.*, p.speaker AS perspective,
    CASE WHEN t.speaker IS NOT DISTINCT FROM p.speaker THEN '<|im_start|>assistant' WHEN t.speaker = 'system' THEN '<|im_start|>system'
      ELSE '<|im_start|>user' || coalesce(' name=' || url_encode(t.speaker), '') END || chr(10) AS head
  FROM t JOIN (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker IS DISTINCT FROM 'system') p USING (conv_id)
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY place ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS b FROM v
)
SELECT conv_id, perspective, chunk, count(*)::BIGINT AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN (b::BIGINT)::VARCHAR || '-' || ((b + length(body))::BIGINT)::VARCHAR END, ',' ORDER BY place), '') AS loss_spans
FROM o GROUP BY conv_id, perspective, chunk
"""
