"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users, together with the spans of the text to learn from: the speaker's own turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import hint, written

#: Context that is nobody's turn: rendered in every perspective, learned in none.
SYSTEM = "system"
UNKNOWN = "unknown"
#: A rendering covers so many turn numbers; longer conversations go on in further parts.
PART_TURNS = 512
#: Where turn numbers repeat so that a part has more rows than this, it is dealt to shards of about ``PART_TURNS`` rows.
PART_ROWS = 2048
END = "<|im_end|>\n"


def heading(role: Column, speaker: Column) -> Column:
    """What stands before a turn, as seen by ``speaker``."""
    who = F.when(role == SYSTEM, F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each conversation, participant, part and shard: the dialogue, the mask and what they hold.

    ``mask`` lists the spans to learn from as ``begin:end`` in code points of ``dialogue``. A part covers
    ``part_turns`` consecutive turn numbers; turns of one number follow one another by role and text, and repeated
    rows are rendered as often as they occur. Where numbers repeat (or are null) so often that a part has over
    ``part_rows`` rows, a hash deals them evenly to shards, so no conversation has to fit in one row or task. A text
    of any length is rendered whole. ``<|`` in a text or role becomes ``< |``, so that no turn can forge another's
    marks; a line feed in a role becomes a space.

    A null role is a participant named ``unknown``, a null text is empty, a null turn counts as turn 0. Turns
    without a conversation cannot be put in order with one another: each distinct one is a dialogue of its own,
    which ``n_copies`` says how often occurs (1 for all others). Conversations of system turns alone have no
    participant and give no row; an empty table gives an empty result; further columns are ignored.
    """
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        safe(F.replace(F.coalesce("role", F.lit(UNKNOWN)), F.lit("\n"), F.lit(" "))).alias("role"),
        safe(F.coalesce("text", F.lit(""))).alias("text"),
    )
    # counting equal rows first makes repeated turns and turns without a conversation cheap
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    named = _sharded(counted.filter("conv_id IS NOT NULL").withColumn("part", F.floor(F.col("turn") / part_turns)), part_turns, part_rows)
    speakers = named.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    # every part and shard gets the participants, so that rows are joined by these and not by conversation
    places = named.select("conv_id", "part", "shard").distinct().join(speakers, "conv_id")
    seen = named.join(places, ["conv_id", "part", "shard"])
    alone = counted.filter((F.col("conv_id").isNull()) & (F.col("role") != SYSTEM))
    dialogues = _render(seen, ["conv_id", "perspective", "part", "shard"]).withColumn("n_copies", F.lit(1).cast("long"))
    single = _turn(alone.withColumn("perspective", F.col("role")).withColumn("times", F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    single = single.select(
        "conv_id", "perspective", zero.alias("part"), zero.alias("shard"), F.lit(1).cast("long").alias("n_turns"), F.lit(1).cast("long").alias("n_learned"),
        F.concat("head", "text", F.lit(END)).alias("dialogue"), F.concat_ws(":", F.length("head"), F.length("head") + F.length("text")).alias("mask"), F.col("n").alias("n_copies"),
    )
    return dialogues.unionByName(single)


def _sharded(counted: DataFrame, part_turns: int, part_rows: int) -> DataFrame:
    """Rows with their shard; the copies of a row in a crowded part are dealt one by one, beginning where its hash says."""
    sizes = counted.groupBy("conv_id", "part").agg(F.sum("n").alias("rows")).filter(F.col("rows") > part_rows)
    sizes = written(sizes.select("conv_id", "part", F.ceil(F.col("rows") / part_turns).alias("shards")), "crowded-parts")
    key = ["conv_id", "part"]
    if sizes.isEmpty():
        return counted.withColumn("shard", F.lit(0).cast("long"))
    sizes = hint(sizes)
    calm = counted.join(sizes, key, "left_anti").withColumn("shard", F.lit(0).cast("long"))
    first = F.conv(F.substring(F.md5(F.concat_ws(" ", "turn", "role", "text")), 1, 7), 16, 10).cast("long")
    each = counted.join(sizes, key).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "shards") - 1)))
    dealt = each.withColumns({"shard": (first + F.col("j")) % F.col("shards"), "n": F.floor((F.col("n") - F.col("j") - 1) / F.col("shards")) + 1})
    return calm.unionByName(dealt.select(calm.columns))


def _turn(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", heading(F.col("role"), F.col("perspective")))


def _render(seen: DataFrame, key: list[str]) -> DataFrame:
    turn = F.struct("turn", "role", "text", "head", "n")
    grouped = _turn(seen).groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    each = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["n"].cast("int"))))
    told = F.transform(each, lambda t: F.concat(t["head"], t["text"], F.lit(END)))
    begin = lambda n: F.struct(n.alias("at"), F.array().cast("array<string>").alias("spans"))
    masks = F.aggregate(
        each,
        begin(F.lit(0)),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(
                F.startswith(t["head"], F.lit("<|im_start|>assistant\n")) & (t["role"] != SYSTEM),
                F.array_append(s["spans"], F.concat_ws(":", s["at"] + F.length(t["head"]), s["at"] + F.length(t["head"]) + F.length(t["text"]))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    spans = masks["spans"]
    return grouped.select(
        *key,
        F.size(each).cast("long").alias("n_turns"),
        F.size(spans).cast("long").alias("n_learned"),
        F.array_join(told, "").alias("dialogue"),
        F.array_join(spans, " ").alias("mask"),
    )


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, replace(replace(coalesce(role, '{UNKNOWN}'), chr(10), ' '), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
c AS (SELECT conv_id, turn // {PART_TURNS} AS part, turn, role, text, count(*) AS n, ('0x' || substr(md5(turn || ' ' || role || ' ' || text), 1, 7))::BIGINT AS h FROM t WHERE conv_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY conv_id, part) > {PART_ROWS} THEN ceil(sum(n) OVER (PARTITION BY conv_id, part) / {PART_TURNS})::BIGINT ELSE 1 END AS shards FROM c),
dealt AS (SELECT conv_id, part, turn, role, text, (h + k - 1) % shards AS shard FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM s)),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> '{SYSTEM}'),
seen AS (SELECT dealt.*, perspective, '<|im_start|>' || CASE WHEN role = '{SYSTEM}' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
         FROM dealt JOIN speakers USING (conv_id)),
placed AS (SELECT *, row_number() OVER w AS n, sum(length(head) + length(text) + {len(END)}) OVER (w ROWS UNBOUNDED PRECEDING) - length(text) - {len(END)} AS begins
           FROM seen WINDOW w AS (PARTITION BY conv_id, perspective, part, shard ORDER BY turn, role, text)),
alone AS (SELECT role, text, turn, count(*) AS n FROM t WHERE conv_id IS NULL AND role <> '{SYSTEM}' GROUP BY ALL)
SELECT conv_id, perspective, part, shard, count(*) AS n_turns, count(*) FILTER (role = perspective) AS n_learned,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS dialogue,
       coalesce(string_agg(begins || ':' || (begins + length(text)), ' ' ORDER BY n) FILTER (role = perspective), '') AS mask, 1::BIGINT AS n_copies
FROM placed GROUP BY conv_id, perspective, part, shard
UNION ALL
SELECT NULL, role, 0, 0, 1, 1, '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10), '22:' || (22 + length(text)), n FROM alone
"""
