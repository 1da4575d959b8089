"""Dialogues rendered once for each participant, as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one stretch of a dialogue, and turns of one piece of it.
STRETCH, PIECE = 64, 256
SYSTEM = "system"


def rotate(conversations: DataFrame, stretch: int = STRETCH, piece: int = PIECE) -> DataFrame:
    """conv_id, perspective, stretch, piece, start, n_turns, text, mask.

    For every participant (each role of a dialogue but ``system``), the
    dialogue with that speaker's turns as ``assistant``, all others as ``user``
    with their name, and system turns as they are. ``mask`` holds the (start,
    end) spans of characters to learn: the speaker's own words with the end
    mark, counted within the piece. A long dialogue comes as several rows: its
    text is their texts in order of stretch and piece, and ``start`` is where a
    row begins in it, so no dialogue has to fit one row.

    Turns go by number (null first); of turns with the same number by role,
    then text. Repeated rows stay repeated. A null text is empty, a null role
    is the participant ``unknown``, a null conv_id one dialogue. Marks inside a
    text are broken by a space. A dialogue of system turns only has no rows.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / stretch))
    order = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "said")
    rows = rows.withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("piece", F.floor((F.col("nth") - 1) / piece))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("role") == F.col("perspective")
    head = (
        F.when(mine, F.lit("<|im_start|>assistant\n"))
        .when(F.col("role") == SYSTEM, F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), "role", F.lit("\n")))
    )
    seen = seen.select(
        "conv_id", "perspective", "stretch", "piece",
        F.struct("nth", head.alias("head"), F.concat("said", F.lit("<|im_end|>")).alias("body"), mine.alias("mine")).alias("t"),
    )
    pieces = seen.groupBy("conv_id", "perspective", "stretch", "piece").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    body = lambda t: F.concat(t.head, t.body, F.lit("\n"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a.at + F.length(body(t))).alias("at"),
            F.when(
                t.mine,
                F.concat(
                    a.spans,
                    F.array(
                        F.struct(
                            (a.at + F.length(t.head)).alias("start"),
                            (a.at + F.length(t.head) + F.length(t.body)).alias("end"),
                        )
                    ),
                ),
            ).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    pieces = pieces.select(
        "conv_id", "perspective", "stretch", "piece",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", body), "").alias("text"),
        spans.alias("mask"),
    )
    before = (
        Window.partitionBy("conv_id", "perspective").orderBy("stretch", "piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long")
    return pieces.select("conv_id", "perspective", "stretch", "piece", start.alias("start"), "n_turns", "text", "mask")
