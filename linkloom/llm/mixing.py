"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its weight's share of all words that are to be drawn.  A source
that would be read more than ``epochs`` times is clamped there, and what is over is
dealt again to the others by their weights, until none is above.  The clamped sources
of a round are those under the water level, so a round is one aggregate over the
table of sources, and only the level, a number, passes through the driver.

A document is taken as often as its source is read whole.  The rest of the target is
filled with documents in the order of a seeded hash, up to the one whose middle lies
beyond it, so that what is taken differs from the target by half a document at most.
Sizes are added up over ranges of that order: no source is gathered in one task.

Defined results: a null text has size 0; null is a source, the last; a document
without an id is drawn like one with an empty id; equal rows count each; sources
without words get the target 0; no documents give no rows.  Columns of docs that are
kept give way to new ones of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut
from linkloom.llm.native import WORD
from linkloom.plans.loops import ranked

NEW = ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]


def sizes(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source, its key (null after all others) and the draw, 60 seeded bits; written."""
    name = F.col(source).cast("string")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    return cut(
        docs.select(
            *(F.col(f"`{c}`") for c in keep if c not in NEW), F.col(doc_id).alias("doc_id"), F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            name.alias("source"), F.coalesce(F.concat(F.lit("a"), name), F.lit("b")).alias("__key"), draw.alias("__draw"),
        )
    )


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """sources with the weights, repeating, in the order of their keys."""
    place = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("__place", F.lit(len(weights))) + 1).cast("int"))
    return ranked(sources, "__place", "__key").withColumn("weight", place).drop("__place")


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """sources (weight, cap) with the target: budget by weight, none above its cap."""
    over = F.col("cap") < F.col("weight") * F.col("__level")
    level, clamped = 0.0, -1
    while True:
        sums = (
            sources.withColumn("__level", F.lit(level))
            .agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("caps"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"))
            .first()
        )
        if sums["n"] == clamped or not sums["open"]:
            break
        clamped, level = sums["n"], (budget - float(sums["caps"])) / sums["open"]
    # with nothing open every source stands at its cap
    even = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), even) if sums["open"] else F.when(F.col("weight") > 0, F.col("cap").cast("double")).otherwise(0.0))


def mix(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (1, 2, 3), share: float = 1.0, epochs: int = 3, seed: int = 2024,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, and what is kept of docs.

    weights: repeated over the sources in the order of their names, or a frame (source,
    weight) in which others weigh nothing.  share: words to draw, as a part of all.
    """
    rows = sizes(docs, seed, doc_id, text, source, keep)
    totals = rows.groupBy("__key").agg(F.sum("size").alias("source_size")).withColumn("cap", F.col("source_size") * epochs)
    if isinstance(weights, DataFrame):
        given = weights.select(F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("__key"), F.col("weight").cast("double").alias("weight"))
        weighed = cut(totals.join(given.groupBy("__key").agg(F.sum("weight").alias("weight")), "__key", "left").fillna(0.0, ["weight"]))
    else:
        weighed = cut(cyclic_weights(cut(totals), weights))
    budget = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    targets = water_fill(weighed, budget).select("__key", "source_size", "target")

    order = ["__draw", F.col("doc_id").asc_nulls_last(), "size"]
    dealt = cut(rows.repartitionByRange("__key", *order).withColumn("__range", F.spark_partition_id()))
    pieces = dealt.groupBy("__key", "__range").agg(F.sum("size").alias("__words"))
    earlier = F.coalesce(F.sum("__words").over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("__before", earlier).join(targets, "__key").drop("__words")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    inside = F.sum("size").over(Window.partitionBy("__key", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    extra = F.col("__before") + F.col("__inside") + F.col("size") / 2 < F.col("target") - F.col("__whole") * F.col("source_size")
    out = dealt.withColumn("__inside", inside).join(pieces, ["__key", "__range"]).withColumn("__whole", whole).withColumn("copies", F.col("__whole") + extra.cast("long"))
    kept = [c for c in rows.columns if c not in NEW and not c.startswith("__")]
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", *kept)


def repeated(mixed: DataFrame) -> DataFrame:
    """mixed with each row as often as it has copies, numbered from 1 in the column copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
