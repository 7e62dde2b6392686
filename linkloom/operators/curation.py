"""Event-sourced curation over a decision log (source, seq, item, action)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import normalize


def replay(log: DataFrame) -> DataFrame:
    """Decisions that stand after every undo took back the latest one before it of its source.

    Undo and decision match like brackets: with the running balance as depth, a decision is undone by the first
    later undo that returns to its depth.  An undo on an empty log does nothing, as the balance is kept from falling
    below zero by its running minimum.
    """
    w = Window.partitionBy("source").orderBy("seq")
    step = F.when(F.col("action") == "undo", -1).otherwise(1)
    raw = log.withColumn("raw", F.sum(step).over(w))
    floor = F.least(F.min("raw").over(w), F.lit(0))
    level = raw.withColumn("depth", F.col("raw") - floor).withColumn("floor_now", floor)
    before = F.coalesce(F.lag("floor_now").over(w), F.lit(0))
    # an undo that lowered the floor met an empty log
    real = level.withColumn("idle", (F.col("action") == "undo") & (F.col("floor_now") < before)).where("not idle")
    slot = F.when(F.col("action") == "undo", F.col("depth") + 1).otherwise(F.col("depth"))
    per_slot = Window.partitionBy("source", "slot").orderBy("seq")
    out = real.withColumn("slot", slot).withColumn("next", F.lead("action").over(per_slot))
    return out.where((F.col("action") != "undo") & (F.coalesce("next", F.lit("")) != "undo")).select("source", "seq", "item", "action")


def last_decisions(log: DataFrame) -> DataFrame:
    """The last standing decision on each item of a source."""
    return replay(log).groupBy("source", "item").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def pending(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items (source, item) without a decision, then those whose last decision defers them (deferred = 1)."""
    last = last_decisions(log)
    return items.join(last, ["source", "item"], "left").where("action is null or action = 'defer'").select("source", "item", F.when(F.col("action") == "defer", 1).otherwise(0).alias("deferred"))


def scoreboard(log: DataFrame) -> DataFrame:
    c = lambda a: F.count_if(F.col("action") == a)
    return replay(log).groupBy("source").agg(c("accept").alias("accepted"), c("discard").alias("discarded"), c("defer").alias("deferred"))


def learn_aliases(known: DataFrame, proposed: DataFrame, least: int = 3) -> DataFrame:
    """Proposed (person, variant) that are long enough and not known up to normalisation."""
    old = known.select("person", normalize(F.col("variant")).alias("norm")).distinct()
    new = proposed.withColumn("norm", normalize(F.col("variant"))).where(F.length("norm") >= least).join(old, ["person", "norm"], "left_anti")
    return new.groupBy("person", "norm").agg(F.min("variant").alias("variant"))


def effects(log: DataFrame) -> DataFrame:
    """(item, sources, first): what the standing acceptances leave of each item: the sources that it has, and the first.

    A decision that was undone leaves nothing, so undoing is replaying what stands.
    """
    accepted = replay(log).where("action = 'accept'")
    return accepted.groupBy("item").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.min_by("source", F.struct("seq", "source")).alias("first"))


def merge(relations: DataFrame, accepted: DataFrame) -> DataFrame:
    """relations (key, sources) with accepted rows (key, source) merged by key: sources join, nothing else changes; new keys are added."""
    both = relations.select("key", F.explode("sources").alias("s"), F.lit(0).alias("new")).unionAll(accepted.select("key", F.col("source").alias("s"), F.lit(1).alias("new")))
    return both.groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("sources"), (F.min("new") == 1).alias("is_new"), F.count_if(F.col("new") == 1).alias("n_accepted"))
