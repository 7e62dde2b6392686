"""What decisions do to the base: new persons, relations, statements, flags.

Each function takes tables and a batch of decisions and gives the tables after
them, so that undoing is doing again what still stands (see curation.replay).
A batch is what curators decide, and is numbered by its order alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import vocab as V
from linkloom.functions.text import blank_to_null, slugify
from linkloom.operators.relations import pair_key
from linkloom.plans.loops import ranked

#: What stands for a missing argument, and the open issue of a person of one name.
NO_ARGUMENT = "(sem argumento registrado)"
ONE_NAME_ISSUE = "confirmar nome completo em outra fonte"


def numbered(df: DataFrame, prefix: str, taken: DataFrame, order: str, width: int = 4) -> DataFrame:
    """df with ids prefix-0001, ... after the highest of that form that is taken."""
    highest = taken.agg(F.coalesce(F.max(F.regexp_extract("id", rf"^{prefix}-(\d+)$", 1).try_cast("long")), F.lit(0)).alias("__highest"))
    rank = ranked(df.select(order).distinct(), "__rank", order)
    number = F.col("__highest") + F.col("__rank") + 1
    text = F.when(F.length(number.cast("string")) < width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string"))
    return df.join(rank, order).crossJoin(highest).withColumn("id", F.concat(F.lit(f"{prefix}-"), text)).drop("__highest", "__rank")


def create_persons(persons: DataFrame, proposed: DataFrame) -> DataFrame:
    """(seq, id, name, status, issue) for proposals (seq, name[, issue]): ids are slugs, with -2, -3, ... where taken.

    A proposal without a name makes no person.  A name of one word opens an issue, unless there is one.
    """
    clean = proposed.withColumn("name", blank_to_null(F.col("name"))).where("name is not null").withColumn("base", slugify(F.col("name")))
    rank = clean.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("seq")))
    needed = rank.groupBy("base").agg(F.max("rank").alias("n"))
    old = persons.select("id", F.regexp_replace("id", r"-\d+$", "").alias("stem"))
    owners = old.select("id", F.col("stem").alias("base")).unionAll(old.where("id <> stem").select("id", F.col("id").alias("base")))
    like = owners.groupBy("base").agg(F.count("*").alias("old"))
    slots = needed.join(like, "base", "left").select("base", F.explode(F.sequence(F.lit(1), F.col("n") + F.coalesce("old", F.lit(0)).cast("int"))).alias("k"))
    ids = slots.withColumn("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))))
    free = ids.join(persons.select("id"), "id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("k")))
    one_word = F.when(F.size(F.split("name", r"\s+")) == 1, F.lit(ONE_NAME_ISSUE))
    issue = F.coalesce(blank_to_null(F.col("issue")), one_word) if "issue" in proposed.columns else one_word
    return rank.join(free.select("base", "rank", "id"), ["base", "rank"]).select("seq", "id", "name", F.lit("rascunho").alias("status"), issue.alias("issue"))


def refusals(accepted: DataFrame, persons: DataFrame, sources: DataFrame) -> DataFrame:
    """Decisions on relations (seq, src, dst, type, confidence, source, issue) with refused: why one can't be carried out, or null."""
    known = persons.select(F.col("id").alias("__p"))
    known_sources = sources.select(F.col("id").alias("__s"), F.lit(True).alias("__there"))
    a, b = known.withColumnRenamed("__p", "__a"), known.withColumnRenamed("__p", "__b")
    j = accepted.join(a, accepted["src"] == a["__a"], "left").join(b, accepted["dst"] == b["__b"], "left").join(known_sources, accepted["source"] == known_sources["__s"], "left")
    sure = F.coalesce("confidence", F.lit("documentado"))
    refused = (
        F.when(F.col("src").isNull() | F.col("dst").isNull() | F.col("type").isNull(), "incomplete").when(F.col("src") == F.col("dst"), "same-person").when(~F.col("type").isin(V.RELATION_TYPES), "bad-type")
        .when(F.col("__a").isNull() | F.col("__b").isNull(), "unknown-person").when(F.col("source").isNotNull() & F.col("__there").isNull(), "unknown-source")
        .when((sure == "documentado") & F.col("source").isNull(), "needs-source").when((sure == "hipotese") & F.col("source").isNull() & blank_to_null(F.col("issue")).isNull(), "needs-issue")
    )
    return j.select(*accepted.columns, refused.alias("refused"))


def _with_key(df: DataFrame) -> DataFrame:
    a, b = pair_key(F.col("src"), F.col("dst"), F.col("type"), F.col("symmetric"))
    return df.withColumns({"ka": a, "kb": b})


def accept_relations(relations: DataFrame, accepted: DataFrame) -> DataFrame:
    """relations (id, src, dst, type, symmetric, confidence, source_ids, issue) after accepted ones that aren't refused.

    A relation of the same key takes the source, and the issue if it has none; nothing else of it changes.  Else the
    first of a key becomes a relation, and the others of that key add their sources to it.  effect: kept, merged or new.
    """
    old, new = _with_key(relations), _with_key(accepted.withColumns({"confidence": F.coalesce("confidence", F.lit("documentado")), "issue": blank_to_null(F.col("issue"))}))
    keys = ["ka", "kb", "type"]
    first = F.min_by(F.struct("src", "dst", "symmetric", "confidence"), "seq")
    batch = new.groupBy(*keys).agg(F.min("seq").alias("seq"), first.alias("f"), F.collect_set("source").alias("added"), F.min_by("issue", F.when(F.col("issue").isNotNull(), F.col("seq"))).alias("opened"))
    target = old.groupBy(*keys).agg(F.min("id").alias("id"))
    to = batch.join(target, keys, "left")
    merged = relations.join(to.where("id is not null").select("id", "added", "opened"), "id", "left")
    none = F.array().cast(relations.schema["source_ids"].dataType)
    kept = merged.select(
        "id", "src", "dst", "type", "symmetric", "confidence", F.array_sort(F.array_union("source_ids", F.coalesce("added", none))).alias("source_ids"), F.coalesce(blank_to_null(F.col("issue")), F.col("opened")).alias("issue"),
        F.when(F.col("added").isNull(), "kept").otherwise("merged").alias("effect"),
    )
    fresh = numbered(to.where("id is null").drop("id"), "rel", relations.select("id"), "seq")
    return kept.unionByName(fresh.select("id", "f.src", "f.dst", "type", "f.symmetric", "f.confidence", F.array_sort("added").alias("source_ids"), F.col("opened").alias("issue"), F.lit("new").alias("effect")))


def truth(said: Column) -> Column:
    """A yes or no said in words; null for anything else."""
    t = F.lower(F.trim(said.cast("string")))
    return F.when(t.isin("true", "sim"), True).when(t.isin("false", "nao", "não"), False)


def accept_statements(statements: DataFrame, accepted: DataFrame, persons: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, person, affirms, argument, source) of decisions (seq, person, affirms, argument, source) of known persons and sources."""
    sound = accepted.join(persons.select(F.col("id").alias("person")), "person", "left_semi").join(sources.select(F.col("id").alias("source")), "source", "left_semi")
    return numbered(sound, "dep", statements.select("id"), "seq").select("id", "person", truth(F.col("affirms")).alias("affirms"), F.coalesce(blank_to_null(F.col("argument")), F.lit(NO_ARGUMENT)).alias("argument"), "source")


def mark_processed(sources: DataFrame, marked: DataFrame) -> DataFrame:
    """sources with the flag of the last mark (seq, id, processed) of each."""
    last = marked.groupBy("id").agg(F.max_by("processed", "seq").alias("__flag"))
    return sources.join(last, "id", "left").withColumn("processed", F.coalesce("__flag", "processed")).drop("__flag")


def without_unused(persons: DataFrame, made: DataFrame, relations: DataFrame, statements: DataFrame) -> DataFrame:
    """persons less those that undone decisions had made (id) and nothing refers to any more."""
    used = relations.select(F.col("src").alias("id")).unionAll(relations.select("dst")).unionAll(statements.select("person")).distinct()
    return persons.join(made.select("id").join(used, "id", "left_anti"), "id", "left_anti")
