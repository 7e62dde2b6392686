"""From a knowledge base's folder to its report and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.functions import vocab as V
from linkloom.operators import centrality, communities, exports, graph, rules, summaries
from linkloom.operators import paths as shortest
from linkloom.operators import relations as R
from linkloom.plans.loops import cut, ranked
from linkloom.sources import dataset as D
from linkloom.sources import jsonl


def problems(spark: SparkSession, root: str) -> DataFrame:
    """All rules over a folder: (level, rule, entity, message)."""
    ds = D.load(spark, root)
    files = {"persons": ds.persons, "relations": ds.relations, "statements": ds.statements, "sources": ds.sources}
    out = rules.schema(ds.persons, ds.relations, ds.statements, ds.sources)
    for name, df in files.items():
        out = out.unionAll(rules.unknown_keys(D.raw_lines(spark, root, name), list(D.KEYS[name]), name)).unionAll(rules.unique_id(df, name))
    aliases = ds.aliases.withColumn("id", F.col("person"))
    for part in (
        rules.references(ds.relations, ds.statements, ds.persons, ds.sources), rules.vocabulary(ds.persons, ds.institutions), rules.single_token_name(ds.persons),
        rules.where(ds.persons, F.col("attribution").isNull(), "warning", "missing-attribution", "persons"), rules.where(ds.persons, (F.col("status") == "verificado") & (F.col("n_sources") == 0), "warning", "unsourced", "persons"),
        rules.evidence(ds.relations), rules.direction(ds.relations), rules.period_format(ds.relations), rules.long_excerpt(ds.relations), rules.duplicate_key(ds.relations),
        rules.missing_reference(aliases.select("id", "person").distinct(), "person", ds.persons, "aliases", "alias"), rules.ambiguous_alias(aliases.withColumnRenamed("name", "variant")), missing_files(spark, root, ds.sources),
    ):
        out = out.unionAll(part)
    return out


def missing_files(spark: SparkSession, root: str, sources: DataFrame) -> DataFrame:
    """Sources whose file isn't in the folder; none where the folder keeps no files at all."""
    named = sources.where(F.coalesce("file", F.lit("")) != "")
    if not jsonl.exists(spark, f"{root}/{D.FILES_FOLDER}"):
        return rules.problem(named.limit(0), "warning", "missing-file", "sources", message=F.col("file"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{D.FILES_FOLDER}").select("path")
    # a file's name in the folder is what follows the folder's own in its path
    inside = there.select(F.concat(F.lit(f"{D.FILES_FOLDER}/"), F.substring_index(F.col("path"), f"/{D.FILES_FOLDER}/", -1)).alias("file")).distinct()
    return rules.problem(named.join(inside, "file", "left_anti"), "warning", "missing-file", "sources", message=F.col("file"))


def mentions(ds: D.Dataset, extracted: DataFrame) -> DataFrame:
    """The names of two words or more that extractions mention and nobody has: the first spelling, times, sources."""
    known = ds.names().select(X.normalize(F.col("name"), apostrophes=False).alias("norm")).distinct()
    said = extracted.select("source", F.explode("mencoes_sem_relacao").alias("name")).withColumn("norm", X.normalize(F.col("name"), apostrophes=False)).where("norm like '% %'")
    out = said.join(known, "norm", "left_anti").groupBy("norm").agg(F.min(F.trim("name")).alias("name"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    return out.select("name", "n", "sources").orderBy(F.desc("n"), "name").limit(100)


def build(spark: SparkSession, root: str, folder: str, origins: list[str] | None = None) -> dict[str, str]:
    """Writes graph.json, metrics.json, metrics.md, open_issues.md, persons.csv, relations.csv, graph.gexf and graph.graphml."""
    ds = D.load(spark, root)
    origins = [] if origins is None else origins
    edges = cut(R.collapse(ds.relations))
    # whole-graph algorithms take numbers for ids
    number = ds.persons.select("id").unionAll(ds.relations.select(F.explode(F.array("src", "dst")))).distinct()
    number = cut(ranked(number, "k", "id"))
    coded = edges.join(number.withColumnsRenamed({"id": "a", "k": "ka"}), "a").join(number.withColumnsRenamed({"id": "b", "k": "kb"}), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "weight20")
    coded = cut(coded)
    main = coded.join(graph.largest(graph.components(coded)).withColumnRenamed("node", "a"), "a", "left_semi")
    paths = shortest.centralities(coded, number.count())
    groups = cut(communities.communities(coded))
    measured = number.withColumnRenamed("k", "node")
    for part in (paths, centrality.eigenvector(main), groups):
        measured = measured.join(part, "node", "left")
    metrics = cut(measured.select("id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("betweenness", "closeness", "eigenvector")), "community"))
    people = cut(exports.persons_table(ds.persons, ds.relations, edges, ds.aliases, origins, metrics))
    issue = F.trim(F.coalesce("issue", F.lit(""))) != ""
    issues = ds.persons.where(issue).select(F.lit("person").alias("entity"), "id", "name", "issue").unionAll(
        exports.relations_table(ds.relations, ds.persons).where(issue).select(F.lit("relation"), "id", F.concat("src_name", F.lit(" → "), "dst_name", F.lit(" ("), "type", F.lit(")")), "issue")
    )
    isolated = people.where("isolated").select("id", "name", "role")
    summary = people.agg(
        F.count("*").alias("persons"), F.count_if(~F.col("isolated")).alias("connected"), F.count_if("isolated").alias("isolated"), F.max(F.when(~F.col("isolated"), F.col("component_size"))).alias("largest_component"), F.sum("degree").alias("degrees"),
    ).crossJoin(edges.agg(F.count("*").alias("edges"), F.sum("n_relations").alias("relations"), F.sum("weight20").alias("weight20"))).crossJoin(communities.modularity(coded, groups))
    statements = ds.statements.agg(F.count("*").alias("n"), F.count_if("affirms").alias("affirm"), F.count_if(~F.col("affirms")).alias("deny"), F.count_if(F.col("affirms").isNull()).alias("undefined"))
    ranks = {f"Highest {c}": R.ranking(people.withColumn(c, F.col(c).try_cast("double")), c).select("id", "name", c) for c in ("degree", "strength", "betweenness", "closeness", "eigenvector")}
    members = R.institution_links(ds.persons).groupBy(F.col("institution").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("members"))
    institutions = ds.institutions.join(members, "id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>"))).orderBy(F.desc(F.size("members")), "name")
    arcs = R.collapse_arcs(R.filtered(ds.relations, types=V.TEACHING_TYPES))
    report = {
        "Summary": summary, **ranks, "Relations by type and confidence": R.audit(ds.relations).orderBy(F.asc_nulls_last("type")), "Teaching and practice": R.audit_verdict(ds.relations),
        "Teaching": arcs.groupBy("src").agg(F.count("*").alias("out_degree")).orderBy(F.desc("out_degree"), "src"), "Statements": statements, "Rules": rules.summary(problems(spark, root)).orderBy("level", "rule"),
        "By type": summaries.by_type(ds.relations).orderBy("type"), "By decade": summaries.by_decade(ds.relations).orderBy("mode", "decade"),
        "Coverage": people.agg(F.count_if("isolated").alias("isolated")).crossJoin(issues.agg(F.count("*").alias("open_issues"))).crossJoin(ds.sources.agg(F.count("*").alias("sources"), F.count_if(~F.col("processed")).alias("unprocessed"))),
        "Isolated persons": isolated, "Sources by processing": ds.sources.groupBy("type", "processed").agg(F.count("*").alias("n")).orderBy("type", "processed"),
    }
    if origins:
        points = number.where(F.col("id").isin(origins))
        around = summaries.reach(coded, points.select(F.col("k").alias("node")))
        report |= {
            "Reach of the origins": points.join(around, points["k"] == around["origin"], "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hops_1", "hops_2", "hops_3", "reachable"))).orderBy("id"),
            "Convergence": summaries.convergence(coded, points.select(F.col("k").alias("node"))),
        }
    out = {n: f"{folder}/{n}" for n in ("graph.json", "metrics.json", "metrics.md", "open_issues.md", "persons.csv", "relations.csv", "graph.gexf", "graph.graphml")}
    exports.document(
        {
            "persons": exports.person_documents(ds.persons, ds.relations, metrics), "edges": exports.edge_documents(edges), "institutions": institutions, "sources": ds.sources.select("id", "type", "author", "title", "venue", "year", "url", "processed"),
            "statements": ds.statements, **{title.lower().replace(" ", "_"): df for title, df in report.items()},
        },
        out["graph.json"],
    )
    exports.document(report, out["metrics.json"])
    exports.report(report, out["metrics.md"])
    exports.open_issues(issues, isolated, mentions(ds, D.extractions(spark, root)), ds.sources.where("not processed").select("id", "author", "title", "year", "density", "file"), out["open_issues.md"])
    exports.csv_with_bom(people, out["persons.csv"])
    exports.csv_with_bom(exports.relations_table(ds.relations, ds.persons), out["relations.csv"])
    vertices = graph.vertices(ds.persons, edges).select("id", "name", "role", "status").join(people.select("id", "degree", "strength", "component", F.col("community").try_cast("int").alias("community")), "id", "left")
    flat = edges.select("a", "b", "weight20", "types", "dominant", "confidences", "n_relations", "n_sources")
    exports.gexf(vertices, flat, out["graph.gexf"])
    exports.graphml(vertices, flat, out["graph.graphml"])
    return out
