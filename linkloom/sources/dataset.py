"""The knowledge base as files: four JSON Lines tables and two YAML vocabularies.

The files keep the names of their format; the tables have the engine's names.
Rows are read without regard to the closed schema, so that the rules can tell
what is wrong with them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import vocab as V
from linkloom.sources import documents, jsonl

# The files, and the keys of their rows with the engine's column and type.
FILES = {"persons": "pessoas.jsonl", "relations": "relacoes.jsonl", "statements": "depoimentos.jsonl", "sources": "fontes.jsonl", "institutions": "vocabularios/instituicoes.yaml", "aliases": "vocabularios/aliases.yaml", "lexicon": "vocabularios/lexico_relacional.yaml"}
#: Where the folder keeps the sources' own files.
FILES_FOLDER = "raw_pdfs"
#: An optional list of capitalised words that make no name; not part of the format.
COMMON_WORDS = "vocabularios/common_words.yaml"
_EDUCATION = "array<struct<instituicao:string,curso:string,ano_inicio:int,ano_conclusao:int>>"
_ACTIVITY = "array<struct<tipo:string,nome:string,papel:string,periodo:string>>"
_REFERENCE = "struct<fonte:string,pagina:string,trecho:string>"
KEYS = {
    "persons": {
        "id": ("id", "string"), "nome": ("name", "string"), "nome_completo": ("full_name", "string"), "nascimento": ("birth", "int"), "morte": ("death", "int"), "local_nascimento": ("birthplace", "string"),
        "titulo_epoca": ("title", "string"), "atribuicao": ("attribution", "string"), "papel_historiografico": ("role", "string"), "formacao": ("education", _EDUCATION), "atuacao": ("activity", _ACTIVITY),
        "notas": ("notes", "string"), "status": ("status", "string"), "fontes": ("source_ids", "array<string>"), "pendencia": ("issue", "string"), "data_entrada": ("entered", "string"), "autor_entrada": ("entered_by", "string"),
    },
    "relations": {
        "id": ("id", "string"), "origem": ("src", "string"), "destino": ("dst", "string"), "tipo": ("type", "string"), "subtipo": ("subtype", "string"), "simetrico": ("symmetric", "boolean"), "periodo": ("period", "string"),
        "descricao": ("description", "string"), "confianca": ("confidence", "string"), "fontes": ("references", f"array<{_REFERENCE}>"), "pendencia": ("issue", "string"), "rompe": ("breaks", "string"),
        "status": ("status", "string"), "data_entrada": ("entered", "string"), "autor_entrada": ("entered_by", "string"),
    },
    "statements": {
        "id": ("id", "string"), "pessoa": ("person", "string"), "existe_escola": ("affirms", "boolean"), "argumento": ("argument", "string"), "fonte": ("reference", _REFERENCE), "data_depoimento": ("said", "string"),
        "status": ("status", "string"), "data_entrada": ("entered", "string"), "autor_entrada": ("entered_by", "string"),
    },
    "sources": {
        "id": ("id", "string"), "tipo": ("type", "string"), "autor": ("author", "string"), "titulo": ("title", "string"), "veiculo": ("venue", "string"), "ano": ("year", "int"), "url": ("url", "string"), "arquivo_local": ("file", "string"),
        "paginas": ("pages", "int"), "processado": ("processed", "boolean"), "densidade": ("density", "string"), "prioridade": ("priority", "int"), "notas": ("notes", "string"), "metadados_automaticos": ("automatic", "boolean"),
    },
}
EXTRACTION = "candidato_id string, pagina int, modelo string, relacoes array<string>, depoimentos array<string>, mencoes_sem_relacao array<string>, observacao string, erro string"


class Dataset(NamedTuple):
    """The tables.  aliases: (person, name), a row for each variant; institutions: (id, name, kind, city, period)."""

    persons: DataFrame
    relations: DataFrame
    statements: DataFrame
    sources: DataFrame
    institutions: DataFrame
    aliases: DataFrame

    def names(self) -> DataFrame:
        """(person, name): names, full names and variants, as a gazetteer takes them."""
        own = self.persons.select(F.col("id").alias("person"), F.explode(F.array_compact(F.array("name", "full_name"))).alias("name"))
        return own.unionAll(self.aliases)


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(kind)) for k, (_, kind) in KEYS[table].items()])


def _table(spark: SparkSession, root: str, table: str) -> DataFrame:
    rows = jsonl.read(spark, f"{root}/{FILES[table]}", raw_schema(table))
    return rows.select(*(F.col(f"`{k}`").alias(name) for k, (name, _) in KEYS[table].items()))


def raw_lines(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(id, value) of a table's lines as they stand, for rules on their keys."""
    path = f"{root}/{FILES[table]}"
    lines = spark.read.text(path) if jsonl.exists(spark, path) else spark.createDataFrame([], "value string")
    return lines.where(F.trim("value") != "").select(F.get_json_object("value", "$.id").alias("id"), "value")


def load(spark: SparkSession, root: str) -> Dataset:
    """All tables of the folder; files that are missing are empty tables."""
    persons, relations, statements, sources = (_table(spark, root, t) for t in ("persons", "relations", "statements", "sources"))
    none = F.array().cast("array<string>")
    named = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), none)
    persons = persons.withColumns({"source_ids": F.coalesce("source_ids", none), "activities": named("activity", "nome"), "educations": named("education", "instituicao"), "n_sources": F.size(F.coalesce("source_ids", none))})
    refs = F.coalesce("references", F.array().cast(f"array<{_REFERENCE}>"))
    ids = F.filter(F.array_distinct(F.transform(refs, lambda x: x["fonte"])), lambda x: F.coalesce(x, F.lit("")) != "")
    relations = relations.withColumns(
        {
            "symmetric": F.coalesce("symmetric", F.lit(False)), "sources": F.array_sort(ids), "source_ids": named("references", "fonte"), "pages": named("references", "pagina"), "n_sources": F.size(ids).cast("long"),
            "evidence": F.size(refs), "excerpt_chars": F.coalesce(F.array_max(F.transform(refs, lambda x: F.length(x["trecho"]))), F.lit(0)),
        }
    )
    statements = statements.withColumns({"source": F.col("reference.fonte"), "page": F.col("reference.pagina")})
    sources = sources.withColumns({"type": F.coalesce("type", F.lit("outro")), "processed": F.coalesce("processed", F.lit(False))})
    inst = [tuple(x.get(k) for k in ("id", "nome", "tipo", "cidade", "periodo")) for x in documents.read_yaml(spark, f"{root}/{FILES['institutions']}") or []]
    aliases = [(k, str(v)) for k, vs in (documents.read_yaml(spark, f"{root}/{FILES['aliases']}") or {}).items() for v in vs or []]
    return Dataset(persons, relations, statements, sources, spark.createDataFrame(inst, "id string, name string, kind string, city string, period string"), spark.createDataFrame(aliases, "person string, name string"))


def lexicon(spark: SparkSession, root: str) -> DataFrame:
    """(grp, type, pattern): the regular expressions of the folder's lexicon by group; a group may suggest a type or none."""
    groups = documents.read_yaml(spark, f"{root}/{FILES['lexicon']}") or {}
    rows = [(str(g), spec.get("tipo_sugerido"), str(p)) for g, spec in groups.items() for p in (spec or {}).get("padroes") or []]
    return spark.createDataFrame(rows, "grp string, type string, pattern string")


def common_words(spark: SparkSession, root: str) -> list[str]:
    """Words that make no name, normalised; the engine's own where the folder has no list."""
    words = documents.read_yaml(spark, f"{root}/{COMMON_WORDS}")
    return V.NOT_NAMES if words is None else sorted({str(w) for w in words})


def save(dataset_rows: DataFrame, table: str, path: str) -> None:
    """A table's rows as a folder of JSON Lines under the keys of the format."""
    jsonl.write(dataset_rows.select(*(F.col(name).alias(k) for k, (name, _) in KEYS[table].items())), path)


def extractions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all work/<source>/extraidos.jsonl, with the folder's name as source."""
    path = f"{root}/work/*/extraidos.jsonl"
    if not jsonl.exists(spark, path):
        return spark.createDataFrame([], EXTRACTION + ", source string")
    rows = spark.read.schema(EXTRACTION).json(path)
    return rows.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
