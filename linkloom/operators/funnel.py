"""The text funnel: from blocks over chunks and matches to scored candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from re import _parser as sre

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from linkloom.functions import vocab as V

from linkloom.functions import text as X

#: Patterns that a lexicon may hold: they become part of the plan.
MOST_PATTERNS = 5000
#: Phrases of a gazetteer that tasks may hold, some 40 MB; a larger one is dealt.
MOST_PHRASES = 200_000
#: First words of a gazetteer's phrases for which a text is searched before its words go to the tasks' Python.
MOST_HEADS = 32
#: The lexicon's group of statements, which tell of no relation.
STATEMENTS = "depoimento"


def merge_blocks(blocks: DataFrame, group: str = "doc_id", order: str = "idx", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks that a page broke joined into paragraphs: (group, first, text), with columns that a group has once.

    A block starts a paragraph unless the one before goes on in it, which depends on the two blocks alone, so
    paragraphs are islands of a running count.
    """
    w = Window.partitionBy(group).orderBy(order)
    start = F.when(F.coalesce(X.continues(F.lag(text).over(w), F.col(text)), F.lit(False)), 0).otherwise(1)
    island = blocks.withColumn("__start", start).withColumn("__n", F.sum("__start").over(w))
    parts = island.groupBy(group, "__n", *carry).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(group, *carry, F.col("first").cast("long").alias("first"), F.array_join(F.transform("p", lambda s: s[text]), " ").alias("text"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, source, first, text): cleaned blocks (doc_id, source, idx, block), empty ones dropped, broken ones merged."""
    cleaned = X.fixed(blocks, "doc_id", "idx", "source", text=X.clean(F.col("block"))).where("text <> ''")
    return merge_blocks(cleaned, carry=("source",))


def chunks(blocks: DataFrame, min_chars: int = 40) -> DataFrame:
    """Paragraphs that are long enough and no noise, numbered within their page: (chunk_id, doc_id, idx, paragraph, source, text)."""
    kept = paragraphs(blocks).where((F.length("text") >= min_chars) & ~X.is_noise(F.col("text")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return kept.select(F.concat_ws("-", "doc_id", "first").alias("chunk_id"), "doc_id", F.col("first").alias("idx"), number.alias("paragraph"), "source", "text")


def gazetteer(names: DataFrame) -> DataFrame:
    """(phrase, n_words, persons): all names and variants (person, name) as words, with the persons that each stands for."""
    phrase = F.trim(X.tokens_padded(F.col("name")))
    return names.select("person", phrase.alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.sort_array(F.collect_set("person")).alias("persons")).withColumn("n_words", F.size(F.split("phrase", " ")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(X.tokens_padded(text)), " "), lambda x: x != "")


def _hits_schema(known: DataFrame) -> list[T.StructField]:
    persons = T.StructField("persons", known.schema["persons"].dataType)
    chosen = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), persons]))
    return [T.StructField("phrases", T.ArrayType(T.StringType())), T.StructField("chosen", chosen)]


class Automaton:
    """Phrases by their words: a tree whose nodes are words, and at its ends the phrases with their persons."""

    def __init__(self, rows: list[tuple[str, list]]):
        self.top: dict = {}
        for phrase, persons in rows:
            node = self.top
            for word in phrase.split(" "):
                node = node.setdefault(word, {})
            node[""] = (phrase, persons)  # no word is empty

    def find(self, words: list[str]) -> tuple[list[str], list[tuple[str, list]]]:
        """All distinct phrases by place, the longest first, and those that stand when each takes its words, from the left."""
        seen, chosen, end = {}, [], 0
        for i, word in enumerate(words):
            node = self.top.get(word)
            if node is None:
                continue
            met, k = [], i
            while node is not None:
                k += 1
                if "" in node:
                    met.append((k, node[""]))
                node = node.get(words[k]) if k < len(words) else None
            for _, (phrase, _) in reversed(met):
                seen.setdefault(phrase)
            if met and i >= end:
                end, best = met[-1]
                chosen.append(best)
        return list(seen), chosen


def _hit(known: DataFrame, rows: list[tuple[str, list]], norm: Column) -> Column:
    """The struct (phrases, chosen) of a normalised text: only its words go to Python, and where phrases start with few
    different words, only those of texts that hold all words that the phrases of one start share."""
    shared = known.sparkSession.sparkContext.broadcast(Automaton(rows))
    schema = T.StructType(_hits_schema(known))

    @F.arrow_udf(schema)
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        kinds = [to_arrow_type(f.dataType) for f in schema]
        for words in parts:
            phrases, chosen = [], []
            for text in words.to_pylist():
                seen, best = automaton.find(text.split()) if text else ([], [])
                phrases.append(seen)
                chosen.append([{"phrase": p, "persons": who} for p, who in best])
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((phrases, chosen), kinds, strict=True)], names=schema.names)

    text, shared_words = F.coalesce(norm, F.lit("")), {}
    for words in (p.split(" ") for p, _ in rows):
        shared_words[words[0]] = shared_words.get(words[0], set(words)) & set(words)
    if len(shared_words) > MOST_HEADS:
        return found(X.padded(text))
    some = F.lit(False)
    for words in shared_words.values():
        # the longest first: it is the rarest, mostly
        each = [F.contains(text, F.lit(w)) for w in sorted(words, key=lambda w: (-len(w), w))]
        some = some | reduce(Column.__and__, each)
    return found(F.when(some, X.padded(text)).otherwise(""))


def _hits_by_first_word(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """A word meets the phrases that it starts by an equi join, with as many words behind it as the longest of all has."""
    longest = known.agg(F.max("n_words")).first()[0] or 0
    split = X.fixed(chunks, "chunk_id", w=_words(F.col("text")))
    places = F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("head"), F.concat(F.array_join(F.slice(F.col("w"), i + 1, int(longest)), " "), F.lit(" ")).alias("run")))
    heads = known.select(F.substring_index("phrase", " ", 1).alias("head"), "phrase", "persons", F.col("n_words").alias("n"))
    met = split.where(F.lit(longest > 0)).select("chunk_id", F.inline(places)).join(heads, "head").where(F.startswith("run", F.concat("phrase", F.lit(" "))))
    order = F.struct("at", (-F.col("n")).alias("back"), "phrase", "persons")
    hits = met.groupBy("chunk_id").agg(F.sort_array(F.collect_list(order)).alias("hits"))
    none = F.array().cast(_hits_schema(known)[1].dataType)
    step = lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] - x["back"]).alias("end"), F.array_append(acc["kept"], F.struct(x["phrase"], x["persons"])).alias("kept"))).otherwise(acc)
    chosen = F.aggregate("hits", F.struct(F.lit(0).alias("end"), none.alias("kept")), step, lambda acc: acc["kept"])
    return hits.select("chunk_id", F.array_distinct(F.transform("hits", lambda x: x["phrase"])).alias("phrases"), chosen.alias("chosen"))


def name_hits(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_id, phrases, chosen): every phrase of a gazetteer in a chunk, and those that are left when matches, from
    the left and the longest first, take their words: "Ana Lima" isn't "Lima" too.

    A gazetteer of at most MOST_PHRASES phrases is sent to the tasks as one automaton; a larger one is dealt by the
    first words of its phrases.  The rows are the same.
    """
    rows = _phrases(known)
    if len(rows) > MOST_PHRASES:
        return _hits_by_first_word(chunks, known)
    made = X.fixed(chunks, "chunk_id", __norm=X.normalize(F.col("text")))
    return made.select("chunk_id", _hit(known, rows, F.col("__norm")).alias("__hit")).select("chunk_id", "__hit.*").where(F.size("phrases") > 0)


def _phrases(known: DataFrame) -> list[tuple[str, list]]:
    """The phrases of a gazetteer, one more than MOST_PHRASES at most."""
    return [(r["phrase"], r["persons"]) for r in known.select("phrase", "persons").limit(MOST_PHRASES + 1).collect()]


def _with_hits(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks with their phrases and chosen (none: empty or null), and their text normalised as __norm, in one pass where
    tasks can hold the gazetteer."""
    rows = _phrases(known)
    made = X.fixed(chunks, *chunks.columns, __norm=X.normalize(F.col("text")))
    if len(rows) <= MOST_PHRASES:
        return made.withColumn("__hit", _hit(known, rows, F.col("__norm"))).select(*made.columns, "__hit.*")
    return made.join(_hits_by_first_word(chunks, known), "chunk_id", "left")


def known_names(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_id, person, phrase), distinct."""
    each = name_hits(chunks, known).select("chunk_id", F.inline("chosen"))
    return each.select("chunk_id", F.explode("persons").alias("person"), "phrase").distinct()


def patterns(lexicon: DataFrame) -> list[tuple[str, str | None, str]]:
    """(grp, type, pattern) of a lexicon of bounded size."""
    rows = [(r["grp"], r["type"], r["pattern"]) for r in lexicon.select("grp", "type", "pattern").limit(MOST_PATTERNS + 1).collect()]
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"a lexicon of more than {MOST_PATTERNS} patterns")
    return sorted(rows, key=lambda r: (r[0], r[2]))


def needed(pattern: str) -> list[str]:
    """Texts of which each match of a regular expression holds one at least; none where nothing can be told.

    Of a sequence the part with the longest texts counts, of alternatives all.
    """

    def of(items) -> list[str]:
        best: list[str] = []
        run = ""

        def better(found: list[str]) -> None:
            nonlocal best
            if found and all(found) and (not best or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
                best = found

        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            better([run] if run else [])
            run = ""
            if op is sre.SUBPATTERN:
                better(of(arg[-1]))
            elif op is sre.BRANCH:
                each = [of(x) for x in arg[1]]
                better([t for x in each for t in x] if all(each) else [])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                better(of(arg[2]))
        better([run] if run else [])
        return best

    return sorted(set(of(sre.parse(pattern))))


def triggers(text: Column, lexicon: DataFrame, normal: bool = False) -> Column:
    """The distinct (grp, type, term) that a lexicon's regular expressions find in a text, once normalised (normal: it is).

    A text meets only the expressions of which it holds a needed part.
    """
    none = F.array().cast("array<struct<grp:string,type:string,term:string>>")

    def of(norm: Column, grp: str, kind: str | None, p: str) -> Column:
        found = F.transform(F.regexp_extract_all(norm, F.lit(p), F.lit(0)), lambda x: F.struct(F.lit(grp).alias("grp"), F.lit(kind).cast("string").alias("type"), F.trim(x).alias("term")))
        parts = needed(p)
        if not parts:
            return found
        holds = F.contains(norm, F.lit(parts[0]))
        for x in parts[1:]:
            holds = holds | F.contains(norm, F.lit(x))
        return F.when(holds, found).otherwise(none)

    rows = patterns(lexicon)
    # a variable of a lambda is worked out once, however often the expressions name it
    return F.element_at(F.transform(F.array(text if normal else X.normalize(text)), lambda norm: F.array_distinct(F.flatten(F.array(*(of(norm, *row) for row in rows))))), 1) if rows else none


def matched(chunks: DataFrame, known: DataFrame, lexicon: DataFrame, common: list[str] = V.NOT_NAMES) -> DataFrame:
    """Chunks with their known persons, unknown names and triggers; chunks that look like references are left out.

    common: capitalised words that make no name.
    """
    out = _with_hits(chunks.where(~X.is_bibliography(F.col("text"))), known)
    pairs = F.flatten(F.transform("chosen", lambda x: F.transform(x["persons"], lambda p: F.struct(p.alias("person"), x["phrase"].alias("phrase")))))
    keep = [c for c in chunks.columns if c not in ("known", "unknown", "triggers")]
    made = X.fixed(
        out, *keep, known=F.coalesce(F.array_distinct(pairs), F.array().cast(f"array<struct<person:{known.schema['persons'].dataType.elementType.simpleString()},phrase:string>>")),
        unknown=X.unknown_names(F.col("text"), F.coalesce("phrases", F.array().cast("array<string>")), common), triggers=triggers(F.col("__norm"), lexicon, normal=True),
    )
    related = F.filter("triggers", lambda t: t["grp"] != STATEMENTS)
    return made.withColumns(
        {
            "n_known": F.size(F.array_distinct(F.transform("known", lambda x: x["person"]))).cast("long"), "n_unknown": F.size("unknown").cast("long"), "n_triggers": F.size(related).cast("long"),
            "statement": F.exists("triggers", lambda t: t["grp"] == STATEMENTS), "types": F.array_sort(F.array_distinct(F.filter(F.transform(related, lambda t: t["type"]), lambda x: x.isNotNull()))),
        }
    )


def passes() -> Column:
    """A name with a trigger, a statement about a known person, or two known persons."""
    known, unknown = F.col("n_known"), F.col("n_unknown")
    return (((known + unknown) > 0) & (F.col("n_triggers") > 0)) | (F.col("statement") & (known > 0)) | (known >= 2)


def scored(matched: DataFrame) -> DataFrame:
    """Chunks that pass, with score2, twice the score: 2 a known person, 1 an unknown name, 1/2 a trigger, 2 for two known."""
    score2 = 4 * F.col("n_known") + 2 * F.col("n_unknown") + F.col("n_triggers") + F.when(F.col("n_known") >= 2, 4).otherwise(0)
    return matched.where(passes()).withColumn("score2", score2.cast("long"))


def candidates(chunks: DataFrame, known: DataFrame, lexicon: DataFrame, common: list[str] = V.NOT_NAMES) -> DataFrame:
    return scored(matched(chunks, known, lexicon, common))


def statistics(chunks: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: chunks, those that look like references, and what the others' names and triggers lack or have."""
    named, triggered, two = F.col("n_known") + F.col("n_unknown") > 0, F.col("n_triggers") > 0, F.col("n_known") >= 2
    out = matched.agg(
        F.count("*").alias("sound"), F.count_if(passes()).alias("candidates"), F.count_if(named & ~triggered & ~F.col("statement") & ~two).alias("name_without_trigger"),
        F.count_if(triggered & ~named).alias("trigger_without_name"), F.count_if(two & ~triggered).alias("pair_without_trigger"), F.count_if(passes() & F.col("statement")).alias("statements"),
    )
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(out).withColumn("bibliography", F.col("chunks") - F.col("sound"))


def with_context(chunks: DataFrame, k: int = 1) -> DataFrame:
    """Chunks with the texts of the k before and after, in order, joined by a blank."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    near = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    return chunks.withColumns({"before": near(-k, -1), "after": near(1, k)})


def localisable(chunks: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, chunk_id): chunks that hold both persons of a pair, or one of them with the other next to it.

    As in a chunk that holds one, next to a chunk with a, b counts in either of the two.
    """
    order = Window.partitionBy("doc_id").orderBy("idx")
    ranked = chunks.withColumn("pos", F.row_number().over(order))
    has = known_names(chunks, known).select("chunk_id", "person").distinct().join(ranked.select("chunk_id", "doc_id", "pos"), "chunk_id")
    a = pairs.join(has.withColumnsRenamed({"person": "a", "chunk_id": "ca", "pos": "pa"}), "a")
    b = has.select(F.col("person").alias("b"), "doc_id", F.col("chunk_id").alias("cb"), F.col("pos").alias("pb"))
    near = a.join(b, ["b", "doc_id"]).where("abs(pa - pb) <= 1")
    # the chunk of b counts, for its neighbour (or itself) has a; the chunk of a counts next to one that has both
    both = near.where("pa = pb").select("a", "b", "doc_id", F.col("pa").alias("pos"))
    beside = both.join(a.select("a", "b", "doc_id", "ca", "pa"), ["a", "b", "doc_id"]).where("abs(pa - pos) <= 1").select("a", "b", F.col("ca").alias("chunk_id"))
    return near.select("a", "b", F.col("cb").alias("chunk_id")).unionAll(beside).distinct()
