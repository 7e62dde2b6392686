"""Fuzzy line deduplication.

A line's normal form is its sequence of words (runs of ASCII letters and digits
and of anything beyond ASCII), lower-cased.  Lines of equal normal form are one
class.  Two classes are alike if 1 - edit distance / longer length of their normal
forms is at least ``SIMILARITY``.  Of each connected group of lines the occurrence
of the smallest (doc_id, line) stays and all others go.

Candidates come from pigeonhole blocks.  A line is cut into 2 or 3 parts (by its
number of words); where fewer changes than parts were made, some part is unchanged,
counted from the line's start or from its end, and keys a table.  Parts are of
sizes that lines of nearly equal length share, so words that are added or lost
don't matter.  Lines of few words also have parts counted in characters.

1. In every table each class is compared with the hub, its most central one.
2. Classes of a table that are not connected then are compared with each other, in
   tiles over tasks.

Lengths, and counts of the pairs of neighbouring characters, rule pairs out before
their texts are fetched and their edit distance is computed.  They do so by a bound,
never by guess: one changed character takes away or adds at most two such pairs.

Blocks of the whole SimHash can't be the tables: one changed word moves a line's
fingerprint by 5 to 15 of 64 bits, and blocks that bridge this hold 3 bits.

Defined results: lines without words (blank lines, rulers) stay.  Null texts stay
null, and lines of rows with a null id take no part.  A text all of whose lines
go becomes empty.  Very long texts and lines count whole.  Rows that repeat an id
count as one document: a line of the same number and content is one occurrence,
kept or removed in each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import kernels as K
from linkloom.llm.common import Batches, cut, map_arrow
from linkloom.llm.components import connected
from linkloom.llm.tiles import hub_pairs, hubbed, mixed_groups, tiles

SIMILARITY = 0.85
#: Counts of character pairs of a line, four bits each, in BAGS longs.
BAGS, BUCKETS, FULL = 4, 64, 15
#: Words from which a line has 2 and 3 parts in words; below FEW_WORDS it has two in characters (too).
PARTS = {4: 2, 12: 3}
FEW_WORDS = 8
SLICE = 1 << 17
ROWS_PER_TASK = 100_000
U64 = np.uint64

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Sizes of parts: each about a third above the one before.
_SIZES = [1]
while _SIZES[-1] < 1 << 40:
    _SIZES.append(max(_SIZES[-1] + 1, _SIZES[-1] * 4 // 3))
_SIZES = np.array(_SIZES)


def _size(n: np.ndarray) -> np.ndarray:
    """The largest part size that n holds."""
    return _SIZES[np.maximum(np.searchsorted(_SIZES, n, side="right") - 1, 0)]


def _lines(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, K.Words]:
    """For every line with words: its text, number and hash; the words' hashes, the positions of its words, the words."""
    low = K.LOWER[s.codes]
    w = K.words(low, s.bounds, _SEPARATOR)
    h = K.span_hashes(low, w.starts, w.ends)
    breaks = np.flatnonzero(s.codes == 10)
    before = np.searchsorted(breaks, s.bounds[:-1])
    line = np.searchsorted(breaks, w.starts) - before[w.text]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (w.text[1:] != w.text[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    first = np.append(at, len(h))
    return w.text[at], line[at], K.sequence_hashes(h, first), h, first, w


def bags(low: np.ndarray, w: K.Words, first: np.ndarray) -> np.ndarray:
    """For each line how often pairs of neighbouring characters of its normal form fall in each bucket, up to FULL; a row of longs."""
    n = len(first) - 1
    begins = np.zeros(len(low), dtype=bool)
    begins[w.starts] = True
    at = np.flatnonzero(~_SEPARATOR[low] & ((low & 0xC0) != 0x80))  # where characters of words begin
    unit = low[at].astype(np.uint32)
    wide = np.flatnonzero(unit >= 128)
    wide = wide[at[wide] + 1 < len(low)]
    unit[wide] += low[at[wide] + 1].astype(np.uint32) << np.uint32(8)
    opens = np.flatnonzero(begins[at])  # the first characters of words, of lines, and of the other words
    starts, gaps = opens[first[:-1]], np.delete(opens, first[:-1])
    before = np.empty_like(unit)
    before[1:], before[:1] = unit[:-1], 0
    ends = before[gaps]
    before[gaps] = 32
    bucket = lambda x, y: ((x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77)) >> np.uint32(20)) & np.uint32(BUCKETS - 1)
    lines = np.arange(n, dtype=np.int64) * BUCKETS
    pairs = np.repeat(lines, np.diff(np.append(starts, len(at)))) + bucket(before, unit)
    counts = np.bincount(pairs, minlength=n * BUCKETS)
    counts -= np.bincount(pairs[starts], minlength=n * BUCKETS)  # nothing is before a line
    counts += np.bincount(np.repeat(lines, np.diff(first) - 1) + bucket(ends, np.full(1, 32, dtype=np.uint32)), minlength=n * BUCKETS)
    counts = np.minimum(counts, FULL).astype(np.uint8).reshape(n, BUCKETS)
    return np.ascontiguousarray(counts[:, 0::2] | counts[:, 1::2] << 4).view(np.uint64)


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a prefix sum of terms times powers; kind tells tables apart."""
    sums = (prefix[end] - prefix[start]) * K.powers(inverse=True, n=len(prefix))[start]
    return K.mix(sums + (end - start).astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F) + kind * U64(0x632BE59BD9B4E019))


def _prefix(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(len(terms) + 1, dtype=np.uint64)
    np.cumsum(terms * K.powers(inverse=False, n=len(terms)), out=out[1:])
    return out


def part_keys(low: np.ndarray, w: K.Words, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table keys of lines, line by line, and where each line's begin.  Lines whose lengths differ by two words, or in
    short lines by the characters that SIMILARITY lets differ, have parts of a common size."""
    n = np.diff(first)
    lines, keys = [], []

    def emit(at: np.ndarray, prefix: np.ndarray, begin: np.ndarray, length: np.ndarray, size: np.ndarray, part: np.ndarray, kind: int) -> None:
        for side, start in ((0, begin + part * size), (1, begin + length - (part + 1) * size)):
            lines.append(at)
            keys.append(_spans(prefix, start, start + size, (2 * part + side).astype(np.uint64) * U64(2) + U64(kind)))

    of_words, size0, parts0 = _prefix(h), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for more in range(3):
        parts = np.where(n >= min(PARTS), np.array([1, *PARTS.values()])[np.searchsorted([*PARTS], n + more, side="right")], 1)
        size = _size((n + more) // parts)
        at = np.repeat(np.arange(len(n)), parts - 1)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1)
        new = (size[at] != size0[at]) | (part >= parts0[at] - 1)
        at, part = at[new], part[new]
        emit(at, of_words, first[at], n[at], size[at], part, 0)
        size0, parts0 = size, parts
    few = np.flatnonzero(n < FEW_WORDS)
    if len(few):
        # the characters of their words, end to end
        words = np.repeat(n < FEW_WORDS, n)
        edge = np.zeros(len(low) + 1, dtype=np.int8)
        edge[w.starts[words]] += 1
        edge[w.ends[words]] -= 1
        codes = low[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        length = np.add.reduceat(w.ends - w.starts, first[:-1])[few]
        begin = np.cumsum(length) - length
        of_bytes, last = _prefix(K.mix(codes.astype(np.uint64) + U64(1))), 0 * length
        room = (length / SIMILARITY - length).astype(np.int64) + 1
        for more in (0 * room, room // 2, room):
            size = np.minimum(_size((length + more) // 2), length)
            at = np.flatnonzero((size != last) & (length >= 6))
            emit(few[at], of_bytes, begin[at], length[at], size[at], 0 * at, 1)
            last = size
    line, key = np.concatenate(lines), np.concatenate(keys)
    order = np.argsort(line, kind="stable")
    return key[order], np.searchsorted(line[order], np.arange(len(n) + 1))


def _length(low: np.ndarray, w: K.Words, first: np.ndarray) -> np.ndarray:
    """Characters of each line's normal form."""
    lead = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum((low & 0xC0) != 0x80, out=lead[1:])
    return np.add.reduceat(lead[w.ends] - lead[w.starts], first[:-1]) + np.diff(first) - 1


def _occurrences(batches: Batches) -> Batches:
    """(doc_id, line, node, bag0.., chars, keys) of every line with words."""
    for batch in batches:
        ids = batch.column("doc_id")
        for s in K.slices(batch.column("text"), SLICE):
            text, line, node, h, first, w = _lines(s)
            if not len(text):
                continue
            low = K.LOWER[s.codes]
            bag = bags(low, w, first)
            keys, at = part_keys(low, w, h, first)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
            columns = [ids.take(pa.array(text + s.first)), pa.array(line, pa.int64()), pa.array(node.view(np.int64)), *(pa.array(bag[:, i].view(np.int64)) for i in range(BAGS)), pa.array(_length(low, w, first), pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "node", *_bag(""), "chars", "keys"])


def _bag(side: str) -> list[str]:
    return [f"bag{i}{side}" for i in range(BAGS)]


def _of(rows, side: str = "") -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in _bag(side)], axis=1)


def may_be_alike(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether bags (rows of longs) and lengths leave it open that two lines are alike; no alike pair is ruled out."""
    longer = np.maximum(la, lb)
    x, y = (np.ascontiguousarray(m).view(np.uint8).reshape(len(m), 8 * BAGS) for m in (a, b))
    more = np.zeros((2, len(longer)), dtype=np.int64)
    for shift in (0, 4):
        d = (x >> shift & 15).astype(np.int8) - (y >> shift & 15).astype(np.int8)
        more += np.stack([np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)])
    return (np.minimum(la, lb) >= SIMILARITY * longer) & (more.max(axis=0) <= 2 * ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64))


def _open_pairs(batches: Batches) -> Batches:
    for batch in batches:
        ok = may_be_alike(_of(batch, "a"), _of(batch, "b"), batch.column("charsa").to_numpy(), batch.column("charsb").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; common ends are cut off, the rest goes through Myers' bit vectors.

    Given most, anything above it may come back as most + 1.
    """
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    most = len(b) if most is None else most
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, room = full, 0, len(a), most + len(b)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        h_up, h_down = down | ~(d | up) & full, up & d
        score += bool(h_up & top) - bool(h_down & top)
        room -= 1
        if score > room:  # the score falls by at most one a character
            return most + 1
        h_up = (h_up << 1 | 1) & full
        up, down = (h_down << 1) & full | ~(x | h_up) & full, h_up & x
    return score


def similar(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < SIMILARITY * longer:
        return not longer
    return 1 - edit_distance(a, b, int((1 - SIMILARITY) * longer + 1e-9)) / longer >= SIMILARITY


def _verify(batches: Batches) -> Batches:
    for batch in batches:
        ok = [similar(x, y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _compare(node: list[int], comp: list[int], side: np.ndarray, own: bool, bag: np.ndarray, chars: np.ndarray, forms: list[str]) -> list[tuple[int, int]]:
    """Links between the two blocks of a tile (or within one, own) that join different components."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
    place: dict[int, int] = {c: c for c in comp}

    def top(c: int) -> int:
        while place[c] != c:
            place[c] = place[place[c]]
            c = place[c]
        return c

    out = []
    for k, i in enumerate(left.tolist()):
        rest = right[k + 1 :] if own else right
        for j in rest[may_be_alike(bag[rest], bag[i : i + 1], chars[rest], chars[i : i + 1])].tolist():
            p, q = top(comp[i]), top(comp[j])
            if p != q and similar(forms[i], forms[j]):
                place[max(p, q)] = min(p, q)
                out.append((node[i], node[j]))
    return out


def _compare_tiles(batches: Batches) -> Batches:
    """Links of the tiles of a partition, whose rows stand together; one tile at a time is held."""
    pend: pa.Table | None = None

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        if not rows.num_rows:
            return []
        code = [rows[c].to_numpy() for c in ("group", "p", "q")]
        edge = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in code], axis=0), True])
        node, comp, forms = (rows[c].to_pylist() for c in ("node", "comp", "form"))
        side, chars, bag = rows["side"].to_numpy(), rows["chars"].to_numpy(), _of(rows)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out += _compare(node[a:b], comp[a:b], side[a:b], code[1][a] == code[2][a], bag[a:b], chars[a:b], forms[a:b])
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if pend is None else pa.concat_tables([pend, pa.Table.from_batches([batch])])
        last = [rows[c][-1].as_py() for c in ("group", "p", "q")]
        mine = np.all([rows[c].to_numpy() == x for c, x in zip(("group", "p", "q"), last, strict=True)], axis=0)
        cut_at = int(np.argmax(mine))  # the last tile may go on in the next batch
        yield batch_of(links(rows.slice(0, cut_at)))
        pend = rows.slice(cut_at).combine_chunks()
    if pend is not None:
        yield batch_of(links(pend))


def _line_texts(batches: Batches) -> Batches:
    """(node, normal form) of the lines wanted from each text."""
    for batch in batches:
        lines, want = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            parts = (text or "").split("\n")
            for x in wanted:
                if x["line"] < len(parts):
                    lines.append(parts[x["line"]])
                    want.append(x["node"])
        nodes, forms = [], []
        for s in K.slices(pa.array(lines, pa.string()), SLICE):
            text, _, node, _, first, w = _lines(s)
            low = K.LOWER[s.codes].tobytes()
            for i, (t, got) in enumerate(zip(text.tolist(), node.view(np.int64).tolist(), strict=True)):
                if want[s.first + t] == got:
                    nodes.append(got)
                    forms.append(" ".join(low[w.starts[k] : w.ends[k]].decode("utf-8", "replace") for k in range(first[i], first[i + 1])))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(forms, pa.string())], names=["node", "form"])


def _forms(nodes: DataFrame, source: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, form) of classes, from the texts of their kept occurrences."""
    wanted = classes.join(nodes, "node", "left_semi").groupBy(F.col("occurrence.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("occurrence.line").alias("line"), "node")).alias("wanted"))
    return cut(map_arrow(source.join(wanted, "doc_id").select("text", "wanted"), _line_texts, "node long, form string").dropDuplicates(["node"]))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, gone: the lines (line, node) to remove from each document that loses any; lines count from 0."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    lines = cut(map_arrow(source, _occurrences, "doc_id long, line long, node long, " + ", ".join(f"{b} long" for b in _bag("")) + ", chars int, keys array<long>"))
    one = lambda c: F.min(c).alias(c)
    classes = cut(lines.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("occurrence"), F.count("*").alias("n"), *map(one, _bag("")), one("chars"), F.first("keys").alias("keys")))
    met, hubs = hubbed(classes.select(F.explode("keys").alias("group"), "node"))
    prints = classes.select("node", "chars", *_bag(""))
    pa_, pb_ = (prints.toDF(x, f"chars{x}", *_bag(x)) for x in "ab")
    pairs = cut(map_arrow(hub_pairs(met, hubs).join(pa_, "a").join(pb_, "b"), _open_pairs, "a long, b long"))
    forms = _forms(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), source, classes)
    ta, tb = forms.toDF("a", "ta"), forms.toDF("b", "tb")
    links = cut(map_arrow(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb"), _verify, "a long, b long"))
    comps = connected(links)
    # hubs have been compared with all of their tables
    rest = met.join(hubs, "group").where("node <> a").join(comps, "node", "left").select("group", "node", F.coalesce("comp", "node").alias("comp"))
    members = cut(mixed_groups(rest))
    if members.limit(1).count():
        more = _forms(members.select("node").distinct(), source, classes).join(prints, "node")
        n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // ROWS_PER_TASK))
        work = tiles(members).join(more, "node").repartition(n, "group", "p", "q").sortWithinPartitions("group", "p", "q")
        links = cut(links.unionAll(map_arrow(work, _compare_tiles, "a long, b long")))
        comps = connected(links)
    grouped = classes.join(comps, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    first = grouped.groupBy("group").agg(F.min("occurrence").alias("first"), F.sum("n").alias("all")).where("all > 1")
    doubled = grouped.select("node", "group").join(first.select("group", "first"), "group").select("node", "first")
    gone = lines.select("doc_id", "line", "node").join(doubled, "node").where("not (doc_id = first.doc_id and line = first.line)")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line", "node"))).alias("gone"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (numbers from 0) of every document with an id."""
    lost, t = removals(docs, doc_id, text), F.coalesce(F.col(text).cast("string"), F.lit(""))
    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    numbers = F.transform(F.coalesce("gone", F.array().cast("array<struct<line:bigint,node:bigint>>")), lambda x: x["line"])
    return counted.where("doc_id is not null").join(lost, "doc_id", "left").select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed_lines"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of their texts; other columns stay as they are."""
    lost = removals(docs, doc_id, text).withColumnRenamed("doc_id", "__id").withColumnRenamed("gone", "__gone")
    joined = docs.join(lost, docs[doc_id].cast("long") == F.col("__id"), "left")
    names = docs.columns
    at = names.index(text)
    schema = T.StructType(docs.schema.fields[:at] + [T.StructField(text, T.StringType())] + docs.schema.fields[at + 1 :])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            old = batch.column(text).cast(pa.string())
            gone = batch.column("__gone").to_pylist()
            if any(gone):
                new = old.to_pylist()
                touched = [i for i, g in enumerate(gone) if g and new[i] is not None]
                for s in K.slices(old.take(pa.array(touched, pa.int64())), SLICE):
                    t, line, h, _, _, _ = _lines(s)
                    have = dict(zip(zip(t.tolist(), line.tolist(), strict=True), h.view(np.int64).tolist(), strict=True))
                    for k in range(len(s.bounds) - 1):
                        i = touched[s.first + k]
                        drop = {x["line"] for x in gone[i] if have.get((k, x["line"])) == x["node"]}
                        new[i] = "\n".join(x for n, x in enumerate(new[i].split("\n")) if n not in drop)
                old = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([old if n == text else batch.column(n) for n in names], names=names)

    return map_arrow(joined.select(*(docs[c] for c in docs.columns), "__gone"), run, schema)
