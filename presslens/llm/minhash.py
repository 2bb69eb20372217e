"""Near-duplicate texts by weighted minwise hashing with darts.

A document is a weighted set: its runs of five words (lower case, cut at white space), each
weighing as often as it occurs. A run that occurs three times has three cells; every cell
is thrown hashed darts at, in the order of their rank (a random, exponentially growing
number), each at one of the signature's coordinates. The dart with the lowest rank that hits
a coordinate is its value. Two documents share a value with the probability of their
weighted Jaccard similarity. Only darts up to a rank that fills all coordinates are thrown,
about t ln t of them whatever the length of the text.

Equal word sequences are one class first; its smallest row stands for it. Representatives
that share all values of a band are candidates: each band bucket links its rows to its
smallest one (a star, never pairs), and the components of these links are compared exactly
by their cells:

* in blocks of bounded size, with an inverted index of the block; a document already in the
  group of another one is not compared with it again. A component of one block is then done.
  About ``PIVOTS`` rows of a component that has several blocks stand in each of them, which
  joins the blocks' groups;
* across the blocks of one component, the documents outside its largest group meet all
  blocks, in chunks of bounded size. Two documents of the largest group need no comparison.

Every pair of a component that could still join two groups is compared, so groups depend on
similarity alone. A pair of similarity s is missed by the bands with probability
(1 - s**6)**28: 2e-4 at 0.8, 1e-9 at 0.9.

Null and empty texts are equal to each other and similar to nothing else; a text of one to
four words is a single run. Rows with one id are documents of their own. The class id is the
smallest id in the class (null only if all are); one row of a class has ``kept``, that
with the smallest id (then the first of the table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from presslens.llm.bloom import id_key, texts_of
from presslens.llm.common import matching_rows, row_slices, stored, text_or_empty
from presslens.llm.components import components

_U = np.uint64
WORDS, BANDS, ROWS = 5, 28, 6
PIVOTS = 16
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"factor", i) | 1 for i in range(WORDS)], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_lists(texts: list[str]) -> list[list[bytes]]:
    return [t.lower().encode().split() for t in texts]


def cells(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all cells of each document in a row, and where those of each document start (and the end)."""
    known = _Hashes()
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((known[x] for w in words for x in w), _U, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    runs = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first - starts[:-1], runs) + np.arange(starts[-1])
    length = np.repeat(np.minimum(sizes, WORDS), runs)
    run = length.astype(_U)
    padded = np.append(h, np.zeros(WORDS, _U))
    for i in range(WORDS):
        run += np.where(i < length, padded[at + i] * _FACTORS[i], _U(0))
    run = _mixed(run)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        run[a:b].sort()
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    new[starts[:-1][runs > 0]] = True
    place = np.arange(len(run))
    copy = place - np.maximum.accumulate(np.where(new, place, 0)) if len(run) else place
    return _mixed(run + copy.astype(_U) * _U(0x9E3779B97F4A7C15)), starts


def dart_signatures(cell: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """Signature (t values) of each document with cells; zeros for the others."""
    weight = np.diff(starts)
    out = np.zeros((len(weight), t), _U)
    todo, margin = np.flatnonzero(weight), 3.0
    while len(todo):
        w = weight[todo]
        upto = np.concatenate([[0], np.cumsum(w)])
        own = cell[np.repeat(starts[todo] - upto[:-1], w) + np.arange(upto[-1])]
        doc = np.repeat(np.arange(len(todo)), w)
        limit = (t * (np.log(t) + margin) / w)[doc]
        best = np.full(len(todo) * t, np.inf)
        value = np.zeros(len(todo) * t, _U)
        rank, number = np.zeros(len(own)), 0
        while len(own):
            number += 1
            dart = _mixed(own + _U(number * 0xD1342543DE82EF95 % (1 << 64)))
            rank = rank - np.log(((dart >> _U(11)).astype(float) + 0.5) / (1 << 53))
            hit = rank <= limit
            own, doc, limit, rank, dart = own[hit], doc[hit], limit[hit], rank[hit], dart[hit]
            name = _mixed(dart + _U(1))
            at = doc * t + (name % _U(t)).astype(np.int64)
            np.minimum.at(best, at, rank)
            lowest = rank == best[at]
            value[at[lowest]] = name[lowest]
        full = np.isfinite(best).reshape(-1, t).all(axis=1)
        out[todo[full]] = value.reshape(-1, t)[full]
        todo, margin = todo[~full], margin * 2
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the word sequence (two halves) and the band keys of each text."""
    for batch in row_slices(batches):
        words = word_lists(batch.column(1).to_pylist())
        cell, starts = cells(words)
        values = dart_signatures(cell, starts, BANDS * ROWS).reshape(len(words), BANDS, ROWS)
        keys = np.repeat(np.arange(1, BANDS + 1, dtype=_U)[None, :], len(words), axis=0)
        for i in range(ROWS):
            keys = _mixed(keys * _U(0x9E3779B97F4A7C15) + values[:, :, i])
        whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), "<i8").reshape(-1, 2)
        lengths = np.where(np.diff(starts) > 0, BANDS, 0)
        flat = keys[np.diff(starts) > 0].reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), batch.column(3), pa.array(whole[:, 0]), pa.array(whole[:, 1]),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, pa.int64()))], ["row", "doc_id", "text_hash", "w1", "w2", "bands"])


def _with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches):
        cell, starts = cells(word_lists(batch.column(1).to_pylist()))
        packed = [cell[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["row", "part", "cells"])


class _Block:
    """Documents of a block with an inverted index of their cells."""

    def __init__(self, packed: list[bytes], least: float):
        self.least = least
        self.size = np.array([len(p) >> 3 for p in packed], np.int64)
        known, self.cell = np.unique(np.frombuffer(b"".join(packed), _U), return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        order = np.argsort(self.cell, kind="stable")
        self.docs = np.repeat(np.arange(len(packed)), self.size)[order]
        self.begin = np.searchsorted(self.cell[order], np.arange(len(known) + 1))

    def similar(self, i: int) -> np.ndarray:
        """Documents at least as similar to document i as asked."""
        own = self.cell[self.first[i]:self.first[i + 1]]
        begin, many = self.begin[own], self.begin[own + 1] - self.begin[own]
        upto = np.cumsum(many)
        met = self.docs[np.repeat(begin - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        common = np.bincount(met, minlength=len(self.size))
        return np.flatnonzero(common >= self.least * (self.size + self.size[i] - common) - 1e-9)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, work: Callable) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each key; a task's rows are sorted by the first ``keys`` columns, of which the third goes to the links."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield from _edges(work(held), now[2])
                held, now = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield from _edges(work(held), now[2])


def _edges(pairs: list[tuple[int, int]], mark: int) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "mark": pa.array([mark] * len(a), pa.int64())})


def _merge(group: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Joins the groups of ``others`` to that of i; one of ``others`` for each group that was another."""
    foreign, at = np.unique(group[others], return_index=True)
    new = foreign != group[i]
    group[np.isin(group, foreign[new])] = group[i]
    return others[at[new]].tolist()


def _inside(least: float):
    """Links of the documents of a block to the smallest row of their group in it. Rows: (row, cells)."""
    def work(rows: list) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())  # a row equal in id and text may come twice
        ids, block = np.array([r[0] for r in rows]), _Block([r[1] for r in rows], least)
        group, waiting = np.arange(len(ids)), np.ones(len(ids), bool)
        while True:
            open_ = np.flatnonzero(waiting)
            if not len(open_) or (group[open_] == group[open_[0]]).all():
                break  # all pairs of documents in different groups have been compared
            sizes = np.bincount(group, minlength=len(ids))
            i = int(open_[np.argmin(sizes[group[open_]])])
            waiting[i] = False
            _merge(group, i, block.similar(i))
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, ids)
        own = smallest[group]
        return [(a, b) for a, b in zip(ids.tolist(), own.tolist(), strict=True) if a != b]
    return lambda batches: _grouped(batches, 3, work)


def _across(least: float):
    """Links between the groups of documents outside their component's largest group and of the rows of a block. Rows: (row, group, outside, cells)."""
    def work(rows: list) -> list[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        names, block = [r[1] for r in rows], _Block([r[3] for r in rows], least)
        group, out = np.unique(np.array(names), return_inverse=True)[1], []
        for i in [k for k, r in enumerate(rows) if r[2]]:
            out += [(names[i], names[j]) for j in _merge(group, i, block.similar(i))]
        return out
    return lambda batches: _grouped(batches, 3, work)


def _candidate_parts(bands: DataFrame) -> DataFrame:
    """(row, part): components of the rows that share a band bucket; rows alone are left out."""
    keyed = bands.select("row", F.explode("bands").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "buckets")
    stars = keyed.join(buckets, "key").filter("row != least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    return components(stars).select(F.col("node").alias("row"), F.col("component").alias("part"))


def _large_parts(placed: DataFrame, links: DataFrame, least: float, block_rows: int) -> DataFrame:
    """(node, component) of the rows of parts that have several blocks, whose links inside the blocks are given.

    Who is outside the largest group of a part meets every block; that links whole groups.
    """
    group = components(links).select(F.col("node").alias("row"), F.col("component").alias("group"))
    rows = stored(placed.filter("blocks > 1").join(stored(group, "groups"), "row", "left").withColumn("group", F.coalesce("group", "row")), "large")
    counts = rows.groupBy("part", "blocks", "group").count()
    most = counts.groupBy("part", "blocks").agg(F.max_by("group", F.struct("count", "group")).alias("main"), (F.sum("count") - F.max("count")).alias("outside"))
    most = stored(most.select("part", "main", F.ceil(F.col("outside") / block_rows).cast("long").alias("chunks")).filter("chunks > 0"), "most")
    known = rows.join(most, "part")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = known.select("part", "block", each("chunks").alias("chunk"), "row", "group", F.lit(False).alias("outside"), "cells")
    outside = known.filter("group != main").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")))
    outside = outside.select("part", each("blocks").alias("block"), "chunk", "row", "group", F.lit(True).alias("outside"), "cells")
    met = base.unionByName(outside).repartition("part", "block", "chunk").sortWithinPartitions("part", "block", "chunk")
    between = components(stored(met.mapInArrow(_across(least), "a long, b long, mark long"), "between")).withColumnRenamed("component", "whole")
    return rows.select("row", "group").join(between, F.col("group") == F.col("node"), "left").select(
        F.col("row").alias("node"), F.coalesce("whole", "group").alias("component"))


def near_groups(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1000) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, text_hash."""
    text = text_or_empty(text_col)
    table = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    kind = dict(table.dtypes)["doc_id"]
    signed = stored(table.mapInArrow(_signed, f"row long, doc_id {kind}, text_hash long, w1 long, w2 long, bands array<long>"), "signatures")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash"))
    classes = stored(signed.groupBy("w1", "w2").agg(smallest.alias("m"), F.count("*").alias("many")).select("w1", "w2", "many", "m.*"), "classes")
    parts = stored(_candidate_parts(signed.select("row", "bands").join(classes.select("row"), "row", "left_semi")), "parts")
    asked = stored(parts.join(classes, "row").select("row", "part", id_key("doc_id"), "text_hash"), "asked")
    texts = texts_of(table.withColumn("doc_id_key", id_key("doc_id")), asked).join(asked, ["doc_id_key", "text_hash"])
    packed = stored(texts.select("row", "text", "part").mapInArrow(_with_cells, "row long, part long, cells binary"), "cells")
    blocks = stored(packed.groupBy("part").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")), "blocks")
    placed = packed.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    # some rows of a large part stand in all its blocks and tie their groups together
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("row", F.lit(2)), F.ceil(F.col("rows") / PIVOTS)) == 0)
    everywhere = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    sorted_blocks = placed.select("part", F.explode(everywhere).alias("block"), "blocks", "row", "cells").repartition("part", "block").sortWithinPartitions("part", "block")
    links = stored(sorted_blocks.mapInArrow(_inside(least), "a long, b long, mark long"), "links")  # mark: blocks of the part
    joined = links.filter("mark = 1").select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not blocks.filter("blocks > 1").isEmpty():
        joined = joined.unionByName(_large_parts(placed, links.filter("mark > 1"), least, block_rows))
    joined = stored(joined, "components")
    labelled = classes.join(joined, classes["row"] == joined["node"], "left").withColumn("label", F.coalesce("component", "row"))
    labelled = stored(labelled.select("w1", "w2", "label", "many", "no_id", "doc_id", "row"), "labelled")
    best = stored(labelled.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("best"), F.sum("many").alias("class_size")), "best")
    known = stored(labelled.join(best, "label").select("w1", "w2", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("class_row"), "class_size"), "known")
    return signed.join(known, ["w1", "w2"]).select("doc_id", "class_id", "class_size", (F.col("row") == F.col("class_row")).alias("kept"), "text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, all columns kept."""
    kept = near_groups(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select("doc_id", "text_hash")
    return matching_rows(docs, stored(kept, "kept"), id_col, text_col)
