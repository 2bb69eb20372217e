"""Removal of byte strings that occur more than once, by a sparse, hash-compared suffix sort.

Task: remove every byte covered by a string of ``length`` bytes (a window) that also starts
anywhere else, in the same document or another one.

Every window has an anchor: of its substrings of ``length`` // 3 bytes the one with the lowest
hash, the last such. Equal windows have equal anchors at equal places, so only windows that
share an anchor need comparing. Windows next to each other mostly have one anchor in common;
such a run is one row (about one for every 130 bytes), with a hash of the anchor and one of all
bytes that its windows cover (the context).

1. Anchors are counted over all runs. A run whose anchor is nowhere else is dropped.
2. Runs with equal anchor and context repeat as a whole: all their windows do. This is a
   combined count, so a passage in a third of all documents is one row a task.
3. Where an anchor has several different contexts, the bytes of one run of each are fetched,
   and the suffixes that start in them are sorted (``suffix_sort``) among those at the same
   place before the anchor. Equal neighbours repeat. An anchor with very many contexts (around
   the ends of a common passage) is sorted in blocks; each block then gives one row of each of
   its windows, and these are counted over the blocks.
4. The covered parts of each document are merged and cut out.

Texts shuffle only where a Bloom filter of the documents asked for lets them pass: for the
contexts in step 3 and for the cuts in step 4.

Null and empty texts and texts shorter than ``length`` lose nothing by themselves. Rows equal in
id and text are copies of each other, so all their windows repeat. A text must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from presslens.llm.bloom import build, filter_size, flag, id_key, texts_of
from presslens.llm.common import row_slices, stored, text_or_empty
from presslens.llm.suffix_sort import PrefixHashes, repeated

_U = np.uint64
_PLACE = (1 << 24) - 1  # bytes of a piece that is worked on at once
_RUNS = "row long, anchor long, context long, start long, windows int, back int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` keys in a row."""
    n = len(keys) - width + 1
    padded = np.append(keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, _U)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, for the texts data[start:end]: text, anchor's hash, first window, number of windows, place of the anchor."""
    short = length // 3
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashed = _mixed(PrefixHashes(data).runs(short))
    keys = (hashed & ~_U(_PLACE)) | (_U(_PLACE) - np.arange(len(hashed), dtype=_U))
    anchor = (_U(_PLACE) - (_lowest(keys, length - short + 1) & _U(_PLACE))).astype(np.int64)
    text = np.full(len(anchor), -1, np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a >= length:
            text[a:b - length + 1] = i
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    windows = np.diff(first, append=len(anchor))
    inside = text[first] >= 0
    first, windows = first[inside], windows[inside]
    return text[first], hashed[anchor[first]].view(np.int64), first, windows, anchor[first]


def _runs(length: int, piece: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, most_bytes=piece):
            rows = batch.column(0).to_numpy()
            whole = [t.encode() for t in batch.column(1).to_pylist()]
            parts = []  # (row, offset in the text, bytes): long texts in overlapping pieces
            for row, text in zip(rows.tolist(), whole, strict=True):
                parts += [(row, a, text[a:a + piece + length - 1]) for a in range(0, max(1, len(text) - length + 1), piece)]
            done = 0
            while done < len(parts):
                held, size = [], 0
                while done < len(parts) and (not held or size + len(parts[done][2]) <= piece):
                    held.append(parts[done])
                    size += len(parts[done][2])
                    done += 1
                buffer = b"".join(p[2] for p in held)
                ends = np.cumsum([len(p[2]) for p in held])
                starts = ends - np.array([len(p[2]) for p in held])
                text, anchor, first, windows, place = anchor_runs(np.frombuffer(buffer, np.uint8), starts, ends, length)
                context = np.array([xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(first.tolist(), (first + windows + length - 1).tolist(), strict=True)], _U)
                own = np.array([p[0] for p in held], np.int64)[text] if len(text) else np.zeros(0, np.int64)
                offset = np.array([p[1] for p in held], np.int64)[text] - starts[text] if len(text) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(anchor.astype(np.int64)), pa.array(context.view(np.int64)), pa.array(first + offset),
                                                  pa.array(windows.astype(np.int32)), pa.array((place - first).astype(np.int32))], ["row", "anchor", "context", "start", "windows", "back"])
    return run


_FOUND = "row long, start long, finish long, key binary"


def _compare(length: int, most_bytes: int = 1 << 20):
    """Repeated windows of contexts with one anchor. Rows sorted by (anchor, block): blocks, row, start, back, many, context bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, now = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now:
                    if size >= most_bytes:
                        yield _compared(held, length)
                        held, size = [], 0
                    now = row[:2]
                held.append(row)
                size += len(row[-1])
        if held:
            yield _compared(held, length)
    return run


def _compared(rows: list, length: int, most_suffixes: int = 250_000) -> pa.RecordBatch:
    rows = list({(r[0], r[3], r[4]): r for r in rows}.values())  # a row equal in id and text may come twice
    data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
    sizes = np.array([len(r[7]) for r in rows], np.int64)
    at = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(data, np.append(np.arange(len(data)) - np.repeat(at, sizes), 0))
    back, windows = np.array([r[5] for r in rows], np.int64), sizes - length + 1
    anchors = np.unique([r[0] for r in rows], return_inverse=True)[1]
    alone, split = np.array([r[6] == 1 for r in rows]), np.array([r[2] > 1 for r in rows])
    out: list[tuple] = []
    slices = -(-int(windows.sum()) // most_suffixes)
    width = -(-length // slices)
    for first in range(0, length, width):  # windows are compared at one place before the anchor, so places are worked on in turn
        low, high = np.maximum(0, back - first - width + 1), np.minimum(windows - 1, back - first)
        many = np.maximum(0, high - low + 1)
        owner = np.repeat(np.arange(len(rows)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many - low, many)
        start = at[owner] + step
        group = anchors[owner] * length + back[owner] - step
        order = np.argsort(group, kind="stable")
        twice = np.zeros(len(owner), bool)
        twice[order] = repeated(data, group[order], start[order], length, hashes)
        hits = np.flatnonzero(twice & alone[owner])  # contexts that occur once: what repeats in them
        if len(hits):
            new = np.flatnonzero((np.diff(hits, prepend=-2) != 1) | (np.diff(owner[hits], prepend=-1) != 0))
            last = np.append(new[1:], len(hits)) - 1
            for a, b in zip(hits[new].tolist(), hits[last].tolist(), strict=True):
                r = rows[owner[a]]
                out.append((r[3], int(r[4] + step[a]), int(r[4] + step[b]) + length, None))
        seen = set()
        for i in np.flatnonzero(split[owner]).tolist():  # an anchor in several blocks: its windows are counted over them
            key = hashlib.blake2b(data[start[i]:start[i] + length].tobytes(), digest_size=16).digest()
            if alone[owner[i]] and not twice[i]:
                r = rows[owner[i]]
                out.append((r[3], int(r[4] + step[i]), int(r[4] + step[i]) + length, key))
            elif key not in seen:
                seen.add(key)
                out.append((None, None, None, key))
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["row", "start", "finish", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches):
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for doc, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = text.encode()
            spans: list[list[int]] = []
            for a, b in sorted((p["start"], p["finish"]) for p in parts):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *[x for s in spans for x in s], len(whole)]
            kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for name, value in zip(out, (doc, len(whole), len(whole) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        kinds = [batch.schema.field(0).type, *[pa.int64()] * 3, pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def repeated_parts(table: DataFrame, ids: DataFrame, length: int, block_rows: int) -> DataFrame:
    """(row, start, finish): parts of texts that repeated windows cover. ``table``: row, text, doc_id, text_hash; ``ids``: the same, stored, without text."""
    runs = stored(table.select("row", "text").mapInArrow(_runs(length), _RUNS), "runs")
    shared = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    cells = filter_size(shared.count())
    likely = flag(runs, F.col("anchor"), stored(build(shared.withColumnRenamed("anchor", "key"), "key", cells), "bloom"), cells, "likely")
    kept = stored(likely.filter("likely").drop("likely").join(shared, "anchor", "left_semi"), "runs")
    one = F.min(F.struct("row", "start", "windows", "back"))
    contexts = stored(kept.groupBy("anchor", "context").agg(F.count("*").alias("many"), one.alias("one")).select("anchor", "context", "many", "one.*"), "contexts")
    whole = kept.join(contexts.filter("many > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "row", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("finish"))
    several = contexts.groupBy("anchor").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = stored(several, "several")  # so that a hot anchor can be split in the join
    asked = stored(contexts.join(several, "anchor").join(ids, "row"), "asked")
    texts = texts_of(table, asked).join(asked, ["doc_id_key", "text_hash"])
    cut = texts.select("anchor", F.pmod(F.xxhash64("row", "start"), F.col("blocks")).alias("block"), "blocks", "row", "start", "back", "many",
                       F.expr(f"substring(cast(text as binary), cast(start + 1 as int), windows + {length - 1})").alias("bytes"))
    found = stored(cut.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(_compare(length), _FOUND), "found")
    parts = whole.unionByName(found.filter("key is null").drop("key"))
    keyed = found.filter("key is not null")
    both = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    return parts.unionByName(keyed.filter("row is not null").join(both, "key").select("row", "start", "finish"))


def cut_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 8192) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    text = text_or_empty(text_col)
    table = docs.select(F.monotonically_increasing_id().alias("row"), id_key(id_col), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ids = stored(table.drop("text"), "ids")
    parts = repeated_parts(table, ids, length, block_rows)
    spans = parts.join(ids, "row").groupBy("doc_id_key", "text_hash").agg(F.collect_list(F.struct("start", "finish")).alias("parts"))
    spans = stored(spans, "spans")  # parts of one text each
    cells = filter_size(spans.count())
    hashed = stored(build(spans.select(F.xxhash64("doc_id_key", "text_hash").alias("key")), "key", cells), "bloom")
    flagged = flag(table.drop("row"), F.xxhash64("doc_id_key", "text_hash"), hashed, cells, "touched")
    own = F.col("doc_id_key.id").alias("doc_id")
    plain = lambda rows: rows.select(
        own, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    touched = flagged.filter("touched").join(spans, ["doc_id_key", "text_hash"], "left")
    empty = F.array().cast("array<struct<start:bigint,finish:bigint>>")
    kind = dict(docs.dtypes)[id_col]
    cut = touched.select(own, "text", F.coalesce("parts", empty).alias("parts")).mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return plain(flagged.filter("not touched")).unionByName(cut)
