"""Harmonic packing of documents into sequences of at most ``capacity`` tokens.

Lengths fall into classes by the reciprocal of their share of a sequence: class k holds
pieces of up to capacity / k tokens, and k of them fill a sequence of that class. A
document first gives whole sequences; of the rest, a piece that leaves its class's
sequence nearly full (``slack``) goes there whole, and a longer one is cut to the exact
size of the next class, the remainder being classed again. Pieces below capacity /
``classes`` are laid end to end (the last class), cut where a sequence ends.

Every task packs its own rows in one pass and holds one open sequence a class. What is
open at its end is laid end to end; the rest below one sequence is cut into powers of two,
which need no padding. No shuffle, no state beyond a task, and nothing grows with a task's
rows. ``sequence_id`` is (partition, number in it).

Null and empty texts have the end id alone. Copies and repeated ids are packed row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from presslens.llm.common import row_slices, text_or_empty
from presslens.llm.tokens import encoder

_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Pieces (row of the document, start, ids) in, finished sequences out."""

    def __init__(self, capacity: int, classes: int, slack: int):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.open: dict[int, list] = {}
        self.small: list = []
        self.small_size = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        at, n, top = 0, len(ids), self.capacity
        while at < n:
            rest = n - at
            if rest >= top:
                size, k = top, 1
            else:
                k = top // rest
                size = rest
                if k < self.classes and top - k * rest > self.slack:
                    k += 1
                    size = top // k
            piece = (doc, at, ids[at:at + size], n)
            at += size
            if k >= self.classes:
                yield from self._append(piece)
            else:
                held = self.open.setdefault(k, [])
                held.append(piece)
                if len(held) == k:
                    yield self.open.pop(k)

    def _append(self, piece) -> Iterator[list]:
        doc, start, ids, n = piece
        while len(ids):
            take = min(len(ids), self.capacity - self.small_size)
            self.small.append((doc, start, ids[:take], n))
            self.small_size += take
            start, ids = start + take, ids[take:]
            if self.small_size == self.capacity:
                yield self.small
                self.small, self.small_size = [], 0

    def close(self) -> Iterator[list]:
        for _, held in sorted(self.open.items()):
            for piece in held:
                yield from self._append(piece)
        rest, size = self.small, self.small_size
        self.open, self.small, self.small_size = {}, [], 0
        while size:
            fill, room = [], 1 << (size.bit_length() - 1)
            size -= room
            while room:
                doc, start, ids, n = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], n))
                    ids = ids[:room]
                fill.append((doc, start, ids, n))
                room -= len(ids)
            yield fill


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, classes: int = 64, slack: int = 32,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the piece's ids if asked for)."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(capacity, classes, slack), TaskContext.get().partitionId() << 32
        kind = None

        def rows(sequences: list[list]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in sequences:
                offset = 0
                for doc, start, ids, n in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset, *([ids] if with_ids else [])))
                    offset += len(ids)
                number += 1
            columns = list(zip(*out, strict=True))
            kinds = [kind, *[pa.int64()] * 6, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in row_slices(batches):
            kind = batch.schema.field(0).type
            done = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(batch.column(1).to_pylist()), strict=True):
                done.extend(packer.add(doc, np.append(ids, np.uint32(end_id))))
            if done:
                yield rows(done)
        if done := list(packer.close()):
            yield rows(done)

    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = _PIECES.format(id=dict(slim.dtypes)["doc_id"]) + ", ids array<long>" * with_ids
    return slim.mapInArrow(run, schema)
