"""Token ids of a corpus in flat binary files.

Rows are range-partitioned by id (repeated ids by their place in the table, so they can be
split), sorted, encoded, and every task writes three flat files to the shared folder: ``.bin`` (the ids of
its documents in a row, unsigned 16-bit where the vocabulary allows it, else 32-bit),
``.off`` (64-bit offsets of each document in it, and the end) and ``.doc`` (64-bit document
ids; null is the smallest integer). A manifest (Parquet) names the files of the attempts
that finished, in order, with their number of documents and tokens; files of lost attempts
are named nowhere. The prefix sum of the token counts gives each part's global base.

Readers map the files of a local or mounted folder into memory and read bytes from other
file systems. Null and empty texts have the end id alone. No rows give an empty manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from presslens.llm.common import file_system, new_folder, read_flat, row_slices, text_or_empty
from presslens.llm.tokens import encoder

_MANIFEST = "part int, name string, documents long, tokens long, kind string"
_NULL_ID = -(1 << 63)


def vocabulary_size(tokenizer_path: str) -> int:
    with open(tokenizer_path, encoding="utf-8") as f:
        known = json.load(f)
    return 1 + max([*known["model"]["vocab"].values(), *[t["id"] for t in known["added_tokens"]]])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and the manifest (``folder``/manifest); the manifest with each part's base."""
    from pyspark import TaskContext

    kind = "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        part, name = TaskContext.get().partitionId(), ""
        ids_out, offsets, ids = None, [np.zeros(1, np.int64)], []
        total, end = 0, np.array([end_id], np.uint32)
        for batch in row_slices(batches):
            if ids_out is None:
                name = f"part-{part:05d}-{uuid.uuid4().hex}"
                store.create_dir(root, recursive=True)
                ids_out = store.open_output_stream(f"{root}/{name}.bin")
            encoded, lengths = [], []
            for tokens in encoder(tokenizer_path).encode(batch.column(1).to_pylist()):
                encoded += (tokens, end)
                lengths.append(len(tokens) + 1)
            ids_out.write(np.concatenate(encoded).astype(kind).tobytes())
            offsets.append(total + np.cumsum(lengths, dtype=np.int64))
            total = int(offsets[-1][-1])
            ids.append(batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if ids_out is None:
            return
        ids_out.close()
        for ending, parts in ((".off", offsets), (".doc", ids)):
            with store.open_output_stream(f"{root}/{name}{ending}") as out:
                out.write(np.concatenate(parts).astype("<i8").tobytes())
        n = sum(map(len, ids))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "documents": pa.array([n], pa.int64()),
                                          "tokens": pa.array([total], pa.int64()), "kind": [kind]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")  # the range bounds need no text
    ordered.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts in order, each with ``base``: the number of ids in all parts before it."""
    parts = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")  # one row a part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; its ids too if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for part in batch.to_pylist():
                at = f"{root}/{part['name']}"
                tokens, offsets, ids = read_flat(store, at + ".bin", part["kind"]), read_flat(store, at + ".off", "<i8"), read_flat(store, at + ".doc", "<i8")
                for a in range(0, len(ids), 4096):
                    cut = offsets[a:min(a + 4096, len(ids)) + 1]
                    each = [tokens[x:y].astype("<u4") for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    own = np.asarray(ids[a:a + 4096])
                    out = {"doc_id": pa.array(own, pa.int64(), mask=own == _NULL_ID), "start": pa.array(cut[:-1] + part["base"], pa.int64()),
                           "n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    parts = read_manifest(spark, folder)
    return parts.repartition(max(1, parts.count()), "part").mapInArrow(read, schema)  # a given number, or tiny rows end in one task


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the corpus to ``folder`` (default: a new one among the shared ones) and read it back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, folder)
