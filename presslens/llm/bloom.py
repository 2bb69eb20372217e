"""Bloom filters as DataFrames: built by a combined aggregate, looked up by a broadcast join.

A key (64-bit hash) has two cells. A filter is (word, bits) rows of 64 cells, of which there
are at most ``MAX_CELLS`` / 64, so its size has a bound whatever the number of keys. Beyond
``MAX_CELLS`` / 32 keys it lets more strangers through; it never loses a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import free_names, stored

MAX_CELLS = 1 << 28
CELLS_A_KEY = 32


def filter_size(keys: int, max_cells: int = MAX_CELLS) -> int:
    return int(min(max_cells, max(1 << 12, 1 << (max(1, keys) * CELLS_A_KEY - 1).bit_length())))


def _cells(key: Column, cells: int) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(cells)), F.pmod(F.shiftright(key, 32), F.lit(cells))


def build(keys: DataFrame, key: str, cells: int, least: int = 1) -> DataFrame:
    """(word, bits) of the cells that at least ``least`` rows hit."""
    hits = keys.select(F.explode(F.array_distinct(F.array(*_cells(F.col(key), cells)))).alias("cell"))
    hit = hits.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    bit = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    return hit.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def flag(rows: DataFrame, key: Column, kept: DataFrame, cells: int, out: str) -> DataFrame:
    """``rows`` with ``out``: whether both cells of the key are in the filter."""
    names = free_names(rows, "bloom_word_1", "bloom_bits_1", "bloom_word_2", "bloom_bits_2")
    checks = []
    for cell, word, bits in zip(_cells(key, cells), names[::2], names[1::2], strict=True):
        side = F.broadcast(kept.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # at most MAX_CELLS / 64 rows
        rows = rows.join(side, F.floor(cell / 64).cast("long") == F.col(word), "left")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))
        checks.append(F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit) != 0)
    return rows.withColumn(out, checks[0] & checks[1]).drop(*names)


def id_key(id_col: str) -> Column:
    """``doc_id_key``: the id as a struct, in which null equals null."""
    return F.struct(F.col(id_col).alias("id")).alias("doc_id_key")


def texts_of(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id_key, text_hash, text) of the texts that ``asked`` names by the first two; few others pass the filter."""
    keys = stored(asked.select(F.xxhash64("doc_id_key", "text_hash").alias("key")).distinct(), "keys")
    cells = filter_size(keys.count())
    rows = flag(table.select("doc_id_key", "text_hash", "text"), F.xxhash64("doc_id_key", "text_hash"), stored(build(keys, "key", cells), "bloom"), cells, "asked")
    return rows.filter("asked").drop("asked")
