"""Exact dedup with a two-pass Bloom filter.

Pass one hashes every document to two cells of a filter and keeps the cells that
two or more rows hit. Pass two looks every document up in the kept cells: a row
with an unset cell cannot have an equal and passes straight through, whatever its
size. Only the others (the possibly repeated) shuffle, and those are compared by
the SHA-256 of the normalised text, so a false positive of the filter costs a
shuffled row and never changes the result.

The filter is broadcast. Its size has a fixed bound (``max_cells / 64`` rows of 16
bytes), whatever the corpus size; with 32 cells a row about one unique row in 250
shuffles. Beyond ``max_cells / 32`` rows that share grows and the result stays.

Normalised text: every character of ``[\\x20\\x09-\\x0D]`` deleted; null is empty. Empty
texts equal each other. Of equal texts the row with the most code points in the
original stays, then the smallest id (null last); of rows equal in that too, one.
Tables without rows give results without rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.bloom import MAX_CELLS, build, filter_size, flag
from presslens.llm.common import SPACES, free_names, stored, text_or_empty


def text_digest(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(F.translate(text_or_empty(text), SPACES, ""), 256))


def _repeated(digests: DataFrame, cells: int) -> DataFrame:
    """The filter after pass one: the cells that at least two rows hit."""
    return stored(build(digests.select(F.xxhash64("digest").alias("key")), "key", cells, least=2), "bloom")


def _groups(candidates: DataFrame) -> DataFrame:
    """(digest, size, best) of texts with two or more rows; combined before the shuffle, so a hot text is one row a task."""
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))
    return candidates.groupBy("digest").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of each group of equal texts has ``kept``.
    """
    digests = stored(docs.select(F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).cast("long").alias("n"),
                                 text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    cells = filter_size(digests.count(), max_cells)
    flagged = flag(digests, F.xxhash64("digest"), _repeated(digests, cells), cells, "repeated")
    single = flagged.filter(~F.col("repeated")).select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    candidates = flagged.filter("repeated").drop("repeated")
    groups = stored(_groups(candidates), "groups")  # stored, so that a hot text can be split in the join
    joined = candidates.join(groups, "digest", "left")
    compared = joined.select(
        F.col("id").alias("doc_id"), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return single.unionByName(compared)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay.

    Texts that cannot be repeated are not shuffled. Which row stays is decided on digests; the rows
    of a text meet that decision by (digest, length, id), so a hot text is spread over tasks, and only
    the row that stays goes on. Rows equal in id, length and text are cut to one a task before they meet.
    """
    digest, n, repeated, best, best_digest = free_names(docs, "x_digest", "x_length", "x_repeated", "x_best", "x_best_digest")
    rows = docs.withColumns({digest: text_digest(text_col), n: F.length(text_or_empty(text_col)).cast("long")})
    digests = stored(rows.select(F.col(id_col).alias("id"), F.col(n).alias("n"), F.col(digest).alias("digest")), "digests")
    cells = filter_size(digests.count(), max_cells)
    bloom = _repeated(digests, cells)
    candidates = flag(digests, F.xxhash64("digest"), bloom, cells, "repeated").filter("repeated")
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id")))
    stays = stored(candidates.groupBy("digest").agg(first.alias("best")), "stays").select(
        F.col("digest").alias(best_digest), F.col("best").alias(best))
    flagged = flag(rows, F.xxhash64(digest), bloom, cells, repeated)
    same = ((F.col(digest) == F.col(best_digest)) & (F.col(n) == -F.col(f"{best}.less")) & F.col(id_col).eqNullSafe(F.col(f"{best}.id")))
    kept = flagged.filter(F.col(repeated)).join(stays, same).dropDuplicates([digest])
    return flagged.filter(~F.col(repeated)).select(*docs.columns).unionByName(kept.select(*docs.columns))
