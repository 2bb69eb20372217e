"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document of it is to appear target / source
size times. The whole part is certain. The fractional parts are rounded in pairs: two
documents exchange words (one gains copies, the other loses as many words) until one
of them is integral, up or down with the odds that keep both expectations. The sum of
words never moves, so a source misses its target by half of one document at most, the
last one left. Pairs are made inside small buckets of a source; what is left of each bucket
(one fractional document) meets its like in the next level of a reduction tree, up to
the source's root. A hot source has more buckets, not larger ones.

Everything is DataFrame functions. Chances come from a hash of (seed, level, id, text),
so reruns agree. Null or empty text: size 0, taken 0. A null source is a source of its
own, last in order. Rows equal in id and text share their chances and stay separate
rows. No rows give no rows; a corpus without words has targets of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from presslens.llm.common import count_words, matching_rows, stored, text_or_empty, unit_hash

BUCKET = 64


def source_targets(sized: DataFrame, weights: tuple[float, ...], total: float, at_most: float) -> DataFrame:
    """(source, number, documents, source_size, target): one row a source.

    Targets are ``total`` x all words shared by weight; where ``at_most`` x the source's
    size is less, the target stops there and the excess is reshared by weight. That ends
    at a common level of target per weight, found by a prefix sum over the sources in
    the order in which they fill up.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = stats.withColumn("number", number).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(at_most)))
    everything, filling = W.partitionBy(), W.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("most").over(filling), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    levels = known.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    reached = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(reached * F.col("weight"))
    return levels.select("source", "number", "documents", "source_size", target.alias("target"))


def _settled(item: Column, copies: int) -> Column:
    return item.withField("part", F.lit(float(copies)))


def _duel(state: Column, new: Column) -> Column:
    """One step of the pivotal method: the open document of the bucket against the next one."""
    old = state["open"]
    old_down, old_up = old["part"] * old["size"], (1 - old["part"]) * old["size"]
    new_down, new_up = new["part"] * new["size"], (1 - new["part"]) * new["size"]
    rise, fall = F.least(old_up, new_down), F.least(old_down, new_up)  # words the old one may gain or lose
    gains = new["chance"] * (rise + fall) < fall

    def step(settled: Column, still_open: Column, words: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), still_open["part"] + words / still_open["size"]))
        return F.struct(still_open.withField("part", part).alias("open"), F.concat(state["done"], F.array(settled)).alias("done"))

    return (F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done")))
            .when(gains & (old_up <= new_down), step(_settled(old, 1), new, -rise))
            .when(gains, step(_settled(new, 0), old, rise))
            .when(old_down <= new_up, step(_settled(old, 0), new, fall))
            .otherwise(step(_settled(new, 1), old, -fall)))


_FIELDS = ["place", "row", "doc_id", "text_hash", "size", "whole", "part", "chance"]
_ITEM = "struct<place:bigint,row:bigint,doc_id:{id},text_hash:bigint,size:bigint,whole:bigint,part:double,chance:double>"


def _round_buckets(items: DataFrame, id_type: str) -> DataFrame:
    """(number, bucket, open, done): each bucket's documents settled but one."""
    item = _ITEM.format(id=id_type)
    listed = items.groupBy("number", "bucket").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS).cast(item))).alias("items"))
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("done"))
    return listed.select("number", "bucket", F.aggregate("items", start, _duel).alias("end")).select("number", "bucket", "end.open", "end.done")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, at_most: float = 2.0, seed: int = 1,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, text_hash, source, size, source_size, target, copies, taken."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text_col).alias("size"),
                               F.xxhash64(text_or_empty(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("row")), "sized")
    targets = stored(source_targets(sized, weights, total, at_most), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chance = lambda level: unit_hash(F.lit(seed), F.lit(level), F.col("place"))
    planned = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "number", "documents", share.alias("share"))
    planned = (planned.withColumns({"whole": F.floor("share").cast("long"), "place": F.xxhash64(F.lit(seed), "doc_id", "text_hash")})
               .withColumns({"part": F.col("share") - F.col("whole"), "chance": chance(0)}))
    fractional = (F.col("part") > 0) & (F.col("size") > 0)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "place"), F.ceil(F.col("documents") / BUCKET))
    open_ = planned.filter(fractional).select("number", bucket.alias("bucket"), *_FIELDS)
    settled = planned.filter(~fractional).select("number", *_FIELDS).withColumn("part", F.lit(0.0))
    largest = targets.agg(F.max("documents")).first()[0] or 0  # rows of the largest source: gives the height of the tree
    buckets, level = math.ceil(largest / BUCKET), 0
    while True:
        rounded = stored(_round_buckets(open_, dict(sized.dtypes)["doc_id"]), "mix")
        settled = settled.unionByName(rounded.select("number", F.explode("done").alias("x")).select("number", "x.*"))
        level += 1
        left = rounded.filter("open is not null").select("number", "bucket", "open.*").withColumn("chance", chance(level))
        if buckets <= 1:
            break
        open_ = left.withColumn("bucket", F.floor(F.col("bucket") / BUCKET))
        buckets = math.ceil(buckets / BUCKET)
    last = left.withColumn("part", (F.col("part") >= 0.5).cast("double")).drop("bucket")  # one a source, to the nearer side
    copies = F.col("whole") + F.col("part").cast("long")
    return settled.unionByName(last).join(targets, "number").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it has copies, all columns kept.

    Of rows equal in id and text one stands for all and has the copies of all.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).filter("copies > 0")
    return matching_rows(docs, stored(taken.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies")), "plan"), id_col, text_col)
