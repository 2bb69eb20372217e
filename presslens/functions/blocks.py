"""All-against-all work in bounded blocks.

Both sides are cut into blocks by hash; each pair of blocks is one group of a
cogrouped pandas function, which returns an already reduced result (a local
top-k, a partial softmax). The pairs themselves never leave the function. With
``by`` only rows with equal keys meet; small keys share a pack, and a key with
many rows is cut into several blocks, so no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _spread(df: DataFrame, own: str, other: str, n_other: str) -> DataFrame:
    return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))


def _renewed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def left_block_rows(left: DataFrame, rows: int, right_blocks: int, most: int) -> int:
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, max(64, math.ceil(rows * right_blocks / tasks))))


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                by: list[str] | None = None, left_rows: int = 4096, right_rows: int = 16384, spread: bool = False) -> DataFrame:
    """``run(left_block, right_block)`` for every pair of blocks (per ``by`` key if given).

    With ``spread`` the left blocks are smaller where the cores would have fewer than two pairs of blocks each.
    """
    n_left, n_right = left.count(), right.count()
    if spread:
        left_rows = left_block_rows(left, n_left, max(1, math.ceil(n_right / right_rows)), left_rows)
    if not by:
        lb = F.lit(max(1, math.ceil(n_left / left_rows))).cast("long")
        rb = F.lit(max(1, math.ceil(n_right / right_rows))).cast("long")
        left, right = (d.withColumns({"_pack": F.lit(0).cast("long"), "_nl": lb, "_nr": rb}) for d in (left, right))
    else:
        packs = max(1, math.ceil(max(n_left / left_rows, n_right / right_rows)))
        cut_l = left.groupBy(*by).agg(F.ceil(F.count("*") / left_rows).alias("_nl"))
        cut_r = right.groupBy(*by).agg(F.ceil(F.count("*") / right_rows).alias("_nr"))
        cuts = cut_l.join(cut_r, by).withColumn("_pack", F.pmod(F.xxhash64(*by), F.lit(packs)))
        # fresh column names on each side, as both may come from the same table
        left, right = (_renewed(d.join(cuts, by)) for d in (left, right))
    left = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.col("_nl")))
    right = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.col("_nr")))
    left = _spread(left, "_lb", "_rb", "_nr").drop("_nl", "_nr")
    right = _spread(right, "_rb", "_lb", "_nl").drop("_nl", "_nr")
    keys = ["_pack", "_lb", "_rb"]
    names = [c.split()[0] for c in schema.split(",")]

    def on_pack(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame(columns=names)
        if not by:
            return run(l, r)[names]
        right_parts = dict(iter(r.groupby(by, sort=False)))
        parts = [run(part, right_parts[key]) for key, part in l.groupby(by, sort=False) if key in right_parts]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(on_pack, schema)


def owner_blocks(pairs: DataFrame, owner: str, item: str, rows: int, least: int = 1) -> tuple[DataFrame, DataFrame, bool]:
    """(owner, item) pairs dealt to blocks ``_pack``, ``_part`` of about ``rows`` pairs.

    Owners share a pack; one with more than ``rows`` pairs is cut into parts by item. The
    second table has (owner, _pack, _parts), the third value tells whether any owner is cut.
    ``least`` is the smallest number of packs.
    """
    load = pairs.groupBy(owner).agg(F.count("*").alias("_load"))
    total, most = load.agg(F.sum("_load"), F.max("_load")).first()
    total, most = total or 0, most or 0
    cores = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = max(least, math.ceil(total / rows), min(cores, math.ceil(total * 16 / rows)), 1)
    owners = load.select(owner, F.pmod(F.xxhash64(owner), F.lit(packs)).alias("_pack"), F.ceil(F.col("_load") / rows).alias("_parts"))
    if most <= rows:
        return pairs.withColumns({"_pack": F.pmod(F.xxhash64(owner), F.lit(packs)), "_part": F.lit(0).cast("long")}), owners, False
    same = F.col(owner).eqNullSafe(F.col("_owner"))
    dealt = pairs.join(owners.withColumnRenamed(owner, "_owner"), same).drop("_owner").withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts"))).drop("_parts")
    return dealt, owners, True
