"""``@query`` puts a Spark function and its oracle SQL under one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.session import prepare_click_log_session
from suite.views import Views, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, whole: bool = False):
    """``whole``: the impressions are all orders, not only those of the evaluation window."""
    def register(fn):
        def run(spark, sf_dir) -> DataFrame:
            return fn(Views(prepare_click_log_session(spark), sf_dir, whole))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, whole)
        return fn
    return register


def whole_query(name: str, sql: str | None = None):
    """For work row by row or list by list, which needs no evaluation window."""
    return query(name, sql, whole=True)


def r6(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


def i64(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def long_vec(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, d, x): vectors in long form for comparison."""
    return df.select(key, F.posexplode(vec).alias("_d", "_x")).select(key, i64(F.col("_d") + 1, "d"), r6("_x", "x"))
