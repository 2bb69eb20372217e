"""Vector aggregates: one vector buffer per group, combined map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.functions.expr import doubles


def dimension(vecs: DataFrame, vec: str = "vec") -> int:
    """Length of the vectors, read from one row."""
    row = vecs.filter(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return row[0] if row else 0


def sum_vector(vec: str, weight: str) -> Column:
    """Aggregate: sum of the vectors of a group, each times the (not negative) column ``weight``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(vec)), F.col(weight).cast("double")))
