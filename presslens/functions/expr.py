"""Column expressions: ids, hashes, time, vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def prefix_id(dataset, raw, *qualifiers) -> Column:
    """``dataset[:qualifier...]:raw`` as one globally unique id."""
    parts = [F.lit(dataset), *[F.lit(q) for q in qualifiers], _col(raw).cast("string")]
    return F.concat_ws(":", *parts)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_key(*parts) -> Column:
    return F.concat_ws(":", *[_col(p).cast("string") if not isinstance(p, int) else F.lit(str(p)) for p in parts])


def hash32(*parts) -> Column:
    """Reproducible 32-bit hash of the parts, as a non-negative long."""
    return F.conv(F.substring(F.md5(joined_key(*parts).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Reproducible pseudo-random number in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def tie_break(seed: int, *parts) -> Column:
    """Reproducible pseudo-random sort key, unrelated to ids and input order."""
    return F.sha2(joined_key(seed, *parts).cast("binary"), 256)


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch (sub-second part dropped); null stays null."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def doubles(vec) -> Column:
    return _col(vec).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two numeric arrays; null if either is null."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec) -> Column:
    return F.sqrt(dot(vec, vec))


def unit(vec) -> Column:
    """L2-normalised vector; null for a null or zero vector."""
    length = norm(vec)
    return F.when(length > 0, F.transform(_col(vec), lambda x: x.cast("double") / length))


def clicked_int(c="clicked") -> Column:
    return _col(c).cast("int")
