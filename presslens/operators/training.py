"""Training tables for neural rankers: vocabulary, encoded titles, negatives, padded histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.functions.expr import clicked_int, hash32, tie_break
from presslens.functions.grouping import global_index, row_numbers, top_k

# fixed values
PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1


def title_tokens(col: str = "title") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def title_vocab(articles: DataFrame, min_freq: int = 2, hot_limit: int | None = None) -> DataFrame:
    """(token, id): pad 0, unk 1, then tokens by falling count (equal counts alphabetically)."""
    counts = articles.select(F.explode(title_tokens()).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = global_index(counts.filter(F.col("n") >= min_freq), [F.col("n").desc(), F.col("token")], "_i", hot_limit)
    words = ranked.select("token", (F.col("_i") + 2).alias("id"))
    special = articles.sparkSession.createDataFrame([(PAD, PAD_ID), (UNK, UNK_ID)], "token string, id long")
    return special.unionByName(words)


def encode_titles(articles: DataFrame, vocab: DataFrame, max_len: int) -> DataFrame:
    """(article_id, ids): the first ``max_len`` token ids, right-padded.

    A null article id carries the all-pad row for articles missing from the catalogue.
    """
    tokens = articles.select("article_id", F.slice(title_tokens(), 1, max_len).alias("_t"))
    words = tokens.select("article_id", F.posexplode("_t").alias("_p", "token"))
    ids = words.join(vocab.filter(~F.col("token").isin(PAD, UNK)), "token", "left")
    # at most max_len tokens per article
    packed = ids.groupBy("article_id").agg(F.sort_array(F.collect_list(
        F.struct("_p", F.coalesce("id", F.lit(UNK_ID).cast("long")).alias("id")))).alias("_w"))
    pad = F.array_repeat(F.lit(PAD_ID).cast("long"), max_len)
    rows = tokens.select("article_id").join(packed, "article_id", "left")
    row_ids = F.slice(F.concat(F.coalesce(F.transform("_w", lambda w: w["id"]), F.array().cast("array<bigint>")), pad), 1, max_len)
    sentinel = articles.sparkSession.range(1).select(
        F.lit(None).cast(articles.schema["article_id"].dataType).alias("article_id"), pad.alias("ids"))
    return rows.select("article_id", row_ids.alias("ids")).unionByName(sentinel)


def pad_history(hist: DataFrame, max_len: int, pad=None) -> DataFrame:
    """(user_id, article_ids, length): the last ``max_len`` clicks, oldest first, right-padded with ``pad``."""
    id_type = hist.schema["article_id"].dataType
    last = top_k(hist.select("user_id", "pos", "article_id"), ["user_id"], [F.col("pos").desc()], max_len, "_back")
    packed = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "article_id"))).alias("_c"))
    filler = F.array_repeat(F.lit(pad).cast(id_type), max_len)
    ids = F.slice(F.concat(F.transform("_c", lambda c: c["article_id"]), filler), 1, max_len)
    return packed.select("user_id", ids.alias("article_ids"), F.size("_c").cast("long").alias("length"))


def negative_samples(imp: DataFrame, neg_k: int, seed: int = 0, hot_limit: int | None = None,
                     max_examples: int | None = None) -> DataFrame:
    """(impression_id, user_id, position, positive, draw, negative): ``neg_k`` draws per clicked candidate.

    The non-clicked candidates of an impression are numbered in hash order. A click
    takes ``neg_k`` consecutive ones from a hashed start (wrapping round), so they are
    distinct; with fewer than ``neg_k`` each draw is hashed on its own and may repeat.
    Clicks meet only the drawn candidates, never the whole list. Impressions of
    one class have no rows. ``max_examples`` keeps that many clicks (in hash order).
    """
    rows = imp.select("impression_id", "user_id", "article_id", "position", clicked_int().alias("_y"))
    neg = rows.filter(F.col("_y") == 0).withColumn("_h", tie_break(seed, "impression_id", "article_id", "position"))
    neg = row_numbers(neg, ["impression_id"], [F.col("_h"), F.col("position")], "_i", hot_limit)
    sizes = neg.groupBy("impression_id").agg(F.count("*").alias("_n"))
    pos = rows.filter(F.col("_y") == 1).join(sizes, "impression_id")
    if max_examples is not None:
        key = tie_break(seed, "impression_id", "article_id")
        pos = global_index(pos.withColumn("_k", key), [F.col("_k"), F.col("position")], "_e", hot_limit).filter(
            F.col("_e") < max_examples).drop("_k", "_e")
    draws = pos.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(neg_k - 1))))
    start = F.pmod(hash32(seed, "impression_id", "article_id", "position"), F.col("_n"))
    lone = F.pmod(hash32(seed, "impression_id", "article_id", "position", "draw"), F.col("_n"))
    index = F.when(F.col("_n") >= neg_k, F.pmod(start + F.col("draw"), F.col("_n"))).otherwise(lone) + 1
    wanted = draws.select("impression_id", "user_id", "position", F.col("article_id").alias("positive"), "draw", index.alias("_i"))
    return wanted.join(neg.select("impression_id", "_i", F.col("article_id").alias("negative")), ["impression_id", "_i"]).drop("_i")


def training_examples(imp: DataFrame, hist: DataFrame, neg_k: int, max_history: int, seed: int = 0,
                      pad=None, max_examples: int | None = None) -> DataFrame:
    """One row per click: positive, its negatives and the user's padded recent history."""
    draws = negative_samples(imp, neg_k, seed, max_examples=max_examples)
    packed = draws.groupBy("impression_id", "user_id", "position", "positive").agg(
        F.sort_array(F.collect_list(F.struct("draw", "negative"))).alias("_d"))
    rows = packed.select("impression_id", "user_id", "position", "positive",
                         F.transform("_d", lambda d: d["negative"]).alias("negatives"))
    return rows.join(pad_history(hist, max_history, pad), "user_id", "left").fillna(0, ["length"])


def vector_coverage(vocab: DataFrame, pretrained: DataFrame) -> DataFrame:
    """(token, id, vec): pretrained vectors of known words, null for others."""
    return vocab.join(pretrained.select(F.col("id").alias("token"), "vec"), "token", "left")


def count_found(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count("*").alias("n_tokens"), F.count("vec").alias("n_found"))
