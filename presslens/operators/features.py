"""Per-candidate ranking features: long-term, short-term, user, item, context, session, in-list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from presslens.functions.expr import dot, doubles, epoch_seconds, unit
from presslens.functions.grouping import checkpointed, hot_groups, medians, row_numbers, top_k
from presslens.functions.vectors import sum_vector
from presslens.operators.interest import SAME_MASS, article_facts, pack_interest, user_packs
from presslens.operators.prepare import UNKNOWN, sentiment_code

HALF_LIFE_HOURS = 24.0
LOOKBACK_HOURS = 24.0 * 7
LAST_CLICKS = 5
#: Rows of one key and lookback that one task may hold with their vectors.
HOT_VECTORS = 100_000
#: Slices of time a lookback of a hot key is cut into.
SLICES = 256

# fixed values: feature names in model order
LONG_TERM = ["lt_cat_affinity", "lt_subcat_affinity", "lt_topic_affinity", "lt_embed_sim", "lt_cat_rank",
             "lt_sentiment_distance"]
SHORT_TERM = ["st_cat_affinity", "st_subcat_affinity", "st_topic_affinity", "st_embed_sim", "st_cat_rank",
              "is_last_clicked_category", "in_recent_categories"]
DRIFT = ["cat_affinity_drift", "embed_sim_drift", "topic_affinity_drift"]
USER = ["log_history_len", "user_mean_read_time", "user_median_read_time", "user_mean_scroll",
        "user_distinct_categories", "user_clicks_last_24h", "user_mean_article_age_h", "hours_since_last_click",
        "user_history_span_h"]
ITEM = ["article_age_h", "is_fresh_6h", "sentiment_score", "sentiment_label", "article_type", "is_premium",
        "title_len", "body_len", "n_topics", "n_entities", "log_history_popularity",
        "log_history_popularity_decayed", "category_code", "age_vs_user_appetite"]
CONTEXT = ["n_candidates", "hour_of_day", "day_of_week", "is_weekend", "is_front_page", "device_type",
           "is_sso_user", "is_subscriber", "user_age", "gender", "context_read_time",
           "context_scroll_percentage", "position_in_view", "relative_position_in_view"]
CONTEXT_ARTICLE = ["context_category_match", "context_topic_overlap", "context_embed_sim"]
SESSION = ["session_position", "session_start_gap_h"]
RELATIVE = ["lt_cat_affinity_rank_in_imp", "st_cat_affinity_rank_in_imp", "lt_embed_sim_rank_in_imp",
            "article_age_rank_in_imp", "history_popularity_rank_in_imp", "article_age_minus_imp_min",
            "lt_embed_sim_minus_imp_max"]
FEATURES = LONG_TERM + SHORT_TERM + DRIFT + USER + ITEM + CONTEXT + CONTEXT_ARTICLE + SESSION + RELATIVE
CATEGORICAL = ["sentiment_label", "article_type", "category_code", "device_type", "gender"]
POSITION_FEATURES = ["position_in_view", "relative_position_in_view"]

CAND = ["impression_id", "user_id", "article_id", "position"]


def category_of(articles: DataFrame) -> DataFrame:
    """(article_id, category) with null categories as one category of their own."""
    return articles.select("article_id", F.coalesce("category", F.lit(UNKNOWN)).alias("category"))


def engagement(read_time: str = "read_time") -> Column:
    seconds = F.least(F.greatest(F.coalesce(F.col(read_time).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(600.0))
    return 1.0 + F.log1p(seconds)


def engaged_clicks(hist: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, article_id, w): total engagement per user and known article."""
    known = hist.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    return known.groupBy("user_id", "article_id").agg(F.sum(engagement()).alias("w"))


# --- long-term -------------------------------------------------------------------------

def long_term_affinity(clicks: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(user_id, value, affinity): engagement share of each value.

    ``clicks`` from :func:`engaged_clicks`; ``values`` is (article_id, value). The
    window runs over a user's distinct values, so it is bounded by the vocabulary.
    """
    sums = clicks.join(values, "article_id").groupBy("user_id", value).agg(F.sum("w").alias("_w"))
    total = F.sum("_w").over(W.partitionBy("user_id"))
    return sums.select("user_id", value, (F.col("_w") / total).alias("affinity"))


def long_term_vector(clicks: DataFrame, vecs: DataFrame) -> DataFrame:
    """(user_id, vec): engagement-weighted unit vector."""
    sums = clicks.join(vecs.select("article_id", "vec"), "article_id").groupBy("user_id").agg(
        sum_vector("vec", "w").alias("_s"))
    return sums.select("user_id", unit("_s").alias("vec"))


PAIR = ["user_id", "article_id"]
MOMENT = ["user_id", "p", "article_id"]


def pairs_of(imp: DataFrame) -> DataFrame:
    """Distinct (user, article) of the candidates: features of a pair are computed once."""
    return imp.select(*PAIR).distinct()


def listed_values(articles: DataFrame, subcats: DataFrame, topics: DataFrame) -> DataFrame:
    """(article_id, kind, value) with the category, subcategories and topics of every article."""
    def rows(df: DataFrame, kind: str, col: str) -> DataFrame:
        return df.select("article_id", F.lit(kind).alias("kind"), F.col(col).cast("string").alias("value"))

    return rows(category_of(articles), "cat", "category").unionByName(
        rows(subcats, "sub", "subcategory")).unionByName(rows(topics, "top", "topic"))


def value_affinity(pairs: DataFrame, affinity: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    """(user_id, article_id, out): sum of the user's affinities over the article's values; absent means 0."""
    hits = pairs.join(values, "article_id").join(affinity, ["user_id", value])
    return hits.groupBy(*PAIR).agg(F.sum("affinity").alias(out))


def similarity(pairs: DataFrame, users: DataFrame, user_vecs: DataFrame, articles: DataFrame, vecs: DataFrame,
               out: str) -> DataFrame:
    """(user_id, article_id, out): dot product, 0 where a known side has no vector; no row if a side is unknown."""
    known = pairs.join(users, "user_id").join(articles.select("article_id").distinct(), "article_id")
    return (known.join(vecs.select("article_id", F.col("vec").alias("_i")), "article_id", "left")
            .join(user_vecs.select("user_id", F.col("vec").alias("_u")), "user_id", "left")
            .select(*PAIR, F.coalesce(dot("_u", "_i"), F.lit(0.0)).alias(out)))


def long_term_pairs(pairs: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                    vecs: DataFrame) -> DataFrame:
    """The four long-term similarity features of each pair.

    Formed in packs of users; users with too many rows for a pack go through :func:`_long_term_joined`.
    """
    asked = checkpointed(pairs.select(*PAIR).dropna()).withColumn("p", F.lit(0).cast("long"))
    clicks = hist.select("user_id", "article_id", F.lit(0).cast("long").alias("t"), engagement().alias("n"))
    packs, large = user_packs(clicks, asked, windows=False)
    facts = article_facts(listed_values(articles, subcats, topics), vecs)
    rows = _without(large, asked), _without(large, clicks)
    found = pack_interest(*rows, facts, packs).select(
        *PAIR, F.col("cat").alias("lt_cat_affinity"), F.col("sub").alias("lt_subcat_affinity"),
        F.col("top").alias("lt_topic_affinity"), F.col("sim").alias("lt_embed_sim"))
    if large is None:
        return found
    return found.unionByName(_long_term_joined(_only(large, asked).select(*PAIR), _only(large, hist), articles, subcats, topics, vecs))


def _without(users: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows if users is None else rows.join(users, "user_id", "left_anti")


def _only(users: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(users, "user_id", "left_semi")


def _long_term_joined(pairs: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                      vecs: DataFrame) -> DataFrame:
    """The same by joins, for users whose rows do not fit a task."""
    clicks = engaged_clicks(hist, articles)
    listed = listed_values(articles, subcats, topics)
    # all kinds of values go through one aggregate and one join
    key = ["user_id", "kind", "value"]
    sums = clicks.join(listed, "article_id").groupBy(*key).agg(F.sum("w").alias("_w"))
    share = F.col("_w") / F.sum("_w").over(W.partitionBy("user_id", "kind"))
    hits = pairs.join(listed, "article_id").join(sums.select(*key, share.alias("_a")), key)
    names = {"cat": "lt_cat_affinity", "sub": "lt_subcat_affinity", "top": "lt_topic_affinity"}
    found = hits.groupBy(*PAIR).agg(*[F.sum(F.when(F.col("kind") == k, F.col("_a"))).alias(n) for k, n in names.items()])
    sims = similarity(pairs, hist.select("user_id").distinct(), long_term_vector(clicks, vecs), articles, vecs, "lt_embed_sim")
    return pairs.join(found, PAIR, "left").fillna(0.0, list(names.values())).join(sims, PAIR, "left")


def long_term_features(imp: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                       vecs: DataFrame) -> DataFrame:
    """``lt_cat_affinity``, ``lt_subcat_affinity``, ``lt_topic_affinity``, ``lt_embed_sim``."""
    return imp.join(long_term_pairs(pairs_of(imp), hist, articles, subcats, topics, vecs), PAIR)


def _ranks(grid: DataFrame, group: list[str]) -> DataFrame:
    """0-based preference rank over the whole vocabulary without building it.

    ``grid`` holds the values a group has read (mass > 0) and those asked for (mass 0).
    Read values go first by mass, ties by code. An unread value comes after them, at
    its code minus the number of read codes below it. Neighbours by mass that are less than
    ``SAME_MASS`` apart are tied.
    """
    read = F.col("mass") > 0
    n_read = F.count_if(read).over(W.partitionBy(*group))
    down = W.partitionBy(*group).orderBy(F.col("mass").desc(), "code")
    lower = F.lag("mass").over(down) - F.col("mass") > F.lit(SAME_MASS)
    tied = grid.withColumn("_lower", F.when(lower, 1).otherwise(0)).withColumn(
        "_tie", F.sum("_lower").over(down.rowsBetween(W.unboundedPreceding, 0)))
    by_mass = F.row_number().over(W.partitionBy(*group).orderBy(read.desc(), "_tie", "code")) - 1
    below = F.count_if(read).over(W.partitionBy(*group).orderBy("code").rowsBetween(W.unboundedPreceding, 0))
    return tied.withColumn("rank", F.when(read, by_mass.cast("long")).otherwise(n_read + F.col("code") - below)).drop("_lower", "_tie")


def category_rank_pairs(pairs: DataFrame, hist: DataFrame, articles: DataFrame, vocab: DataFrame,
                        out: str = "lt_cat_rank") -> DataFrame:
    """(user_id, article_id, out): rank of the article's category in the user's preference (0 = best)."""
    codes = vocab.select(F.col("value").alias("category"), F.col("code").cast("long").alias("code"))
    cats = category_of(articles).join(codes, "category")
    # decimals add up to the same in any order
    read = hist.join(cats.select("article_id", "category"), "article_id").groupBy("user_id", "category").agg(
        F.sum(engagement().cast("decimal(38,18)")).alias("mass"))
    wanted = pairs.join(hist.select("user_id").distinct(), "user_id").join(cats, "article_id")
    asked = wanted.select("user_id", "category", "code", F.lit(0).cast("decimal(38,18)").alias("mass"))
    grid = read.join(codes, "category").select("user_id", "category", "code", F.col("mass").cast("decimal(38,18)").alias("mass"))
    grid = grid.unionByName(asked).groupBy("user_id", "category", "code").agg(F.max("mass").alias("mass"))
    ranks = _ranks(grid, ["user_id"]).select("user_id", "category", F.col("rank").alias(out))
    return wanted.join(ranks, ["user_id", "category"]).select(*PAIR, out)


def category_rank(imp: DataFrame, hist: DataFrame, articles: DataFrame, vocab: DataFrame,
                  out: str = "lt_cat_rank") -> DataFrame:
    """Add the long-term category rank of each candidate; null if user or category is unknown."""
    return imp.join(category_rank_pairs(pairs_of(imp), hist, articles, vocab, out), PAIR, "left")


def user_sentiment(hist: DataFrame, articles: DataFrame) -> DataFrame:
    rows = hist.join(articles.select("article_id", "sentiment_score"), "article_id")
    return rows.groupBy("user_id").agg(F.avg("sentiment_score").alias("mean_sentiment"))


def sentiment_distance(imp: DataFrame, hist: DataFrame, articles: DataFrame) -> DataFrame:
    rows = imp.join(articles.select("article_id", F.col("sentiment_score").alias("_s")), "article_id", "left")
    rows = rows.join(user_sentiment(hist, articles), "user_id", "left")
    return rows.withColumn("lt_sentiment_distance", F.abs(F.col("_s") - F.col("mean_sentiment"))).drop("_s", "mean_sentiment")


def recent_categories(imp: DataFrame, hist: DataFrame, articles: DataFrame, last_n: int = LAST_CLICKS) -> DataFrame:
    """``is_last_clicked_category`` and ``in_recent_categories`` over the last clicks with a category."""
    return _recent_columns(imp.join(category_of(articles), "article_id", "left"), hist, articles, last_n)


def _recent_columns(rows: DataFrame, hist: DataFrame, articles: DataFrame, last_n: int = LAST_CLICKS) -> DataFrame:
    """The two columns in place of ``category``."""
    last = top_k(hist.select("user_id", "pos", "article_id").join(category_of(articles), "article_id"), ["user_id"],
                 [F.col("pos").desc()], last_n, "_back")
    seen = last.groupBy("user_id", "category").agg(F.min("_back").alias("_back"))
    return rows.join(seen, ["user_id", "category"], "left").withColumns({
        "is_last_clicked_category": F.coalesce((F.col("_back") == 1).cast("long"), F.lit(0).cast("long")),
        "in_recent_categories": F.col("_back").isNotNull().cast("long"),
    }).drop("category", "_back")


# --- short-term ------------------------------------------------------------------------

def window_mass(probes: DataFrame, clicks: DataFrame, keys: list[str], values: list[str], lookback_s: int,
                half_life_s: float | None = None, every: bool = True) -> DataFrame:
    """Sums of ``values`` over the clicks in ``[p - lookback, p)`` of each probe, optionally decayed by age.

    ``probes`` is (keys, p), ``clicks`` (keys, t, values), times in whole seconds.
    A probe is never paired with single clicks. Time is cut into blocks of one
    lookback: the window is a prefix of the probe's own block plus a suffix of the
    block before, both read off running sums on one merged time line. Clicks of the
    same second are added first, so a (key, block) group cannot exceed the number
    of seconds in a lookback however many rows a key has. A probe goes only to blocks
    in which its key has clicks; without any its sums are 0, or it has no row if not ``every``.
    """
    rate = math.log(2.0) / half_life_s if half_life_s else 0.0
    span = int(lookback_s)
    key = ", ".join(keys)

    def age(end: str, block: str) -> str:
        return f"(({end}) - {block} * {span}) * {rate!r}D"

    def each(pattern: str) -> list[str]:
        return [pattern.format(v=v) for v in values]

    merged = clicks.groupBy(*keys, "t").agg(*[F.sum(v).cast("double").alias(v) for v in values])
    line = merged.selectExpr("*", f"floor(t / {span}) as _b").selectExpr("*", f"exp({age('t', '_b')}) as _g").selectExpr(
        *keys, "_b", "t as _t", "1 as _kind", "cast(null as bigint) as p", *each("{v} * _g as {v}"))
    asked = probes.select(*keys, F.col("p").cast("long").alias("p")).distinct()
    edges = asked.selectExpr(*keys, "p", f"explode(array(p, p - {span})) as _t").selectExpr(*keys, f"floor(_t / {span}) as _b", "_t", "0 as _kind", "p")
    busy = clicks.selectExpr(*[f"{k} as _at_{k}" for k in keys], f"floor(t / {span}) as _at_b").distinct()
    edges = edges.join(busy, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys] + [F.col("_b") == F.col("_at_b")], "left_semi")
    line = line.unionByName(edges.selectExpr(*keys, "_b", "_t", "_kind", "p", *each("0.0D as {v}")))
    window = "over (partition by {key}, _b order by {order} rows between unbounded preceding and current row)"
    before = window.format(key=key, order="_t, _kind")
    after = window.format(key=key, order="_t desc, _kind desc")
    sums = line.selectExpr(*keys, "_kind", "p", "p = _t as _now", f"exp(-({age('p', '_b')})) as _decay",
                           *each("sum({v}) " + before + " as {v}_pre"), *each("sum({v}) " + after + " as {v}_suf"))
    rows = sums.filter("_kind = 0").selectExpr(*keys, "p", *each("if(_now, {v}_pre, {v}_suf) * _decay as {v}"))
    if every:
        rows = rows.unionByName(asked.selectExpr(*keys, "p", *each("0.0D as {v}")))
    return rows.groupBy(*keys, "p").agg(*[F.sum(v).alias(v) for v in values])


def near_clicks(clicks: DataFrame, probes: DataFrame, key: str, lookback_s: int) -> DataFrame:
    """The clicks in a block of time (of one lookback) that the window of some probe of their key touches."""
    span = int(lookback_s)
    blocks = probes.select(key, F.explode(F.array(*[F.floor((F.col("p") - back) / span) for back in (0, span)])).alias("_b")).distinct()
    return clicks.withColumn("_b", F.floor(F.col("t") / span)).join(blocks, [key, "_b"], "left_semi").drop("_b")


def window_vectors(probes: DataFrame, clicks: DataFrame, key: str, vec: str, lookback_s: int, half_life_s: float,
                   hot_rows: int | None = None) -> DataFrame:
    """(key, p, vec): decayed sum of the vectors ``vec`` of the clicks in ``[p - lookback, p)`` of each probe.

    The same blocks as :func:`window_mass`: a click goes to its own block and the next one, a
    probe to its own. A task reads its (key, block) groups in order and keeps one running
    sum of whole vectors, from which every probe takes a difference. Keys with more than
    ``hot_rows`` rows in a block are cut into slices of time, see :func:`_sliced_vectors`.
    A probe without clicks in its window, or with a null key, has no row.
    """
    span, rate = int(lookback_s), math.log(2.0) / half_life_s
    given = clicks.select(key, F.col("t").cast("long").alias("t"), F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    asked = probes.select(key, F.col("p").cast("long").alias("p")).distinct()
    counted = given.select(key, F.floor(F.col("t") / span).alias("_b")).unionByName(asked.select(key, F.floor(F.col("p") / span).alias("_b")))
    hot = hot_groups(counted.filter(F.col(key).isNotNull()), [key, "_b"], hot_rows or HOT_VECTORS)
    if hot is None:
        return _block_vectors(asked, given, key, span, rate)
    keys = hot.select(key).distinct()
    cool = _block_vectors(asked.join(keys, key, "left_anti"), given.join(keys, key, "left_anti"), key, span, rate)
    return cool.unionByName(_sliced_vectors(asked.join(keys, key, "left_semi"), given.join(keys, key, "left_semi"), key, span, rate))


def _block_vectors(asked: DataFrame, clicks: DataFrame, key: str, span: int, rate: float) -> DataFrame:
    own = F.floor(F.col("t") / span)
    given = clicks.select(key, F.explode(F.array(own, own + 1)).alias("_b"), F.col("t").alias("_t"), "_v")
    wanted = asked.select(key, F.floor(F.col("p") / span).alias("_b"), (F.col("p") - span).alias("_from"), F.col("p").alias("_t"), "p")
    return _line_vectors(wanted, given, key, span, rate).select(key, "p", "vec")


def _sliced_vectors(asked: DataFrame, clicks: DataFrame, key: str, span: int, rate: float) -> DataFrame:
    """The same for keys with very many clicks: a window is the end of one slice of time, whole slices, and the start of another.

    Clicks of one second are added first. Ends and starts come from running sums inside one (key, slice),
    which holds at most as many clicks as a slice has seconds. A slice's sum, decayed to its first second,
    then counts as one click of that second, and the blocks above run on these sums.
    """
    width = -(-span // SLICES)
    seconds = checkpointed(clicks.withColumn("_w", F.lit(1.0)).groupBy(key, "t").agg(sum_vector("_v", "_w").alias("_v")))
    own, first, last = (F.floor((F.col(c) - back) / width) for c, back in (("t", 0), ("p", span), ("p", 0)))
    # (key, _low, _high): whole slices from the second _low to before the second _high
    cut = asked.select(key, "p", ((first + 1) * width).alias("_low"), (last * width).alias("_high"))
    edge = F.explode(F.array(F.struct(last.alias("_b"), F.col("_high").alias("_from"), F.col("p").alias("_t")),
                             F.struct(first.alias("_b"), (F.col("p") - span).alias("_from"), F.col("_low").alias("_t"))))
    edges = cut.select(key, "p", edge.alias("_e")).select(key, "_e.*", "p")
    parts = _line_vectors(edges, seconds.select(key, own.alias("_b"), F.col("t").alias("_t"), "_v"), key, width, rate)
    start = own * width
    totals = seconds.select(key, start.alias("_s"), "_v", F.exp((F.col("t") - start) * rate).alias("_w")).groupBy(key, F.col("_s").alias("t")).agg(
        sum_vector("_v", "_w").alias("_v"))
    block = F.floor(F.col("t") / span)
    whole = cut.select(key, F.floor(F.col("_high") / span).alias("_b"), F.col("_low").alias("_from"), F.col("_high").alias("_t"), F.col("_high").alias("p")).distinct()
    middle = _line_vectors(whole, totals.select(key, F.explode(F.array(block, block + 1)).alias("_b"), F.col("t").alias("_t"), "_v"), key, span, rate)
    middle = cut.join(middle.select(key, F.col("_from").alias("_low"), F.col("p").alias("_high"), "vec"), [key, "_low", "_high"]).select(
        key, "p", "vec", F.exp((F.col("_high") - F.col("p")) * rate).alias("_w"))
    every = parts.select(key, "p", "vec", F.lit(1.0).alias("_w")).unionByName(middle)
    return every.groupBy(key, "p").agg(sum_vector("vec", "_w").alias("vec"))


def _line_vectors(asked: DataFrame, clicks: DataFrame, key: str, size: int, rate: float) -> DataFrame:
    """(key, _from, p, vec): for each of ``asked`` (key, _b, _from, _t, p) the clicks (key, _b, _t, _v) of its
    group (key, _b) from second ``_from`` to before ``_t``, decayed to ``p``. Group b starts at second b * ``size``."""
    nothing = F.lit(None).cast("long")
    given = clicks.select(key, "_b", "_t", F.lit(1).alias("_kind"), nothing.alias("_from"), nothing.alias("p"), "_v")
    asked = asked.select(key, "_b", "_t", F.lit(0).alias("_kind"), "_from", "p", F.lit(None).cast("array<double>").alias("_v"))
    # at one second the probe stands before the clicks, which it must not see
    line = given.unionByName(asked).repartition(key, "_b").sortWithinPartitions(key, "_b", "_t", "_kind")
    kind = asked.schema[key].dataType.simpleString()
    return line.mapInArrow(_running_vectors(size, rate), f"{key} {kind}, _from long, p long, vec array<double>")


def _running_vectors(size: int, rate: float, chunk: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, chunk
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            first = int(_starts(table)[-1])  # the last group may go on
            if first:
                yield from answer(table.slice(0, first))
            held, rows = table.slice(first).to_batches(), rows - first
            enough = max(chunk, 2 * rows)  # a long group is not looked through again for every batch
        if held:
            yield from answer(pa.Table.from_batches(held).combine_chunks())

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = _starts(table)
        shift = table.column("_b").to_numpy() * size
        t = table.column("_t").to_numpy() - shift  # from -size to size
        click = table.column("_kind").to_numpy() == 1
        asked = np.flatnonzero(~click)
        if not len(asked):
            return
        probes = table.take(pa.array(asked))
        start, at = (probes.column(c).to_numpy() - shift[asked] for c in ("_from", "p"))
        flat = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dim = len(flat) // max(1, int(click.sum()))
        sums = np.zeros((len(t) + 1, dim))
        sums[1:][click] = flat.reshape(-1, dim) * np.exp(rate * t[click])[:, None] if dim else 0.0
        np.cumsum(sums, axis=0, out=sums)
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(t)))
        low = np.searchsorted(group * 8 * size + t, group[asked] * 8 * size + start)
        some = np.cumsum(np.append(0, click))
        any_ = some[asked] > some[low]  # no click in the window: no row
        seen = (sums[asked[any_]] - sums[low[any_]]) * np.exp(-rate * at[any_])[:, None]
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * dim, pa.int32()), pa.array(seen.ravel()))
        found = probes.filter(pa.array(any_)).combine_chunks()
        names = [table.column_names[0], "_from", "p"]
        yield pa.RecordBatch.from_arrays([*[_one(found.column(c)) for c in names], out], [*names, "vec"])

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _starts(table: pa.Table) -> np.ndarray:
    """First row of each (key, block) group of a sorted table."""
    change = np.ones(table.num_rows, bool)
    for name in (table.column_names[0], "_b"):
        column = table.column(name).combine_chunks()
        differs = pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        change[1:] = differs if name != "_b" else differs | change[1:]
    return np.flatnonzero(change)


def known_clicks(hist: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, article_id, t, n): clicks on known articles per second."""
    rows = hist.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    return rows.groupBy("user_id", "article_id", epoch_seconds("click_time").alias("t")).agg(
        F.count("*").cast("double").alias("n"))


def with_second(imp: DataFrame) -> DataFrame:
    return imp.withColumn("p", epoch_seconds("impression_time"))


def day_counts(imp: DataFrame, hist: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, p, user_clicks_last_24h) for known users."""
    probes = with_second(imp).select("user_id", "p").distinct()
    counts = window_mass(probes, known_clicks(hist, articles), ["user_id"], ["n"], 86400, every=False)
    users = hist.select("user_id").distinct()
    return probes.join(users, "user_id").join(counts, ["user_id", "p"], "left").select(
        "user_id", "p", F.coalesce("n", F.lit(0.0)).alias("user_clicks_last_24h"))


def clicks_last_24h(imp: DataFrame, hist: DataFrame, articles: DataFrame) -> DataFrame:
    """``user_clicks_last_24h``: null for an unknown user, 0 without clicks in the day before."""
    return with_second(imp).join(day_counts(imp, hist, articles), ["user_id", "p"], "left").drop("p")


def short_term_moments(imp: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                       vecs: DataFrame, vocab: DataFrame,
                       half_life_hours: float = HALF_LIFE_HOURS, lookback_hours: float = LOOKBACK_HOURS) -> DataFrame:
    """(user_id, p, article_id) with the ``st_*`` features; p is the impression time in seconds.

    Formed in packs of users, where each moment adds up the clicks of its window; users with too many
    rows or pairs of click and candidate go through :func:`_short_term_joined`.
    """
    look, half = int(lookback_hours * 3600), half_life_hours * 3600
    asked = checkpointed(with_second(imp).select(*MOMENT).dropna().distinct())
    clicks = hist.select("user_id", "article_id", epoch_seconds("click_time").alias("t"), F.lit(1.0).alias("n")).dropna()
    packs, large = user_packs(clicks, asked, windows=True)
    facts = article_facts(listed_values(articles, subcats, topics), vecs, vocab)
    found = pack_interest(_without(large, asked), _without(large, clicks), facts, packs, look, math.log(2.0) / half).select(
        *MOMENT, F.col("cat").alias("st_cat_affinity"), F.col("sub").alias("st_subcat_affinity"), F.col("top").alias("st_topic_affinity"),
        F.col("sim").alias("st_embed_sim"), F.col("rank").alias("st_cat_rank"))
    if large is None:
        return found
    return found.unionByName(_short_term_joined(_only(large, asked), _only(large, hist), articles, subcats, topics, vecs, vocab, look, half))


def _short_term_joined(cand: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                       vecs: DataFrame, vocab: DataFrame, look: int, half: float) -> DataFrame:
    """The same by joins and running sums, for users whose rows do not fit a task. ``cand`` is (user_id, p, article_id)."""
    known = articles.select("article_id").distinct()
    # both are read by every family below; clicks that no window can hold go at once
    moments = checkpointed(cand.select("user_id", "p").distinct().join(hist.select("user_id").distinct(), "user_id"))
    clicks = checkpointed(near_clicks(known_clicks(hist, articles), moments, "user_id", look))
    asked = cand.select(*MOMENT).distinct().join(known, "article_id")

    # one time line per (user, kind, value) for all families; kind "sub*" and "top*" count every value of the kind
    listed = checkpointed(listed_values(articles, subcats, topics))
    values = checkpointed(clicks.join(listed, "article_id").select("user_id", "t", "n", "kind", "value"))
    whole = values.filter("kind <> 'cat'").selectExpr("user_id", "t", "n", "concat(kind, '*') as kind", "'' as value")
    wanted = checkpointed(asked.join(listed, "article_id"))
    # of categories, all that were read in the blocks of time a moment's window touches, for share and rank
    block = F.floor(F.col("t") / look)
    read = values.filter("kind = 'cat'").select("user_id", "kind", "value", F.explode(F.array(block, block + 1)).alias("_b")).distinct()
    key = ["user_id", "kind", "value"]
    probes = moments.withColumn("_b", F.floor(F.col("p") / look)).join(read, ["user_id", "_b"]).select(*key, "p")
    probes = probes.unionByName(wanted.filter("kind <> 'cat'").select(*key, "p")).unionByName(
        moments.selectExpr("user_id", "explode(array('sub*', 'top*')) as kind", "'' as value", "p"))
    mass = checkpointed(window_mass(probes, values.unionByName(whole), key, ["n"], look, half, every=False).filter("n > 0"))

    # per moment: topic and subcategory mass, and the vector sum
    sums = mass.filter("value = '' and kind in ('sub*', 'top*')").groupBy("user_id", "p").agg(
        *[F.max(F.when(F.col("kind") == f"{k}*", F.col("n"))).alias(f"n_{k}") for k in ("sub", "top")])
    placed = clicks.join(vecs.select("article_id", doubles("vec").alias("_x")), "article_id").select(
        "user_id", "t", F.transform("_x", lambda x: x * F.col("n")).alias("_x"))
    summed = window_vectors(moments, placed, "user_id", "_x", look, half).select("user_id", "p", unit("vec").alias("_u"))
    totals = moments.join(sums, ["user_id", "p"], "left").join(summed, ["user_id", "p"], "left")

    codes = vocab.select("value", F.col("code").cast("long").alias("code"))
    categories = wanted.filter("kind = 'cat'").drop("kind")
    grid = mass.filter("kind = 'cat'").select("user_id", "p", "value", F.col("n").alias("mass")).unionByName(
        categories.select("user_id", "p", "value", F.lit(0.0).alias("mass"))).join(codes, "value")
    grid = grid.groupBy("user_id", "p", "value", "code").agg(F.max("mass").alias("mass"))
    grid = _ranks(grid.withColumn("_all", F.sum("mass").over(W.partitionBy("user_id", "p"))), ["user_id", "p"]).filter(F.col("_all") > 0)
    shares = grid.select("user_id", "p", "value", (F.col("mass") / F.col("_all")).alias("st_cat_affinity"),
                         F.col("rank").alias("st_cat_rank"))
    by_category = categories.join(shares, ["user_id", "p", "value"]).select(*MOMENT, "st_cat_affinity", "st_cat_rank")
    by_value = wanted.join(mass.filter("kind in ('sub', 'top')"), [*key, "p"]).groupBy(*MOMENT).agg(
        F.sum(F.when(F.col("kind") == "sub", F.col("n"))).alias("_sub"),
        F.sum(F.when(F.col("kind") == "top", F.col("n"))).alias("_top"))

    rows = cand.select(*MOMENT).distinct().join(by_category, MOMENT, "left").join(by_value, MOMENT, "left")
    rows = rows.join(known.withColumn("_known", F.lit(True)), "article_id", "left")
    rows = rows.join(vecs.select("article_id", doubles("vec").alias("_i")), "article_id", "left")
    rows = rows.join(totals, ["user_id", "p"], "left")
    # a known article without vector has similarity 0, an unknown one none
    sim = F.when(F.col("_known").isNotNull() & F.col("_u").isNotNull(), F.coalesce(dot("_u", "_i"), F.lit(0.0)))
    zero = F.lit(0.0)
    return rows.select(
        *MOMENT, F.coalesce("st_cat_affinity", zero).alias("st_cat_affinity"),
        F.coalesce(F.when(F.col("n_sub") > 0, F.col("_sub") / F.col("n_sub")), zero).alias("st_subcat_affinity"),
        F.coalesce(F.when(F.col("n_top") > 0, F.col("_top") / F.col("n_top")), zero).alias("st_topic_affinity"),
        sim.alias("st_embed_sim"), "st_cat_rank")


def short_term_features(imp: DataFrame, *tables: DataFrame, **options) -> DataFrame:
    """``st_*``: interest of the last days, decayed to each impression's own time, strictly before it.

    Further arguments as for :func:`short_term_moments`.
    """
    return with_second(imp).join(short_term_moments(imp, *tables, **options), MOMENT).drop("p")


def drift_features(frame: DataFrame) -> DataFrame:
    """Short-term minus long-term."""
    return frame.withColumns({
        "cat_affinity_drift": F.col("st_cat_affinity") - F.col("lt_cat_affinity"),
        "embed_sim_drift": F.col("st_embed_sim") - F.col("lt_embed_sim"),
        "topic_affinity_drift": F.col("st_topic_affinity") - F.col("lt_topic_affinity")})


# --- user, item, context, session --------------------------------------------------------

def user_profile(hist: DataFrame, articles: DataFrame, hot_limit: int | None = None) -> DataFrame:
    """One row per user with the history aggregates."""
    scroll = F.col("scroll") if "scroll" in hist.columns else F.lit(None).cast("double")
    t = epoch_seconds("click_time")
    base = hist.groupBy("user_id").agg(
        F.count("*").alias("_n"), F.avg("read_time").alias("user_mean_read_time"), F.avg(scroll).alias("user_mean_scroll"),
        F.min(t).alias("_first"), F.max(t).alias("_last"))
    known = hist.select("user_id", "article_id", t.alias("_t")).join(
        category_of(articles).join(articles.select("article_id", epoch_seconds("published_at").alias("_pub")), "article_id"), "article_id")
    # distinct categories by a two-step count, so a hot user is combined map side
    cats = known.groupBy("user_id", "category").agg(F.sum(F.col("_t") - F.col("_pub")).alias("_age"),
                                                    F.count(F.col("_t") - F.col("_pub")).alias("_aged"))
    shape = cats.groupBy("user_id").agg(F.count("*").alias("_cats"),
                                        F.try_divide(F.sum("_age"), F.sum("_aged")).alias("_mean_age"))
    middle = medians(hist, ["user_id"], ["read_time"], hot_limit).withColumnRenamed("read_time", "user_median_read_time")
    rows = base.join(shape, "user_id", "left").join(middle, "user_id", "left")
    return rows.select(
        "user_id", F.log1p(F.col("_n").cast("double")).alias("log_history_len"), "user_mean_read_time",
        "user_median_read_time", "user_mean_scroll",
        F.coalesce("_cats", F.lit(0).cast("long")).alias("user_distinct_categories"),
        (F.col("_mean_age") / 3600.0).alias("user_mean_article_age_h"),
        ((F.col("_last") - F.col("_first")) / 3600.0).alias("user_history_span_h"), F.col("_last").alias("_last_click"))


def user_features(imp: DataFrame, hist: DataFrame, articles: DataFrame) -> DataFrame:
    rows = imp.join(user_profile(hist, articles), "user_id", "left")
    return rows.withColumn("hours_since_last_click",
                           (epoch_seconds("impression_time") - F.col("_last_click")) / 3600.0).drop("_last_click")


def item_features(imp: DataFrame, articles: DataFrame, topics: DataFrame, vocab: DataFrame, popularity: DataFrame,
                  type_vocab: DataFrame | None = None) -> DataFrame:
    """Article metadata, age at the impression and popularity from the history window."""
    have = set(articles.columns)

    def text_len(name):
        return F.length(F.coalesce(name, F.lit(""))).cast("long") if name in have else F.lit(None).cast("long")

    n_topics = topics.groupBy("article_id").agg(F.count("*").alias("_nt"))
    entity_count = F.coalesce(F.size("ner_clusters"), F.lit(0)) if "ner_clusters" in have else (
        F.col("n_entities") if "n_entities" in have else F.lit(0))
    meta = category_of(articles).join(
        vocab.select(F.col("value").alias("category"), F.col("code").cast("long").alias("_code")), "category", "left")
    facts = articles.select(
        "article_id", epoch_seconds("published_at").alias("_pub"), "sentiment_score",
        (sentiment_code("sentiment_label") if "sentiment_label" in have else F.lit(-1).cast("long")).alias("sentiment_label"),
        (F.coalesce("article_type", F.lit(UNKNOWN)) if "article_type" in have else F.lit(UNKNOWN)).alias("_type"),
        F.coalesce(F.col("premium").cast("long"), F.lit(0).cast("long")).alias("is_premium"), text_len("title").alias("title_len"),
        text_len("body").alias("body_len"), F.least(entity_count, F.lit(127)).cast("long").alias("n_entities"),
        F.lit(True).alias("_known"))
    facts = facts.join(meta.select("article_id", "_code"), "article_id").join(n_topics, "article_id", "left")
    if type_vocab is not None:
        facts = facts.join(type_vocab.select(F.col("value").alias("_type"), F.col("code").cast("long").alias("article_type")), "_type", "left")
    else:
        facts = facts.withColumn("article_type", F.lit(-1).cast("long"))
    rows = imp.join(facts.drop("_type"), "article_id", "left").join(
        popularity.select("article_id", F.col("clicks").alias("_raw"), F.col("decayed").alias("_dec")), "article_id", "left")
    age = (epoch_seconds("impression_time") - F.col("_pub")) / 3600.0
    seen = F.col("_known").isNotNull()
    zero, minus = F.lit(0.0), F.lit(-1).cast("long")
    return rows.withColumns({
        "article_age_h": age,
        "is_fresh_6h": F.coalesce((age < 6.0).cast("long"), F.lit(0).cast("long")),
        "sentiment_label": F.coalesce("sentiment_label", minus), "article_type": F.coalesce("article_type", minus),
        "is_premium": F.coalesce("is_premium", F.lit(0).cast("long")),
        "n_topics": F.when(seen, F.least(F.coalesce("_nt", F.lit(0).cast("long")), F.lit(127).cast("long"))),
        "category_code": F.coalesce("_code", minus),
        "log_history_popularity": F.log1p(F.when(seen, F.coalesce(F.col("_raw").cast("double"), zero)).otherwise(zero)),
        "log_history_popularity_decayed": F.log1p(F.when(seen, F.coalesce("_dec", zero)).otherwise(zero)),
    }).drop("_pub", "_known", "_code", "_nt", "_raw", "_dec")


def context_features(imp: DataFrame, hot_limit: int | None = None) -> DataFrame:
    """List size, request time and the optional request columns with their fill values."""
    sizes = imp.groupBy("impression_id").agg(F.count("*").alias("n_candidates"))
    return _context_columns(imp.join(sizes, "impression_id"))


def _context_columns(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)

    def optional(name, kind, fill=None):
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return c if fill is None else F.coalesce(c, F.lit(fill).cast(kind))

    ts, last = F.col("impression_time"), F.greatest(F.col("n_candidates") - 1, F.lit(1))
    front = F.col("context_article_id").isNull() if "context_article_id" in have else F.lit(True)
    return rows.withColumns({
        "hour_of_day": F.hour(ts).cast("long"), "day_of_week": F.weekday(ts).cast("long"),
        "is_weekend": (F.weekday(ts) >= 5).cast("long"), "is_front_page": front.cast("long"),
        "device_type": optional("device_type", "long", -1), "is_sso_user": optional("is_sso_user", "int", 0).cast("long"),
        "is_subscriber": optional("is_subscriber", "int", 0).cast("long"), "user_age": optional("age", "double"),
        "gender": optional("gender", "double", -1.0), "context_read_time": optional("read_time", "double"),
        "context_scroll_percentage": optional("scroll_percentage", "double"),
        "position_in_view": F.col("position").cast("long"),
        "relative_position_in_view": F.col("position") / last})


def context_pairs(pairs: DataFrame, articles: DataFrame, topics: DataFrame, vecs: DataFrame) -> DataFrame:
    """Category match, shared topics and similarity of (article_id, context_article_id) pairs."""
    cats = category_of(articles)

    def ctx(df, name):
        return df.select(F.col("article_id").alias("context_article_id"), F.col(name).alias(f"_c_{name}"))

    known = pairs.join(cats, "article_id").join(ctx(cats, "category"), "context_article_id")
    shared = pairs.join(topics, "article_id").join(
        topics.select(F.col("article_id").alias("context_article_id"), "topic"), ["context_article_id", "topic"])
    shared = shared.groupBy("article_id", "context_article_id").agg(F.count("*").alias("_n"))
    rows = known.join(shared, ["article_id", "context_article_id"], "left")
    rows = rows.join(vecs.select("article_id", "vec"), "article_id", "left").join(ctx(vecs, "vec"), "context_article_id", "left")
    return rows.select("article_id", "context_article_id",
                       (F.col("category") == F.col("_c_category")).cast("long").alias("context_category_match"),
                       F.coalesce("_n", F.lit(0).cast("long")).alias("context_topic_overlap"),
                       F.coalesce(dot("vec", "_c_vec"), F.lit(0.0)).alias("context_embed_sim"))


def _context_column(imp: DataFrame) -> DataFrame:
    if "context_article_id" in imp.columns:
        return imp
    return imp.withColumn("context_article_id", F.lit(None).cast(imp.schema["article_id"].dataType))


def _context_keys(imp: DataFrame) -> DataFrame:
    return imp.select("article_id", "context_article_id").filter(F.col("context_article_id").isNotNull()).distinct()


def context_article_features(imp: DataFrame, articles: DataFrame, topics: DataFrame, vecs: DataFrame) -> DataFrame:
    """Match of each candidate with the article being read when the list was shown."""
    imp = _context_column(imp)
    rows = context_pairs(_context_keys(imp), articles, topics, vecs)
    return imp.join(rows, ["article_id", "context_article_id"], "left").fillna(
        0, ["context_category_match", "context_topic_overlap"])


def session_features(impressions: DataFrame, session: str = "session_id", hot_limit: int | None = None) -> DataFrame:
    """``session_position`` and ``session_start_gap_h`` per impression; give it the whole split.

    ``impressions`` has one row per impression: impression_id, user_id, impression_time, session.
    """
    keys = ["user_id", session]
    numbered = row_numbers(impressions, keys, [F.col("impression_time"), F.col("impression_id")], "session_position", hot_limit)
    start = impressions.groupBy(*keys).agg(F.min(epoch_micros("impression_time")).alias("_start"))
    return numbered.join(start, keys).withColumn(
        "session_start_gap_h", (epoch_micros("impression_time") - F.col("_start")) / 3.6e9).drop("_start")


def epoch_micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- within the list ---------------------------------------------------------------------

def rank_in_impression(frame: DataFrame, cols: dict[str, str], hot_limit: int | None = None) -> DataFrame:
    """Percentile rank of each column inside its impression (0 lowest, 1 highest).

    Nulls rank lowest, ties by position; 0.5 where a list has fewer than two values.
    """
    stats = frame.groupBy("impression_id").agg(F.count("*").alias("_size"), *[F.count(c).alias(f"_n_{c}") for c in cols])
    orders = {f"_r_{c}": [F.col(c).asc_nulls_first(), F.col("position")] for c in cols}
    ranked = row_numbers(frame, ["impression_id"], orders, hot_limit=hot_limit).join(stats, "impression_id")
    return ranked.withColumns({
        out: F.when((F.col("_size") <= 1) | (F.col(f"_n_{c}") <= 1), 0.5).otherwise(
            (F.col(f"_r_{c}") - 1) / (F.col("_size") - 1)) for c, out in cols.items()
    }).drop("_size", *[f"_n_{c}" for c in cols], *[f"_r_{c}" for c in cols])


def impression_offsets(frame: DataFrame) -> DataFrame:
    """``article_age_minus_imp_min`` and ``lt_embed_sim_minus_imp_max``."""
    ends = frame.groupBy("impression_id").agg(F.min("article_age_h").alias("_lo"), F.max("lt_embed_sim").alias("_hi"))
    return frame.join(ends, "impression_id").withColumns({
        "article_age_minus_imp_min": F.col("article_age_h") - F.col("_lo"),
        "lt_embed_sim_minus_imp_max": F.col("lt_embed_sim") - F.col("_hi")}).drop("_lo", "_hi")


RANKED = {"lt_cat_affinity": "lt_cat_affinity_rank_in_imp", "st_cat_affinity": "st_cat_affinity_rank_in_imp",
          "lt_embed_sim": "lt_embed_sim_rank_in_imp", "article_age_h": "article_age_rank_in_imp",
          "log_history_popularity": "history_popularity_rank_in_imp"}


def labels(imp: DataFrame, clicks: DataFrame) -> DataFrame:
    """``clicked`` per candidate from a table of clicked (impression_id, article_id)."""
    hits = clicks.select("impression_id", "article_id").distinct().withColumn("_hit", F.lit(1).cast("long"))
    return imp.join(hits, ["impression_id", "article_id"], "left").withColumn(
        "clicked", F.coalesce("_hit", F.lit(0).cast("long"))).drop("_hit")


def feature_frame(imp: DataFrame, hist: DataFrame, articles: DataFrame, subcats: DataFrame, topics: DataFrame,
                  vecs: DataFrame, vocab: DataFrame, popularity: DataFrame, sessions: DataFrame,
                  type_vocab: DataFrame | None = None) -> DataFrame:
    """One row per candidate with the 65 features of :data:`FEATURES`, plus keys and label.

    ``sessions`` comes from :func:`session_features` over the whole split. The result
    is meant to be written once and read by training, scoring and evaluation.
    """
    imp = _context_column(imp)
    # every table is derived from the candidate keys, never from the growing frame, so the plan stays linear
    # in the number of families; narrow tables of the same key are put together before the frame meets them
    pairs = pairs_of(imp)
    pair_table = long_term_pairs(pairs, hist, articles, subcats, topics, vecs).join(
        category_rank_pairs(pairs, hist, articles, vocab), PAIR, "left")
    moments = short_term_moments(imp, hist, articles, subcats, topics, vecs, vocab)
    moments = moments.join(day_counts(imp, hist, articles), ["user_id", "p"], "left").join(pair_table, PAIR)
    context = context_pairs(_context_keys(imp), articles, topics, vecs)
    rows = item_features(with_second(imp), articles, topics, vocab, popularity, type_vocab).join(category_of(articles), "article_id", "left")
    rows = rows.join(context, ["article_id", "context_article_id"], "left").fillna(
        0, ["context_category_match", "context_topic_overlap"])
    rows = _recent_columns(drift_features(rows.join(moments, MOMENT).drop("p")), hist, articles)
    rows = user_features(rows.join(user_sentiment(hist, articles), "user_id", "left"), hist, articles)
    rows = rows.withColumns({"lt_sentiment_distance": F.abs(F.col("sentiment_score") - F.col("mean_sentiment")),
                             "age_vs_user_appetite": F.col("article_age_h") - F.col("user_mean_article_age_h")})
    # lists last: what is computed within them finds the rows in place
    sizes = imp.groupBy("impression_id").agg(F.count("*").alias("n_candidates"))
    lists = sizes.join(sessions.select("impression_id", "session_position", "session_start_gap_h"), "impression_id", "left")
    rows = _context_columns(rows.join(lists, "impression_id"))
    keep = [c for c in [*CAND, "impression_time", "clicked"] if c in rows.columns]
    rows = rows.select(*keep, *[F.col(f).cast("double").alias(f) for f in FEATURES if f not in RELATIVE])
    if hot_groups(imp, ["impression_id"]) is None:
        rows = _list_columns(rows)
    else:
        # lists too long for one task are read several times: the frame is stored once
        rows = impression_offsets(rank_in_impression(checkpointed(rows), RANKED))
    return rows.select(*keep, *FEATURES)


def _list_columns(rows: DataFrame) -> DataFrame:
    """:func:`rank_in_impression` and :func:`impression_offsets` of lists that fit a task."""
    of_list = W.partitionBy("impression_id")
    size = F.count("*").over(of_list)
    places = {out: F.row_number().over(of_list.orderBy(F.col(c).asc_nulls_first(), "position")) for c, out in RANKED.items()}
    rows = rows.withColumns(places | {"_size": size} | {f"_n_{c}": F.count(c).over(of_list) for c in RANKED} | {
        "article_age_minus_imp_min": F.col("article_age_h") - F.min("article_age_h").over(of_list),
        "lt_embed_sim_minus_imp_max": F.col("lt_embed_sim") - F.max("lt_embed_sim").over(of_list)})
    return rows.withColumns({out: F.when((F.col("_size") <= 1) | (F.col(f"_n_{c}") <= 1), 0.5).otherwise(
        (F.col(out) - 1) / (F.col("_size") - 1)) for c, out in RANKED.items()})
