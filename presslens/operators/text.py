"""Tokens, BM25 index, retrieval and candidate scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from presslens.functions.blocks import block_pairs, owner_blocks
from presslens.functions.expr import hash32
from presslens.functions.grouping import checkpointed, global_index, top_k

# fixed values: Danish and English function words
DANISH_STOPWORDS = """
ad af alle als andet andre at bare blev blive bliver da de dem den denne
der deres det dette dig din dine disse dog du eller en end ens er et for
fra ham han hans har havde have hende hendes her hos hun hvad hvem hvis
hvor hvordan hvorfor hvornar i ikke ind ingen intet jeg jer jeres kan kom
kommer kun kunne lad lidt lige man mange med meget men mig min mine mit
mod ned nej ni noget nogle nu nar ogsa om op os over pa selv si sig sin
sine sit skal skulle som sadan tag tak til ud under var vare ved vi vil
ville vor vores
"""
ENGLISH_STOPWORDS = """
a an the and or but if in on at to for of with by from is are was were
be been being this that these those it its as not no do does did have
has had can could will would should may might must i you he she we they
them his her their our your s t just
"""
STOPWORDS = sorted(set(DANISH_STOPWORDS.split()) | set(ENGLISH_STOPWORDS.split()))
#: Postings a wanted result that the first pass of a retrieval reads, at least.
FIRST_POSTINGS = 64
#: Postings that queries meet by common terms, as a multiple of all postings and query terms: with more, every score is formed in blocks.
MET_POSTINGS = 100
#: Queries, scores and postings of a block that are worked on at once.
HELD_QUERIES, HELD_SCORES, HELD_POSTINGS = 16, 1 << 22, 1 << 15
#: Counts of terms of several users that are worked on at once.
HELD_TIMES = 1 << 20
TOKEN = r"[\p{L}\p{N}_]+"


def tokenize(col) -> Column:
    """Lower-cased word tokens without stopwords, repeats kept; null or empty text has none."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def article_text(articles: DataFrame) -> Column:
    """``title + ' ' + abstract``; a missing part counts as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "abstract") if c in articles.columns]
    return F.concat_ws(" ", *parts)


def doc_terms(articles: DataFrame) -> DataFrame:
    """(article_id, term, tf, doc_len) for every distinct term of every article (one row an article).

    An article's tokens are in one row, so they are counted in the batch they arrive in,
    without any shuffle.
    """
    tokens = articles.select("article_id", tokenize(article_text(articles)).alias("_t"))
    id_type = articles.schema["article_id"].dataType.simpleString()
    return tokens.mapInArrow(_count_terms, f"article_id {id_type}, term string, doc_len int, tf long")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            ids, tokens = (c.slice(start, 500) for c in batch.columns)
            sizes = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            words = tokens.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            known = max(1, len(words.dictionary))
            pairs, tf = np.unique(doc * known + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, word = pairs // known, pairs % known
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(sizes[row], pa.int32()),
                                              pa.array(tf, pa.int64())], ["article_id", "term", "doc_len", "tf"])


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, term, qtf) of query texts."""
    terms = queries.select(key, F.explode(tokenize(text)).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("qtf"))


def user_query(hist: DataFrame, terms: DataFrame, block_rows: int = 16384) -> DataFrame:
    """(user_id, term, qtf): the tokens of all clicked articles, repeated clicks counting again.

    Clicked articles are dealt to blocks of users, and a block gets the terms of its articles once
    each, compressed; counts are added inside the block, so what leaves it is the result. A user with more than
    ``block_rows`` articles is spread over several blocks whose counts are added afterwards.
    """
    clicks = checkpointed(hist.filter(F.col("article_id").isNotNull()).groupBy("user_id", "article_id").agg(F.count("*").alias("_n")))
    dealt, _, cut = owner_blocks(clicks, "user_id", "article_id", block_rows)
    user_type, keys = clicks.schema["user_id"].dataType.simpleString(), ["_pack", "_part"]
    id_type = terms.schema["article_id"].dataType.simpleString()
    lists = terms.filter(F.col("term").isNotNull() & F.col("article_id").isNotNull()).select(
        "article_id", "term", F.coalesce(F.col("tf").cast("double"), F.lit(0.0)).alias("tf")).mapInArrow(
        _pack_terms, f"article_id {id_type}, n int, size int, packed binary")
    found = dealt.select(*keys, "article_id").distinct().join(lists, "article_id")
    # fresh names, as both sides of a block come from the same pairs
    found = found.select(*[F.col(c).alias(c) for c in (*keys, "article_id", "n", "size", "packed")])
    counts = dealt.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(
        _count_block, f"user_id {user_type}, term string, qtf long")
    return counts.groupBy("user_id", "term").agg(F.sum("qtf").alias("qtf")) if cut else counts


def _pack_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed row (word lengths, counts, words) for the terms that a batch has of an article."""
    for batch in batches:
        names = batch["article_id"].dictionary_encode()
        rows = pa.table({"code": names.indices, "term": batch["term"], "tf": batch["tf"]}).sort_by([("code", "ascending"), ("term", "ascending")])
        words = rows["term"].combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        tf, data = rows["tf"].to_numpy(), memoryview(words.buffers()[2] or b"")
        n = np.bincount(rows["code"].to_numpy(), minlength=len(names.dictionary))
        parts, sizes, start = [], [], 0
        for end in np.cumsum(n):
            raw = np.diff(ends[start:end + 1]).astype(np.int32).tobytes() + tf[start:end].tobytes() + bytes(data[ends[start]:ends[end]])
            parts.append(pa.compress(raw, codec="zstd", asbytes=True))
            sizes.append(len(raw))
            start = end
        yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(n, pa.int32()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())],
                                         ["article_id", "n", "size", "packed"])


def _unpacked(lists: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.LargeStringArray, np.ndarray]:
    """(articles, first place and number of the terms of each, terms, counts); an article may come in several rows."""
    names = lists["article_id"].combine_chunks().dictionary_encode()
    code, n = names.indices.to_numpy(zero_copy_only=False), lists["n"].to_numpy().astype(np.int64)
    order = np.argsort(code, kind="stable")
    lengths, counts, words = [np.zeros(1, np.int64)], [np.empty(0)], []
    packed, raw_size = lists["packed"], lists["size"].to_numpy()
    for i in order:
        raw = pa.decompress(packed[int(i)].as_buffer(), int(raw_size[i]), codec="zstd", asbytes=True)
        lengths.append(np.frombuffer(raw, np.int32, n[i]))
        counts.append(np.frombuffer(raw, np.float64, n[i], 4 * n[i]))
        words.append(raw[12 * n[i]:])
    ends = np.cumsum(np.concatenate(lengths), dtype=np.int64)
    terms = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(words)))
    sizes = np.bincount(code, weights=n, minlength=len(names.dictionary)).astype(np.int64)
    return names.dictionary, np.cumsum(sizes) - sizes, sizes, terms, np.concatenate(counts)


def _count_block(clicks: pa.Table, lists: pa.Table) -> pa.Table:
    users = clicks["user_id"].combine_chunks().unique()
    clicks, at = _by_user(clicks, users)
    articles, firsts, sizes, terms, tf = _unpacked(lists)
    row = pa.compute.fill_null(pa.compute.index_in(clicks["article_id"].combine_chunks(), articles), -1).to_numpy(zero_copy_only=False)
    start, size = (np.where(row >= 0, np.append(x, 0)[row], 0) for x in (firsts, sizes))
    words = terms.dictionary_encode()
    code, known, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary)), clicks["_n"].to_numpy()
    of_user = np.repeat(np.arange(len(users)), np.diff(at))
    bounds = _cuts(np.add.reduceat(np.append(size, 0), at[:-1]) if len(users) else size, 1 << 20)
    parts = []
    for a, b in zip(bounds, bounds[1:]):
        mine = slice(at[a], at[b])
        place = _ranges(start[mine], size[mine])
        pairs, which = np.unique(np.repeat(of_user[mine], size[mine]) * known + code[place], return_inverse=True)
        qtf = np.bincount(which, weights=tf[place] * np.repeat(n[mine], size[mine]), minlength=len(pairs))
        parts.append((pairs, qtf))
    pairs, qtf = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, float), zip(*parts))) if parts else (np.empty(0, np.int64), np.empty(0))
    return pa.table([users.take(pa.array(pairs // known)), words.dictionary.take(pa.array(pairs % known)).cast(pa.string()), pa.array(qtf.astype(np.int64))],
                    names=["user_id", "term", "qtf"])


def bm25_index(articles: DataFrame, k1: float = 1.5, b: float = 0.75, idf_floor: float | None = 0.25,
               terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, article_id, weight). Build once, write as a table, reuse.

    ``terms`` is a stored :func:`doc_terms` table, if there is one already. A
    negative idf (a term in more than half of the articles) is replaced with
    ``idf_floor`` times the mean idf; None keeps it.
    """
    # the terms are read three times, so they are stored once instead of cutting all texts again
    terms = checkpointed(doc_terms(articles)) if terms is None else terms
    n_docs = articles.agg(F.count("*").cast("double")).scalar()
    avgdl = terms.agg(F.sum("tf")).scalar() / n_docs
    df = terms.groupBy("term").agg(F.count("*").alias("_df"))
    idf = df.select("term", (F.log(n_docs - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)).alias("idf"))
    if idf_floor is not None:
        floor = idf.agg(F.avg("idf")).scalar() * idf_floor
        idf = idf.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
    tf = F.col("tf").cast("double")
    saturation = tf + k1 * (1.0 - b + b * F.col("doc_len") / avgdl)
    return terms.join(idf, "term").select(
        "term", "article_id", (F.col("idf") * tf * (k1 + 1.0) / saturation).alias("weight"))


def bm25_score_all(qterms: DataFrame, postings: DataFrame, key: str = "query_id") -> DataFrame:
    """Score of every (query, article) pair that shares a term."""
    shared = qterms.join(postings, "term")
    return shared.groupBy(key, "article_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def block_top(scores: np.ndarray, ids: np.ndarray, ties: np.ndarray, k: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise first k columns by rounded score, then tie value, then id: (row, column) indices.

    Only columns that reach a bound of their row are sorted: its k-th best score, or the k-th best of
    the maxima of 64 columns each, which is no higher. ``most`` scores are worked on at once.
    """
    n, wide = scores.shape
    place = np.empty(wide, np.int64)
    place[np.lexsort((ids, ties))] = np.arange(wide)
    k, step = min(k, wide), max(1, most // max(1, wide))
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, n if k > 0 else 0, step):
        part = scores[a:a + step]
        if np.isnan(part.max()):
            part = np.where(np.isnan(part), -np.inf, part)
        tops = part if wide // 64 < 4 * k else part[:, :wide // 64 * 64].reshape(len(part), -1, 64).max(axis=2)
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
        near = np.where(np.isfinite(least), 2e-9 + 4e-15 * np.abs(least), 0.0)  # scores that are equal when rounded
        row, col = np.nonzero(part >= (least - near)[:, None])
        order = np.lexsort((place[col], -np.round(part[row, col], 9), row))
        row, col = row[order], col[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[best] + a)
        cols.append(col[best])
    return np.concatenate(rows), np.concatenate(cols)


def best_first() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("_tie"), F.col("article_id")]


def bm25_top_k(qterms: DataFrame, postings: DataFrame, articles: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Top k articles per query over the whole corpus, exact.

    A query without any known term returns no rows. Articles sharing no term
    score 0 and fill the list when needed.

    Posting lists are pruned by their largest weights. A first pass scores each query's
    strongest terms alone and then the k best articles so found with all terms; the least of
    these scores is a threshold the answer cannot fall below. Terms so weak that all of them together stay under it cannot bring an article
    into the list: their postings, the long ones, are read only for the few articles whose
    other terms come close enough. Queries and articles meet by common terms alone, and
    only sums leave a join. Long queries, which meet most postings, are scored in blocks instead.
    """
    if k <= 0:
        return qterms.select(key, F.lit(None).cast("string").alias("article_id"),
                             F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    # fresh columns, as both tables may come from one table of terms
    asked = checkpointed(qterms.select(F.col(key).alias(key), F.col("term").alias("term"), F.col("qtf").cast("double").alias("qtf")))
    lists = postings.select(F.col("term").alias("term"), F.col("article_id").alias("article_id"), F.col("weight").alias("weight"))
    lists = checkpointed(lists.join(asked.select("term").distinct(), "term", "left_semi"))  # read by every pass
    known = lists.groupBy("term").agg(F.max("weight").alias("_most"), F.min("weight").alias("_least"), F.count("*").alias("_df"))
    bounded = checkpointed(asked.join(known, "term").withColumn("_bound", F.col("qtf") * F.col("_most")))
    signed, met, n_asked = bounded.agg(F.count_if((F.col("_least") < 0) | (F.col("qtf") < 0)), F.coalesce(F.sum("_df"), F.lit(0)), F.count("*")).first()
    if signed or met > MET_POSTINGS * (lists.count() + n_asked):
        # sums of maxima are no bounds then, or the queries are so long that joins would hold nearly all pairs many times over
        return _bm25_top_k_signed(asked, lists, articles, k, key)
    strongest = W.partitionBy(key).orderBy(F.col("_bound").desc(), "term")
    read = F.coalesce(F.sum("_df").over(strongest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = bounded.withColumn("_read", read).filter(F.col("_read") < FIRST_POSTINGS * k)
    partial = first.join(lists, "term").groupBy(key, "article_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    best = partial.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc()))).filter(F.col("_n") <= k)

    def over(rows: DataFrame, terms: DataFrame) -> DataFrame:
        """(key, article_id, _more): what the terms add to the given articles."""
        pairs = rows.select(key, "article_id").join(terms.select(key, "term", "qtf"), key)
        return pairs.join(lists, ["article_id", "term"]).groupBy(key, "article_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("_more"))

    # a margin for sums in another order and for scores that are equal when rounded
    least = F.when(F.count("*") == k, F.min("_more") * (1 - 1e-9) - 1e-8).otherwise(F.lit(0.0))
    thresholds = over(checkpointed(best), bounded).groupBy(key).agg(least.alias("_need"))
    thresholds = checkpointed(thresholds)
    weaker = F.sum("_bound").over(strongest.rowsBetween(W.currentRow, W.unboundedFollowing))
    split = bounded.withColumn("_upto", weaker).join(thresholds, key)
    split = split.select(key, "term", "qtf", "_bound", "_need", (F.col("_upto") >= F.col("_need")).alias("_leads"))
    rest = split.groupBy(key, "_need").agg(F.sum(F.when(~F.col("_leads"), F.col("_bound")).otherwise(0.0)).alias("_rest"))
    led = split.filter("_leads").select(key, "term", "qtf").join(lists, "term").groupBy(key, "article_id").agg(
        F.sum(F.col("qtf") * F.col("weight")).alias("_sum"))
    close = checkpointed(led.join(rest, key).filter(F.col("_sum") + F.col("_rest") >= F.col("_need")).select(key, "article_id", "_sum"))
    added = over(close, split.filter("not _leads"))
    scored = close.join(added, [key, "article_id"], "left").select(
        key, "article_id", (F.col("_sum") + F.coalesce("_more", F.lit(0.0))).alias("score"), hash32("article_id").alias("_tie"))
    found = checkpointed(top_k(scored, [key], best_first(), k, "rank").drop("rank"))
    # lists shorter than k: of the first 2k articles in the order of ties, k at least are not in the list
    short = bounded.select(key).distinct().join(found.groupBy(key).agg(F.count("*").alias("_n")), key, "left").filter(F.coalesce("_n", F.lit(0)) < k)
    spare = articles.select("article_id", hash32("article_id").alias("_tie")).orderBy("_tie", "article_id").limit(2 * k)
    spare = short.select(key, F.lit(0.0).alias("score"), F.explode(F.array(F.lit(0))).alias("_one")).join(spare.withColumn("_one", F.explode(F.array(F.lit(0)))), "_one")
    fill = spare.drop("_one").join(found.select(key, "article_id"), [key, "article_id"], "left_anti")
    return top_k(found.unionByName(fill), [key], best_first(), k, "rank").drop("_tie").select(key, "article_id", "score", "rank")


def _bm25_top_k_signed(qterms: DataFrame, postings: DataFrame, articles: DataFrame, k: int, key: str,
                       block_terms: int = 4_000_000, block_postings: int = 4_000_000) -> DataFrame:
    """The same with weights of any sign, and for queries that meet a large share of all postings.

    Terms are numbered; blocks of queries meet blocks of articles in numpy, every score of a block is
    formed there and only its top k is shuffled. A block holds about ``block_terms`` terms of
    queries and ``block_postings`` postings; a table is copied once for each block of the other.
    """
    # fresh columns, as both tables may come from one table of terms
    qterms = qterms.select(F.col(key).alias(key), F.col("term").alias("term"), F.col("qtf").cast("double").alias("qtf"))
    postings = postings.select(F.col("term").alias("term"), F.col("article_id").alias("article_id"), F.col("weight").alias("weight"))
    both = qterms.select("term").distinct().join(postings.select("term").distinct(), "term")
    codes = checkpointed(global_index(both, [F.col("term")], "_code").select("term", F.col("_code").cast("int").alias("_code")))

    def listed(rows: DataFrame, owner: str, value: str, codes_as: str, values_as: str) -> DataFrame:
        lists = rows.join(codes, "term").groupBy(owner).agg(F.collect_list(F.struct("_code", value)).alias("_l"))
        return lists.select(owner, F.col("_l._code").alias(codes_as), F.col(f"_l.{value}").alias(values_as))

    asked = checkpointed(listed(qterms, key, "qtf", "q_codes", "qtfs"))
    held = listed(postings, "article_id", "weight", "codes", "weights")
    catalog = articles.select(F.col("article_id").alias("article_id"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    items = checkpointed(catalog.join(held, "article_id", "full").select("article_id", hash32("article_id").alias("_tie"), F.coalesce("codes", none[0]).alias("codes"),
                                                                        F.coalesce("weights", none[1]).alias("weights")))
    id_type = articles.schema["article_id"].dataType.simpleString()
    key_type = qterms.schema[key].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, ties, keys = right["article_id"].to_numpy(), right["_tie"].to_numpy(), left[key].to_numpy()
        size = right["codes"].map(len).to_numpy()
        code, weight = (np.concatenate([*right[c], np.empty(0, t)]) for c, t in (("codes", np.int32), ("weights", np.float64)))
        filled = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[filled]
        known, place = np.unique(code, return_inverse=True)
        step, parts = max(1, min(HELD_QUERIES, HELD_SCORES // max(1, len(ids)))), []
        bounds = _cuts(size[filled], HELD_POSTINGS)
        for a in range(0, len(left), step):
            n = min(step, len(left) - a)
            times = np.zeros((len(known) + 1, n))
            for i in range(n):
                at = np.minimum(np.searchsorted(known, left["q_codes"].iloc[a + i]), max(0, len(known) - 1))
                met = known[at] == left["q_codes"].iloc[a + i] if len(known) else np.zeros(len(at), bool)
                times[np.where(met, at, len(known)), i] = left["qtfs"].iloc[a + i]
            scores = np.zeros((len(ids), n))
            for b, c in zip(bounds, bounds[1:]):
                low, high = first[b], first[c - 1] + size[filled[c - 1]]
                scores[filled[b:c]] = np.add.reduceat(times[place[low:high]] * weight[low:high, None], first[b:c] - low, axis=0)
            scores = np.ascontiguousarray(scores.T)
            rows, cols = block_top(scores, ids, ties, k)
            parts.append((rows + a, cols, scores[rows, cols]))
        rows, cols, best = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({key: keys[rows], "article_id": ids[cols], "_tie": ties[cols], "score": best})

    n_asked, n_terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("q_codes")), F.lit(0))).first()
    n_items, n_postings = items.agg(F.count("*"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    rows = [max(1, int(n / max(1.0, total / most))) for n, total, most in ((n_asked, n_terms, block_terms), (n_items, n_postings, block_postings))]
    local = block_pairs(asked, items, key, "article_id", run, f"{key} {key_type}, article_id {id_type}, _tie bigint, score double",
                        left_rows=rows[0], right_rows=rows[1], spread=True)
    return top_k(local, [key], best_first(), k, "rank").drop("_tie")


def _term_lists(table: DataFrame, value: str, dealt: DataFrame) -> DataFrame:
    """(_pack, _part, article_id, terms, values): each block gets the terms of its articles, one row an article."""
    lists = table.filter(F.col("term").isNotNull()).select(F.col("article_id").alias("article_id"), F.col("term").alias("_t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    lists = lists.groupBy("article_id").agg(F.collect_list(F.struct("_t", "_v")).alias("_l"))
    wanted = dealt.select("_pack", "_part", "article_id").distinct()
    found = wanted.join(lists, "article_id")
    # fresh names, as both sides of a block come from the same pairs
    return found.select(*[F.col(c).alias(c) for c in ("_pack", "_part", "article_id")], F.col("_l._t").alias("terms"), F.col("_l._v").alias("values"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _cuts(sizes: np.ndarray, limit: int) -> list[int]:
    """Bounds of runs whose sizes sum to about ``limit``, or hold one item."""
    run = np.cumsum(sizes) // limit
    return [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)] if len(sizes) else [0]


def _lists_of(lists: pa.Table, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of the list of each named article; length 0 without a list."""
    sizes = pa.compute.list_value_length(lists["terms"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    row = pa.compute.fill_null(pa.compute.index_in(names, lists["article_id"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
    known = row >= 0
    return np.where(known, np.append(first, 0)[row], 0), np.where(known, np.append(sizes, 0)[row], 0)


def _by_user(table: pa.Table, users: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """The rows in the order of ``users``, and the first row of each user (one bound more than users)."""
    code = pa.compute.index_in(table["user_id"].combine_chunks(), users).to_numpy(zero_copy_only=False).astype(np.int64)
    return table.take(np.argsort(code, kind="stable")), np.append(0, np.cumsum(np.bincount(code, minlength=len(users))))


def score_pairs(pairs: DataFrame, qterms: DataFrame, postings: DataFrame, block_rows: int = 16384, block_terms: int = 1_000_000) -> DataFrame:
    """BM25 total of the given distinct (user_id, article_id) pairs; pairs sharing no term are absent.

    Pairs are dealt to blocks of users. A block gets the terms of its users and, once each, the
    postings of the articles it asks for; terms meet inside the block, and only scores leave
    it. A user with more than ``block_rows`` pairs is spread over several blocks.
    """
    pairs = checkpointed(pairs.select("user_id", "article_id").dropna())
    asked = qterms.filter(F.col("term").isNotNull()).select(F.col("user_id").alias("user_id"), F.col("term").alias("term"), F.col("qtf").cast("double").alias("qtf"))
    asked = checkpointed(asked.join(pairs.select("user_id").distinct(), "user_id", "left_semi"))
    dealt, owners, cut = owner_blocks(pairs, "user_id", "article_id", block_rows, -(-asked.count() // block_terms))
    if cut:
        asked = asked.join(owners, "user_id").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    else:
        asked = asked.join(owners.drop("_parts"), "user_id").withColumn("_part", F.lit(0).cast("long"))
    left = dealt.select("_pack", "_part", "user_id", "article_id", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("qtf"))
    left = left.unionByName(asked, allowMissingColumns=True)
    types = {c: pairs.schema[c].dataType.simpleString() for c in ("user_id", "article_id")}
    keys = ["_pack", "_part"]
    return left.groupBy(*keys).cogroup(_term_lists(postings, "weight", dealt).groupBy(*keys)).applyInArrow(
        _score_block, f"user_id {types['user_id']}, article_id {types['article_id']}, score double")


def _score_block(left: pa.Table, lists: pa.Table) -> pa.Table:
    terms_only = pa.compute.is_valid(left["term"])
    queries, pairs = left.filter(terms_only), left.filter(pa.compute.invert(terms_only))
    users = left["user_id"].combine_chunks().unique()
    vocabulary = queries["term"].combine_chunks().unique()

    queries, q_at = _by_user(queries, users)
    pairs, p_at = _by_user(pairs, users)
    term = pa.compute.index_in(queries["term"].combine_chunks(), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    qtf = queries["qtf"].to_numpy()
    # terms no query has point to a last place, which stays 0
    listed = pa.compute.fill_null(pa.compute.index_in(lists["terms"].combine_chunks().flatten(), vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False)
    weight = lists["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    start, size = _lists_of(lists, pairs["article_id"].combine_chunks())
    score, shared = np.zeros(len(size)), np.zeros(len(size), bool)
    times, present = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1, bool)
    for u in range(len(users)):
        mine = slice(q_at[u], q_at[u + 1])
        np.add.at(times, term[mine], qtf[mine])
        present[term[mine]] = True
        bounds = [p_at[u] + c for c in _cuts(size[p_at[u]:p_at[u + 1]], 1 << 20)]
        for a, b in zip(bounds, bounds[1:]):
            at = _ranges(start[a:b], size[a:b])
            pair = np.repeat(np.arange(b - a), size[a:b])
            met = present[listed[at]]
            at, pair = at[met], pair[met]
            score[a:b] = np.bincount(pair, weights=times[listed[at]] * weight[at], minlength=b - a)
            shared[a:b] = np.bincount(pair, minlength=b - a) > 0
        times[term[mine]], present[term[mine]] = 0.0, False
    out = pa.table([pairs["user_id"], pairs["article_id"], pa.array(score)], names=["user_id", "article_id", "score"])
    return out.filter(pa.array(shared))


@dataclass(frozen=True)
class ClickedTerms:
    """The queries of :func:`user_query` as their parts: ``hist`` (user_id, article_id) and ``terms`` of the articles.

    Written out, they have a row for each user and each word the user has met; scoring needs no such table.
    """
    hist: DataFrame
    terms: DataFrame


def zipped(table: pa.Table) -> bytes:
    """The table as one compressed value; a column of terms is best given as a dictionary."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unzipped(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def _by_slice(batches: Iterator[pa.RecordBatch], at_once: int = 250_000) -> Iterator[pa.RecordBatch]:
    """One compressed row for each slice of about ``at_once`` rows (_slice, _asked, article_id, term, value)."""
    held: list[pa.RecordBatch] = []

    def flushed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(np.argsort(rows["_slice"].to_numpy(), kind="stable"))
        names, at, n = np.unique(rows["_slice"].to_numpy(), return_index=True, return_counts=True)
        parts = (rows.slice(a, k).select(["article_id", "term", "value"]).combine_chunks() for a, k in zip(at.tolist(), n.tolist()))
        packed = [zipped(t.set_column(1, "term", t["term"].combine_chunks().dictionary_encode())) for t in parts]
        asked = pa.array([held[0]["_asked"][0].as_py()] * len(packed), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(names), asked, pa.array(packed, pa.binary())], ["_slice", "_asked", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= at_once:
            yield flushed()
            held.clear()
    if held:
        yield flushed()


def _turned_round(rows: pa.Table) -> pa.Table:
    """One row for a slice: the articles of each side with the terms that the other side has too, as numbers inside the slice."""
    sides = {asked: [unzipped(x) for x in rows.filter(pa.compute.equal(rows["_asked"], asked))["packed"]] for asked in (True, False)}

    def words(tables: list[pa.Table]) -> pa.Array:
        return pa.chunked_array([c.dictionary for t in tables for c in t["term"].chunks], pa.string()).unique()

    given, met = (words(sides[asked]) for asked in (True, False))
    vocabulary = met.filter(pa.compute.is_in(met, given))
    out: dict[str, list] = {"known": [len(vocabulary)]}
    for name, asked in (("given", True), ("met", False)):
        codes = [pa.compute.fill_null(pa.compute.index_in(c.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)[c.indices.to_numpy(zero_copy_only=False)]
                 for t in sides[asked] for c in t["term"].chunks]
        code = np.concatenate([np.empty(0, np.int32), *codes])
        if not len(vocabulary) or not len(code):
            return pa.table({"known": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in SLICE[1:]}})
        kept = np.flatnonzero(code >= 0)
        table = pa.concat_tables([t.select(["article_id", "value"]) for t in sides[asked]])
        articles = table["article_id"].take(kept).combine_chunks().dictionary_encode()
        article = articles.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((code[kept], article))
        sizes = np.bincount(article, minlength=len(articles.dictionary)).astype(np.int32)
        out[f"{name}_articles"] = [zipped(pa.table({"article_id": articles.dictionary, "size": sizes}))]
        out[name] = [zipped(pa.table({"term": code[kept][order], "value": table["value"].to_numpy()[kept][order]}))]
    return pa.table({"known": pa.array(out["known"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in SLICE[1:]}})


def dealt_pairs(pairs: DataFrame, facts: DataFrame, pack_rows: int, more: int = 0) -> tuple[int, DataFrame, DataFrame]:
    """Number of packs, and both tables (with a user_id) with their ``_pack``: a user with more than ``pack_rows`` pairs is spread over several.

    ``facts`` go to all packs of their user; ``more`` is the number of their rows, if it counts. There are no more packs
    than the rows or the idle cores ask for.
    """
    n_pairs, tasks = pairs.count(), 2 * pairs.sparkSession.sparkContext.defaultParallelism
    packs = max(1, -(-(n_pairs + more) // pack_rows), min(tasks, -(-n_pairs // 16384)))
    load = pairs.groupBy("user_id").agg(F.count("*").alias("_load"))
    most = load.agg(F.max("_load")).first()[0] or 0
    pack = F.pmod(F.xxhash64("user_id"), F.lit(packs))
    if most <= pack_rows:
        return packs, pairs.withColumn("_pack", pack), facts.withColumn("_pack", pack)
    cut = load.select(F.col("user_id").alias("_owner"), F.least(F.ceil(F.col("_load") / pack_rows), F.lit(packs)).alias("_parts"))
    part = F.pmod(F.xxhash64("article_id"), F.col("_parts"))
    dealt, own = (t.join(cut, F.col("user_id").eqNullSafe(F.col("_owner"))) for t in (pairs, facts))
    dealt = dealt.withColumn("_pack", F.pmod(pack + part, F.lit(packs))).drop("_owner", "_parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part")
    own = own.select("*", every).withColumn("_pack", F.pmod(pack + F.col("_part"), F.lit(packs))).drop("_owner", "_parts", "_part")
    return packs, dealt, own


SLICE = ["known", "given_articles", "given", "met_articles", "met"]
PACK = ["_pack", "users", "articles", "pairs", "clicks"]


def _packed_users(rows: pa.Table) -> pa.Table:
    """One row for a pack: its users, its articles, and the pairs and clicks of each user as numbers of articles."""
    asked = pa.compute.is_null(rows["_n"])
    pairs, clicks = rows.filter(asked), rows.filter(pa.compute.invert(asked))
    users = pairs["user_id"].combine_chunks().unique()
    clicks = clicks.filter(pa.compute.is_in(clicks["user_id"], users))
    articles = pa.chunked_array([*pairs["article_id"].chunks, *clicks["article_id"].chunks], rows.schema.field("article_id").type).unique()
    sides, counts = [], []
    for table in (pairs, clicks):
        user, code = (pa.compute.index_in(table[c].combine_chunks(), of).to_numpy(zero_copy_only=False).astype(np.int32)
                      for c, of in (("user_id", users), ("article_id", articles)))
        order = np.lexsort((code, user))
        counts.append(np.bincount(user, minlength=len(users)).astype(np.int64))
        sides.append({"code": code[order], "n": table["_n"].to_numpy()[order]})
    sides[0].pop("n")
    tables = [{"user_id": users, "pairs": counts[0], "clicks": counts[1]}, {"article_id": articles}, *sides]
    return pa.table({"_pack": rows["_pack"].slice(0, 1), **{c: pa.array([zipped(pa.table(t))], pa.binary()) for c, t in zip(PACK[1:], tables)}})


class _Pack:
    """Scores of the pairs of a pack, to which one slice of terms after the other is added."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.users, articles, pairs, clicks = (unzipped(row[c]) for c in PACK[1:])
        self.articles = articles["article_id"].combine_chunks()
        self.pair, self.click = (t["code"].to_numpy() for t in (pairs, clicks))
        self.n = clicks["n"].to_numpy()
        self.p_at, self.c_at = (np.append(0, np.cumsum(self.users[c].to_numpy())) for c in ("pairs", "clicks"))
        self.p_user, self.c_user = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (self.p_at, self.c_at))
        self.score, self.shared, self.known = np.zeros(len(self.pair)), np.zeros(len(self.pair), bool), np.zeros(len(self.pair), bool)

    def catalogued(self, articles: pa.Table) -> None:
        self.known |= pa.compute.is_in(self.articles, articles["article_id"].combine_chunks()).to_numpy(zero_copy_only=False)[self.pair]

    def _placed(self, row: dict[str, pa.Scalar], side: str, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """First entry and number of entries for each article of ``of``, and the terms and values of all entries."""
        named, entries = unzipped(row[f"{side}_articles"]), unzipped(row[side])
        sizes = np.append(named["size"].to_numpy(), 0).astype(np.int64)
        at = pa.compute.fill_null(pa.compute.index_in(self.articles, named["article_id"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        return (np.cumsum(sizes) - sizes)[at][of], sizes[at][of], entries["term"].to_numpy(), entries["value"].to_numpy()

    def add(self, row: dict[str, pa.Scalar]) -> None:
        known = row["known"].as_py()
        start, size, term, weight = self._placed(row, "given", self.pair)
        c_start, c_size, c_term, tf = self._placed(row, "met", self.click)
        plain = bool((tf > 0).all())  # sums of counts show by themselves then which terms a user has met
        at_once = max(1, HELD_TIMES // known)
        times = np.zeros(min(at_once, len(self.users)) * known)
        present = times if plain else np.zeros(len(times))
        load = np.append(0, np.cumsum(size))[self.p_at]
        loads = np.diff(load)
        bounds = sorted({*_cuts(loads, HELD_TIMES), *range(0, len(self.users), at_once)})
        for a, b in zip(bounds, bounds[1:]):
            if not loads[a:b].any():
                continue
            used = []
            for c, d in _spans(c_size[self.c_at[a]:self.c_at[b]]):
                mine = slice(self.c_at[a] + c, self.c_at[a] + d)
                at = _ranges(c_start[mine], c_size[mine])
                key = c_term[at] + np.repeat((self.c_user[mine] - a) * known, c_size[mine])
                np.add.at(times, key, tf[at] * np.repeat(self.n[mine], c_size[mine]))
                if not plain:
                    present[key] = 1.0
                used.append(key)
            if not any(map(len, used)):
                continue
            for c, d in _spans(size[self.p_at[a]:self.p_at[b]]):
                mine = self.p_at[a] + c + np.flatnonzero(size[self.p_at[a] + c:self.p_at[a] + d])
                if not len(mine):
                    continue
                at, first = _ranges(start[mine], size[mine]), np.cumsum(size[mine]) - size[mine]
                key = term[at] + np.repeat((self.p_user[mine] - a) * known, size[mine])
                found = times[key]
                self.score[mine] += np.add.reduceat(found * weight[at], first)
                self.shared[mine] |= np.add.reduceat(found if plain else present[key], first) > 0
            for key in used:
                times[key] = 0.0
                present[key] = 0.0

    def result(self) -> pa.RecordBatch:
        users = self.users["user_id"].combine_chunks().take(pa.array(self.p_user))
        return pa.RecordBatch.from_arrays([users, self.articles.take(pa.array(self.pair)), pa.array(self.score, mask=~self.shared), pa.array(self.known)],
                                          ["user_id", "article_id", "score", "known"])


def _score_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs: dict[int, _Pack] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i] for c in batch.schema.names}
            name = row["_pack"].as_py()
            if name not in packs:
                packs[name] = _Pack(row)
            if row["known"].is_valid:
                packs[name].add(row)
            elif row["given_articles"].is_valid:
                packs[name].catalogued(unzipped(row["given_articles"]))
    for pack in packs.values():
        yield pack.result()


def _catalogue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([zipped(pa.table(batch))], pa.binary())], ["given_articles"])


def _clicked_scores(pairs: DataFrame, clicked: ClickedTerms, postings: DataFrame, articles: DataFrame | None, pack_rows: int, slice_terms: int) -> DataFrame:
    """(user_id, article_id, score, known) of each pair without nulls: the score is null without a shared term, known tells whether ``articles`` has it.

    Terms are dealt to slices and users to packs, which are stored as compressed rows. A task reads all slices, one after the other,
    for one pack and adds to the pack's scores: neither table is copied for the other, and only scores leave a task.
    A user with more than ``pack_rows`` pairs is spread over several packs.
    """
    spark = pairs.sparkSession
    clicks = clicked.hist.select("user_id", "article_id").dropna().join(pairs.select("user_id").distinct(), "user_id", "left_semi")
    clicks = checkpointed(clicks.groupBy("user_id", "article_id").agg(F.count("*").cast("double").alias("_n")))
    sides, slices = [], 1
    for table, value, asked in ((postings, "weight", pairs), (clicked.terms, "tf", clicks)):
        wanted = checkpointed(asked.select("article_id").distinct())
        table = table.filter(F.col("term").isNotNull() & F.col("article_id").isNotNull()).select(
            F.col("article_id").alias("article_id"), F.col("term").alias("term"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
        per = table.groupBy("article_id").agg(F.count("*").alias("_k"))
        total = per.agg(F.sum("_k")).first()[0] or 0
        few = per.join(wanted, "article_id", "left_semi").agg(F.sum("_k")).first()[0] or 0
        # where most are wanted, the others cost less than a join that would shuffle every row
        sides.append(table if 2 * few > total else table.join(wanted, "article_id", "left_semi"))
        slices = max(slices, -(-(total if 2 * few > total else few) // slice_terms))
    packs, dealt, own = dealt_pairs(pairs, clicks, pack_rows, clicks.count())
    rows = dealt.select("_pack", "user_id", "article_id", F.lit(None).cast("double").alias("_n")).unionByName(own.select("_pack", "user_id", "article_id", "_n"))
    rows = checkpointed(rows.groupBy("_pack").applyInArrow(_packed_users, "_pack long, users binary, articles binary, pairs binary, clicks binary"))

    chunks = None
    for table, asked in zip(sides, (True, False)):
        table = table.select(F.pmod(F.xxhash64("term"), F.lit(slices)).alias("_slice"), F.lit(asked).alias("_asked"), "article_id", "term", "value")
        table = table.mapInArrow(_by_slice, "_slice long, _asked boolean, packed binary")
        chunks = table if chunks is None else chunks.unionByName(table)
    kinds = "known int, given_articles binary, given binary, met_articles binary, met binary"
    lists = checkpointed(chunks.groupBy("_slice").applyInArrow(_turned_round, kinds))
    # a pack meets this row even if there are no lists
    lists = spark.range(1).select(F.lit(None).cast("int").alias("known")).unionByName(lists, allowMissingColumns=True)
    if articles is not None:
        held = checkpointed(articles.select("article_id").dropna().distinct())
        lists = lists.unionByName(held.mapInArrow(_catalogue, "given_articles binary"), allowMissingColumns=True)
    # one partition is read row by row for each partition of the other side, which is one pack and held
    met = lists.coalesce(1).hint("shuffle_replicate_nl").crossJoin(rows.repartitionById(packs, F.col("_pack").cast("int")))
    types = {c: pairs.schema[c].dataType.simpleString() for c in ("user_id", "article_id")}
    return met.select(*SLICE, *PACK).mapInArrow(_score_packs, f"user_id {types['user_id']}, article_id {types['article_id']}, score double, known boolean")


def score_clicked(pairs: DataFrame, clicked: ClickedTerms, postings: DataFrame, pack_rows: int = 2_500_000,
                  slice_terms: int = 1_000_000) -> DataFrame:
    """:func:`score_pairs` for the words of the articles each user has clicked, whose counts are added where they are used."""
    pairs = checkpointed(pairs.select("user_id", "article_id").dropna())
    return _clicked_scores(pairs, clicked, postings, None, pack_rows, slice_terms).filter("score is not null").drop("known")


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = _cuts(sizes, 1 << 20)
    return zip(bounds, bounds[1:])


def bm25_pairs(pairs: DataFrame, qterms: DataFrame | ClickedTerms, postings: DataFrame, articles: DataFrame,
               out: str = "score") -> DataFrame:
    """(user_id, article_id, out): 0 without shared terms, -inf outside the catalogue. Clicked terms read ``pairs`` several times; give a stored table."""
    catalog = articles.select("article_id").distinct().withColumn("_known", F.lit(True))
    total = F.when(F.col("_known").isNull(), F.lit(float("-inf"))).otherwise(F.coalesce("_s", F.lit(0.0))).alias(out)
    if not isinstance(qterms, ClickedTerms):
        scores = score_pairs(pairs, qterms, postings).withColumnRenamed("score", "_s")
        rows = pairs.join(scores, ["user_id", "article_id"], "left").join(catalog, "article_id", "left")
        return rows.select("user_id", "article_id", total)
    pairs = pairs.select("user_id", "article_id")
    scores = _clicked_scores(pairs.dropna(), qterms, postings, articles, 2_500_000, 1_000_000).select(
        "user_id", "article_id", F.when(F.col("known"), F.coalesce("score", F.lit(0.0))).otherwise(F.lit(float("-inf"))).alias(out))
    unnamed = pairs.filter(F.col("user_id").isNull() | F.col("article_id").isNull())
    if unnamed.isEmpty():
        return checkpointed(scores)
    unnamed = unnamed.join(catalog, "article_id", "left").withColumn("_s", F.lit(0.0)).select("user_id", "article_id", total)
    return checkpointed(scores.unionByName(unnamed))


def bm25_score_candidates(imp: DataFrame, qterms: DataFrame | ClickedTerms, postings: DataFrame, articles: DataFrame,
                          out: str = "score") -> DataFrame:
    """Score of each shown candidate; ``qterms`` are given as a table or as the clicks they come from.

    Each (user, article) pair is scored once, however many impressions repeat it,
    and postings of articles that are no candidates are never joined to queries.
    """
    pairs = imp.select("user_id", "article_id").distinct()
    if isinstance(qterms, ClickedTerms):
        pairs = checkpointed(pairs)
    return imp.join(bm25_pairs(pairs, qterms, postings, articles, out), ["user_id", "article_id"])
