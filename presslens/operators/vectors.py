"""Text encoding, vector alignment, pooling, exact and approximate k-NN, candidate scoring."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from presslens.functions.blocks import block_pairs
from presslens.functions.expr import doubles, hash32, unit
from presslens.functions.grouping import checkpointed, row_numbers, top_k
from presslens.functions.vectors import dimension, sum_vector
from presslens.operators.text import article_text, best_first, block_top, dealt_pairs, tokenize, unzipped, zipped

MINUS_INF = float("-inf")


def encode_text(articles: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64,
                seed: int = 0, min_count: int = 2, batch: int = 64) -> DataFrame:
    """(article_id, vec): unit vectors of ``title + ' ' + abstract``.

    ``encoder`` maps a list of texts to a matrix and runs on Arrow batches. Without
    one, Spark ML's Word2Vec is fitted on the articles' own tokens, with a bounded number of
    different words (:func:`_named_words`).
    """
    if encoder is not None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                parts = [encoder(frame["text"].iloc[i:i + batch].tolist()) for i in range(0, len(frame), batch)]
                rows = [v for p in parts for v in np.asarray(p, dtype=np.float64)]
                yield pd.DataFrame({"article_id": frame["article_id"], "vec": rows})
        id_type = articles.schema["article_id"].dataType.simpleString()
        texts = articles.select("article_id", article_text(articles).alias("text"))
        raw = texts.mapInPandas(run, f"article_id {id_type}, vec array<double>")
        return raw.select("article_id", unit("vec").alias("vec"))
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    tokens = articles.select("article_id", F.monotonically_increasing_id().alias("_row"), tokenize(article_text(articles)).alias("tokens"))
    tokens, partitions = _named_words(checkpointed(tokens), min_count)
    model = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="_v").fit(tokens)
    return model.transform(tokens).select("article_id", unit(vector_to_array("_v")).alias("vec"))


#: Words with vectors of their own, if there are more than MAX_WORDS; the others share the vectors that are left.
OWN_WORDS, MAX_WORDS = 49_152, 65_536
#: Words that one task learns from, about.
TASK_WORDS = 5_000_000


def _named_words(tokens: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """(article_id, tokens) with at most ``MAX_WORDS`` different words, and the number of tasks to learn from them.

    Word2Vec keeps its whole vocabulary in the driver, which therefore must not grow with the texts. Where more
    words occur ``min_count`` times, the most frequent keep their names and each of the others
    gets one of the names left, by its hash; no word is left out that had a vector before.
    """
    words = tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count)
    words = checkpointed(words)
    n, total = words.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    partitions = max(1, math.ceil(total / TASK_WORDS))
    if n <= MAX_WORDS:
        return tokens, partitions
    own = [r.term for r in words.orderBy(F.col("_n").desc(), "term").limit(OWN_WORDS).select("term").collect()]  # OWN_WORDS rows
    # the others are looked up once a text; texts travel as numbers
    kind = {c: tokens.schema[c].dataType.simpleString() for c in ("article_id", "_row")}
    texts = tokens.mapInArrow(_numbered(own, MAX_WORDS - OWN_WORDS), f"article_id {kind['article_id']}, _row {kind['_row']}, codes array<int>, others array<string>, names array<int>")
    others = texts.select("_row", F.posexplode("others").alias("_at", "term"))
    left_out = others.join(words.select("term"), "term", "left_anti").groupBy("_row").agg(F.collect_list("_at").alias("_out"))
    rows = texts.select("article_id", "_row", "codes", "names").join(left_out, "_row", "left").drop("_row")
    return checkpointed(rows.mapInArrow(_named(own), f"article_id {kind['article_id']}, tokens array<string>")), partitions


def _numbered(own: list[str], shared: int):
    """Tokens as their places in ``own``, or -1 - i for the text's i-th other word; ``names`` has the shared name of each of these, by its hash."""
    vocabulary = pa.array(own, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            words = batch.column("tokens").flatten().dictionary_encode()
            known, row = max(1, len(words.dictionary)), np.repeat(np.arange(len(size)), size)
            word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pa.compute.fill_null(pa.compute.index_in(words.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)[word]
            other = codes < 0
            keys, which = np.unique(row[other] * known + word[other], return_inverse=True)
            first = np.searchsorted(keys, np.arange(len(size) + 1) * known)
            codes[other] = -1 - (which - first[row[other]])
            name = np.array([zlib.crc32(w.encode()) % shared for w in words.dictionary.to_pylist()], np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), values) for at, values in (
                (np.append(0, np.cumsum(size)), pa.array(codes)), (first, words.dictionary.take(pa.array(keys % known))), (first, pa.array(name[keys % known])))]
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), batch.column("_row"), *lists], ["article_id", "_row", "codes", "others", "names"])

    return run


def _named(own: list[str]):
    """The tokens of :func:`_numbered` by name, without the other words whose places are in ``_out``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for codes, names, out in zip(*(batch.column(c).to_pylist() for c in ("codes", "names", "_out")), strict=True):
                other = [f"#{n}" for n in names]  # no word has this sign
                for i in out or ():
                    other[i] = None
                named = (own[c] if c >= 0 else other[-1 - c] for c in codes)
                texts.append([n for n in named if n is not None])
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), pa.array(texts, pa.list_(pa.string()))], ["article_id", "tokens"])

    return run


def encode_incremental(articles: DataFrame, store_path: str, model: str,
                       encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of exactly these articles under ``model``; only new or changed texts are encoded.

    The store has a folder for each model, to which only keys (article_id, text hash)
    it lacks are appended, in one committed job: a key is there once, and a row made
    by another model or from an older text is never read or used.
    """
    spark = articles.sparkSession
    keyed = articles.withColumn("text_hash", F.sha2(article_text(articles), 256))
    key = ["article_id", "text_hash"]
    id_type = articles.schema["article_id"].dataType.simpleString()
    folder = f"{store_path}/model={model}"

    def stored() -> DataFrame | None:
        try:
            return spark.read.schema(f"article_id {id_type}, text_hash string, vec array<double>").parquet(folder)
        except AnalysisException:
            return None  # nothing written yet

    known = stored()
    missing = keyed if known is None else keyed.join(known.select(*key), key, "left_anti")
    fresh = encode(missing).join(keyed.select(*key), "article_id").select(*key, doubles("vec").alias("vec"))
    fresh.write.mode("append").parquet(folder)
    return keyed.select(*key).join(stored(), key).select("article_id", "vec")


def align_vectors(vecs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unit vectors of catalogue articles; ids outside it and zero vectors are dropped."""
    rows = vecs.join(catalog.select("article_id").distinct(), "article_id", "left_semi")
    return rows.select("article_id", unit("vec").alias("vec")).filter(F.col("vec").isNotNull())


def vector_coverage(aligned: DataFrame, catalog: DataFrame) -> DataFrame:
    from presslens.operators.audit import coverage
    return coverage(catalog, aligned)


def _pooled(weighted: DataFrame, key: str, vecs: DataFrame) -> DataFrame:
    """Normalised weighted sum per key of rows (key, article_id, _w)."""
    joined = weighted.join(vecs.select("article_id", "vec"), "article_id")
    sums = joined.groupBy(key).agg(sum_vector("vec", "_w").alias("_sum"))
    return sums.select(key, unit("_sum").alias("vec")).filter(F.col("vec").isNotNull())


def pool_mean(hist: DataFrame, vecs: DataFrame) -> DataFrame:
    """(user_id, vec): normalised mean of the history vectors.

    A user without resolvable history, or with a zero sum, has no row: that is the
    null vector once joined. (The mean and the sum have the same direction.)
    """
    clicks = hist.groupBy("user_id", "article_id").agg(F.count("*").cast("double").alias("_w"))
    return _pooled(clicks, "user_id", vecs)


def _recency(hist: DataFrame, vecs: DataFrame, decay: float, hot_limit: int | None) -> DataFrame:
    resolvable = hist.select("user_id", "pos", "article_id").join(vecs.select("article_id"), "article_id", "left_semi")
    ranked = row_numbers(resolvable, ["user_id"], [F.col("pos").desc()], "_back", hot_limit)
    weight = F.pow(F.lit(decay), F.col("_back") - 1)
    return ranked.groupBy("user_id", "article_id").agg(F.sum(weight).alias("_w"))


def pool_recency(hist: DataFrame, vecs: DataFrame, decay: float = 0.9,
                 hot_limit: int | None = None) -> DataFrame:
    """Like :func:`pool_mean` with weight ``decay**i``, i counted back over resolvable clicks."""
    return _pooled(_recency(hist, vecs, decay, hot_limit), "user_id", vecs)


def entity_mentions(articles: DataFrame, col: str = "entities") -> DataFrame:
    """(article_id, entity_id, confidence) multiset from both JSON fields; malformed text has none."""
    mention = "array<struct<WikidataId:string,Confidence:double>>"
    parsed = F.from_json(col, f"title_entities {mention}, abstract_entities {mention}")
    empty = F.array().cast(mention)
    both = F.concat(F.coalesce(parsed["title_entities"], empty), F.coalesce(parsed["abstract_entities"], empty))
    rows = articles.select("article_id", F.explode(both).alias("m"))
    return rows.select("article_id", F.col("m.WikidataId").alias("entity_id"), F.col("m.Confidence").alias("confidence")
                       ).filter((F.col("entity_id") != "") & F.col("confidence").isNotNull())


def entity_vectors(articles: DataFrame, mentions: DataFrame, vecs: DataFrame, dim: int | None = None) -> DataFrame:
    """Confidence-weighted mean entity vector of every article; a zero vector where nothing resolves.

    ``vecs`` is (entity_id, vec). Column ``covered`` tells real vectors from fill.
    """
    dim = dim or dimension(vecs)
    weighted = mentions.filter(F.col("confidence") > 0).groupBy("article_id", "entity_id").agg(
        F.sum("confidence").alias("_w"))
    sums = weighted.join(vecs, "entity_id").groupBy("article_id").agg(
        sum_vector("vec", "_w").alias("_sum"))
    pooled = sums.select("article_id", unit("_sum").alias("_vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return articles.select("article_id").join(pooled, "article_id", "left").select(
        "article_id", F.coalesce("_vec", zero).alias("vec"), F.col("_vec").isNotNull().alias("covered"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


#: Scores of a block that are held at once.
HELD_SCORES = 1 << 22


def _knn_blocks(queries: DataFrame, items: DataFrame, k: int, key: str, by: list[str] | None,
                left_rows: int, right_rows: int) -> DataFrame:
    key_type = queries.schema[key].dataType.simpleString()
    id_type = items.schema["article_id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked, known = _matrix(left["vec"]), _matrix(right["vec"]).T
        ids, ties, keys = right["article_id"].to_numpy(), right["_tie"].to_numpy(), left[key].to_numpy()
        step, parts = max(1, HELD_SCORES // len(ids)), []
        for a in range(0, len(asked), step):
            scores = asked[a:a + step] @ known
            rows, cols = block_top(scores, ids, ties, k)
            parts.append((rows + a, cols, scores[rows, cols]))
        rows, cols, best = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({key: keys[rows], "article_id": ids[cols], "_tie": ties[cols], "score": best})

    left = queries.filter(F.col("vec").isNotNull()).select(key, doubles("vec").alias("vec"), *(by or []))
    right = items.select("article_id", doubles("vec").alias("vec"), hash32("article_id").alias("_tie"), *(by or []))
    return block_pairs(left, right, key, "article_id", run,
                       f"{key} {key_type}, article_id {id_type}, _tie bigint, score double",
                       by=by, left_rows=left_rows, right_rows=right_rows, spread=True)


def knn(queries: DataFrame, vecs: DataFrame, k: int, key: str = "query_id", left_rows: int = 16384,
        right_rows: int = 65536) -> DataFrame:
    """Exact top k by dot product of unit vectors; a null query vector has no rows.

    Query and vector blocks are multiplied in numpy, a few rows at a time; a block returns its top k
    only. A table is copied once for each block of the other, hence the large blocks.
    """
    return top_k(_knn_blocks(queries, vecs, k, key, None, left_rows, right_rows), [key], best_first(), k, "rank").drop("_tie")


def ivf_build(vecs: DataFrame, nlist: int, seed: int = 0, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """Cells by k-means: (cell, vec) centroids and (article_id, vec, cell) members."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    points = vecs.select("article_id", doubles("vec").alias("vec")).withColumn("_p", array_to_vector("vec"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_p", predictionCol="cell").fit(points)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # nlist rows
    centroids = vecs.sparkSession.createDataFrame(centres, "cell int, vec array<double>")
    return centroids, model.transform(points).drop("_p")


def ivf_knn(queries: DataFrame, centroids: DataFrame, members: DataFrame, nprobe: int, k: int,
            key: str = "query_id", left_rows: int = 16384, right_rows: int = 65536) -> DataFrame:
    """Approximate top k: search only the ``nprobe`` cells nearest to the query; scores are exact."""
    near = centroids.select(F.col("cell").alias("article_id"), unit("vec").alias("vec")).filter(F.col("vec").isNotNull())
    probes = knn(queries, near, nprobe, key).select(key, F.col("article_id").alias("cell"))
    routed = queries.select(key, "vec").join(probes, key)
    found = _knn_blocks(routed, members, k, key, ["cell"], left_rows, right_rows)
    return top_k(found, [key], best_first(), k, "rank").drop("_tie")


def ivf_lists(rows: int) -> int:
    """Number of cells for so many vectors: one for 4096, at least 16 and at most the square root of the rows.

    A smaller cell does not shorten the product of two blocks, and each probe sends the query's vector once more.
    """
    return max(1, min(round(math.sqrt(rows)), max(16, rows // 4096)))


def ivf_probes(queries: DataFrame, centroids: DataFrame, members: DataFrame, k: int, least: float = 0.9, key: str = "query_id",
               sample: int = 1000) -> int:
    """Smallest ``nprobe`` whose mean recall@k is ``least`` or more, measured against the exact search.

    Measured on the ``sample`` queries with the smallest key hash, and two standard errors are
    taken off where these are not all. A neighbour is found if its cell is probed, so the rank of
    its cell tells the recall for every ``nprobe``. Every cell is probed if nothing less suffices.
    """
    asked = queries.filter(F.col("vec").isNotNull())
    some = asked.orderBy(hash32(key), key).limit(sample)
    cells = centroids.select(F.col("cell").alias("article_id"), unit("vec").alias("vec")).filter(F.col("vec").isNotNull())
    nlist = centroids.count()
    order = knn(some, cells, nlist, key).select(key, F.col("article_id").alias("cell"), F.col("rank").alias("_probe"))
    truth = knn(some, members, k, key).select(key, "article_id").join(members.select("article_id", "cell"), "article_id")
    rows = truth.join(order, [key, "cell"], "left").select(key, "_probe").toPandas()  # sample * k rows at most
    if rows.empty:
        return nlist
    query, probe = pd.factorize(rows[key])[0], rows["_probe"].to_numpy(dtype=float, na_value=np.nan)
    found = np.zeros((query.max() + 1, nlist))
    hit = ~np.isnan(probe)
    np.add.at(found, (query[hit], probe[hit].astype(int) - 1), 1)
    recall = found.cumsum(axis=1) / np.bincount(query)[:, None]  # of every query, by nprobe - 1
    error = 0.0 if asked.count() <= sample else 2 * recall.std(axis=0) / math.sqrt(len(recall))
    enough = np.flatnonzero(recall.mean(axis=0) - error >= least)
    return int(enough[0]) + 1 if len(enough) else nlist


def ann_audit(exact: DataFrame, approx: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Mean and minimum recall@k of an approximate result and the share of perfect queries."""
    truth = exact.filter(F.col("rank") <= k).select(key, "article_id")
    found = approx.filter(F.col("rank") <= k).select(key, "article_id").withColumn("_hit", F.lit(1.0))
    per = truth.join(found, [key, "article_id"], "left").groupBy(key).agg(
        F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
    return per.agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"),
                   F.avg((F.col("recall") >= 1.0).cast("double")).alias("perfect_share"), F.count("*").alias("n_queries"))


#: Pairs of a pack, whose users' vectors are held; products of vectors formed at once.
PACK_PAIRS, HELD_PRODUCTS = 1 << 19, 1 << 14


def _rows_of(vecs: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix, and which of them are ``width`` numbers without a null; the others are rows of zeros."""
    size = pa.compute.fill_null(pa.compute.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    flat = vecs.flatten()
    gaps = np.bincount(np.repeat(np.arange(len(size)), np.maximum(size, 0)), weights=flat.is_null().to_numpy(zero_copy_only=False), minlength=len(size))
    whole = (size == width) & (gaps == 0)
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out = np.zeros((len(size), width))
    out[whole] = pa.compute.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)[at[whole, None] + np.arange(width)]
    return out, whole


def _vector_pack(pairs: pa.Table, users: pa.Table) -> pa.Table:
    """One row for a pack: its pairs as numbers of users and articles, by article, and a vector or null for each user."""
    if not len(pairs):
        return pa.table({"_pack": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("users", "articles", "pairs")}})
    lone = pairs["user_id"].combine_chunks().unique()
    lone = lone.filter(pa.compute.invert(pa.compute.is_in(lone, users["user_id"].combine_chunks())))
    users = pa.concat_tables([users.select(["user_id", "vec"]), pa.table({"user_id": lone, "vec": pa.nulls(len(lone), users.schema.field("vec").type)})])
    users = users.filter(pa.compute.is_in(users["user_id"], pairs["user_id"].combine_chunks()))
    names, articles = users["user_id"].combine_chunks().unique(), pairs["article_id"].combine_chunks().unique()
    of = pa.compute.index_in(users["user_id"].combine_chunks(), names).to_numpy(zero_copy_only=False)
    users, n = users.take(np.argsort(of, kind="stable")), np.bincount(of, minlength=len(names))
    user, article = (pa.compute.index_in(pairs[c].combine_chunks(), x).to_numpy(zero_copy_only=False) for c, x in (("user_id", names), ("article_id", articles)))
    # a user given twice has each pair twice
    row, article = np.repeat((np.cumsum(n) - n)[user], n[user]), np.repeat(article, n[user])
    row += np.arange(len(row)) - np.repeat(np.cumsum(n[user]) - n[user], n[user])
    order = np.lexsort((row, article))
    tables = {"users": users.select(["user_id", "vec"]), "articles": pa.table({"article_id": articles}),
              "pairs": pa.table({"user": row[order].astype(np.int32), "article": article[order].astype(np.int32)})}
    return pa.table({"_pack": pairs["_pack"].slice(0, 1), **{c: pa.array([zipped(t)], pa.binary()) for c, t in tables.items()}})


class _VectorPack:
    def __init__(self, row: dict[str, pa.Scalar]):
        users, articles, pairs = (unzipped(row[c]) for c in ("users", "articles", "pairs"))
        self.users, self.articles = users["user_id"].combine_chunks(), articles["article_id"].combine_chunks()
        self.user, self.article = (pairs[c].to_numpy() for c in ("user", "article"))
        self.at = np.searchsorted(self.article, np.arange(len(self.articles) + 1))
        vecs = users["vec"].combine_chunks()
        self.given = vecs.is_valid().to_numpy(zero_copy_only=False)
        size = pa.compute.fill_null(pa.compute.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
        self.width = int(size.max(initial=0))
        self.vecs, self.whole = _rows_of(vecs, self.width)
        self.met = np.zeros(len(self.articles), bool)

    def scores(self, items: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of the pairs whose articles are among ``items``."""
        code = pa.compute.fill_null(pa.compute.index_in(items["article_id"].combine_chunks(), self.articles), -1).to_numpy(zero_copy_only=False)
        items, code = items.filter(pa.array(code >= 0)), code[code >= 0]
        self.met[code] = True
        vecs = items["vec"].combine_chunks()
        known = vecs.is_valid().to_numpy(zero_copy_only=False)
        rows, whole = _rows_of(vecs, self.width)
        size = self.at[code + 1] - self.at[code]
        item = np.repeat(np.arange(len(code)), size)
        pair = np.repeat(self.at[code] - np.cumsum(size) + size, size) + np.arange(len(item))
        score, none = np.zeros(len(pair)), np.zeros(len(pair), bool)
        for a in range(0, len(pair), HELD_PRODUCTS):
            i, u = item[a:a + HELD_PRODUCTS], self.user[pair[a:a + HELD_PRODUCTS]]
            both = known[i] & self.given[u]
            score[a:a + len(i)] = np.where(both, np.einsum("ij,ij->i", self.vecs[u], rows[i]), np.where(known[i], 0.0, MINUS_INF))
            none[a:a + len(i)] = both & ~(self.whole[u] & whole[i])
        yield self._out(pair, pa.array(score, mask=none))

    def rest(self) -> pa.RecordBatch:
        pair = np.flatnonzero(~self.met[self.article])
        return self._out(pair, pa.array(np.full(len(pair), MINUS_INF)))

    def _out(self, pair: np.ndarray, score: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.users.take(pa.array(self.user[pair])), self.articles.take(pa.array(self.article[pair])), score],
                                          ["user_id", "article_id", "score"])


def _score_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs: dict[int, _VectorPack] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i] for c in batch.schema.names}
            pack = packs.get(row["_pack"].as_py())
            if pack is None:
                pack = packs[row["_pack"].as_py()] = _VectorPack(row)
            if row["items"].is_valid:
                yield from pack.scores(unzipped(row["items"]))
    for pack in packs.values():
        yield pack.rest()


def _vector_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([zipped(pa.table(batch))], pa.binary())], ["items"])


def cosine_pairs(pairs: DataFrame, user_vecs: DataFrame, vecs: DataFrame, out: str = "score") -> DataFrame:
    """(user_id, article_id, out): dot product, 0 for a user without vector, -inf for an unknown article.

    Users are dealt to packs, which hold their pairs and vectors. A task reads the articles' vectors, stored once,
    list by list for one pack: vectors are neither copied for pairs nor for packs. ``pairs`` are read several
    times; give a stored table.
    """
    pairs = pairs.select("user_id", "article_id")
    users = user_vecs.filter(F.col("user_id").isNotNull()).select("user_id", doubles("vec").alias("vec"))
    packs, dealt, own = dealt_pairs(pairs, users, PACK_PAIRS)
    types = {c: pairs.schema[c].dataType.simpleString() for c in ("user_id", "article_id")}
    rows = checkpointed(dealt.groupBy("_pack").cogroup(own.groupBy("_pack")).applyInArrow(
        _vector_pack, "_pack long, users binary, articles binary, pairs binary"))
    items = vecs.filter(F.col("article_id").isNotNull()).select("article_id", doubles("vec").alias("vec"))
    items = checkpointed(items.mapInArrow(_vector_lists, "items binary"))
    # a pack meets this row even if there are no vectors
    items = pairs.sparkSession.range(1).select(F.lit(None).cast("binary").alias("items")).unionByName(items)
    met = items.coalesce(1).hint("shuffle_replicate_nl").crossJoin(rows.repartitionById(packs, F.col("_pack").cast("int")))
    scores = met.mapInArrow(_score_vectors, f"user_id {types['user_id']}, article_id {types['article_id']}, score double")
    return scores.withColumnRenamed("score", out)


def cosine_candidates(imp: DataFrame, user_vecs: DataFrame, vecs: DataFrame, out: str = "score") -> DataFrame:
    """Cosine score per shown candidate; vectors travel with distinct pairs, not with every impression."""
    pairs = checkpointed(imp.select("user_id", "article_id").distinct())
    return imp.join(cosine_pairs(pairs, user_vecs, vecs, out), ["user_id", "article_id"])


def history_sequence(hist: DataFrame, vecs: DataFrame, hot_limit: int | None = None) -> DataFrame:
    """Ordered, unpooled history vectors, one row per resolvable click: (user_id, seq, article_id, vec).

    Long form on purpose: a user's sequence has no bound, so it is not packed in one row.
    """
    known = hist.select("user_id", "pos", "article_id").join(vecs.select("article_id", "vec"), "article_id")
    return row_numbers(known, ["user_id"], [F.col("pos")], "seq", hot_limit).drop("pos")


def attention_scores(imp: DataFrame, hist: DataFrame, vecs: DataFrame, wq: np.ndarray | None = None,
                     wk: np.ndarray | None = None, popularity: DataFrame | None = None, pop_weight: float = 0.0,
                     out: str = "score", left_rows: int = 4096, right_rows: int = 8192) -> DataFrame:
    """Softmax attention of each candidate over its user's history.

    Candidate c and history h: logits (c Wq)(h Wk) / sqrt(d); score = sum(softmax * (h.c))
    plus ``pop_weight * log(popularity)``. Empty history leaves the popularity term,
    an unknown candidate scores -inf. Users are packed into blocks and a long history
    is cut into several; a block returns (max, sum, weighted sum) per candidate and the
    parts are merged by a rescaled sum, so no task sees a whole long history.
    """
    pairs = imp.select("user_id", "article_id").distinct().join(vecs.select("article_id", "vec"), "article_id")
    clicks = hist.select("user_id", "article_id", "pos").join(vecs.select("article_id", "vec"), "article_id")
    left = pairs.select("user_id", "article_id", doubles("vec").alias("vec"))
    right = clicks.select("user_id", "pos", doubles("vec").alias("hvec"))
    user_type, id_type = (left.schema[c].dataType.simpleString() for c in ("user_id", "article_id"))

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cand, past = _matrix(l["vec"]), _matrix(r["hvec"])
        q = cand if wq is None else cand @ wq
        key = past if wk is None else past @ wk
        logits = (q @ key.T) / np.sqrt(q.shape[1])
        top = logits.max(axis=1)
        e = np.exp(logits - top[:, None])
        return pd.DataFrame({"user_id": l["user_id"].to_numpy(), "article_id": l["article_id"].to_numpy(),
                             "top": top, "mass": e.sum(axis=1), "won": (e * (cand @ past.T)).sum(axis=1)})

    parts = block_pairs(left, right, "article_id", "pos", run,
                        f"user_id {user_type}, article_id {id_type}, top double, mass double, won double",
                        by=["user_id"], left_rows=left_rows, right_rows=right_rows)
    # merge: two aggregates, because the common maximum is needed first
    best = parts.groupBy("user_id", "article_id").agg(F.max("top").alias("_m"))
    scale = F.exp(F.col("top") - F.col("_m"))
    merged = parts.join(best, ["user_id", "article_id"]).groupBy("user_id", "article_id").agg(
        (F.sum(F.col("won") * scale) / F.sum(F.col("mass") * scale)).alias("_att"))
    known = vecs.select("article_id").distinct().withColumn("_known", F.lit(True))
    rows = imp.join(merged, ["user_id", "article_id"], "left").join(known, "article_id", "left")
    extra = F.lit(0.0)
    if popularity is not None:
        from presslens.operators.profiles import popularity_score
        rows = popularity_score(rows, popularity, out="_pop")
        extra = F.lit(float(pop_weight)) * F.log("_pop")
    score = F.when(F.col("_known").isNull(), F.lit(MINUS_INF)).otherwise(F.coalesce("_att", F.lit(0.0)) + extra)
    return rows.withColumn(out, score).select(*imp.columns, out)
