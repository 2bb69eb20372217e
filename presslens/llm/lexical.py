"""Ranked lexical search over segments, best document intervals first.

The index is a table of segments, each with the postings of some documents: for every term
the documents in the order of their ids and how often they hold it. A segment is made from
the rows of one task and closed at ``segment_bytes`` of text, so building it shuffles
nothing; document frequencies are the sums of the segments' counts.

A search looks up its terms' posting lists in each segment. A sparse table over the lists
tells the place of the largest impact in any range of a list in two reads. The bound of an
interval of documents is the sum, over the terms, of the weighted maximum in its range. The
interval with the highest bound is taken first and split at the document with the largest
single impact, which is scored exactly; an interval with few postings is scored whole. The
search of a segment ends when no bound exceeds the k-th score (at an equal bound: when the
interval starts behind the k-th document). The segments' lists of k are then ranked together.

Weights are whole numbers: with N documents that have a term, L terms in them and n in a
document, m = 100 - b + (b * n * N) div L, a term in df documents weighs
floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and adds weight * ((10**9 * tf) div (1000 * tf + 8 * m))
for each time the query holds it. Terms are runs of ASCII letters and digits and of characters
beyond ASCII, with A-Z in lower case.

Null and empty texts have no terms: such documents are never found, such queries find
nothing. Rows with one document id are documents of their own; query rows with one id are one
query. Documents of equal score stand in the order of their ids, null last. Other columns are
not looked at. Without rows on either side there is no result. A single query must fit a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from presslens.llm.common import stored, text_or_empty

SEGMENT_BYTES, LEAF_POSTINGS, B = 16 << 20, 512, 75
#: Queries of a search travel to all tasks; more than these bytes of terms go in several passes.
MAX_QUERY_BYTES = 32 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Builder:
    """Collects documents into a segment."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.numbers, self.ids, self.sizes, self.terms, self.counts, self.bytes = _Numbers(), [], [], [], [], 0

    def add(self, doc_id, text: str) -> None:
        words = terms_of(text)
        if words:
            term, count = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
            self.ids.append(doc_id)
            self.sizes.append(len(words))
            self.terms.append(term)
            self.counts.append(count.astype(np.int32))
            self.bytes += len(text) + 64

    def segment(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        doc = np.repeat(np.arange(len(order)), [len(self.terms[i]) for i in order])
        term = np.concatenate([self.terms[i] for i in order])
        by_term = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[by_term], np.arange(len(self.numbers) + 1))
        sizes = np.array([self.sizes[i] for i in order], np.int64)
        row = {"docs": len(order), "words": int(sizes.sum()), "doc_ids": [self.ids[i] for i in order], "sizes": sizes.tobytes(),
               "terms": b" ".join(self.numbers), "starts": starts.astype(np.int64).tobytes(),
               "doc": doc[by_term].astype(np.int32).tobytes(), "tf": np.concatenate([self.counts[i] for i in order])[by_term].tobytes()}
        self.clear()
        return pa.RecordBatch.from_pylist([row], self.schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored segments of all documents that have a term."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = f"docs long, words long, doc_ids array<{dict(rows.dtypes)['doc_id']}>, sizes binary, terms binary, starts binary, doc binary, tf binary"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Builder(schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.add(doc_id, text.as_py())
                if own.bytes >= segment_bytes:
                    yield own.segment()
        if own.ids:
            yield own.segment()

    return stored(rows.mapInArrow(run, out), "segments")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each segment."""
    for batch in batches:
        for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            df = np.diff(np.frombuffer(starts, np.int64))
            yield pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t in terms.split(b" ")], pa.string()), "df": pa.array(df, pa.int64())})


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = terms_of(text)
            ids += [i] * len(words)
            rows += [w.decode() for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(rows, pa.string())], ["item_id", "term"])


class _Lists:
    """Posting lists of the asked terms of a segment, one behind the other, with their sparse table."""

    def __init__(self, places: np.ndarray, starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, norm: np.ndarray):
        many = starts[places + 1] - starts[places]
        self.begin = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(starts[places] - self.begin[:-1], many) + np.arange(self.begin[-1])
        self.doc, count = doc[at].astype(np.int64), tf[at].astype(np.int64)
        self.impact = 1_000_000_000 * count // (1000 * count + 8 * norm[self.doc])
        self.docs = len(norm)
        self.key = np.repeat(np.arange(len(places)), many) * self.docs + self.doc  # ascending over all lists
        level = np.arange(len(at), dtype=np.int32)
        self.table, step = [level], 1  # level j: place of the largest impact among 2**j from here
        while 2 * step <= (many.max() if len(many) else 0):
            a, b = level[:-step], level[step:]
            level = np.where(self.impact[a] >= self.impact[b], a, b)
            self.table.append(np.concatenate([level, np.zeros(len(at) - len(level), np.int32)]))
            step *= 2
        self.table = np.stack(self.table) if len(at) else np.zeros((1, 0), np.int32)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range (none empty)."""
        j = np.frexp((high - low).astype(float))[1] - 1
        a, b = self.table[j, low], self.table[j, high - (1 << j)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, lists: np.ndarray, weight: np.ndarray, k: int, leaf: int) -> list[tuple[int, int]]:
        """The k best (score, document), best first; ``lists`` are the query's terms."""
        best: list[tuple[int, int]] = []  # smallest on top; documents negated

        def offer(score: int, doc: int) -> None:
            if score > 0:
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (score, -doc))

        def hopeful(bound: int, first: int) -> bool:
            return bound > 0 and (len(best) < k or bound > best[0][0] or (bound == best[0][0] and first < -best[0][1]))

        waiting, number = [], 0

        def push(which: np.ndarray, low: np.ndarray, high: np.ndarray, first: int) -> None:
            nonlocal number
            some = high > low
            if not some.any():
                return
            which, low, high = which[some], low[some], high[some]
            top = self.largest(low, high)
            value = weight[which] * self.impact[top]
            bound = int(value.sum())
            if hopeful(bound, first):
                number += 1
                heapq.heappush(waiting, (-bound, first, number, which, low, high, int(self.doc[top[np.argmax(value)]])))

        push(np.arange(len(lists)), self.begin[lists], self.begin[lists + 1], 0)
        while waiting:
            bound, first, _, which, low, high, doc = heapq.heappop(waiting)
            if not hopeful(-bound, first):
                break  # the others have lower bounds, or start later at the same
            many = high - low
            if many.sum() <= leaf:
                upto = np.cumsum(many)
                at = np.repeat(low - (upto - many), many) + np.arange(upto[-1])
                docs, place = np.unique(self.doc[at], return_inverse=True)
                score = np.zeros(len(docs), np.int64)
                np.add.at(score, place, np.repeat(weight[which], many) * self.impact[at])
                order = np.lexsort((docs, -score))[:k]
                for s, d in zip(score[order].tolist(), docs[order].tolist(), strict=True):
                    offer(s, d)
                continue
            place = np.searchsorted(self.key, lists[which] * self.docs + doc)
            inside = (place < high) & (place >= low)
            inside[inside] = self.doc[place[inside]] == doc
            offer(int((weight[which[inside]] * self.impact[place[inside]]).sum()), doc)
            push(which, low, place, first)
            push(which, place + inside, high, doc + 1)
        return [(s, -d) for s, d in sorted(best, reverse=True)]


def _searched(k: int, b: int, all_docs: int, all_words: int, leaf: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, terms, starts, doc, tf, queries = (batch.column(c)[i].as_py() for c in range(7))
                known = {t: n for n, t in enumerate(terms.split(b" "))}
                norm = 100 - b + (b * np.frombuffer(sizes, np.int64) * all_docs) // all_words
                asked = sorted({known[t] for q in queries for t in (x.encode() for x in q["terms"]) if t in known})
                number = {place: n for n, place in enumerate(asked)}
                lists = _Lists(np.array(asked, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(doc, np.int32), np.frombuffer(tf, np.int32), norm)
                out = []
                for q in queries:
                    own = [(number[known[t]], w) for t, w in ((x.encode(), w) for x, w in zip(q["terms"], q["weights"], strict=True)) if t in known]
                    if own:
                        which, weight = (np.array(x, np.int64) for x in zip(*sorted(own), strict=True))
                        out += [{"item_id": q["item_id"], "doc_id": ids[d], "score": s} for s, d in lists.search(which, weight, k, leaf)]
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", text_col: str = "text", b: int = B,
           leaf: int = LEAF_POSTINGS, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each query with a score above 0."""
    items = queries.select(F.col(query_id).alias("item_id"), text_or_empty(text_col).alias("text"))
    item_kind, kinds = dict(items.dtypes)["item_id"], dict(index.dtypes)
    asked = stored(items.mapInArrow(_query_terms, f"item_id {item_kind}, term string").groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    all_docs, all_words = index.agg(F.sum("docs"), F.sum("words")).first()
    out = f"item_id {item_kind}, doc_id {kinds['doc_ids'][6:-1]}, score long"
    if not all_docs:
        return index.sparkSession.createDataFrame([], out).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    found = index.select("terms", "starts").mapInArrow(_term_counts, "term string, df long")
    df = found.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * all_docs + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df.withColumn("weight", weight).filter("weight > 0"), "term")
    weighted = stored(weighted.select("item_id", "term", (F.col("times") * F.col("weight")).alias("weight")), "weighted")
    size = weighted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    passes = -(-size // max_query_bytes)
    grouped = weighted.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    grouped = grouped.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(max(1, passes))).cast("int"))
    blocks = stored(grouped.groupBy("pass").agg(F.collect_list(F.struct("item_id", "terms", "weights")).alias("queries")), "blocks")
    schema = to_arrow_schema(index.sparkSession.createDataFrame([], out).schema)
    best = None
    for number in range(max(1, passes)):  # a stated query set against all segments; one pass but for very large sets
        own = F.broadcast(blocks.filter(F.col("pass") == number))  # about max_query_bytes
        rows = index.withColumn("pass", F.explode(F.array(F.lit(number)))).join(own, "pass")
        part = rows.select("doc_ids", "sizes", "terms", "starts", "doc", "tf", "queries").mapInArrow(_searched(k, b, all_docs, all_words, leaf, schema), out)
        best = part if best is None else best.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
