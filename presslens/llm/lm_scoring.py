"""Language-model scores from an n-gram trie (words and pairs of words) in Elias-Fano levels.

Tokens: the text with A-Z in lower case, cut at ``[\\x20\\x09-\\x0D]``, then one end. The
probability of a token w after v is smoothed towards its share among all tokens:

    p(w | v) = (c(v w) + mu * p(w)) / (c(v) + mu),   p(w) = (c(w) + 1) / (N + V + 1)

Every task turns its texts into blocks of word numbers, with the block's words as 64-bit
hashes. Counts over the whole corpus come from two exchanges of packed arrays, one row a
(block, shard) with each word or pair once however often it occurs in the block:

* words go to shards by range of their hash; a shard adds up the training counts, keeps
  them, and tells each block the counts of its words;
* pairs go to shards by the hash of the first word (the context); the followers of a hot
  context (one token in 1024 or ``shard_tokens`` tokens, held-out rows included) are split by
  their hash over ``splits`` shards for every ``shard_tokens`` tokens of the context. Each shard builds a trie file in the shared folder, maps it into memory and answers for the
  pairs of every block.

Trie file: level one is the contexts in order, with monotone pointers to their followers
and the weight left for p(w); level two is each context's followers in order, with the
smoothed share c(v w) / (c(v) + mu) as an 8-bit code of its logarithm. All sequences are
Elias-Fano coded. A query finds the context, takes its range from the pointers and searches
the successor of the follower's hash in that range. Followers are told apart by 32 bits
within a context.

Blocks, shards and answers are bounded by parameters; their number grows with the corpus.
The driver sees N, V, the number of documents and the hot contexts, at most 1024 or one for
``shard_tokens`` tokens. A document must fit a task.

Null and empty texts have the end alone. Without training rows every count is 0 and p is
(0 + 1) / (0 + 0 + 1). Rows with one id are scored each by itself; null ids stay null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import file_system, new_folder, read_flat, row_slices, stored, text_or_empty
from presslens.llm.elias_fano import EliasFano

MU = 500.0
_U = np.uint64
#: Codes 1 to 255 stand for log10 from -10 to 0; 0 stands for no training count.
_STEP = 10 / 254
_START, _END = (xxhash.xxh3_64_intdigest(x) for x in (b" start", b" end"))  # no word holds a space


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _code(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round((np.log10(p) + 10) / _STEP), 0, 254) + 1, 0).astype(np.uint8)


def _decoded(code: np.ndarray) -> np.ndarray:
    table = 10 ** ((np.arange(256) - 1) * _STEP - 10)
    table[0] = 0.0
    return table[code]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_BLOCK = "block long, taught long, size long, ids binary, no_id binary, learn binary, lengths binary, tokens binary, words binary, counts binary, seen binary"


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def fresh():
            return _Numbers(), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words, ids, learn, lengths, tokens, _ = state
            hashes = np.array([*map(xxhash.xxh3_64_intdigest, words), _END], dtype=_U)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            flat = np.concatenate(tokens)
            flat[flat < 0] = len(words)  # the end
            flat = rank[flat]
            size, taught = np.array(lengths, np.int64), np.array(learn, bool)
            counts = np.bincount(flat[np.repeat(taught, size)], minlength=len(order))
            seen = np.bincount(flat, minlength=len(order))
            row = {"block": (part << 24) | number, "taught": int(taught.sum()), "size": len(flat), "ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(), "no_id": np.array([i is None for i in ids]).tobytes(),
                   "learn": taught.tobytes(), "lengths": size.tobytes(), "tokens": zstandard.ZstdCompressor(level=3).compress(flat.tobytes()), "words": hashes[order].tobytes(), "counts": counts.astype("<u4").tobytes(),
                   "seen": seen.astype("<u4").tobytes()}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64() if k in ("block", "taught", "size") else pa.binary()) for k, v in row.items()})

        state = fresh()
        for batch in row_slices(batches):
            for doc, text, taught in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, ids, learn, lengths, tokens, total = state
                own = text.encode().lower().split()
                tokens.append(np.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)), -1))
                ids.append(doc)
                learn.append(taught)
                lengths.append(len(own) + 1)
                state = (*state[:5], total + len(own) + 1)
                if state[5] >= block_tokens:
                    yield block()
                    state, number = fresh(), number + 1
        if state[1]:
            yield block()
    return run


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _array(value: bytes, kind="<i8") -> np.ndarray:
    return np.frombuffer(value, kind)


def _tokens(packed: bytes) -> np.ndarray:
    return _array(zstandard.ZstdDecompressor().decompress(packed), "<u4")


def _word_counts(ranges: int):
    """Each block's words and their counts in training and in all rows, a row for each range of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts, seen = _array(row["words"], "<u8"), _array(row["counts"], "<u4"), _array(row["seen"], "<u4")
                shard = _ranges(words, ranges)
                cut = np.searchsorted(shard, np.arange(ranges + 1))
                for r in np.unique(shard).tolist():
                    a, b = cut[r], cut[r + 1]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([r], pa.int64()), "block": pa.array([row["block"]], pa.int64()),
                                                      "words": [words[a:b].tobytes()], "counts": [counts[a:b].tobytes()], "seen": [seen[a:b].tobytes()]})
    return run


def _add_words(least: float):
    """All counts of a range, the counts of each block's words, and the words with ``least`` tokens or more in all rows."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = [_array(x, "<u8") for x in rows["words"]]
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        total, seen = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        np.add.at(total, place, np.concatenate([_array(x, "<u4") for x in rows["counts"]]))
        np.add.at(seen, place, np.concatenate([_array(x, "<u4") for x in rows["seen"]]))
        answers = np.split(total[place], np.cumsum([len(w) for w in words])[:-1])
        taught, hot = total > 0, seen >= least
        out = [(int(rows["shard"].iloc[0]), -1, known[taught].tobytes(), total[taught].tobytes(), int(total.sum()), int(taught.sum()))]
        out.append((out[0][0], -2, known[hot].tobytes(), seen[hot].tobytes(), 0, 0))
        out += [(out[0][0], int(b), b"", a.tobytes(), 0, 0) for b, a in zip(rows["block"], answers, strict=True)]
        return pd.DataFrame(out, columns=["shard", "block", "words", "counts", "n", "v"])
    return run


def _pairs(tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 32 | follower's 32 bits) of every token; the context after the last word is the start."""
    first = np.cumsum(lengths) - lengths
    context = np.empty(len(tokens), _U)
    context[1:] = tokens[:-1]
    context[first] = len(words)
    return (context << _U(32)) | (words[tokens] & _U(0xFFFFFFFF)), context


def _parts(contexts: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Number of parts of each context if it is hot (``hot`` is sorted), else 0."""
    if not len(hot):
        return np.zeros(len(contexts), np.int64)
    at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
    return np.where(hot[at] == contexts, parts[at], 0)


def _sharded(keys: np.ndarray, contexts: np.ndarray, ranges: int, splits: int, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Shard of each pair: range of the context's hash and a part of it; a hot context goes by the follower to as many shards as it has parts."""
    number = (keys >> _U(32)).astype(np.int64)
    part = (contexts % _U(splits)).astype(np.int64)[number]
    many = _parts(contexts, hot, parts)[number]
    split = many > 0
    part[split] = (keys[split] & _U(0xFFFFFFFF)).astype(np.int64) % many[split]
    return ((_ranges(contexts, ranges) * splits)[number] + part) % (ranges * splits)


def _context_counts(ranges: int, splits: int, hot: np.ndarray, parts: np.ndarray):
    """The counts of a range's words for each shard that may have their pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = _array(words, "<u8"), _array(counts)
                part, many = (words % _U(splits)).astype(np.int64), _parts(words, hot, parts)
                for k in range(max(splits, int(many.max(initial=0)))):
                    own = np.where(many > 0, k < many, part == k)
                    if own.any():
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([(shard * splits + k) % (ranges * splits)], pa.int64()),
                                                          "words": [words[own].tobytes()], "counts": [counts[own].tobytes()]})
    return run


def _pair_counts(ranges: int, splits: int, hot: np.ndarray, parts: np.ndarray):
    """Each block's pairs and their training counts, a row for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, lengths, words = _tokens(row["tokens"]), _array(row["lengths"]), _array(row["words"], "<u8")
                taught = np.repeat(_array(row["learn"], bool), lengths)
                pairs, _ = _pairs(tokens, lengths, words)
                keys, counts = np.unique(pairs, return_counts=True)
                if not taught.all():
                    learned, times = np.unique(pairs[taught], return_counts=True)
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, learned)] = times
                contexts = np.append(words, _U(_START))
                shard = _sharded(keys, contexts, ranges, splits, hot, parts)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(ranges * splits + 1))
                for s in np.unique(shard).tolist():
                    own = order[cut[s]:cut[s + 1]]
                    number = (keys[own] >> _U(32)).astype(np.int64)
                    start = np.flatnonzero(np.diff(number, prepend=-1))
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int64()), "block": pa.array([row["block"]], pa.int64()), "contexts": [contexts[number[start]].tobytes()],
                        "sizes": [np.diff(start, append=len(own)).astype("<u4").tobytes()], "followers": [(keys[own] & _U(0xFFFFFFFF)).astype("<u4").tobytes()],
                        "counts": [counts[own].astype("<u4").tobytes()]})
    return run


class Trie:
    """One shard's contexts and followers, read from its file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        part = lambda p: EliasFano.from_arrays({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(p + ".")})
        self.contexts, self.pointers, self.followers = part("contexts"), part("pointers"), part("followers")
        self.shares, self.left = arrays["shares"], arrays["left"]

    @staticmethod
    def arrays(contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray, totals: np.ndarray, mu: float) -> dict[str, np.ndarray]:
        """From sorted distinct (context, follower) with training counts and the contexts' own counts (by pair)."""
        start = np.flatnonzero(np.diff(contexts, prepend=_U(0)) != 0) if len(contexts) else np.zeros(0, np.int64)
        if len(contexts) and (not len(start) or start[0] != 0):
            start = np.concatenate([[0], start])
        number = np.repeat(np.arange(len(start)), np.diff(start, append=len(contexts))).astype(_U)
        coded = {"contexts": EliasFano.of(contexts[start]), "pointers": EliasFano.of(np.append(start, len(contexts)).astype(_U)),
                 "followers": EliasFano.of((number << _U(32)) | followers)}
        out = {f"{k}.{name}": a for k, e in coded.items() for name, a in e.arrays().items()}
        return out | {"shares": _code(counts / (totals + mu)), "left": _code(mu / (totals[start] + mu))}

    @staticmethod
    def write(store, path: str, arrays: dict[str, np.ndarray]) -> None:
        """A line that names the arrays (kind, place, length), then the arrays, each from a multiple of 8 bytes."""
        names, at = {}, 0
        for name, a in arrays.items():
            names[name] = (a.dtype.str, at, len(a))
            at += -(-a.nbytes // 8) * 8
        head = json.dumps(names).encode()
        head += b" " * (-(len(head) + 8) % 8)
        with store.open_output_stream(path) as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays.values():
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def open(cls, store, path: str) -> Trie:
        data = read_flat(store, path, "<u1")
        size = int.from_bytes(data[:8].tobytes(), "little")
        names = json.loads(data[8:8 + size].tobytes())
        return cls({k: data[8 + size + at:8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in names.items()})

    def query(self, contexts: np.ndarray, sizes: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """Codes of the smoothed shares of the pairs: each context with its followers; 0 where there is none."""
        place, known = self.contexts.successors(contexts)
        pointers = self.pointers.values().astype(np.int64)
        place = np.where(known, place, 0)
        first, last = np.repeat(pointers[place], sizes), np.repeat(pointers[np.minimum(place + 1, len(pointers) - 1)], sizes)
        wanted = (np.repeat(place.astype(_U), sizes) << _U(32)) | followers
        at, found = self.followers.successors(wanted, first, last)
        found &= np.repeat(known, sizes)
        out = np.zeros(len(followers), np.uint8)
        out[found] = self.shares[at[found]]
        return out


def _answer_pairs(folder: str, mu: float, keep: bool):
    def run(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"block": [], "shard": [], "shares": []})
        if asked.empty:
            return empty
        contexts, sizes = [_array(x, "<u8") for x in asked["contexts"]], [_array(x, "<u4").astype(np.int64) for x in asked["sizes"]]
        followers = [_array(x, "<u4").astype(_U) for x in asked["followers"]]
        counts = np.concatenate([_array(x, "<u4") for x in asked["counts"]]).astype(np.int64)
        known, number = np.unique(np.concatenate(contexts), return_inverse=True)
        pairs = (np.repeat(number.astype(_U), np.concatenate(sizes)) << _U(32)) | np.concatenate(followers)
        taught = counts > 0
        distinct, place = np.unique(pairs[taught], return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts[taught])
        own = np.zeros(len(known), np.int64)
        for k, c in zip(words["words"], words["counts"], strict=True):
            keys = _array(k, "<u8")
            at = np.minimum(np.searchsorted(keys, known), max(0, len(keys) - 1))
            hit = keys[at] == known if len(keys) else np.zeros(len(known), bool)
            own[hit] = _array(c)[at[hit]]
        which = (distinct >> _U(32)).astype(np.int64)
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/shard-{int(asked['shard'].iloc[0]):06d}-{uuid.uuid4().hex}.trie"
        Trie.write(store, path, Trie.arrays(known[which], distinct & _U(0xFFFFFFFF), total, own[which], mu))
        trie = Trie.open(store, path)
        shares = [trie.query(c, s, f).tobytes() for c, s, f in zip(contexts, sizes, followers, strict=True)]
        if not keep:
            del trie
            store.delete_file(path)
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "shares": shares})
    return run


def _scores(ranges: int, splits: int, hot: np.ndarray, parts: np.ndarray, n: int, v: int, taught_docs: int, mu: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = blocks.iloc[0]
        tokens, lengths, hashes = _tokens(row["tokens"]), _array(row["lengths"]), _array(row["words"], "<u8")
        own = answers[answers["kind"] == 0].sort_values("shard")
        counts = np.concatenate([_array(x) for x in own["answer"]])
        keys, inverse = np.unique(_pairs(tokens, lengths, hashes)[0], return_inverse=True)
        order = np.argsort(_sharded(keys, np.append(hashes, _U(_START)), ranges, splits, hot, parts), kind="stable")
        shares = np.zeros(len(keys), np.uint8)
        shares[order] = np.concatenate([_array(x, "<u1") for x in answers[answers["kind"] == 1].sort_values("shard")["answer"]])
        left = _decoded(_code(mu / (np.append(counts, taught_docs) + mu)))  # as the contexts' level has it
        single = (counts + 1) / (n + v + 1)
        first = np.cumsum(lengths) - lengths
        context = np.empty(len(tokens), np.int64)
        context[1:] = tokens[:-1]
        context[first] = len(hashes)
        p = _decoded(shares)[inverse] + left[context] * single[tokens]
        add = lambda x: np.add.reduceat(x, first)
        ids = pd.array(_array(row["ids"]), dtype="Int64")
        ids[_array(row["no_id"], bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": ~_array(row["learn"], bool), "n_tokens": lengths, "n_known": add((counts[tokens] > 0).astype(np.int64)),
                             "train_tokens": n, "base_score": add(np.log10(single)[tokens]), "score": add(np.log10(p))})
    return run


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, block_tokens: int = 2_000_000,
                    shard_tokens: int = 1_000_000, splits: int = 4, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model is counted over the rows where ``learn`` is true. Its trie files stay in
    ``folder`` if that is given; else each is removed when its shard has answered.
    """
    keep, folder = folder is not None, folder or new_folder(docs.sparkSession, "trie")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = stored(rows.mapInArrow(_blocks(block_tokens), _BLOCK), "blocks", "zstd")
    tokens, taught_docs, all_docs = blocks.agg(F.sum("size"), F.sum("taught"), F.sum(F.length("no_id"))).first()
    if tokens is None:
        return rows.select("doc_id", F.lit(False).alias("held_out"), *[F.lit(0).cast(t).alias(c) for c, t in (
            ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))])
    ranges = max(1, round(tokens / (shard_tokens * splits)))
    least = max(1.0, min(tokens / 1024, shard_tokens))
    words = stored(blocks.select("block", "words", "counts", "seen").mapInArrow(_word_counts(ranges), "shard long, block long, words binary, counts binary, seen binary")
                   .groupBy("shard").applyInPandas(_add_words(least), "shard long, block long, words binary, counts binary, n long, v long"), "words")
    n, v = words.agg(F.sum("n"), F.sum("v")).first()
    found = words.filter("block = -2").select("words", "counts").collect()  # 1024 words or one a shard_tokens tokens at most
    hot, often = (np.concatenate([_array(x[c], kind) for x in found]) for c, kind in (("words", "<u8"), ("counts", "<i8")))
    if all_docs >= least:
        hot, often = np.append(hot, _U(_START)), np.append(often, all_docs)
    order = np.argsort(hot)
    hot, parts = hot[order], np.minimum(splits * np.ceil(often[order] / shard_tokens), ranges * splits).astype(np.int64)
    start = words.sparkSession.createDataFrame([(int(_ranges(np.array([_START], _U), ranges)[0]), np.array([_START], "<u8").tobytes(), np.array([taught_docs], "<i8").tobytes())],
                                               "shard long, words binary, counts binary")
    known = words.filter("block = -1").select("shard", "words", "counts").unionByName(start)
    known = known.mapInArrow(_context_counts(ranges, splits, hot, parts), "shard long, words binary, counts binary")
    asked = blocks.select("block", "learn", "lengths", "tokens", "words").mapInArrow(
        _pair_counts(ranges, splits, hot, parts), "shard long, block long, contexts binary, sizes binary, followers binary, counts binary")
    pairs = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_answer_pairs(folder, mu, keep), "block long, shard long, shares binary")
    answers = words.filter("block >= 0").select("block", F.lit(0).alias("kind"), "shard", F.col("counts").alias("answer")).unionByName(
        pairs.select("block", F.lit(1).alias("kind"), "shard", F.col("shares").alias("answer")))
    return blocks.drop("counts", "seen", "taught", "size").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _scores(ranges, splits, hot, parts, int(n), int(v), int(taught_docs), mu),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
