"""Byte-level BPE without merging: longest tokens, a table of pairs that may stand together, and steps back.

BPE starts from bytes and merges the pair of the lowest rank, leftmost first. Its result is
the only row of tokens in which every two neighbours are *compatible*: encoding the two
alone gives the two again. So a piece of text is encoded from left to right: take the longest
token that starts here (an Aho-Corasick automaton finds all tokens of the piece in one pass),
else the next shorter one that is compatible with the token before; where none is, mark the
place as dead and take a step back. A place dies once, so this is linear in the piece.

Whether tokens x and y are compatible is decided at their seam. While x is put together, its
last part runs through a row of tokens (its right edge), each there until the rank of the
merge that takes it up; y has a left edge likewise. The pair is broken up if some merge of a
token of one edge with a token of the other has a lower rank than the merges that end the two
(at the same rank, the merge further left comes first). Answers are kept in a table of bounded
size, as are the ids of pieces seen before.

Special tokens of the file are found in the text before it is cut into pieces. Decoding joins
the bytes of the tokens by a table of offsets; bytes that are no UTF-8 become U+FFFD.

Null texts count as empty and have no ids. A text is one row and must fit a task, with any
length of its pieces. Rows keep their order and their id, whatever it is or how often it comes;
other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from presslens.llm.common import row_slices, text_or_empty

#: Fixed value: how the byte-level pre-tokenizer cuts text. White space is what Unicode says, without U+001C to U+001F.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_WIDE_SPACE, _BEFORE_WORD = re.compile(r"\s\s"), re.compile(r" (?=\S)")
#: Texts of each kind whose ids are remembered, and slots of the table of pairs (a power of 2).
MAX_PIECES, TABLE = 600_000, 1 << 21


def _byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 characters stand for themselves, other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the tables made from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = _byte_of_char()
        to_bytes = lambda token: bytes(map(byte.__getitem__, token))
        self.special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"{path}: special token {t['content']!r} takes characters beside it")
            self.special[t["content"]] = t["id"]
        vocab = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> its two parts and the rank of their merge
        for rank, merge in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if whole in self.parts or any(len(x) > 1 and p not in self.parts for x, p in zip((a, b), pair, strict=True)):
                raise ValueError(f"{path}: the merges are not in the order in which tokens are made")
            self.rank[pair], self.parts[whole] = rank, (*pair, rank)
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for t, i in vocab.items():
            token[i] = t
        self.length = np.array([len(t) for t in token])
        self.edges: tuple[dict, dict] = {}, {}
        alive = [len(t) == 1 for t in token]
        for whole, (a, b, rank) in self.parts.items():  # parts before wholes
            alive[whole] = alive[a] and alive[b] and not self._broken(a, b, rank)
        if not all(bytes([b]) in vocab for b in range(256)):
            raise ValueError(f"{path}: not every byte is a token")
        known = {t: i for t, i in vocab.items() if alive[i]}
        self.shorter = np.array([next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for t in token])
        self.automaton = ahocorasick.Automaton()
        for t, i in known.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        for content, i in self.special.items():
            token[i] = content.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in token])])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.keys, self.answers = np.full(TABLE, -1), np.zeros(TABLE, bool)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at this side (0: left, 1: right) while ``token`` is made, with the rank that ends each; the last is the token."""
        known = self.edges[side]
        if token not in known:
            if token in self.parts:
                inner = self._edge(self.parts[token][side], side)
                known[token] = [*inner[:-1], (inner[-1][0], self.parts[token][2]), (token, math.inf)]
            else:
                known[token] = [(token, math.inf)]
        return known[token]

    def _broken(self, x: int, y: int, end: float = math.inf) -> bool:
        """Whether a merge across the seam comes before ``end`` (at which x and y end themselves)."""
        for a, a_end in self._edge(x, 1):
            for b, b_end in self._edge(y, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank < min(a_end, end) and rank <= b_end:
                    return True
        return False

    def _fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pairs are compatible; a pair that is not in the table takes the slot of another."""
        key = x << 32 | y
        slot = (key * 0x1E3779B97F4A7C15 >> 32) & (TABLE - 1)
        out, missing = self.answers[slot], np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            new, at = np.unique(key[missing], return_inverse=True)
            answers = np.array([not self._broken(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
            out[missing] = answers[at]
            self.keys[slot[missing]], self.answers[slot[missing]] = key[missing], out[missing]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. All pieces take their steps together, so a step is a few array operations."""
        text = "\u0100".join([p.decode("latin-1") for p in pieces])  # no token has this character
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest = np.full(len(text) + 1, -1)
        longest[found[:, 0] + 1 - self.length[found[:, 1]]] = found[:, 1]  # of several, the last one stays: it ends last
        sizes = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        came, dead = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, bool)  # token that ends before a place; places with no way on
        stop = (begin + sizes)[sizes > 0]
        at = begin[sizes > 0]
        token = longest[at]
        while len(at):
            last, there = came[at], token >= 0
            to = at + np.where(there, self.length[token], 0)
            good = there & ~dead[to]
            check = np.flatnonzero(good & (last >= 0))
            good[check] = self._fits(last[check], token[check])
            came[to[good]] = token[good]
            back = ~there
            dead[at[back]], came[at[back]] = True, -1
            before = at[back] - self.length[last[back]]
            at = np.where(good, to, at)
            token = np.where(good, longest[to], self.shorter[np.where(there, token, last)])
            at[back] = before
            if good.any():
                open_ = at < stop
                at, token, stop = at[open_], token[open_], stop[open_]
        ends = np.concatenate([[0], np.cumsum(came >= 0)[begin + sizes]])
        row = came[came >= 0].astype("<u4")
        return [row[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Coder:
    """``encode`` and ``decode`` of whole texts.

    The pattern always cuts before a space with something other than white space after it, so
    a text is first split there, and what stands between two such spaces is looked up whole.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cut = regex.compile(PIECES).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces: dict[str, bytes] = {}  # ids of pieces seen before
        self.words: dict[str, bytes] = {}  # ids of what stands between spaces, with the space before it
        self.starts: dict[str, bytes] = {}  # the same for the first in a text

    def _split(self, text: str) -> list[str]:
        return _BEFORE_WORD.split(text) if _WIDE_SPACE.search(text) or text[-1:].isspace() else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        parts = [[t] if self.special is None else self.special.split(t) for t in texts]  # text, special token, text, ...
        rows = [[self._split(t) for t in p[::2]] for p in parts]
        words = {w for row in rows for part in row for w in part[1:]}
        starts = {part[0] for row in rows for part in row}
        new = [*self._learn(words, self.words, " "), *self._learn(starts, self.starts, "")]
        out = []
        for p, row in zip(parts, rows, strict=True):
            ids = []
            for i, part in enumerate(row):
                if i:
                    ids.append(np.array([self.vocabulary.special[p[2 * i - 1]]], "<u4").tobytes())
                ids.append(self.starts[part[0]])
                ids += map(self.words.__getitem__, part[1:])
            out.append(b"".join(ids))
        for known, added in new:
            if len(known) > MAX_PIECES:  # what came first stays
                for key in added:
                    del known[key]
        return out

    def _learn(self, asked: set[str], known: dict[str, bytes], before: str) -> list[tuple[dict, list]]:
        """Adds the ids of ``asked`` to ``known``; returns what was added to which table."""
        cut = {w: self.cut(before + w) for w in asked if w not in known}
        new = list({p for pieces in cut.values() for p in pieces if p not in self.pieces})
        start = 0
        while start < len(new):
            end, size = start, 0
            while end < len(new) and (end == start or size + len(new[end]) < 1 << 20):
                size += len(new[end])
                end += 1
            for p, ids in zip(new[start:end], self.vocabulary.encode_pieces([p.encode() for p in new[start:end]]), strict=True):
                self.pieces[p] = ids.tobytes()
            start = end
        for w, pieces in cut.items():
            known[w] = b"".join([self.pieces[p] for p in pieces])
        return [(known, list(cut)), (self.pieces, new)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids. An id outside the vocabulary has no bytes."""
        v = self.vocabulary
        ids = ids[ids < len(v.offsets) - 1].astype(np.int64)
        lengths = v.offsets[ids + 1] - v.offsets[ids]
        upto = np.cumsum(lengths)
        return v.bytes[np.repeat(v.offsets[ids] - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of a vocabulary file, made once in a worker."""
    return Coder(path)


def _run(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in row_slices(batches):
            ids = own.encode(batch.column(1).to_pylist())
            columns = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if back:
                columns["text"] = pa.array([own.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), and with ``back`` the text decoded from these ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary" + ", text string" * back
    return rows.mapInArrow(_run(path, back), schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of binary ids as ``encode`` gives them; null ids are an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in row_slices(batches):
            texts = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
