"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

A text in which every run of white space is one character is cut before each space. The
two vocabularies used here never join characters across such a cut (one takes the space
as the start of the next token, the other drops it), so the ids of the pieces in a row
are the ids of the text. Other texts are encoded whole. The ids of a piece are remembered
up to a bound on the number of pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np

#: Remembered pieces of a tokenizer in a worker; later ones are encoded again when they return.
MAX_PIECES = 600_000
_WIDE_SPACE = re.compile(r"\s\s")
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r'.,;:!?()"\-'
_PLAIN = re.compile(f" [{_LETTER}{_MARK}\n]+")
_CLASS_CHANGE = re.compile(f"(?<=[{_LETTER}])(?=[{_MARK}\n])|(?<=[{_MARK}])(?=[{_LETTER}\n])|(?<=\n)(?=[{_LETTER}{_MARK}])")
#: Both ways of encoding must agree on this text, or the full pattern is used for every piece.
_PROBE = "The (quick, brown) \u00c9l\u00e8ve-Stra\u00dfe; a.\nNew LINE: yes!? \u00dc\n \"end\"..."


class _Numbers(dict):
    """piece -> number, given at first sight."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """``encode(texts)`` gives the ids of each text, as the library alone would."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        #: A special token cuts a text without touching what stands beside it.
        self.cut_id, self.cut = next(((i, t.content) for i, t in sorted(special.items())), (None, None))
        self.specials = [t.content for t in special.values()]
        self.words = None
        if self.cut is not None:
            self.words = _Words(path)
            pieces = [" " + p for p in _PROBE.split(" ")[1:]]
            if not np.array_equal(self.words.ids(pieces)[0], np.concatenate(self.whole(pieces))):
                self.words = None
        self.numbers = _Numbers()  # piece with its space -> place in the next two
        self.ids = np.zeros(0, np.uint32)  # ids of all pieces in a row
        self.ends = np.zeros(1, np.int64)  # where those of each piece end, after a 0

    def encode(self, texts: list[str], batch_chars: int = 1 << 21) -> Iterator[np.ndarray]:
        """For each text the array of its ids (unsigned 32-bit)."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= batch_chars):
                chars += len(texts[end])
                end += 1
            yield from self._batch(texts[start:end])
            start = end

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self.cut is not None and "\0" not in t and not _WIDE_SPACE.search(t) and not any(s in t for s in self.specials) for t in texts]
        others = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        pieces = ["\0 " + t if t else "" for t, p in zip(texts, plain, strict=True) if p]  # "\0" marks the first piece: it has no space
        split = [t.split(" ")[1:] for t in pieces]
        for words in split:
            if words:
                words[0] = "\0" + words[0]
        used = len(self.numbers)
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        new = list(islice(reversed(self.numbers), len(self.numbers) - used))[::-1]
        ids, ends = self._new([p[1:] if p[0:1] == "\0" else " " + p for p in new])
        all_ids = np.concatenate([self.ids, ids])
        all_ends = np.concatenate([self.ends, self.ends[-1] + ends])
        starts, lengths = all_ends[numbers], all_ends[numbers + 1] - all_ends[numbers]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        row = all_ids[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        if len(self.numbers) <= MAX_PIECES:
            self.ids, self.ends = all_ids, all_ends
        else:
            for p in new:
                del self.numbers[p]
        k = 0
        for p in plain:
            if p:
                yield row[cuts[k]:cuts[k + 1]]
                k += 1
            else:
                yield next(others)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where those of each piece end."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        plain = np.array([self.words is not None and _PLAIN.fullmatch(p) is not None for p in pieces])
        first, first_ends = self.words.ids([p for p, own in zip(pieces, plain.tolist(), strict=True) if own]) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        others = [p for p, own in zip(pieces, plain.tolist(), strict=True) if not own]
        more = np.array(self.whole([self.cut.join(others) + self.cut])[0] if others else [], dtype=np.uint32)
        cut = more == self.cut_id
        more_ends = np.flatnonzero(cut) - np.arange(len(others))
        lengths, begin = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        lengths[plain], lengths[~plain] = np.diff(first_ends, prepend=0), np.diff(more_ends, prepend=0)
        begin[plain], begin[~plain] = first_ends - lengths[plain], len(first) + more_ends - lengths[~plain]
        upto = np.cumsum(lengths)
        return np.concatenate([first, more[~cut]])[np.repeat(begin - (upto - lengths), lengths) + np.arange(upto[-1])], upto


class _Words:
    """The model of a byte-level tokenizer on plain words, cut by a simple rule instead of the full pattern.

    A plain piece holds Latin-1 letters, a few punctuation marks and line ends after its space.
    For these the usual patterns come down to runs of letters, runs of marks and line ends, and
    normalisation to lower case at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.lower = self.model.normalizer is not None
        self.space = "\u0120the" in self.model.get_vocab()
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit("\1"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.between = self.model.encode("|", add_special_tokens=False).ids[0]

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = []
        for start in range(0, len(pieces), 10_000):
            text = _CLASS_CHANGE.sub("\1", "\1|\1".join(pieces[start:start + 10_000])) + "\1|"
            if not self.space:
                text = text.replace(" ", "").replace("\n", "\1")
            texts.append(text.lower() if self.lower else text)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        cut = ids == self.between
        return ids[~cut], np.flatnonzero(cut) - np.arange(len(pieces))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The tokenizer of a file, loaded once in a worker."""
    return Encoder(path)
