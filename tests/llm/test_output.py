"""Sharding, mixing, packing and token files against brute force and round trips."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from presslens.llm import mixing, packing, sharding, token_files
from presslens.llm.tokens import Encoder

from .conftest import messy_rows

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
ENCODERS = {p: Encoder(p) for p in (BYTES, WORDS)}


def library_ids(path, text):
    return np.array(LIBRARY[path].encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.one_of(st.sampled_from(["word", "Élan", "don't", "'s", " ", "  ", "\n", "\t", ", ", ".", "(x)", "42", "<|endoftext|>", "|", "\0", "\1", "İ", "é", "ß-", "中文", "a b c d e f"]),
                              st.text(max_size=6)), max_size=12).map("".join))
def test_ids_are_those_of_the_library(path, text):
    assert next(ENCODERS[path].encode([text])).tolist() == library_ids(path, text).tolist()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_with_a_full_memory(path, monkeypatch):
    monkeypatch.setattr("presslens.llm.tokens.MAX_PIECES", 5)
    encoder, texts = Encoder(path), [r[1] or "" for r in messy_rows()]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts, batch_chars=300)] == [library_ids(path, t).tolist() for t in texts]


def test_shards_are_contiguous_and_even(messy):
    rows = sharding.byte_shards(messy, 7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in messy_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    order = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - total / 7) <= largest + 1 for own in shards.values())


def test_shards_hold_middles_of_equal_pieces(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").repartition(5)
    got = {r.doc_id: r.shard for r in sharding.byte_shards(docs, 40).collect()}
    sizes = [i % 50 + 16 for i in range(1000)]
    upto = 0
    for i, size in enumerate(sizes):
        assert got[i] == (2 * upto + size) * 40 // (2 * sum(sizes))
        upto += size


def targets_by_hand(sizes, total=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, total * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 23), ("b", "a", None, "é", "z")[min(i % 9, 4)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, count(t), s) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want, taken = targets_by_hand(dict(sizes)), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 12  # half of the largest document
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_is_fair(spark):
    """Each document's expected copies are its share: the mean over seeds comes near it."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    copies = defaultdict(list)
    for seed in range(25):
        for r in mixing.mix(docs, seed=seed).collect():
            copies[r.doc_id].append(r.copies - r.target / r.source_size)
    assert abs(np.mean([x for v in copies.values() for x in v])) < 0.05
    assert max(abs(np.mean(v)) for v in copies.values()) < 0.45


def test_mix_of_messy_rows(messy):
    rows = messy_rows()
    got = mixing.mix(messy).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    assert all(r.taken <= 2 * r["size"] for r in got)
    taken = mixing.mixed_documents(messy)
    assert taken.columns == messy.columns
    assert taken.filter("text is not null").count() > 0


def test_packing_covers_every_id_once(messy):
    want = defaultdict(list)
    for r in messy_rows():
        ids = np.append(library_ids(WORDS, r[1]), np.uint32(2)).astype("<u4")
        want[r[0]].append(ids)
    pieces = packing.pack(messy, WORDS, 2, capacity=256, classes=16, slack=4, with_ids=True).collect()
    got = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        got[p.doc_id].append(p)
    for doc, texts in want.items():
        assert sum(p.length for p in got[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            own = sorted(got[doc], key=lambda p: p.start)
            assert [x for p in own for x in p.ids] == texts[0].tolist() and own[0].start == 0
            assert all(a.start + a.length == b.start for a, b in pairwise(own)) and {p.doc_tokens for p in own} == {len(texts[0])}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(own))
        size = own[-1].offset + own[-1].length
        assert size <= 256
        padding += 0 if size & (size - 1) == 0 else 256 - size
    assert padding <= 0.05 * sum(p.length for p in pieces)


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 300), max_size=60))
def test_packer_fills_classes(lengths):
    packer = packing.Packer(64, 8, 2)
    done = [s for i, n in enumerate(lengths) for s in packer.add(i, np.arange(n, dtype=np.uint32))] + list(packer.close())
    seen = defaultdict(list)
    for pieces in done:
        assert 0 < sum(len(p[2]) for p in pieces) <= 64
        for doc, start, ids, n in pieces:
            assert n == lengths[doc] and ids.tolist() == list(range(start, start + len(ids)))
            seen[doc] += ids.tolist()
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(lengths))


def test_token_files_round_trip(spark, messy, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(messy, folder, BYTES, 2)
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    want = Counter((r[0], tuple([*library_ids(BYTES, r[1]).tolist(), 2])) for r in messy_rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    parts = manifest.collect()
    assert sum(p.documents for p in parts) == len(got) and sum(p.tokens for p in parts) == sum(r.n_tokens for r in got)
    assert {p.kind for p in parts} == {"<u2"}
    flat = np.concatenate([np.fromfile(tmp_path / "tokens" / f"{p.name}.bin", "<u2") for p in sorted(parts, key=lambda p: p.part)])
    assert flat.tolist() == [x for r in got for x in r.ids]


def test_empty_tables(nothing, tmp_path):
    assert sharding.byte_shards(nothing, 40).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    assert packing.pack(nothing, WORDS, 2).count() == 0
    assert token_files.token_files(nothing, BYTES, 2).count() == 0
