"""Byte-level BPE against the library and against plain merging."""

import json
import random

import numpy as np
import pytest

from presslens.llm import bpe

from .conftest import messy_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def agree(library, texts):
    for text, own, want in zip(texts, bpe.coder(PATH).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(own, "<u4")
        assert ids.tolist() == want.ids, text[:100]
        assert bpe.coder(PATH).decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_random_texts(library):
    rng = random.Random(1)
    odd = "abcdefghij  \n\t'AB012.,-é中\x1c\x85　​😀" + "\0"
    agree(library, ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(4000)])
    agree(library, ["".join(rng.choice("aabeinrst") for _ in range(rng.randint(0, 300))) for _ in range(500)])


def test_runs_and_special_tokens(library):
    agree(library, ["a" * n for n in range(150)] + [" " * n + "x" for n in range(150)] + ["-" * n for n in range(150)])
    agree(library, ["<|endoftext|>", "x<|endoftext|> y  <|endoftext|><|endoftext|>\n", "<|endoftext", "x" * 30_000, "ab" * 20_000, "Ā" * 50, ""])


def test_every_code_point(library):
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    agree(library, [f"a{c}b 1{c} {c}.{c}" for c in points])


def test_compatible_pairs_are_those_that_plain_merging_keeps():
    v = bpe.coder(PATH).vocabulary
    single = {v.bytes[v.offsets[i]]: i for i in range(len(v.length)) if v.length[i] == 1}

    def merged(data):
        ids = [single[b] for b in data]
        while True:
            ranked = [(v.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:]))]
            if not ranked or min(ranked)[0] == 1 << 30:
                return ids
            i = min(ranked)[1]
            whole = next(w for w in by_pair[(ids[i], ids[i + 1])])
            ids[i:i + 2] = [whole]

    by_pair = {}
    for whole, (a, b, _) in v.parts.items():
        by_pair.setdefault((a, b), []).append(whole)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3000, 3000), rng.integers(0, 3000, 3000)
    of = lambda t: v.bytes[v.offsets[t]:v.offsets[t + 1]].tobytes()
    want = [merged(of(a) + of(b)) == [a, b] for a, b in zip(x.tolist(), y.tolist())]
    assert 0.2 < np.mean(want) < 1 and v._fits(x, y).tolist() == want
    assert v._fits(x, y).tolist() == want  # from the table


def test_small_bounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(bpe, "TABLE", 16)
    own = bpe.Coder(PATH)
    texts = [r[1] or "" for r in messy_rows()]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(own.words) <= 20 and len(own.pieces) <= 20


def test_rows(spark, messy, nothing, library):
    coded = bpe.encode(messy, PATH, back=True)
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in messy_rows())
    assert sorted((repr(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in coded.collect()) == want
    back = bpe.decode(bpe.encode(messy, PATH), PATH)
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((a, t) for a, _, t in want)
    assert bpe.encode(nothing, PATH).count() == 0 and bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0


def test_broken_bytes_and_unknown_ids():
    own = bpe.coder(PATH)
    cut = np.frombuffer(own.encode(["é中"])[0], "<u4")
    assert own.decode(cut[:1]) in ("é", "�") and own.decode(np.array([999_999], np.uint32)) == ""


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    (tmp_path / "reversed.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "reversed.json"))
