import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import byte_bpe, nnls_packing
from riskloom.llm.packing import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def padding(fill, window):
    return 0 if fill & (fill - 1) == 0 else window - fill


def checked(rows, texts, window):
    """The pieces give the ids of each document exactly once, in sequences without gaps; sum of the padding."""
    library = Tokenizer.from_file(PATH)
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    by_doc = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for i, ids in by_doc.items():
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(own) == len(want)
    total = 0
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= window
        total += padding(end, window)
    return total


@pytest.mark.parametrize("window", [64, 1024])
def test_pack_equals_the_tokenizer_without_padding(spark, docs_of, window):
    rng = random.Random(3)
    words = ["alpha", "Straße", "ñandú", "don't", "<|endoftext|>", "\n", "  ", "12345", "日本", "###", " "]
    texts = [" ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(3, 1)))) for _ in range(300)]
    texts += ["", None, "same text again", "same text again", " ".join(["long"] * 5000), "x" * 3000]
    rows = nnls_packing.pack(nnls_packing.pieces(docs_of(list(enumerate(texts))), PATH, window), PATH, window).collect()
    assert checked(rows, texts, window) == 0


def test_one_length_only_and_equal_rows(spark, docs_of):
    texts = ["one two three four five six"] * 40
    rows = nnls_packing.pack(nnls_packing.pieces(docs_of(list(enumerate(texts))), PATH, 64), PATH, 64).collect()
    assert checked(rows, texts, 64) == 0
    same = nnls_packing.pack(nnls_packing.pieces(docs_of([(1, "a b c")] * 5 + [(None, None)]), PATH, 16), PATH, 16).collect()
    assert sum(r.length for r in same) == 5 * 4 + 1
    assert nnls_packing.pack(nnls_packing.pieces(docs_of([]), PATH), PATH).count() == 0


def test_a_text_of_many_megabytes(spark, docs_of):
    text = "some words of a very long text " * 300_000
    rows = nnls_packing.pack(nnls_packing.pieces(docs_of([(0, text), (1, "short")]), PATH), PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 0) == rows[0].doc_tokens or rows[0].doc_id == 1
    assert {r.offset for r in rows if r.length == 1024} == {0}


def test_combinations_equal_brute_force():
    counts = np.bincount([3, 5, 8, 11, 16, 4, 12, 1, 15], minlength=17)
    want = {(a, 16 - a, 0) for a in range(8, 16) if counts[a] and counts[16 - a]}
    want |= {(a, b, 16 - a - b) for a in range(1, 16) for b in range(1, a + 1) if 0 < 16 - a - b <= b and counts[a] and counts[b] and counts[16 - a - b]}
    assert set(map(tuple, nnls_packing.combinations(counts.copy()).tolist())) == want


def test_solution_satisfies_the_optimality_conditions():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 64, 3000), minlength=65).astype(float)
    counts[64] = 0
    parts = nnls_packing.combinations(counts.copy())
    x = nnls_packing.least_squares(parts, counts, 20_000)
    used = np.zeros(65)
    for row, n in zip(parts, x):
        for length in row[row > 0]:
            used[length] += n
    gradient = np.array([sum(used[p] - counts[p] for p in row if p) for row in parts])
    size = counts.max()
    assert x.min() >= 0 and gradient.min() > -0.01 * size and np.abs(gradient * x).max() < 0.05 * size * x.max()


def test_rounding_keeps_sums_and_plan_uses_each_piece_once():
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.integers(1, 65, 2000), minlength=65)
    left = counts.copy()
    left[64] = 0
    parts = nnls_packing.combinations(left)
    x = rng.random(len(parts)) * 3
    whole = nnls_packing.rounded(parts, x)
    for longest in np.unique(parts[:, 0]):
        own = parts[:, 0] == longest
        assert abs(whole[own].sum() - x[own].sum()) <= 0.5 + 1e-6 and (np.abs(whole - x)[own] <= 1.0 + 1e-6).all()
    found = nnls_packing.plan(counts)
    fill = defaultdict(int)
    for length in range(1, 65):
        ranks = np.arange(counts[length])
        sequence, offset, position = nnls_packing.places(found, 64, np.full(len(ranks), length), ranks)
        for s, p in zip(sequence, position):
            if p < 0:
                fill[int(s)] += length
            else:
                for _, n, t, _ in nnls_packing.parts_of(found, 64, int(p), length):
                    fill[t] += n
    assert sum(padding(n, 64) for n in fill.values()) == 0 and sum(fill.values()) == (counts * np.arange(65)).sum()


def test_ids_equal_the_library_for_every_kind_of_character():
    library, own = Tokenizer.from_file(PATH), byte_bpe.load(PATH)
    for low in range(0, 0x30000, 997):
        text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2\n{chr(c)}{chr(c)} x" for c in range(low, low + 60) if not 0xD800 <= c <= 0xDFFF)
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert b"".join(own.bytes[i] for i in own.plain_ids(text)) == text.encode()
