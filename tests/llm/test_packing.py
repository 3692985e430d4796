import random
import zlib

import numpy as np
import pytest

from riskloom.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))

TEXTS = [
    None, "", " \n", "Hello it's THE world's 42nd test!!'s ''d", "a\x00b \x0b c\x1cd", "É é İ ǅ Σίσυφος ΑΣ", "<|endoftext|> x <| y",
    "one two three ²½ ŉ ſ ª", "日本語 и русский", "_under_ #*$%& |||", "word " * 9000, "don't we'll I'm they've you're he'd",
]


def test_ids_equal_the_tokenizers():
    t = packing.WordTokenizer(PATH)
    rng = random.Random(1)
    chars = [chr(c) for c in range(32, 384)] + list("  \n\t'")
    texts = [x for x in TEXTS if x] + ["".join(rng.choices(chars, k=rng.randint(1, 80))) for _ in range(3000)]
    for text in texts:
        want = np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert t.ids(text) == want, text[:80]


def check(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    t = packing.WordTokenizer(PATH)
    for i, text in texts.items():
        ids = t.ids(text or "") + b"\x01\0\0\0"
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            assert p.length == min(capacity, len(ids) // 4 - at)
            at += p.length
        assert at == len(ids) // 4
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_places_are_gapless_and_pieces_whole(docs_of):
    rng = random.Random(2)
    texts = dict(enumerate(TEXTS)) | {100 + i: "tok " * rng.choice([3, 7, 7, 31, 60, 61, 200]) for i in range(300)}
    rows = packing.pack(packing.pieces(docs_of(list(texts.items())), PATH, 64), 64).collect()
    n = check(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= 1.02 * total / 64 + 1


def test_empty_and_repeated_rows(docs_of):
    assert packing.pack(packing.pieces(docs_of([]), PATH)).count() == 0
    rows = packing.pack(packing.pieces(docs_of([(1, "a b"), (1, "a b"), (None, None)]), PATH)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert sorted(r.offset + r.length for r in rows)[-1] == 7 and {r.sequence_id for r in rows} == {0}


@pytest.mark.parametrize("seed", range(20))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(1, 60))}
    patterns = packing.plan(counts, 100)
    used = {}
    for times, lengths in patterns:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_exact_complements_fill_sequences():
    single = packing.plan({60: 5, 40: 5}, 100)
    pairs = packing.plan({50: 4, 30: 4, 20: 4}, 100)
    triples = packing.plan({55: 3, 20: 3, 15: 3, 10: 3, 44: 3}, 100)
    for patterns, total in ((single, 5), (pairs, 4)):
        assert all(sum(x) == 100 for _, x in patterns) and sum(t for t, _ in patterns) == total
    assert (3, [55, 20, 15, 10]) in triples
