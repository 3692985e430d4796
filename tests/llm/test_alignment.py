import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import alignment
from riskloom.llm.packing import tokenizer_path
from riskloom.llm.queries import QUERIES

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    bytes_a = {i: bytes(byte[c] for c in t) if t != "<|endoftext|>" else t.encode() for t, i in a.get_vocab().items()}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(bytes_a[i] for i in ids_a) != raw or b"".join(map(piece, ids_b)) != raw:
            return []
        ends = [[], []]
        for k, ids, size in ((0, ids_a, lambda i: len(bytes_a[i])), (1, ids_b, lambda i: len(piece(i)))):
            at = 0
            for i in ids:
                at += size(i)
                ends[k].append((at, i))
        both = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
        cut = defaultdict(lambda: ([], []))
        for k in (0, 1):
            for e, i in ends[k]:
                cut[min(x for x in (e, *both) if x >= e and x in both) if e not in both else e][k].append(i)
        return [cut[e] for e in sorted(both)]

    return groups


def brute(texts, groups):
    aligned = [groups(t) for t in texts]
    links = [[(x, y) for g in own for x in g[0] for y in g[1]] for own in aligned]
    counts = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for own, pairs in zip(aligned, links):
        spelled = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in own)
        out.append((
            sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(pairs), sum(counts[p] == best[p[0]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(spelled.encode()).hexdigest() if own else "",
        ))
    return out


def compared(found, texts, groups):
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(i, *r) for i, r in enumerate(brute(texts, groups))]


def test_align_equals_brute_force(spark, docs_of, library):
    rng = random.Random(8)
    words = ["the", "tokenization", "Straße", "ñandú", "日本語", "don't", "<|endoftext|>", "</s>", "a\nb", "x\ty", "12345", "###", "naïve", " ", "ab ", " c", "\n", "🙂", "\x00"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += [" ".join(f"{rng.choice('abcdef')}{rng.choice(['ing', 'tion', 'ouea', 'ééth'])}{rng.choice('xyz.,')}" for _ in range(30)) for _ in range(100)]
    texts += ["", None, " ", "\n", "  two  blanks ", "of ▁ own", "same words", "same words", "end\n", " front", "ﬁ ½"]
    compared(alignment.align(docs_of(list(enumerate(texts))).repartition(5), A, B), texts, library)


def test_small_chunks_and_segments_give_the_same(spark, docs_of, library, monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma  ", "delta\n", "some"]) for _ in range(400))
    assert len(list(alignment.segments(text))) == 1
    monkeypatch.setattr(alignment, "SEGMENT", 50)
    own = alignment.load(A, B)
    chunk = alignment.Chunk(own, [text, None, "alpha beta"])
    assert len(list(alignment.segments(text))) > 10
    want = brute([text, None, "alpha beta"], library)
    assert list(zip(*(x.tolist() for x in chunk.numbers), chunk.digests)) == [(*r[:4], r[6]) for r in want]


def test_empty_table_and_nulls(spark, docs_of):
    assert alignment.align(docs_of([]), A, B).count() == 0
    rows = [tuple(r) for r in alignment.align(docs_of([(None, None), (None, ""), (5, None)]), A, B).collect()]
    assert sorted(rows, key=str) == sorted([(None, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, ""), (5, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_a_text_of_many_megabytes(spark, docs_of):
    text = "some words of\na very long text tionly " * 300_000
    rows = {r.doc_id: r for r in alignment.align(docs_of([(0, text), (1, "some words of")]), A, B).collect()}
    one = {r.doc_id: r for r in alignment.align(docs_of([(0, "some words of\na very long text tionly some"), (1, "x")]), A, B).collect()}
    assert rows[0].n_a > 300_000 * (one[0].n_a - 1) - 1 and rows[1].n_a == 3


def test_query_equals_brute_force(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(docs)
    texts = [docs[i] for i in ids]
    found = sorted(tuple(r) for r in QUERIES["op12_token_alignment"](spark, folder).collect())
    assert found == [(i, *r) for i, r in zip(ids, brute(texts, fast(library, texts)))]


def fast(groups, texts):
    """The same groups by pieces between blanks, since brute force is quadratic in a text; whole texts are compared above."""
    cache = {}

    def of(text):
        if not text:
            return []
        out = []
        for word in text.split(" "):
            if word not in cache:
                cache[word] = groups(word)
            out += cache[word]
        return out

    assert all(" " not in (t or "")[:1] and "  " not in (t or "") for t in texts)
    return of
