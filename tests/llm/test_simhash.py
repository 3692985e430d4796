import random

import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def slow_components(fps, radius):
    ids, parent = sorted(fps), {}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_follow_the_definition(docs_of):
    texts = [None, "", " \n\t", "One", "a B", "a b c", "A b c d", "ÄB äb x y z " * 50, "x " * 2000, "É É É\x0bé é"]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(6):
            x = seed
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for bucket in (8, 10_000):
        nodes = simhash.connected_components(simhash.linked(df, len(signed), bucket=bucket)).collect()
        got = {}
        for r in nodes:
            got.setdefault(r.component, set()).add(r.node)
        want = {}
        for x, c in slow_components({x: x for x in signed}, 2).items():
            want.setdefault(c, set()).add(x)
        real = set(signed)
        parts = {frozenset(g & real) for g in got.values() if len(g & real) > 1}
        assert parts == {frozenset(g) for g in want.values() if len(g) > 1}


def test_repeats_nulls_and_empty_tables(docs_of):
    text = "the quick brown fox jumps over the lazy dog " * 5
    rows = [(4, text), (2, text.upper()), (2, text.upper()), (9, None), (7, ""), (5, "something else entirely different here"), (None, text)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect())
    assert got == [(False, 2, 2), (False, 2, 2), (False, 4, 2), (False, 5, 5), (False, 7, 7), (False, 9, 7), (True, 0, 2)]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_near_copies_share_a_component(docs_of):
    rng = random.Random(5)
    words = [str(rng.getrandbits(30)) for _ in range(3000)]
    other = [*words[:1500], "changed", *words[1501:]]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))])).collect()}
    fps = {i: slow_fingerprint(t) for i, t in ((1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words))))}
    assert got == slow_components(fps, 2)


def test_document_columns_are_not_read(docs_of):
    frame = docs_of([(1, "a b c d")]).withColumn("fp", F.lit("clash"))
    assert simhash.near_duplicates(frame).columns == ["doc_id", "fp", "group", "component_id"]
