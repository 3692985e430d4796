import random
from itertools import combinations

from riskloom.llm import suffix_dedup


def brute(rows, length):
    places = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            places[s] = places.get(s, 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if places[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i is None, i or 0, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def corpus(seed, unit):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.randint(unit // 2, 3 * unit)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(passages) if rng.random() < 0.6 else text(rng.randint(1, 2 * unit))
            if rng.random() < 0.4:
                k = rng.randrange(len(part))
                part = part[:k] + "#" + part[k + 1 :]
            parts.append(part)
        rows.append((i, "".join(parts)))
    rows += [(80, rows[0][1]), (80, rows[0][1]), (81, rows[1][1] * 2), (None, rows[2][1]), (82, None), (83, ""), (84, "a" * 3 * unit), (85, "ab" * 3 * unit), (80, rows[3][1])]
    return rows


def got(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in docs.collect())


def test_removal_equals_brute_force(docs_of):
    for seed, length, gram, tree_rows in ((1, 400, 200, 200), (2, 40, 12, 200), (3, 40, 20, 3), (4, 24, 24, 200)):
        rows = corpus(seed, length)
        assert got(suffix_dedup.deduplicate(docs_of(rows), length, gram, tree_rows)) == brute(rows, length)


def test_empty_table(docs_of):
    assert suffix_dedup.deduplicate(docs_of([])).count() == 0


def test_intervals_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        lcp = [rng.randrange(4) for _ in range(rng.randrange(9))]
        want = set()
        for a, b in combinations(range(len(lcp) + 1), 2):
            h = min(lcp[a:b])
            if (a == 0 or lcp[a - 1] < h) and (b == len(lcp) or lcp[b] < h):
                want.add((h, a, b))
        assert set(suffix_dedup.intervals(lcp)) == want


def test_maximal_repeats_have_all_their_occurrences():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 7)
        left = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(n)]
        right = [b"x" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(n)]
        want = set()
        for k in range(2, n + 1):
            for some in combinations(range(n), k):
                b = min(suffix_dedup.common(left[i], left[j]) for i, j in combinations(some, 2))
                a = min(suffix_dedup.common(right[i], right[j]) for i, j in combinations(some, 2))
                have = tuple(i for i in range(n) if suffix_dedup.common(left[i], left[some[0]]) >= b and suffix_dedup.common(right[i], right[some[0]]) >= a)
                if have == some and a + b >= 3:
                    want.add((b, a, some))
        found = [(b, a, tuple(sorted(m))) for b, a, m in suffix_dedup.maximal_repeats(left, right, 3)]
        assert len(found) == len(set(found)) and set(found) == want
