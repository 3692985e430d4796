import random

from riskloom.llm import substring_dedup


def brute(rows, window):
    """word sequences of all windows, by the smallest doc_id they start in"""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            if i is not None:
                seq = tuple(ws[p : p + window])
                first[seq] = min(i, first.get(seq, i))
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i is None, i or 0, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out)


def corpus(seed, unit):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "Ça", "x,"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randint(unit // 2, 4 * unit))] for _ in range(6)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 3 * unit))]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            ws += part
        rows.append((100 - i, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (300, None), (301, ""), (302, " \n "), (303, "a " * 5000), (304, "a " * 400)]
    return rows


def got(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in docs.collect())


def test_removal_equals_brute_force(docs_of):
    for seed, window, gram in ((1, 50, 16), (2, 10, 4), (3, 6, 6)):
        rows = corpus(seed, window)
        assert got(substring_dedup.deduplicate(docs_of(rows), window, gram)) == brute(rows, window)


def test_empty_table(docs_of):
    assert substring_dedup.deduplicate(docs_of([])).count() == 0
