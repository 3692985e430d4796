import itertools
import random

import numpy as np
import pytest

from riskloom.llm import language


def best_path(scores, penalty):
    """Smallest best labelling over all of them."""
    n, k = scores.shape
    value = lambda path: sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 5, 3, 6, 1, 4])
    starts = np.cumsum(sizes) - sizes
    for penalty in (0.0, 0.7, 3.0):
        scores = rng.standard_normal((sizes.sum(), 3))
        labels = language.viterbi(scores, starts, sizes, penalty)
        for s, n in zip(starts, sizes):
            best, value = best_path(scores[s : s + n], penalty)
            assert value(labels[s : s + n].tolist()) == pytest.approx(best)


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    kinds = {"aa": ["the", "ing", "of", "wh"], "bb": ["eau", "oui", "le", "que"], "ru": ["при", "вет", "ст", "о"]}
    rows = [(words(rng, s, 40), lang) for lang, s in kinds.items() for _ in range(20)] + [(None, "aa"), ("x y", None), ("", "bb"), ("12", "zz")]
    return language.train(spark.createDataFrame(rows, "text string, lang string")), kinds


def test_texts_get_their_language(docs_of, model):
    m, kinds = model
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        lang = sorted(kinds)[i % 3]
        rows.append((i, words(rng, kinds[lang], rng.randint(3, 50))))
        want[i] = lang
    rows += [(100, None), (101, ""), (102, "12 #!\n"), (103, "the " * 40_000), (103, "the " * 40_000)]
    want |= {100: "und", 101: "und", 102: "und", 103: "aa"}
    got = language.identify(docs_of(rows), m).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got} == want
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(docs_of([]), m).count() == 0


def test_spans_of_mixed_texts(docs_of, model):
    m, kinds = model
    rng = random.Random(6)
    parts = [words(rng, kinds[x], 25) for x in ("aa", "ru", "bb")]
    text = " ... ".join(parts)
    [row] = language.spans(docs_of([(1, text)]), m).collect()
    assert [s.lang for s in row.spans] == ["aa", "ru", "bb"]
    assert [text[s.start : s.end] for s in row.spans] == parts
    assert [tuple(r) for r in language.spans(docs_of([(2, None), (3, "1")]), m).collect()] == [(2, []), (3, [])]


def test_scripts_narrow_the_candidates(docs_of, model):
    m, _ = model
    assert m.langs == ["aa", "bb", "ru", "zz"]
    latin, cyrillic = language.NAMES.index("latin"), language.NAMES.index("cyrillic")
    assert m.allowed[latin].tolist() == [True, True, False, False] and m.allowed[cyrillic].tolist() == [False, False, True, False]


def test_a_model_without_texts_knows_nothing(spark, docs_of):
    m = language.train(spark.createDataFrame([], "text string, lang string"))
    assert [tuple(r) for r in language.identify(docs_of([(1, "abc")]), m).collect()] == [(1, "und", 0.0)]
    assert [tuple(r) for r in language.spans(docs_of([(1, "abc")]), m).collect()] == [(1, [])]
