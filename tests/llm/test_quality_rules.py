import random
import re

from riskloom.llm import quality_rules as qr


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": sum(c.isupper() for c in text or ""),
    }


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "Cé", "D#", "x|y", "\U0001d54f"])
    out = [None, "", " \n\t\x0b\x0c\r", "\x85 \xa0x", "one", "a a\n" * 9, "w " * 20_000, "a b c d e f g h " * 3, "A B C D E F G H i A B C D E F G H"]
    return out + [(" " if i % 2 else "\n").join(word() for _ in range(rng.randint(1, 80))) for i in range(80)]


def test_ledger_equals_brute_force(docs_of):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "none")]
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in qr.ledger(docs_of(rows).withColumnRenamed("source", "n_lines")).collect()}
    for i, t in rows:
        m = measures(t)
        r = got[i, m["n_words"], m["word_chars"]]
        assert {c: r[c] for c in m} == m, t
        fails = [eval(rule.replace(" OR ", " or "), {}, m) for rule in qr.RULES.values()]  # noqa: S307
        assert r.failures == sum(1 << b for b, f in enumerate(fails) if f)
    assert qr.ledger(docs_of([])).count() == 0


def test_policies_and_ablations_read_the_bits(spark):
    bits = [0, 1, 2, 3, 4, 12, 32, 63, 8]
    entries = spark.createDataFrame(list(enumerate(bits)), "doc_id bigint, failures bigint")
    got = {(r.doc_id, r.policy): r.kept for r in qr.apply_policies(entries).collect()}
    assert got == {(i, v): not b & qr.mask(rules) for i, b in enumerate(bits) for v, rules in qr.POLICIES.items()}
    for rules in qr.POLICIES.values():
        m = qr.mask(rules)
        want = {r: (sum(bool(b & qr.mask([r])) for b in bits), sum(b & m == qr.mask([r]) for b in bits)) for r in rules}
        assert {r.rule: (r.failed, r.regained) for r in qr.ablations(entries, rules).collect()} == want
    assert all((r.failed, r.regained) == (0, 0) for r in qr.ablations(entries.limit(0), qr.BASE).collect())
