"""Quality rules as a bitmask ledger: measure once, judge by any policy afterwards.

Only DataFrame functions. One pass over the texts writes the measurements and one bit for each failed rule;
policies are masks over those bits, so that a new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import unclashing

SPACE = r"\x20\x09-\x0D"
REPEAT_WINDOW = 8
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

# Rules in the order of their bits: name -> SQL condition of failure over the measurements.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "100 * n_upper > 40 * word_chars",
}
BASE = ["few_words", "repeated_windows"]

# Policies by version: the rules whose failure rejects a document.
POLICIES = {1: BASE, 2: [*BASE, "word_length", "symbols", "repeated_lines"], 3: list(RULES)}
CURRENT = 3


def mask(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _text_measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Words as hashes, and what is counted on characters and lines."""
    text = _filled(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    cut = docs.select(
        "doc_id", *carry,
        F.transform(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        lines.alias("lines"),
    )
    return cut.select(
        "doc_id", *carry, "words", "word_chars", "n_symbols", "n_upper",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows of eight whose word sequence is found twice or more in the text.

    Windows are 64-bit hashes of word hashes. Texts without a repeated hash stop there; in the others the
    hashes are sorted with their places, and the places of repeated ones are added up without overlap.
    """
    w = F.col("words")
    window = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - REPEAT_WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(REPEAT_WINDOW)]),
    )
    df = df.withColumn("windows", F.when(F.col("n_words") >= REPEAT_WINDOW, window))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.col("windows").isNotNull() & repeats, placed))
    p = F.col("placed")
    twice = F.filter(
        p, lambda x, j: (x["h"] == F.get(p, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(p, j - 1)["h"]))
    )
    df = df.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
    total = F.aggregate(
        "at", start,
        lambda acc, x: F.struct(
            (acc["n"] + F.least(F.lit(REPEAT_WINDOW), x - acc["last"]).cast("bigint")).alias("n"), x.alias("last")
        ),
    )["n"]
    return df.withColumn("n_repeat_words", F.when(p.isNull(), F.lit(0).cast("bigint")).otherwise(total))


def ledger(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the measurements and ``failures``, a bit for each rule of ``RULES`` that the text fails.

    One row per input row, also for repeated or NULL doc_ids. A NULL or empty text has no words and
    measures zero everywhere. Other columns of ``docs`` are left out, save those named in ``carry``.
    """
    carry = carry or []
    unclashing(carry, ["doc_id", *MEASUREMENTS, "failures"])
    texts = docs.select("doc_id", "text", *[c for c in carry if c != "text"])
    # generated rather than projected, so that a filter on the result is not pushed down with all that it is made of
    values = F.struct(*MEASUREMENTS)
    measured = _repeat_words(_text_measures(texts, carry)).select("doc_id", F.inline(F.array(values)), *carry)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures.cast("bigint"))


def rejects(rules: list[str]) -> Column:
    """True where a ledger row fails one of ``rules``."""
    return F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0


def apply_policies(entries: DataFrame, policies: dict[int, list[str]] = POLICIES) -> DataFrame:
    """Ledger rows with ``policy, kept`` for each policy version."""
    verdicts = F.array(*[F.struct(F.lit(v).alias("policy"), (~rejects(rules)).alias("kept")) for v, rules in policies.items()])
    return entries.withColumn("verdict", F.explode(verdicts)).select(*entries.columns, "verdict.*")


def ablations(entries: DataFrame, rules: list[str]) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those kept again if it alone is dropped.

    One aggregation over the ledger: a document comes back without a rule if, of the policy's bits, it has
    that one only. An empty ledger gives zeros.
    """
    failed = F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("bigint"))
    sums = [F.count(F.when(failed.bitwiseAND(F.lit(mask([r])).cast("bigint")) != 0, 1)).alias(f"fail_{r}") for r in rules]
    alone = [F.count(F.when(failed == mask([r]), 1)).alias(f"alone_{r}") for r in rules]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("failed"), F.col(f"alone_{r}").alias("regained")) for r in rules])
    return entries.agg(*sums, *alone).select(F.inline(rows))
