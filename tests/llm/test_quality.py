"""Quality rules against a plain restatement, and the binomial bound against exact sums."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.llm import quality
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def check(rows, got):
    want = sorted(((i, *base(t)) for i, t in rows), key=str)
    have = sorted(
        (tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got),
        key=str,
    )
    assert have == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_base_counts_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], QUERIES["op2_quality_rules"](spark, sf).collect())


def test_edge_cases(spark):
    long = "a b c d e f " * 3000
    texts = [None, "", " \t\n", "x", "a b c d e a b c d e", "é#\n\né#\n \t\né#", long, long, "a\x0bb\x0cc\rd e  f", "w " * 11]
    rows = [(i if i else None, t, None, None, None) for i, t in enumerate(texts)]
    docs = local_frame(spark, rows + rows[4:5], SCHEMA).withColumn("n_words", F.lit("x"))
    labels = local_frame(spark, [(1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    measured, cutoffs = quality.fit(docs, labels)
    assert cutoffs.count() == 0
    check([(r[0], r[1]) for r in rows + rows[4:5]], quality.verdicts(measured, cutoffs).collect())
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 0
    empty = docs.limit(0)
    assert quality.verdicts(*quality.fit(empty, labels.limit(0))).count() == 0


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (50, 3, 0.1), (400, 2, 0.01), (5000, 30, 0.01), (7, 7, 0.9), (1, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    df = local_frame(spark, [(k, n)], "k long, n long")
    got = df.select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert got == pytest.approx(1.0 if k > n * p else exact, rel=1e-9)


def test_cutoffs_hold_their_risk_per_stratum(spark):
    def doc(i):
        good, lang = i % 4 != 0, ("en", "de")[i % 2]
        words = [f"w{i}x{j}" for j in range(40)]
        if not good:
            words = [w + "###" for w in words]
        return (i, " ".join(words), lang, None, None), (i, int(good), 0)

    made = [doc(i) for i in range(2400)] + [((9000 + i, "### " * 3 + " ".join(f"q{i}y{j}" for j in range(30)), "fr", None, None), (9000 + i, i % 2, 0)) for i in range(40)]
    docs = local_frame(spark, [d for d, _ in made], SCHEMA)
    labels = local_frame(spark, [x for _, x in made], "doc_id long, quality int, toxic int")
    measured, cutoffs = quality.fit(docs, labels)
    rows = cutoffs.collect()
    assert rows and {r["stratum"] for r in rows} <= {"en", "de"}  # fr has too few labels to prove anything
    for r in rows:
        assert r["p_value"] <= 0.05 / (3 * len(quality.CUTOFFS)) and r["n_lost"] <= 0.01 * r["n_good"]
    out = {r["doc_id"]: r["kept"] for r in quality.verdicts(measured, cutoffs).collect()}
    assert all(out[i] == (i % 4 != 0) for i in range(2400) if ("en", "de")[i % 2] in {r["stratum"] for r in rows})
    assert all(out[9000 + i] for i in range(40))
    assert quality.filter_documents(docs, labels).count() == sum(out.values())
