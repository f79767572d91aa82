"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.llm import variants
from sieveline.llm.common import Scratch
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_pairs(words):
    words = sorted(set(words))
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out = set()
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            out |= {(w, x) for x in by_size.get(size, ()) if near(w, x)}
    return out


def plain_group(counts, ratio=10):
    pairs = {w: [] for w in counts}
    for a, b in plain_pairs(counts):
        pairs[a].append(b)
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(pairs[w]), counts[form[w]] if form[w] else None))
    return rows


def found(spark, words):
    frame = local_frame(spark, [(w,) for w in words], "word string")
    rows = [tuple(r) for r in variants.neighbours(frame, Scratch(spark)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("alphabet,sizes", [("ab", (0, 8)), ("abc", (1, 6)), ("abcdeé", (3, 12)), ("aßÿ", (5, 9))])
def test_neighbours_match_brute_force(spark, alphabet, sizes):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(260)}
    for w in list(words)[:80]:  # and planted variants
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]}
    assert found(spark, words) == plain_pairs(words)


def test_runs_nested_words_and_shared_stems(spark):
    stem = "interoperab"
    words = ["a" * i for i in range(0, 20)] + [stem + x for x in ("le", "ly", "ility", "l", "", "lee", "ble")]
    words += [x + stem for x in ("x", "y", "xx", "yx")] + ["abab" * 3, "baba" * 3, "abab" * 3 + "a"]
    assert found(spark, words) == plain_pairs(words)


def test_large_frontiers_are_shuffled(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))) for _ in range(400)}
    frame = local_frame(spark, [(w,) for w in words], "word string")
    rows = variants.neighbours(frame, Scratch(spark), broadcast_states=3).collect()
    assert {tuple(r) for r in rows} == plain_pairs(words) and len(rows) == len(plain_pairs(words))


def test_long_words(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde") for _ in range(n)) for n in (62, 63, 64, 64, 65, 66, 80, 300)] + ["a" * n for n in range(60, 70)]
    words = set(base)
    for w in base:
        for i in (0, 1, len(w) // 2, len(w) - 1):
            words |= {w[:i] + w[i + 1 :], w[:i] + "é" + w[i + 1 :], w[:i] + "ab" + w[i:], w[:i] + "b" + w[i:]}
    words |= {"q" * 200_000, "q" * 199_999, "q" * 100_000 + "r" + "q" * 99_999}
    assert found(spark, words) == plain_pairs([w for w in words if len(w) < 1000]) | {
        (a, b)
        for a, b in [("q" * 200_000, "q" * 199_999), ("q" * 199_999, "q" * 200_000)]
        + [(x, y) for x in ("q" * 200_000, "q" * 199_999) for y in ("q" * 100_000 + "r" + "q" * 99_999,)]
        + [(y, x) for x in ("q" * 200_000, "q" * 199_999) for y in ("q" * 100_000 + "r" + "q" * 99_999,)]
    }


def test_groups_follow_forms_to_the_last(spark):
    counts = {"planning": 5000, "plannign": 3, "planing": 400, "plaing": 30, "paing": 2, "plannin": 5000, "plannings": 20, "alone": 7}
    frame = local_frame(spark, list(counts.items()), "word string, n long")
    got = variants.group(frame, Scratch(spark)).collect()
    assert {tuple(r) for r in got} == plain_group(counts) and len(got) == len(counts)
    assert {r["word"]: r["root"] for r in got}["paing"] == "plannin" or {r["word"]: r["root"] for r in got}["paing"] == "planning"
    with pytest.raises(ValueError):
        variants.group(frame, Scratch(spark), ratio=1)


def plain_words(docs, typo_every):
    n = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_workers_get_the_package_before_the_first_step(spark, monkeypatch):
    shipped = []
    monkeypatch.setattr(variants, "ship_package", shipped.append)
    variants.count_words(local_frame(spark, [(1, "wording")], "doc_id long, text string"))
    assert len(shipped) == 1


@pytest.mark.parametrize("typo_every", [0, 3, 31])
def test_words_are_counted_with_planted_slips(spark, typo_every):
    docs = [(1, "Überall überall ÜBERALL Planning planning, PLANNING planning! short words"), (2, "planning planing7planning_planning"), (None, "planning planning"), (3, None), (4, ""), (4, ""), (5, "planningé " * 3000)]
    wide = local_frame(spark, docs, "doc_id long, text string").select("*", F.lit("w").alias("word"), F.lit(3).alias("n"))
    got = variants.count_words(wide, typo_every=typo_every).collect()
    assert {r["word"]: r["n"] for r in got} == plain_words(docs, typo_every)
    assert variants.count_words(wide.limit(0)).count() == 0


def test_no_words_null_words_and_repeated_words(spark):
    assert found(spark, []) == set()
    assert found(spark, [None, "planning", "planning", "planing"]) == {("planning", "planing"), ("planing", "planning")}
    none = local_frame(spark, [], "word string, n long")
    assert variants.group(none, Scratch(spark)).count() == 0


def test_query_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(got) == plain_group(plain_words(docs, 31)) and len(got) == len(set(got))
