"""Katz backoff against a direct computation, and its probabilities adding up to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import katz
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), katz.END]


def discounts(counts):
    n = Counter(counts)
    k = katz.DISCOUNTED
    d = dict.fromkeys(range(1, k + 1), 1.0)
    if n[1]:
        cut = (k + 1) * n[k + 1] / n[1]
        for r in d:
            if n[r] and cut < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < x < 1:
                    d[r] = x
    return lambda c: d.get(c, 1.0) * c


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            own = tokens(t)
            self.uni.update(own)
            for h, w in zip([None, *own], own):
                self.bi[h][w] += 1
        self.n = sum(self.uni.values())
        self.d1 = discounts(self.uni.values())
        self.d2 = discounts([c for own in self.bi.values() for c in own.values()])
        lost = sum(c - self.d1(c) for c in self.uni.values())
        self.scale = self.n if lost > 0 else self.n + 1
        self.unknown = (lost if lost > 0 else 1) / self.scale

    def word(self, w):
        return self.d1(self.uni[w]) / self.scale if w in self.uni else self.unknown

    def prob(self, h, w):
        own = self.bi.get(h)
        if not own:
            return self.word(w)
        total = sum(own.values())
        lost = sum(c - self.d2(c) for c in own.values())
        total, lost = (total, lost) if lost > 0 else (total + 1, 1)
        if w in own:
            return self.d2(own[w]) / total
        return lost / total / (1 - sum(map(self.word, own))) * self.word(w)


def check(rows, got):
    """rows: (doc_id, text, held)"""
    model = Plain([t for _, t, held in rows if not held])
    want = Counter()
    for i, t, held in rows:
        own = tokens(t)
        base = sum(math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1)) for w in own)
        full = sum(math.log10(model.prob(h, w)) for h, w in zip([None, *own], own))
        want[i, held, len(own), sum(w in model.uni for w in own), model.n, round(base, 6), round(full, 6)] += 1
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    for key in want.keys() | have.keys():
        if want[key] != have[key]:
            near = [k for k in have if k[:5] == key[:5] and abs(k[5] - key[5]) < 1e-5 * max(1, abs(key[5])) and abs(k[6] - key[6]) < 1e-5 * max(1, abs(key[6]))]
            assert near, key
    assert sum(want.values()) == sum(have.values())


def test_query_matches_direct_computation(spark, sf):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, QUERIES["op10_katz"](spark, sf).collect())


@pytest.mark.parametrize("buckets,chunk,share", [(1, 1 << 20, 4), (7, 1, 4), (5, 200, 1000)])
def test_edge_cases(spark, monkeypatch, buckets, chunk, share):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    texts = [None, "", " \t", "a", "A b\x0bc", "a b a b a b c d", "the the the the " * 400, "é É ñ", "x" * 3000, "a b c. a b d! " * 30, "new words here", " a b ", "b qqq b qqq rrr"]
    rows = [(i, t, i in (5, 7, 10, 12)) for i, t in enumerate(texts)] + [(3, "a", False), (3, "a", False), (None, "a b", True)]
    docs = local_frame(spark, rows, "doc_id long, text string, held boolean").withColumn("score", F.lit("x")).repartition(3)
    check(rows, katz.score(docs, F.col("held"), buckets).collect())
    assert katz.score(docs.limit(0), F.col("held"), buckets).count() == 0
    out = katz.score(docs, F.lit(True), buckets).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out} == {(0, 0, 0.0, 0.0)}


def test_probabilities_add_up():
    model = Plain(["a b a c a d e f g a b", "b c d a", "a a a b h i j k", ""])
    for h in [None, "a", "b", "k", "zz"]:
        assert sum(model.prob(h, w) for w in [*model.uni, "?"]) == pytest.approx(1)


def test_blocks_round_trip():
    arrays = {"a": np.array([3, 70000, 2**40], np.uint64), "b": np.zeros(0, np.uint32), "c": np.array([1.5]), "d": [None, 4]}
    got = katz._unpacked(katz._packed(**arrays))
    assert all((got[k] == v).all() if isinstance(v, np.ndarray) else got[k] == v for k, v in arrays.items())
