"""SimHash groups against brute force over all pairs of fingerprints."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import simhash
from sieveline.llm.common import Scratch
from sieveline.llm.components import components
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame


def plain_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, bits):
    """least id reachable, by brute force; prints: (id, fingerprint)"""
    values = sorted({f for _, f in prints})
    parent = {f: f for f in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        least[root(f)] = min(i, least.get(root(f), i))
    return [least[root(f)] for _, f in prints]


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_print(r["text"])) for r in rows]
    want = {i: (f"{f:016x}", g) for (i, f), g in zip(prints, grouped(prints, 2))}
    got = QUERIES["op4_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("bits,segments,crowd", [(0, 2, 32), (1, 2, 2), (2, 2, 2), (2, 2, 32), (2, 3, 4), (3, 2, 3), (4, 3, 4)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bits, segments, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(bits * 10 + segments)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        values |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(20)}
    values = sorted(values)
    fps = local_frame(spark, [(simhash._signed(v),) for v in values], "fp long")
    scratch = Scratch(spark)
    labels = {r["node"]: r["label"] for r in components(simhash.links(fps, scratch, bits, segments), scratch).collect()}
    mine = [labels.get(simhash._signed(v), simhash._signed(v)) for v in values]
    want = grouped([(i, v) for i, v in enumerate(values)], bits)
    pairs = lambda xs: [[j for j, y in enumerate(xs) if y == x] for x in xs]
    assert pairs(mine) == pairs(want)


def test_edge_cases(spark):
    long = "w x y z " * 30000
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c d", "A B\nC D", long, long + "end", "é à ü"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, "one", "x"), (None, "one", None), (None, "unlike anything else here", None)]
    docs = local_frame(spark, rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[0] == by[1] == by[2] == {(0, 0)}
    assert {c for _, c in by[3] | by[4]} == {3} and by[6] == {(by[6].copy().pop()[0], 6)} and {c for _, c in by[7]} == {6}
    assert {c for _, c in by[None]} == {3, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 5, 6, 10, None} <= set(ids) and not {1, 2, 4, 7} & set(ids)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    apart = ["the quick brown fox jumps over a lazy dog", "seven ships sail slowly past the harbour wall", "never mix paint with cold water"]
    rows = [(None, apart[0]), (None, apart[1]), (None, apart[1]), (7, apart[0] + " twice as high"), (7, apart[2]), (7, apart[2]), (9, apart[2])]
    docs = local_frame(spark, rows, "doc_id long, text string")
    assert len({plain_print(t) for _, t in rows}) == 4
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted({(i, t) for i, t in rows if i != 9}, key=str)


def test_components_on_a_chain_a_hub_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = local_frame(spark, chain + hub + [(5, 5), (7000, 7000), (6, 5), (2000, -3)], "src long, dst long")
    labels = {r["node"]: r["label"] for r in components(edges, Scratch(spark)).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and len({labels[1000 + i] for i in range(400)}) == 1
    assert labels[2000] == labels[-3] and len(set(labels.values())) == 3 and 7000 not in labels
    assert components(edges.limit(0), Scratch(spark)).count() == 0
