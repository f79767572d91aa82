"""Recurring lines against a plain count, whole documents and cut ranges alike."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import linededup
from sieveline.llm.common import Scratch
from sieveline.llm.queries import ORACLES, QUERIES
from sieveline.session import local_frame
from tests.oracle_check import compare, connect

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(docs, min_docs, keep_first=False, min_chars=1):
    """{(id, text): kept text}; documents in order of id."""
    where = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            where[key(line)].add(d)
    out, seen = {}, set()
    for d in sorted(set(docs), key=lambda d: (d[0] or 0, d[1] or "")):
        kept = []
        for line in (d[1] or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars and len(where[k]) >= min_docs and not (keep_first and k not in seen):
                continue
            seen.add(k)
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def dedup(spark, docs, **rules):
    frame = local_frame(spark, docs, "doc_id long, text string")
    return linededup.keep_lines(frame, linededup.line_bitmaps(frame, Scratch(spark), **rules))


def test_query_matches_sql(spark, sf):
    assert compare(QUERIES["op11_line_dedup"](spark, sf), connect(sf), ORACLES["op11_line_dedup"]) is None


@pytest.mark.parametrize("min_docs,keep_first,min_chars", [(3, False, 1), (3, True, 1), (1, True, 1), (2, True, 4), (40, False, 1)])
def test_matches_a_plain_count(spark, min_docs, keep_first, min_chars):
    rng = random.Random(min_docs)
    line = lambda: rng.choice(["Hot line", " hot LINE\t", "", "Ä", "x", "ab ", *(f"line {rng.randrange(30)}" for _ in range(4))])
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(12)))) for i in range(120)]
    got = dedup(spark, docs, min_docs=min_docs, keep_first=keep_first, min_chars=min_chars).collect()
    want = plain(docs, min_docs, keep_first, min_chars)
    assert {r["doc_id"]: r["text"] for r in got} == {d[0]: t for d, t in want.items()}
    for r, d in ((r, docs[r["doc_id"]]) for r in got):
        assert r["n_lines"] == d[1].count("\n") + 1
        assert r["n_dropped"] == r["n_lines"] - (r["text"].count("\n") + 1 if r["n_dropped"] < r["n_lines"] else 0)


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_line_on_most_rows_fills_many_ranges(spark, keep_first):
    docs = [(i, "same\n" * (i % 3 + 1) + (f"own {i}" if i % 2 else "pair %d" % (i // 4))) for i in range(400)]
    frame = local_frame(spark, docs, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = linededup.line_bitmaps(frame, Scratch(spark), min_docs=10, keep_first=keep_first)
        got = {r["doc_id"]: r["text"] for r in linededup.keep_lines(frame, found).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {d[0]: t for d, t in plain(docs, 10, keep_first).items()}


def test_the_stream_gives_the_same_in_batches_of_any_size():
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(0, 12, 300))
    rows = sorted((int(h), 0, int(rng.integers(0, 6)), 0, i) for i, h in enumerate(hashes))
    import pyarrow as pa

    def marks(size, keep_first):
        batches = []
        for at in range(0, len(rows), size):
            cols = list(zip(*rows[at : at + size]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32())], names=list("abcde")))
        return sorted(tuple(r.values()) for b in linededup._stream(4, keep_first)(iter(batches)) for r in b.to_pylist())

    for keep_first in (False, True):
        assert marks(1, keep_first) == marks(7, keep_first) == marks(300, keep_first)


def test_nulls_blank_long_and_repeated_rows(spark):
    long = "\n".join(f"l{i % 7}" for i in range(50_000))
    docs = [(1, None), (2, ""), (None, "a\nb"), (None, "a\nc"), (3, "a\nb"), (3, "a\nb"), (4, "a"), (4, "b\r\n\n \t"), (5, long)]
    got = dedup(spark, docs, min_docs=3).orderBy("doc_id", "text").collect()
    assert len(got) == len(docs)
    texts = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in got)
    # `a` stands in four documents, `b` in three: the repeated row of id 3 counts once
    assert texts == sorted([(1, "", 1, 0), (2, "", 1, 0), (0, "", 2, 2), (0, "c", 2, 1), (3, "", 2, 2), (3, "", 2, 2), (4, "", 1, 1), (4, "\n \t", 3, 1), (5, long, 50_000, 0)])


def test_extra_columns_and_empty_tables(spark):
    names = ["k1", "k2", "h1", "h2", "pos", "row", "bitmap", "n_lines", "lang"]
    docs = local_frame(spark, [(i, "x\ny%d" % i) for i in range(3)], "doc_id long, text string")
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    got = linededup.keep_lines(wide, linededup.line_bitmaps(wide, Scratch(spark), min_docs=2))
    assert set(got.columns) == {"doc_id", "text", "n_dropped", *names}
    assert {(r["doc_id"], r["text"], r["k1"], r["row"], r["n_lines"]) for r in got.collect()} == {(i, "y%d" % i, "k1", "row", 2) for i in range(3)}
    none = wide.limit(0)
    assert linededup.keep_lines(none, linededup.line_bitmaps(none, Scratch(spark))).count() == 0


def test_bitmaps_come_back():
    rng = random.Random(1)
    for n in (1, 2, 9, 1000, 40_000):
        for share in (0, 0.01, 0.5, 1):
            gone = sorted(i for i in range(n) if rng.random() < share)
            data = linededup.encode(n, gone)
            assert np.flatnonzero(~linededup.decode(data, n)).tolist() == gone
            assert len(data) <= n // 8 + 2
    assert len(linededup.encode(40_000, [])) == 4


def test_kept_texts_have_the_digest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain([(r["doc_id"], r["text"]) for r in docs], 10)
    got = QUERIES["op11_line_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {d[0]: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
