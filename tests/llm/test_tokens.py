"""Encoder, wavelet shards and packing against the tokenizer itself and plain recomputation."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import packing, wavelet
from sieveline.llm.common import Scratch
from sieveline.llm.queries import QUERIES, tokenizer_path
from sieveline.llm.tokens import Encoder
from sieveline.session import local_frame, scratch_path

ODD = [
    None, "", " \n\t", "a", "don't we'll I'M it's 'tis ''s 'll'd", "İSTANBUL ÀÉ ß ſ K ﬁ ½ ² naïve", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "y ́é é é", "日本語 text!!..\"'s", "a\x00b \x1c c\x85d\xa0e f", "ΑΣ ΑΣ. Ⅷ ñÑ×÷ªº¼", "THE!! the,the.3,000 +1 (377) 555-0271 a@b.c",
    "word " * 9000 + "end", "x" * 5000, "one. two! three? " * 700,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def expected(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_file(plain, spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for limit in (600_000, 40):
        enc = Encoder(tokenizer_path(), limit)
        got = [ids.tolist() for at in range(0, len(texts), 7) for ids in enc.batch(pa.array(texts[at : at + 7], pa.string()))]
        assert got == [expected(plain, t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("n,levels,top", [(0, 3, 8), (1, 1, 2), (513, 4, 16), (3000, 16, 50000), (1024, 17, 100000)])
def test_wavelet_matrix(n, levels, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    ids[: n // 2] %= 5
    data = wavelet.dump(wavelet.WaveletMatrix.build(ids, levels), [None, 5], [n, 0])
    matrix, doc_ids, lengths = wavelet.load(data)
    assert doc_ids == [None, 5] and lengths.tolist() == [n, 0]
    assert (matrix.decode() == ids).all() and (matrix.access(np.arange(n)) == ids).all()
    for token in [0, 1, 4, int(ids[-1]) if n else 2, top + 1, 1 << 20]:
        where = np.nonzero(ids == token)[0].tolist()
        assert matrix.count(token) == len(where) and matrix.count(token, n // 3, n // 2) == sum(n // 3 <= w < n // 2 for w in where)
        assert matrix.occurrences(token) == where and matrix.select(token, len(where)) == -1
    with pytest.raises(ValueError):
        wavelet.load(b"other" + data)


def test_shards_round_trip(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = expected(plain, r["text"], 2)
        want[r["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    got = QUERIES["op6_token_shards"](spark, sf).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def odd_docs(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(3, "a", 0), (3, "b c", 0), (None, "no id", 0)]
    return local_frame(spark, rows, "doc_id long, text string, start long").withColumn("length", F.lit("x"))


def test_shards_edge_cases(spark, plain):
    docs = odd_docs(spark).repartition(5)
    path = scratch_path(spark, "shards")
    wavelet.write_shards(docs, path, tokenizer_path(), 2, shard_ids=300)
    assert spark.read.parquet(path).count() > 3
    got = sorted(wavelet.read_shards(spark, path, Scratch(spark)).collect(), key=lambda r: r["start"])
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert order == sorted(order) and len(got) == len(ODD) + 3
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    want = sorted(crc(expected(plain, r["text"], 2)) for r in docs.collect())
    assert sorted(r["ids_crc32"] for r in got) == want
    none = scratch_path(spark, "shards")
    wavelet.write_shards(docs.limit(0), none, tokenizer_path(), 2)
    assert wavelet.read_shards(spark, none, Scratch(spark)).count() == 0


def check_packing(plain, docs, pieces, size, end):
    texts = {}
    for doc_id, text in docs:
        texts.setdefault(doc_id, []).append(expected(plain, text, end))
    seen = {}
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sum(r["length"] for r in pieces) == sum(len(ids) for own in texts.values() for ids in own)
    for doc_id, own in texts.items():
        for ids in own:
            parts = sorted((r["start"], r["length"], r["ids_crc32"]) for r in seen[doc_id, len(ids)])
            if len(own) == 1:
                at = 0
                for start, length, check in parts:
                    assert start == at and check == crc(ids[start : start + length])
                    at += length
                assert at == len(ids)
    padded = sum(0 if n & (n - 1) == 0 else size - n for n in (sum(x for _, x in p) for p in windows.values()))
    return padded / sum(r["length"] for r in pieces)


def test_packing_query(spark, sf, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(plain, docs, QUERIES["op8_packing"](spark, sf).collect(), 2048, 1) < 0.05


@pytest.mark.parametrize("size,block", [(2048, 1 << 20), (64, 500), (100, 4000)])
def test_packing_edge_cases(spark, plain, size, block):
    docs = odd_docs(spark)
    got = packing.pack(docs, tokenizer_path(), 1, size, block).collect()
    check_packing(plain, [(r["doc_id"], r["text"]) for r in docs.collect()], got, size, 1)
    assert packing.pack(docs.limit(0), tokenizer_path(), 1, size, block).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for size in (16, 20, 64):
        for _ in range(40):
            at = [0]
            while len(at) < 40:
                at.append(at[-1] + rng.randint(1, size // 2))
            price = [rng.choice([0.0, 2.0, 9.0]) for _ in at]
            cost = [0.0] + [float("inf")] * (len(at) - 1)
            for j in range(1, len(at)):
                for i in range(j):
                    n = at[j] - at[i]
                    if n <= size:
                        cost[j] = min(cost[j], cost[i] + price[j] + (0 if n & (n - 1) == 0 else size - n))
            found = packing.cuts(np.array(at), np.array(price), size)
            paid, last = 0.0, 0
            for j in found:
                n = at[j] - at[last]
                assert n <= size
                paid += price[j] + (0 if n & (n - 1) == 0 else size - n)
                last = j
            assert found[-1] == len(at) - 1 and paid == pytest.approx(cost[-1])


def test_all_ends_of_documents_and_sentences_are_weighed():
    """places and cuts together against the cheapest choice over every end, one place at a time"""
    rng = np.random.default_rng(3)
    for size, mean in ((16, 3), (64, 9), (256, 200)):
        for _ in range(8):
            total = 700
            ends = np.unique(rng.integers(1, total, total // mean))
            docs = np.append(rng.choice(ends, min(len(ends), 5), replace=False), total)
            docs.sort()
            at, price = packing.places(ends, docs, total, size)
            assert set(ends) | set(docs) | {0} <= set(at) and np.diff(at).max() <= min(size, packing.INNER_STEP)
            of = dict(zip(at.tolist(), price.tolist()))
            assert all(of[e] == (0.0 if e in docs else packing.SENTENCE_CUT) for e in ends.tolist())
            cost = {0: 0.0}
            for j in at.tolist()[1:]:
                cost[j] = min(c + of[j] + (0 if (j - i) & (j - i - 1) == 0 else size - j + i) for i, c in cost.items() if j - i <= size)
            bounds = at[[0, *packing.cuts(at, price, size)]]
            gaps = np.diff(bounds).tolist()
            paid = sum(of[b] for b in bounds[1:].tolist()) + sum(0 if n & (n - 1) == 0 else size - n for n in gaps)
            assert bounds[-1] == total and max(gaps) <= size and paid == pytest.approx(cost[total])
