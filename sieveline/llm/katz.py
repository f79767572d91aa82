"""Katz backoff language model over words: bigrams, unigrams, the unknown word.

Counts and scores are partitioned by n-gram, not by document. Documents are cut into chunks; a
chunk asks once for each of its distinct n-grams, in compact sorted blocks, one per bucket of a
table. A bucket adds up the training counts of all chunks, keeps its part of the model and answers
each chunk with what its own n-grams need. So no task holds the vocabulary or the model, a word of a
third of the corpus is one entry per chunk, and what is shuffled is distinct n-grams per chunk.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)     if the bigram was seen in training
             = a(h) P(w)                     otherwise
    P(w)     = d(c(w)) c(w) / N, and what is left over for the unknown word

d are Good-Turing discounts, a(h) the weight that makes P( | h) add up to one exactly.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch
from sieveline.session import scratch_path

#: Counts up to this are discounted (Katz's k).
DISCOUNTED = 5
#: Text after which a chunk is closed (a longer text makes a chunk of its own).
CHUNK_BYTES = 8 << 20
#: A word with over 1/HOT_SHARE of its bucket's tokens spreads its bigrams over all buckets.
HOT_SHARE = 4
#: The token after the last word; no word can be spelled like it.
END = "\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _planes(a: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, lowest first, so that rare high bytes compress."""
    a = np.ascontiguousarray(a, f"<u{a.dtype.itemsize}")
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(-1)


def _packed(**columns) -> bytes:
    out = io.BytesIO()
    flat = {k: (v.dtype.itemsize, _planes(v)) if isinstance(v, np.ndarray) and v.dtype.kind == "u" else v for k, v in columns.items()}
    with zstandard.ZstdCompressor(level=1).stream_writer(out, closefd=False) as writer:
        pickle.dump(flat, writer, protocol=5)
    return out.getvalue()


def _unpacked(data: bytes) -> dict:
    flat = pickle.load(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)))  # noqa: S301 (own scratch files)
    return {k: _unplanes(v[1], v[0]) if isinstance(v, tuple) else v for k, v in flat.items()}


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


@dataclass(frozen=True)
class Discounts:
    """d(c) by Good-Turing for c = 1 to DISCOUNTED, 1 beyond; `by_count[c]`."""

    by_count: tuple[float, ...]

    @classmethod
    def of(cls, of_counts: list[int]) -> Discounts:
        """of_counts[r]: n-grams seen r times, r = 0 to DISCOUNTED + 1. A count whose ratio is not
        a proper discount (too few n-grams to tell) keeps its whole weight."""
        k, n = DISCOUNTED, of_counts
        d = [1.0] * (k + 1)
        cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            if n[r] and cut < 1:
                ratio = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < ratio < 1:
                    d[r] = ratio
        return cls(tuple(d))

    def apply(self, counts: np.ndarray) -> np.ndarray:
        d = np.array(self.by_count)
        return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED).astype(np.int64)], 1.0) * counts


@dataclass(frozen=True)
class Unigrams:
    """tokens N, words V, start contexts, discounts; first dense id of each bucket; hot dense ids."""

    tokens: int
    words: int
    starts: int
    discounts: Discounts
    unknown: float
    scale: float
    offsets: np.ndarray
    hot: np.ndarray

    def prob(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count; the unknown word's for 0."""
        return np.where(counts > 0, self.discounts.apply(counts) / self.scale, self.unknown)


def _of_counts(counts: np.ndarray) -> list[int]:
    low = counts[counts <= DISCOUNTED + 1].astype(np.int64)
    return np.bincount(low, minlength=DISCOUNTED + 2).tolist()


_BLOCKS = "kind int, bucket int, chunk long, body binary"
_REPLIES = "chunk long, bucket int, body binary, stats binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word number of each token, bounds by text) of A-Z lower-cased texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    flat = flat.dictionary_encode()
    spelled, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    bounds = bounds - bounds[0]
    if "" in spelled:  # an edge of white space
        real = at != spelled.index("")
        kept = np.concatenate([[0], np.cumsum(real)])
        at, bounds = at[real], kept[bounds]
    return spelled, at, bounds


def _local(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, ascending; token numbers in them, each text closed by END; sizes)."""
    spelled, at, bounds = _words(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 11) for w in (*spelled, END)], np.uint64)
    sizes = np.diff(bounds) + 1
    tokens = np.full(int(sizes.sum()), len(spelled), np.int64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = at
    used = np.zeros(len(hashes), bool)
    used[tokens] = True
    order = np.argsort(hashes)
    order = order[used[order]]
    rank = np.zeros(len(hashes), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[tokens], sizes


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _ask_words(buckets: int):
    """Batches (doc_id, held_out, text) to word requests (kind 0) and the chunk itself (kind 1)."""

    def chunk(number: int, rows: pa.Table) -> pa.RecordBatch:
        held = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
        texts = rows.column(2).combine_chunks()
        hashes, tokens, sizes = _local(texts)
        train = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(hashes)).astype(np.uint32)
        bucket = _buckets(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                out.append((0, b, number, _packed(hashes=_deltas(hashes[own]), counts=train[own])))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as writer:
            writer.write_table(rows)
        out.append((1, -1, number, sink.getvalue().to_pybytes()))
        return _rows(_BLOCKS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES - size)))
                held.append(batch.slice(begin, end - begin))
                size += int(sizes[end - 1]) - before
                begin = end
                if size >= CHUNK_BYTES:
                    yield chunk(number, pa.Table.from_batches(held))
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(number, pa.Table.from_batches(held))

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket of the unigram table: its answers to each chunk, and its figures."""
    bucket = table.column("bucket")[0].as_py()
    asked = [(c, _unpacked(b)) for c, b in zip(table.column("chunk").to_pylist(), table.column("body").to_pylist())]
    hashes = [_sums(a["hashes"]) for _, a in asked]
    every, where = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([a["counts"] for _, a in asked]), minlength=len(every)).astype(np.int64)
    known = counts > 0
    rank = np.cumsum(known) - 1  # of a word among the bucket's training words
    rows, at = [], 0
    for (chunk, _), own in zip(asked, hashes):
        mine = where[at : at + len(own)]
        at += len(own)
        rows.append((chunk, bucket, _packed(ranks=rank[mine].astype(np.uint32), counts=counts[mine].astype(np.uint64)), None))
    seen = counts[known]
    hot = np.nonzero(seen * HOT_SHARE > seen.sum())[0] if len(seen) else np.zeros(0, np.int64)
    figures = {"bucket": bucket, "words": len(seen), "tokens": int(seen.sum()), "of_counts": _of_counts(seen), "hot": hot.tolist()}
    rows.append((-1, bucket, None, pickle.dumps(figures)))
    return pa.Table.from_batches([_rows(_REPLIES, rows)])


def _encode(model, buckets: int):
    """A chunk and the answers to its words to one row of token numbers, dense ids and counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uni: Unigrams = model.value
        number = left.column("chunk")[0].as_py()
        rows = pa.ipc.open_stream(left.column("body")[0].as_py()).read_all()
        hashes, tokens, sizes = _local(rows.column(2).combine_chunks())
        ids, counts = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
        bucket = _buckets(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, body in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()):
            own, answer = order[cuts[b] : cuts[b + 1]], _unpacked(body)
            counts[own] = answer["counts"]
            ids[own] = np.where(answer["counts"] > 0, uni.offsets[b] + answer["ranks"].astype(np.int64) + 1, 0).astype(np.uint64)
        often = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent tokens get small numbers
        number_of = np.empty(len(often), np.int64)
        number_of[often] = np.arange(len(often))
        doc_ids = rows.column(0).to_pylist()
        body = _packed(
            doc_ids=doc_ids,
            held=rows.column(1).to_numpy(zero_copy_only=False).astype(bool),
            sizes=sizes.astype(np.uint32),
            tokens=number_of[tokens].astype(np.uint32),
            ids=ids[often],
            counts=counts[often],
        )
        return pa.Table.from_batches([_rows("chunk long, body binary", [(number, body)])])

    return run


class _Pairs:
    """The distinct bigrams of an encoded chunk, in order of context and word, with their buckets.

    Contexts and words are dense ids; id 0 is the start of a text as a context and the unknown word
    as a word. All bigrams of known contexts are asked for, since the unknown words after a context
    need its weight.
    """

    def __init__(self, chunk: dict, uni: Unigrams, buckets: int):
        tokens = chunk["tokens"].astype(np.int64)
        sizes = chunk["sizes"].astype(np.int64)
        n = len(chunk["ids"]) + 1
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], tokens[:-1] + 1])
        before[first] = 0
        self.before, self.tokens, self.first = before, tokens, first  # contexts: 0 start, else token + 1
        keys, self.where = np.unique(before * n + tokens, return_inverse=True)
        train = np.repeat(~chunk["held"], sizes)
        self.train = np.bincount(self.where[train], minlength=len(keys)).astype(np.uint32)
        context, word = keys // n, keys % n
        ids = np.concatenate([[0], chunk["ids"].astype(np.int64)])
        self.context, self.word = ids[context], ids[word + 1]
        self.known = (context == 0) | (self.context > 0)  # of the start or a training word
        mix = self.context.astype(np.uint64) * _MIX
        spread = np.isin(self.context, uni.hot)
        mix = np.where(spread, (mix ^ self.word.astype(np.uint64)) * _MIX, mix)
        bucket = _buckets(mix ^ (mix >> np.uint64(29)), buckets)
        order = np.lexsort((self.word, self.context, bucket))
        order = order[self.known[order]]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.of_bucket = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        counts = np.concatenate([[0], chunk["counts"].astype(np.int64)])
        self.word_counts = counts[word + 1]


def _ask_pairs(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = model.value
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = _Pairs(_unpacked(body.as_py()), uni, buckets)
                out = []
                for b, own in enumerate(pairs.of_bucket):
                    if len(own):
                        context, start, width = np.unique(pairs.context[own], return_index=True, return_counts=True)
                        words = pairs.word[own]
                        steps = np.diff(words, prepend=0)
                        steps[start] = words[start]
                        body = _packed(
                            contexts=_deltas(context.astype(np.uint64)), widths=width.astype(np.uint32), steps=steps.astype(np.uint64),
                            counts=pairs.train[own], word_counts=pairs.word_counts[own].astype(np.uint64),
                        )
                        out.append((0, b, number, body))
                yield _rows(_BLOCKS, out)

    return run


def _spelled_out(asked: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, context number of each bigram, word of each bigram) of a request."""
    contexts, widths = _sums(asked["contexts"]), asked["widths"].astype(np.int64)
    sums = np.cumsum(asked["steps"].astype(np.int64))
    start = np.cumsum(widths) - widths
    base = np.where(start > 0, sums[np.maximum(start - 1, 0)], 0)
    number = np.repeat(np.arange(len(contexts)), widths)
    return contexts, number, sums - base[number]


def _count_pairs(model):
    """A bucket of the bigram table: counts for each chunk, and what its contexts' weights need."""

    def run(table: pa.Table) -> pa.Table:
        uni: Unigrams = model.value
        bucket = table.column("bucket")[0].as_py()
        asked = [(c, _unpacked(b)) for c, b in zip(table.column("chunk").to_pylist(), table.column("body").to_pylist())]
        spelled = [_spelled_out(a) for _, a in asked]
        context = np.concatenate([c[k] for c, k, _ in spelled])
        word = np.concatenate([w for _, _, w in spelled]).astype(np.uint64)
        size = [len(w) for _, _, w in spelled]
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        place = np.cumsum(new) - 1
        where = np.empty(len(order), np.int64)
        where[order] = place
        first = order[new]
        counts = np.bincount(where, weights=np.concatenate([a["counts"] for _, a in asked])).astype(np.int64)
        seen = counts > 0
        lower = np.where(seen, uni.prob(np.concatenate([a["word_counts"] for _, a in asked])[first].astype(np.int64)), 0.0)
        contexts, of = np.unique(context[first], return_inverse=True)
        # by context: bigrams seen once, twice, ... DISCOUNTED times, and the lower probability of all seen
        few = np.stack([np.bincount(of, weights=counts == r, minlength=len(contexts)) for r in range(1, DISCOUNTED + 1)]).astype(np.uint32)
        lower = np.bincount(of, weights=lower, minlength=len(contexts))
        rows, at = [], 0
        for (chunk, _), (own, _, _), n in zip(asked, spelled, size):
            mine = np.searchsorted(contexts, own)
            rows.append((chunk, bucket, _packed(counts=counts[where[at : at + n]].astype(np.uint32), few=few[:, mine].reshape(-1), lower=lower[mine]), None))
            at += n
        hot = np.nonzero(np.isin(contexts, uni.hot.astype(np.uint64)))[0]
        parts = {int(contexts[i]): (few[:, i].astype(np.int64).tolist(), float(lower[i])) for i in hot}
        rows.append((-1, bucket, None, pickle.dumps({"of_counts": _of_counts(counts[seen]), "hot": parts})))
        return pa.Table.from_batches([_rows(_REPLIES, rows)])

    return run


@dataclass(frozen=True)
class Bigrams:
    discounts: Discounts
    hot: dict[int, tuple[np.ndarray, float]]


def weights(total: np.ndarray, few: np.ndarray, lower: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(divisor of the counts, backoff weight) by context.

    total: c(h); few[r - 1]: bigrams of h seen r times; lower: unigram probability of all words seen
    after h. A context whose counts all keep their weight counts one occurrence more, so that
    something is left for unseen words; the unknown word is always among them.
    """
    discount = np.array(d.by_count[1:])
    r = np.arange(1, DISCOUNTED + 1)
    lost = ((1 - discount) * r) @ few
    divisor = np.where(lost > 0, total, total + 1).astype(float)
    left = np.where(lost > 0, lost, 1.0) / np.maximum(divisor, 1.0)
    return divisor, left / np.maximum(1.0 - lower, 1e-300)


def _score(model, pair_model, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uni: Unigrams = model.value
        bi: Bigrams = pair_model.value
        chunk = _unpacked(left.column("body")[0].as_py())
        pairs = _Pairs(chunk, uni, buckets)
        n_pairs = len(pairs.word)
        counts = np.zeros(n_pairs, np.int64)
        few, lower = np.zeros((DISCOUNTED, n_pairs)), np.zeros(n_pairs)
        for b, body in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()):
            own, answer = pairs.of_bucket[b], _unpacked(body)
            counts[own] = answer["counts"]
            _, number = np.unique(pairs.context[own], return_inverse=True)
            few[:, own] = answer["few"].reshape(DISCOUNTED, -1)[:, number]
            lower[own] = answer["lower"][number]
        local, of = np.unique(pairs.context, return_inverse=True)
        some = np.full(len(local), -1, np.int64)
        some[of[pairs.known]] = np.nonzero(pairs.known)[0]
        few, lower = np.where(some >= 0, few[:, some], 0.0), np.where(some >= 0, lower[some], 0.0)
        for i in np.nonzero(np.isin(local, uni.hot))[0]:
            if int(local[i]) in bi.hot:
                few[:, i], lower[i] = bi.hot[int(local[i])]
        ids = np.concatenate([[0], chunk["ids"].astype(np.int64)])
        by_id = np.argsort(ids[1:], kind="stable") + 1
        found = by_id[np.minimum(np.searchsorted(ids[by_id], local), len(by_id) - 1)]
        totals = np.concatenate([[0], chunk["counts"].astype(np.int64)])[found]
        totals = np.where(local == 0, uni.starts, totals)
        divisor, alpha = weights(totals, few, lower, bi.discounts)
        # an unknown word is a context without figures: its followers have their unigram probability
        word_counts = np.concatenate([[0], chunk["counts"].astype(np.int64)])
        unigram = uni.prob(word_counts)[1:]
        number = of[pairs.where]
        c = counts[pairs.where]
        start = pairs.before == 0
        token_context = np.where(start, 0, ids[pairs.before])
        open_ = start | (token_context > 0)
        open_ &= totals[number] > 0
        p_word = unigram[pairs.tokens]
        seen = bi.discounts.apply(c) / np.maximum(divisor[number], 1.0)
        prob = np.where(open_, np.where(c > 0, seen, alpha[number] * p_word), p_word)
        token_counts = word_counts[1:][pairs.tokens]
        base = np.log10((token_counts + 1) / (uni.tokens + uni.words + 1))
        sizes = chunk["sizes"].astype(np.int64)
        sums = [np.add.reduceat(x, pairs.first).tolist() for x in ((token_counts > 0).astype(np.int64), base, np.log10(prob))]
        n = len(sizes)
        return pa.Table.from_batches(
            [_rows(_SCORES, list(zip(chunk["doc_ids"], chunk["held"].tolist(), sizes.tolist(), sums[0], [uni.tokens] * n, sums[1], sums[2])))]
        )

    return run


def _figures(replies: DataFrame) -> list[dict]:
    """One small record per bucket."""
    rows = replies.where("chunk = -1").select("stats").toArrow().column(0)
    return [pickle.loads(r.as_py()) for r in rows]  # noqa: S301 (own scratch files)


def score(docs: DataFrame, held_out, buckets: int | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text), see _SCORES; `held_out`: Column, true for rows that
    are scored but not learnt from (null: learnt from).

    Tokens are runs without ASCII white space, A-Z lower-cased, then one end; a null or empty text
    is the end alone. n_known counts tokens seen in training, base_score adds up the logarithms of
    add-one unigram probabilities, score those of the backoff model (base 10). Without training
    rows every token is unknown with probability 1. No rows give no rows.

    `buckets` is the number of parts of each table, by default that of input or shuffle partitions,
    whichever is more. Each step's blocks are written or answered before the next step, and blocks
    no longer needed are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    if buckets is None:
        buckets = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    asked_path = scratch_path(spark, "katz-words")
    rows.mapInArrow(_ask_words(buckets), _BLOCKS).write.partitionBy("kind").parquet(asked_path)
    blocks = spark.read.schema("bucket int, chunk long, body binary, kind int").parquet(asked_path)
    replies, replies_path = scratch.write(
        blocks.where("kind = 0").select("bucket", "chunk", "body").groupBy("bucket").applyInArrow(_count_words, _REPLIES), "katz-counts"
    )
    figures = _figures(replies)
    starts = rows.where("not held_out").count()
    of_counts = np.sum([f["of_counts"] for f in figures], axis=0).tolist() if figures else [0] * (DISCOUNTED + 2)
    words = np.zeros(buckets, np.int64)
    for f in figures:
        words[f["bucket"]] = f["words"]
    offsets = np.cumsum(words) - words
    hot = sorted({int(offsets[f["bucket"]]) + h + 1 for f in figures for h in f["hot"]} | {0})
    tokens, discounts = sum(f["tokens"] for f in figures), Discounts.of(of_counts)
    lost = sum((1 - discounts.by_count[r]) * r * of_counts[r] for r in range(1, DISCOUNTED + 1))
    scale = tokens if lost > 0 else tokens + 1
    unknown = (lost if lost > 0 else 1.0) / scale
    uni = Unigrams(tokens, int(words.sum()), starts, discounts, unknown, float(scale), offsets, np.array(hot, np.int64))
    model = spark.sparkContext.broadcast(uni)  # a few numbers per bucket

    asked = replies.where("chunk >= 0").select("chunk", "bucket", "body")
    encoded = blocks.where("kind = 1").select("chunk", "body").groupBy("chunk").cogroup(asked.groupBy("chunk"))
    encoded, _ = scratch.write(encoded.applyInArrow(_encode(model, buckets), "chunk long, body binary"), "katz-chunks")
    scratch.drop(asked_path, replies_path)
    del blocks, asked, replies
    scratch.release()

    requests = encoded.mapInArrow(_ask_pairs(model, buckets), _BLOCKS).select("bucket", "chunk", "body")
    replies, _ = scratch.write(requests.groupBy("bucket").applyInArrow(_count_pairs(model), _REPLIES), "katz-pairs")
    del requests
    scratch.release()
    figures = _figures(replies)
    of_counts = np.sum([f["of_counts"] for f in figures], axis=0).tolist() if figures else [0] * (DISCOUNTED + 2)
    parts: dict[int, tuple[np.ndarray, float]] = {}
    for f in figures:
        for context, (few, lower) in f["hot"].items():
            was = parts.get(context, (np.zeros(DISCOUNTED), 0.0))
            parts[context] = (was[0] + np.array(few), was[1] + lower)
    pair_model = spark.sparkContext.broadcast(Bigrams(Discounts.of(of_counts), parts))
    asked = replies.where("chunk >= 0").select("chunk", "bucket", "body")
    return encoded.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_score(model, pair_model, buckets), _SCORES)
