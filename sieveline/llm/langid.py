"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of words, with a mark at either end of a word. Counts
come from a bounded sample of labelled documents. All models share sorted arrays: the hashes of the
n-grams, and by n-gram the log probability of its last character and the log weight of backing off
from it, one column per language. A text gets the language with the least cross-entropy per
character; the sharpness of the score and the limits of rejection are calibrated on documents that
were not counted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch
from sieveline.session import small

ORDER = 4
#: Labelled documents that are counted, and as many that calibrate, per language (in expectation:
#: documents are taken by a hash of their id). It bounds the model and nothing else.
SAMPLE_DOCS = 400
#: Share of a language's own calibration documents that may be rejected.
REJECTED_SHARE = 0.005
#: Sharpness of the scores, of which calibration takes the best.
SHARPNESS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
UNKNOWN = "und"
WORD_BYTES = 4 << 20
_START, _END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """hashes: sorted; log_prob and log_back: n-grams x languages (log_prob is nan where the
    language lacks the n-gram); floor: log probability of an unseen character, by language."""

    langs: list[str]
    hashes: np.ndarray
    log_prob: np.ndarray
    log_back: np.ndarray
    floor: np.ndarray

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) log probability of each word with its end, and characters scored."""
        marked = [_START + w + _END for w in words]
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.array([len(m) for m in marked], np.int64)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(starts, sizes)  # 0 at the start mark
        score = np.repeat(self.floor[None, :], len(chars), axis=0)
        context = None  # rows of the (k-1)-gram that ends one character before
        gram = np.zeros(len(chars), np.uint64)
        for k in range(1, ORDER + 1):
            gram = _shift(gram) if k > 1 else gram
            gram = (gram ^ chars) * _MIX
            gram ^= gram >> np.uint64(31)
            row = self._rows(gram ^ np.uint64(k))
            row[place < k - 1] = -1
            if context is not None:
                back = np.where(context[:, None] >= 0, self.log_back[context], 0.0)
                back[place < k - 1] = 0.0
                score += back
            own = np.where(row[:, None] >= 0, self.log_prob[row], np.nan)
            score = np.where(np.isnan(own), score, own)
            context = np.concatenate([[-1], row[:-1]])
        score[place == 0] = 0.0
        totals = np.add.reduceat(score, starts, axis=0) if len(words) else np.zeros((0, len(self.langs)))
        return totals, sizes - 1

    def _rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _shift(grams: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), grams[:-1]])


def gram_hash(gram: str) -> int:
    """The hash that `Model.words` computes for an n-gram."""
    h = np.zeros(1, np.uint64)
    for c in gram:
        h = (h ^ np.uint64(ord(c))) * _MIX
        h ^= h >> np.uint64(31)
    return int(h[0] ^ np.uint64(len(gram)))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words without ASCII white space of lower-cased texts (null: none), and the bounds by text."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().dictionary_encode(), bounds - bounds[0]


def has_letter(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some megabytes of text (a longer text is a piece of its own)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + WORD_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over the words of `labelled` (lang, text), orders 1 to ORDER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                words, bounds = words_of(batch.column(1))
                langs = batch.column(0).to_pylist()
                counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
                at = words.indices.to_numpy()
                for lang, a, b in zip(langs, bounds, bounds[1:]):
                    for i, n in zip(*np.unique(at[a:b], return_counts=True)):
                        counts[lang][int(i)] += int(n)
                spelled = words.dictionary.to_pylist()
                grams: dict[tuple[str, str], int] = defaultdict(int)
                for lang, own in counts.items():
                    for i, n in own.items():
                        marked = _START + spelled[i] + _END
                        for end in range(1, len(marked) + 1):
                            for k in range(1, min(ORDER, end) + 1):
                                grams[lang, marked[end - k : end]] += n
                if grams:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.array([g[0] for g in grams], pa.string()),
                            "gram": pa.array([g[1] for g in grams], pa.string()),
                            "n": pa.array(list(grams.values()), pa.int64()),
                        }
                    )

    found = labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, float], float]:
    """(probability by n-gram, backoff weight by context, probability of an unseen character).

    Counts of all orders of one language. Below the highest order a gram counts the different
    characters before it; a gram at the start of a word has none and keeps its count. The start
    mark is never predicted.
    """
    by_order: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    for gram, n in counts.items():
        if len(gram) == ORDER or gram[0] == _START:
            by_order[len(gram)][gram] = by_order[len(gram)].get(gram, 0) + n
        if len(gram) > 1:
            tail = gram[1:]
            by_order[len(tail)][tail] = by_order[len(tail)].get(tail, 0) + 1
    for k in range(1, ORDER + 1):
        by_order[k] = {g: n for g, n in by_order[k].items() if g[-1] != _START}
    chars = len({g for g in by_order[1]})
    prob: dict[str, float] = {}
    back: dict[str, float] = {}
    floor = 0.0
    for k in range(1, ORDER + 1):
        grams = by_order[k]
        once, twice = sum(n == 1 for n in grams.values()), sum(n == 2 for n in grams.values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total: dict[str, float] = defaultdict(float)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in grams.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        weight = {h: min(discount, 1.0) * kinds[h] / total[h] for h in total}
        if k == 1:
            floor = weight.get("", 1.0) / (chars + 1)
            lower = dict.fromkeys(grams, floor)
        else:
            back |= weight
            # the lower order's probability, itself backed off where it lacks the gram
            lower = {g: prob[g[1:]] if g[1:] in prob else _backed(g[1:], prob, back, floor) for g in grams}
        for g, n in grams.items():
            h = g[:-1]
            prob[g] = max(n - discount, 0.0) / total[h] + (lower[g] if k == 1 else weight[h] * lower[g])
    return prob, back, floor


def _backed(gram: str, prob: dict[str, float], back: dict[str, float], floor: float) -> float:
    if gram in prob:
        return prob[gram]
    if len(gram) <= 1:
        return floor
    return back.get(gram[:-1], 1.0) * _backed(gram[1:], prob, back, floor)


def build(counts: dict[str, dict[str, int]]) -> Model:
    """The shared arrays from counts by language."""
    langs = sorted(counts)
    parts = [kneser_ney(counts[lang]) for lang in langs]
    grams = sorted({g for prob, back, _ in parts for g in (*prob, *back)})
    hashes = np.array([gram_hash(g) for g in grams], np.uint64)
    order = np.argsort(hashes)
    log_prob = np.full((len(grams), len(langs)), np.nan)
    log_back = np.zeros((len(grams), len(langs)))
    place = {grams[o]: i for i, o in enumerate(order)}
    for j, (prob, back, _) in enumerate(parts):
        for g, p in prob.items():
            log_prob[place[g], j] = math.log(p)
        for g, w in back.items():
            if g:
                log_back[place[g], j] = math.log(w) if w > 0 else -50.0
    floor = np.log(np.array([max(f, 1e-12) for _, _, f in parts]))
    return Model(langs, hashes[order], log_prob, log_back, floor)


def cross_entropies(docs: DataFrame, keep: list[str], model) -> DataFrame:
    """`keep` columns, has_letter, n_scored and entropy: cross-entropy per character by language.

    model: the broadcast Model, whose size the sample bounds. Whole texts are scored, word by
    distinct word of a few megabytes.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for whole in batches:
            for batch in _slices(whole, len(keep)):
                texts = batch.column(len(keep))
                words, bounds = words_of(texts)
                by_word, size = m.words(words.dictionary.to_pylist())
                at = words.indices.to_numpy()
                table = np.concatenate([by_word, size[:, None]], axis=1)[at]
                table = np.concatenate([table, np.zeros((1, table.shape[1]))])
                sums = np.add.reduceat(table, bounds[:-1], axis=0)
                sums[bounds[:-1] == bounds[1:]] = 0.0
                n = sums[:, -1]
                entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(entropy.reshape(-1)), len(m.langs)).cast(pa.list_(pa.float64()))
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, has_letter(texts), pa.array(n.astype(np.int64)), lists],
                    names=[*keep, "has_letter", "n_scored", "entropy"],
                )

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, schema + ", has_letter boolean, n_scored long, entropy array<double>")


@dataclass
class Identifier:
    """A broadcast model with its calibration; `predict` applies it."""

    model: object
    langs: list[str]
    sharpness: float
    limits: list[float]

    def predict(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` columns, lang_pred, score (0 to 1), best (that language's cross-entropy) and rejected.

        A null text or one without a letter is `und` with score 0 and rejected. Any other gets a
        learned language; rejected says that its cross-entropy lies beyond what nearly all
        calibration documents of that language had. Equal cross-entropies: the first language by
        name.
        """
        if not self.langs:
            return docs.select(
                *keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("best"), F.lit(True).alias("rejected"),
            )
        found = cross_entropies(docs, keep, self.model)
        best = F.array_min("entropy")
        at = F.array_position("entropy", best).cast("int")
        lang = F.element_at(F.array(*map(F.lit, self.langs)), at)
        limit = F.element_at(F.array(*map(F.lit, self.limits)), at)
        ok = F.col("has_letter")
        return found.select(
            *keep,
            F.when(ok, lang).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(ok, 1.0 / _spread(self.sharpness)).otherwise(0.0).alias("score"),
            F.when(ok, best).alias("best"),
            F.when(ok, best > limit).otherwise(True).alias("rejected"),
        )


def _spread(sharpness: float) -> Column:
    """Sum over languages of exp(-sharpness * (entropy - least entropy))."""
    least = F.array_min("entropy")
    return F.aggregate("entropy", F.lit(0.0), lambda a, e: a + F.exp(-sharpness * (e - least)))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """An identifier from `labelled` (doc_id, text, lang); rows with a null text or lang are ignored.

    Of each language about `sample_docs` documents are counted and as many calibrate, chosen by a
    hash of the id. Languages with fewer use all they have. Without any labelled row every text is
    `und`.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample_docs) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    # one row per language; `small` broadcasts it only if there are few, so that texts stay in place
    taken = rows.join(small(share), "lang").withColumn("draw", draw).where("draw < share")
    taken = taken.select("doc_id", "text", "lang", (F.col("draw") < F.col("share") / 2).alias("counted"))
    taken, path = scratch.write(taken, "langid-sample")  # both halves of a bounded sample
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    table = gram_counts(taken.where("counted")).toArrow().to_pydict()  # bounded by the sample
    for lang, gram, n in zip(table["lang"], table["gram"], table["n"]):
        counts[lang][gram] = n
    model = build(counts) if counts else Model([], np.zeros(1, np.uint64), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)
    if not model.langs:
        scratch.drop(path)
        return Identifier(shared, [], 1.0, [])
    spare = cross_entropies(taken.where("not counted"), ["lang"], shared).where("has_letter")
    own = F.get("entropy", F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int") - 1)
    spare = spare.withColumn("own", own).where("own is not null")
    least = F.array_min("entropy")
    losses = [F.avg(s * (F.col("own") - least) + F.ln(_spread(s))).alias(str(i)) for i, s in enumerate(SHARPNESS)]
    loss = spare.agg(*losses).first()
    sharpness = SHARPNESS[min(range(len(SHARPNESS)), key=lambda i: (loss[i] if loss[i] is not None else math.inf, i))]
    quantiles = spare.groupBy("lang").agg(F.percentile("own", 1 - REJECTED_SHARE).alias("limit")).collect()
    limits = {r["lang"]: r["limit"] for r in quantiles}
    scratch.drop(path)
    return Identifier(shared, model.langs, sharpness, [float(limits.get(lang, math.inf)) for lang in model.langs])
