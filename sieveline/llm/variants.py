"""Spelling variants: words one edit apart, found by walking a trie whose edges are a table.

A state is (word, position, node, edits). A word's states without an edit are the prefixes of the
word itself; where other edges leave such a node, one edit steps onto another edge, and from there
the state follows the trie without further edits, one join with the edge table a level. States that
reach the end of the word at the end of an entry are neighbours. Being neighbours goes both ways, so
a word only looks for entries that lack one of its letters or have a greater one in its place.

Two words one edit apart share the first or the last half of either. So the trie of the words is
entered in its lower half only, and so is the trie of the reversed words; the crowded upper levels
are never walked. Edges are compressed: one runs to the next node where entries part or end, and a
node has at most one edge a letter, so a state meets no more edges than the alphabet has letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch
from sieveline.session import ship_package, small

#: Runs of letters that are words (fixed values).
LETTERS = "A-Za-zÀ-ÿ"
#: A word has a row for each of its prefixes in the trie; those longer than this meet by hashes.
LONG = 64
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HELD = 1 << 18


def count_words(docs: DataFrame, min_chars: int = 7, min_n: int = 2, typo_every: int = 0) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least `min_chars` code points that occur
    at least `min_n` times in `docs` (doc_id, text).

    With `typo_every` m, occurrences whose hash h = crc32 of `<doc_id>:<run>` is a multiple of m
    lose the code point h % length before they are counted, which plants misspellings. A null id
    reads as the empty text; a null text has no words. No rows give no rows.
    """
    ship_package(docs.sparkSession)  # before the step that needs it is made
    find = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs: Counter = Counter()
                for word, n in Counter(find(text.as_py() or "")).items():
                    runs[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in runs.items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), seed)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    total[word] += n
                if len(total) > _HELD:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"]
    )


def _part(text: Column, start: Column, length: Column) -> Column:
    """`length` code points after the first `start`."""
    return F.substr(text, start + 1, length)


def edge_table(paths: DataFrame) -> DataFrame:
    """(node, c, label, child, leaf) of the trie over `paths` (word, p, node).

    An edge leaves `node` with the letter `c` and spells `label` down to `child`, the next node
    where entries part or one ends; `leaf` says that one entry alone lies beyond. The end of an
    entry is an edge too, with no letter.
    """
    word, p = F.col("word"), F.col("p")
    ends = paths.groupBy("node", _part(word, p, F.lit(1)).alias("c")).agg(F.min("word").alias("lo"), F.max("word").alias("hi"))
    # \x01 parts the two: the group backtracks to the longest prefix that begins the second as well
    shared = F.length(F.regexp_extract(F.concat("lo", F.lit("\x01"), "hi"), "^([^\x01]*)[^\x01]*\x01\\1", 1))
    ends = ends.withColumn("leaf", F.col("lo") == F.col("hi"))
    stop = F.when(F.col("c") == "", F.length("node")).when(F.col("leaf"), F.length("lo")).otherwise(shared)
    ends = ends.withColumn("stop", stop)
    label = _part(F.col("lo"), F.length("node"), F.col("stop") - F.length("node"))
    return ends.select("node", "c", label.alias("label"), _part(F.col("lo"), F.lit(0), F.col("stop")).alias("child"), "leaf")


def _half(words: DataFrame, later: int, scratch: Scratch, broadcast_states: int) -> tuple[DataFrame, list[str]]:
    """(word, near) whose common prefix reaches half of `word`, rounded up with `later` = 1; `near`
    has a greater letter in one place or lacks one."""
    word, size = F.col("word"), F.length("word")
    paths = words.select("word", F.explode(F.sequence(F.shiftright(size + later, 1), size)).alias("p"))
    paths = paths.withColumn("node", _part(word, F.lit(0), F.col("p")))
    edges, edges_path = scratch.write(edge_table(paths), "trie")

    p, c, label = F.col("p"), F.col("c"), F.col("label")
    n, r = F.length("word"), F.length("label")
    own, after = _part(word, p, F.lit(1)), _part(word, p + 1, F.lit(1))
    steps = F.array(
        F.when((c > own) & (F.substr(label, F.lit(2)) == _part(word, p + 1, r - 1)), p + r),  # replaced
        F.when((c == after) & (label == _part(word, p + 1, r)), p + 1 + r),  # the entry lacks the letter
    )
    states = (
        paths.where(p < n).join(edges, "node").where((c != own) & ((c > own) | (c == after)))
        .select("word", "child", "leaf", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("pos"))
    )
    found, written = [], [edges_path]
    while True:
        ended = F.col("pos") == F.length("word")
        alive = states.where(~F.col("leaf") | ended)
        states, path = scratch.write(alive, "frontier")
        written.append(path)
        found.append(states.where("leaf").select("word", F.col("child").alias("near")))
        going = states.where("not leaf").select("word", "pos", F.col("child").alias("node"))
        if going.isEmpty():
            break
        going = going.withColumn("c", _part(F.col("word"), F.col("pos"), F.lit(1)))
        met = edges.join(small(going, broadcast_states), ["node", "c"])
        met = met.where(label == _part(F.col("word"), F.col("pos"), r))
        states = met.select("word", "child", "leaf", (F.col("pos") + r).alias("pos"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs, written


def _hashes(word: str) -> tuple[np.ndarray, int]:
    """Of a word without each of its letters in turn, and of the whole word."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, whole = np.zeros(len(codes), np.int64), 0
    for prime, base in ((2147483647, 1000003), (2147483629, 999983)):
        powers = np.ones(len(codes), np.uint64)
        done = 1
        while done < len(codes):  # powers[done:] from what is there
            step = pow(base, done, prime)
            powers[done : 2 * done] = powers[: len(powers[done : 2 * done])] * np.uint64(step) % np.uint64(prime)
            done *= 2
        terms = (codes + np.uint64(1)) * powers % np.uint64(prime)
        sums = np.cumsum(terms) % np.uint64(prime)
        back = np.uint64(pow(base, -1, prime))
        after = (sums[-1] + np.uint64(prime) - sums) % np.uint64(prime) * back % np.uint64(prime)
        part = (sums + np.uint64(prime) - terms + after) % np.uint64(prime)
        out = (out << 31) | part.astype(np.int64)
        whole = (whole << 31) | int(sums[-1])
    return out, whole


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced; linear in the length."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the common prefix's length
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return (a[low + 1 :] if len(a) == len(b) else a[low:]) == b[low + 1 :]


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near), in one order or both, of long words: two that differ by a replacement are equal without the letter
    at that position, and one lacks a letter if the other without a letter equals it. Words travel
    as ids; the pairs' distances are verified on the words."""

    def run(batches):
        for batch in batches:
            for key, word in zip(batch.column(0), batch.column(1)):
                less, whole = _hashes(word.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(less) + 1, key.as_py(), np.int64)),
                        pa.array(np.append(less, whole)),
                        pa.array(np.append(np.arange(len(less)), -1)),
                    ],
                    names=["id", "sig", "at"],
                )

    keyed = words.select(F.xxhash64("word").alias("id"), "word")
    rows = keyed.mapInArrow(run, "id long, sig long, at long")
    a, b = (rows.select(F.col("id").alias(k), "sig", "at") for k in ("a", "b"))
    replaced = a.where("at >= 0").join(b.where("at >= 0"), ["sig", "at"]).where("a < b").select("a", "b")
    shorter = a.where("at >= 0").select("a", "sig").distinct().join(b.where("at < 0").select("b", "sig"), "sig").select("a", "b")
    pairs = replaced.union(shorter).distinct()
    pairs = pairs.join(keyed.select(F.col("id").alias("a"), F.col("word").alias("x")), "a")
    pairs = pairs.join(keyed.select(F.col("id").alias("b"), F.col("word").alias("y")), "b")

    @F.pandas_udf("boolean")
    def verified(x, y):
        return x.combine(y, one_edit)

    return pairs.where(verified("x", "y")).select(F.col("x").alias("word"), F.col("y").alias("near"))


def neighbours(words: DataFrame, scratch: Scratch, broadcast_states: int = 100_000) -> DataFrame:
    """(word, near) for all pairs of distinct entries of `words` (word) exactly one edit apart.

    Both orders of a pair are rows. Entries hold no \\x01; null entries are left out, repeated ones
    count once. Frontiers of up to `broadcast_states` states (and a checked size in bytes) are sent
    to the edges, larger ones are shuffled.
    """
    words, _ = scratch.write(words.where("word is not null").select("word").distinct(), "words")
    short = words.where(F.length("word") <= LONG)
    forward, a = _half(short, 0, scratch, broadcast_states)
    backward, b = _half(short.select(F.reverse("word").alias("word")), 1, scratch, broadcast_states)
    pairs = forward.union(backward.select(F.reverse("word").alias("word"), F.reverse("near").alias("near")))
    long = words.where(F.length("word") >= LONG)
    if not long.where(F.length("word") > LONG).isEmpty():
        pairs = pairs.union(_long_pairs(long))
    both = pairs.union(pairs.select("near", "word")).distinct()
    found, _ = scratch.write(both, "neighbours")
    scratch.drop(*a, *b)
    return found


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) by following `forms` (word, form) to the last, twice as far in each round."""
    now, path = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, moved_path = scratch.write(now.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        scratch.drop(path)
        now, path = moved.select("word", F.coalesce("next", "root").alias("root")), moved_path
        if moved.where("next is not null").isEmpty():
            return now


def group(words: DataFrame, scratch: Scratch, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each entry of `words` (word, n; a row a word).

    `form` is the neighbour with the largest n (ties: the least in code-point order) if that is at
    least `ratio` (over 1) times the word's own, else null; `root` the last one reached over forms,
    the word itself without one. No rows give no rows.
    """
    if ratio <= 1:
        raise ValueError("a ratio of over 1 keeps forms from going in circles")
    words, _ = scratch.write(words.select("word", "n"), "counts")
    near = neighbours(words, scratch)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    each = near.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    own = words.join(each, "word", "left").withColumn("has", -F.col("best")["n"] >= ratio * F.col("n"))
    own = own.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("has"), F.col("best")["near"]).alias("form"), F.when(F.col("has"), -F.col("best")["n"]).alias("form_n"),
    )
    own, _ = scratch.write(own, "forms")
    last = roots(own.where("form is not null"), scratch)
    done = own.join(last, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
