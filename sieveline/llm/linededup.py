"""Lines that recur across documents, found in one sorted stream and returned as keep bitmaps.

Each line's key is hashed to 128 bits. The (hash, document, position) rows are range-partitioned by
hash and document and sorted by position within, so that equal lines stand together in order of
their occurrence, and a line on a third of all rows is spread over as many ranges as it fills. Each
task streams its range once and decides every run of equal hashes on the way; it holds no more than
the rows of fewer than `min_docs` documents. Runs that a range border may cut report their counts,
and those few are decided together afterwards. Texts never travel with the lines: what comes back is
one compressed bitmap per document, which `keep_lines` applies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch

#: Stripped from both ends of a line (fixed values).
BLANK = b" \t\n\x0b\x0c\r"
_CHUNK = 1 << 18
_DROPPED, _OPEN, _EDGE, _OPEN_FIRST = 0, 1, 2, 3
_COLUMNS = ("h1", "h2", "k1", "k2", "pos")
_MARKS = "k1 long, k2 long, pos int, state byte, h1 long, h2 long, n long"


def _keys(text: str = "text"):
    """The document of a row: its id and text, as two longs that are never null."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("k1"),
        F.xxhash64(F.col(text), F.col(text).isNull(), F.col("doc_id").isNull()).alias("k2"),
    ]


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, k1, k2, pos) of each line whose key has `min_chars` code points, and for each row
    of `docs` one with null hashes and its number of lines as pos."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            digests, doc, pos, heads = [], [], [], []

            def rows():
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                n, at = len(h), np.array(doc, np.int64)
                own = np.array([i for i, _ in heads], np.int64)
                none = np.zeros(len(heads), bool)
                valid = np.concatenate([np.ones(n, bool), none])
                pad = np.zeros(len(heads), np.int64)
                both = np.concatenate([at, own])
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[:, 0], pad]), mask=~valid),
                        pa.array(np.concatenate([h[:, 1], pad]), mask=~valid),
                        pa.array(k1[both]),
                        pa.array(k2[both]),
                        pa.array(np.array(pos + [c for _, c in heads], np.int32)),
                    ],
                    names=list(_COLUMNS),
                )

            for i, text in enumerate(batch.column(2)):
                lines = (text.as_py() or b"").lower().split(b"\n")
                heads.append((i, len(lines)))
                for j, line in enumerate(lines):
                    key = line.strip(BLANK)
                    if key and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(i)
                        pos.append(j)
                        if len(pos) >= _CHUNK:
                            yield rows()
                            digests, doc, pos, heads = [], [], [], []
            yield rows()

    rows = docs.select(*_keys(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, k1 long, k2 long, pos int")


class _Run:
    """The run of equal hashes that the stream stands in."""

    def __init__(self, rows, min_docs: int, keep_first: bool, at_start: bool):
        self.key, self.at_start = (rows[0][0], rows[1][0]), at_start
        self.min_docs, self.keep_first = min_docs, keep_first
        self.head = [c[:1] for c in rows]
        self.docs, self.last, self.waiting = 0, None, []

    def add(self, rows, docs: int, head: bool = False):
        """Take further rows; gives what is decided by now."""
        self.docs += docs
        self.last = (rows[2][-1], rows[3][-1])
        if head and self.keep_first:
            rows = [c[1:] for c in rows]
        if len(rows[0]):
            self.waiting.append(rows)
        if self.docs < self.min_docs:
            return
        for held in self.waiting:
            yield _marks(held, _DROPPED)
        self.waiting = []

    def finish(self, edge: bool):
        """Rows of a border run that are still open, and its count. Other open runs are too rare."""
        if edge:
            for held in self.waiting:
                yield _marks(held, _OPEN)
            if self.keep_first:
                yield _marks(self.head, _OPEN_FIRST)
            yield _marks(self.head, _EDGE, self.docs)


def _marks(rows, state: int, n: int = 0) -> pa.RecordBatch:
    h1, h2, k1, k2, pos = rows
    size = len(pos)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(k1), pa.array(k2), pa.array(pos), pa.array(np.full(size, state, np.int8)),
            pa.array(h1), pa.array(h2), pa.array(np.full(size, n, np.int64)),
        ],
        names=["k1", "k2", "pos", "state", "h1", "h2", "n"],
    )


def _stream(min_docs: int, keep_first: bool):
    """Map over one sorted range: decided rows, and what the range's first and last run need."""

    def run(batches):
        now = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            size = batch.num_rows
            if not size:
                continue
            h1, h2, k1, k2, _ = rows
            begins, other = np.empty(size, bool), np.empty(size, bool)
            begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            other[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            begins[0] = now is None or (h1[0], h2[0]) != now.key
            other[0] = now is None or (k1[0], k2[0]) != now.last
            other |= begins
            starts = np.flatnonzero(begins).tolist()
            if not begins[0]:
                stop = starts[0] if starts else size
                yield from now.add([c[:stop] for c in rows], int(other[:stop].sum()))
            if not starts:
                continue
            if now is not None:
                yield from now.finish(now.at_start)
            if now is None and len(starts) > 1:  # the range's first run ends in this batch
                part = [c[: starts[1]] for c in rows]
                now = _Run(part, min_docs, keep_first, True)
                yield from now.add(part, int(other[: starts[1]].sum()), head=True)
                yield from now.finish(True)
                starts = starts[1:]
            low, high = starts[0], starts[-1]
            if low < high:  # runs that lie within this batch
                which = np.cumsum(begins[low:high]) - 1
                gone = np.bincount(which, other[low:high])[which] >= min_docs
                if keep_first:
                    gone &= ~begins[low:high]
                if gone.any():
                    yield _marks([c[low:high][gone] for c in rows], _DROPPED)
            part = [c[high:] for c in rows]
            now = _Run(part, min_docs, keep_first, now is None)
            yield from now.add(part, int(other[high:].sum()), head=True)
        if now is not None:
            yield from now.finish(True)

    return run


def encode(n_lines: int, dropped) -> bytes:
    """Keep bitmap of a document: byte 1 and the lengths of alternating kept and dropped runs as
    base-128 numbers, or byte 0 and one bit a line, whichever is shorter."""
    bits = np.ones(n_lines, bool)
    bits[np.asarray(dropped, np.int64)] = False
    turns = np.flatnonzero(bits[1:] != bits[:-1]) + 1
    runs = np.diff(np.concatenate([[0], turns, [n_lines]])).tolist()
    if n_lines and not bits[0]:
        runs.insert(0, 0)
    if len(runs) > n_lines // 8 + 1:
        return b"\x00" + np.packbits(bits).tobytes()
    out = bytearray(b"\x01")
    for x in runs:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    packed = b"\x00" + np.packbits(bits).tobytes()
    return bytes(out) if len(out) <= len(packed) else packed


def decode(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The keep bits of `encode`."""
    if bitmap[0] == 0:
        return np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), count=n_lines).astype(bool)
    runs, x, shift = [], 0, 0
    for b in bitmap[1:]:
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            runs.append(x)
            x = shift = 0
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


def _encoded(batches):
    for batch in batches:
        sizes, lists = batch.column(2).to_pylist(), batch.column(3)
        drops = [np.asarray(x.values) for x in lists]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array([len(d) for d in drops], pa.int64()),
                pa.array([encode(n, d) for n, d in zip(sizes, drops)], pa.binary()),
            ],
            names=["k1", "k2", "n_lines", "n_dropped", "bitmap"],
        )


def line_bitmaps(
    docs: DataFrame, scratch: Scratch, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1
) -> DataFrame:
    """(k1, k2, n_lines, n_dropped, bitmap) for each document of `docs` (doc_id, text).

    A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Keys of at least
    `min_chars` code points in at least `min_docs` documents lose all their lines, or with
    `keep_first` all but the first in order of doc_id and position. A document is a pair of id and
    text: repeated rows are one document, and a null id is an id of its own. A null or empty text
    is one empty line, which is never dropped. No rows give no rows; extra columns are not read.
    """
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars start at 1")
    lines, lines_path = scratch.write(line_rows(docs, min_chars), "lines")
    order = ["h1", "h2", "k1", "k2"]
    dealt = lines.where("h1 is not null").repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    marks, _ = scratch.write(dealt.mapInArrow(_stream(min_docs, keep_first), _MARKS), "marks")
    place = F.struct("k1", "k2", "pos")
    common = (
        marks.where(F.col("state") == _EDGE).groupBy("h1", "h2")
        .agg(F.sum("n").alias("docs"), F.min(place).alias("least"))
        .where(F.col("docs") >= min_docs)
    )
    late = (
        marks.where(F.col("state").isin(_OPEN, _OPEN_FIRST)).join(common, ["h1", "h2"])
        .where((F.col("state") == _OPEN) | (place != F.col("least")))
    )
    gone = marks.where(F.col("state") == _DROPPED).select("k1", "k2", "pos").union(late.select("k1", "k2", "pos"))
    sizes = lines.where("h1 is null").select("k1", "k2", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    each = sizes.union(gone.select("k1", "k2", F.lit(None).cast("int"), "pos"))
    each = each.groupBy("k1", "k2").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    found, _ = scratch.write(
        each.mapInArrow(_encoded, "k1 long, k2 long, n_lines long, n_dropped long, bitmap binary"), "bitmaps"
    )
    scratch.drop(lines_path)
    return found


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with the lines that their bitmaps keep, joined by \\n, and two more columns,
    `n_lines` and `n_dropped`, which replace columns of these names. A null text is the empty one."""

    @F.pandas_udf("string")
    def kept(text, bitmap, n_lines):
        import pandas as pd

        def one(t, b, n):
            bits = decode(b, n)
            return t if bits.all() else "\n".join([x for x, k in zip(t.split("\n"), bits) if k])

        return pd.Series([one(t or "", b, n) for t, b, n in zip(text, bitmap, n_lines)], dtype=object)

    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct("*").alias("row"), *_keys())
    joined = rows.join(bitmaps, ["k1", "k2"])
    text = kept(F.col("row")["text"], F.col("bitmap"), F.col("n_lines"))
    return joined.select(*[F.col("row")[c].alias(c) for c in own], text.alias("text"), "n_lines", "n_dropped")
