"""Packing of documents into training windows by order-preserving dynamic programming.

Documents follow each other by doc_id. A window is cut after a document (free), after a sentence
or, where neither comes soon enough, inside one (both at a price in padded places). Every end of a
document or sentence is a possible cut, and the cheapest cuts minimise padding plus these prices:

    cost[j] = price[j] + min over i of cost[i] + padding(at[j] - at[i]),  at[j] - at[i] <= size

Padding is size - length, so the minimum of cost[i] + at[i] over a sliding window of i is enough; a
queue that is kept increasing yields it in constant time. Lengths that are a power of two are not
padded; those transitions are looked up and compared as well.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sieveline.llm.tokens import encoder
from sieveline.llm.wavelet import in_order
from sieveline.session import ship_package

#: Prices of a cut, in padded places.
SENTENCE_CUT = 4.0
INNER_CUT = 24.0
#: Places between possible cuts inside a sentence.
INNER_STEP = 128
#: Ids that are solved together; what follows the last cut is carried into the next block.
BLOCK_IDS = 1 << 20
SENTENCE_END = r"[.!?]+[\"')\]]*(</w>)?$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(at: np.ndarray, price: np.ndarray, size: int, last: bool = True) -> list[int]:
    """Indexes of the cheapest cuts over ascending places `at`, at[0] = 0 being the first start.

    Gaps must not exceed `size`. With `last` the final place is a cut, otherwise the cheapest of
    those so near the end that no whole window follows.
    """
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int32)
    index[at] = np.arange(n)
    starts, stops = [], []  # of the transitions whose length is a power of two
    power = 1
    while power < size:
        first = int(np.searchsorted(at, power))
        i = index[at[first:] - power]
        hit = np.flatnonzero(i >= 0)
        starts.append(i[hit])
        stops.append(hit + first)
        power *= 2
    starts, stops = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, stops))
    order = np.argsort(stops, kind="stable")
    from_, to = starts[order].tolist(), [*stops[order].tolist(), n]
    exact = 0
    places, prices = at.tolist(), price.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        here = places[j]
        while places[queue[0][1]] < here - size:
            queue.popleft()
        least, i = queue[0]
        best = least + size - here
        while to[exact] == j:
            k = from_[exact]
            if cost[k] < best:
                best, i = cost[k], k
            exact += 1
        cost[j] = best = best + prices[j]
        back[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not last:
        near = [k for k in range(n - 1, -1, -1) if places[k] > places[-1] - size]
        j = min(near, key=lambda k: (cost[k], -k))
    chosen = []
    while j > 0:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def places(ends: np.ndarray, doc_ends: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts and their prices: documents' ends, sentences' ends, steps inside long gaps."""
    step = min(INNER_STEP, size)
    known = np.zeros(total + 1, bool)
    known[ends] = known[doc_ends] = known[[0, total]] = True
    at = np.flatnonzero(known)
    more = (np.diff(at) - 1) // step
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    inner = np.repeat(at[:-1], more) + (nth + 1) * step
    cost = np.full(total + 1, SENTENCE_CUT)
    cost[inner] = INNER_CUT
    cost[doc_ends] = 0.0
    known[inner] = True
    every = np.flatnonzero(known)
    return every, cost[every]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Pieces of every document (null text: only the end id), in windows of at most `size` ids.

    A piece names its document, where it starts there, its length and checksum, and its window and
    place in it. Null and repeated doc_ids are packed like others; no rows give no rows. Windows
    do not cross the ranges of doc_id that tasks hold; each range is read in blocks, so memory does
    not depend on its size (a single document is held whole).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        stops = enc.endings(SENTENCE_END)
        end = np.array([end_id], enc.dtype)
        window = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids left, ids of the document
        count = 0

        def solve(last: bool):
            nonlocal held, count, window
            flat = np.concatenate([h[2] for h in held])
            doc_ends = np.cumsum([len(h[2]) for h in held])
            at, price = places(np.nonzero(stops[flat])[0] + 1, doc_ends, len(flat), size)
            bounds = at[[0, *cuts(at, price, size, last)]]
            wide = flat.astype("<u4")
            rows, rest, begin = [], [], 0
            w = 0
            for (doc_id, start, ids, total), stop in zip(held, doc_ends.tolist()):
                here = begin
                while here < stop and w + 1 < len(bounds):
                    until = min(stop, int(bounds[w + 1]))
                    rows.append((doc_id, start + here - begin, until - here, zlib.crc32(wide[here:until].tobytes()), total, window + w, here - int(bounds[w])))
                    here = until
                    if here == bounds[w + 1]:
                        w += 1
                if here < stop:
                    rest.append((doc_id, start + here - begin, ids[here - begin :], total))
                begin = stop
            window += w
            held, count = rest, sum(len(r[2]) for r in rest)
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_pydict({k: pa.array(list(v), pa.int64()) for k, v in zip(names, columns)})

        for doc_id, ids in enc.stream(batches):
            ids = np.concatenate([ids, end])
            held.append((doc_id, 0, ids, len(ids)))
            count += len(ids)
            if count >= block_ids:
                yield solve(False)
        if held:
            yield solve(True)

    ship_package(docs.sparkSession)
    return in_order(docs).mapInArrow(run, PIECES)
