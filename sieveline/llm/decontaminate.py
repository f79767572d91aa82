"""Benchmark decontamination on canonical templates.

Numbers, names and units of a text become typed placeholders, so that a question keeps its template
when its values change. Windows of template tokens are hash-joined between documents and benchmark
items. For each document and item the values that fill the placeholders are compared: in a copy of
the item one item value must stand for one document value throughout; windows that break this do
not count. A document leaks an item if the windows that count for one copy cover enough of the item's.
An item without a window, being short or of numbers, leaks where the whole of it stands as it is spelled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch, fresh, row_key, text_key

WINDOW = 5
SIMILARITY = 0.8
#: Tokens of a window that must be words, names included, and those that must be plain words.
LEAST_WORDS = 3
LEAST_PLAIN = 2
#: Tokens of the shortest item that can leak; fewer tell nothing from chance.
LEAST_TOKENS = 3
#: Item windows up to which documents are compared with a broadcast table of their hashes (8 bytes
#: each) before the join; beyond it every window of a document takes part in the shuffled join.
BROADCAST_WINDOWS = 4_000_000
PIECE_BYTES = 4 << 20
# Units of measure that make a unit placeholder after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw v a c f k j kj pa kpa usd eur gbp dollars dollar cents cent percent hours minutes "
    "seconds meters metres miles feet inches pounds grams kilograms liters litres".split()
)
# Units that are words of their own as well; they count only where they touch the number.
TOUCHING = frozenset("in a c f j k s v w".split())
# Capitalised words that are no names.
FUNCTION_WORDS = frozenset(
    "an the this that these those what which who whom whose when where why how is are was were be been do does did has have "
    "had can could will would shall should may might must if then and or but nor so as at by for from in into of off on out "
    "over to up with without it its he she they we you his her their our your my there here not no yes all any each every "
    "some both after before while because although during since until".split()
)
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it is one-to-one
_SHIFT = np.uint64(29)
#: Bytes of a token that are hashed together with those of all others; longer ones one by one.
_TOGETHER = 64

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_UPPER_POINT = np.array([chr(i).isupper() for i in range(0x800)])  # characters of two bytes
_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, eight at a time."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = left.astype(np.uint64) * _MIX
    rows = None
    for k in range(0, _TOGETHER, 8):
        if rows is None:
            more = eight[starts] & _KEPT[np.minimum(left, 8)]
            out = (out ^ more) * _MIX
            out ^= out >> _SHIFT
        else:
            more = (out[rows] ^ (eight[starts[rows] + k] & _KEPT[np.minimum(left[rows] - k, 8)])) * _MIX
            out[rows] = more ^ (more >> _SHIFT)
        rows = np.flatnonzero(left > k + 8) if rows is None else rows[left[rows] > k + 8]
        if not len(rows):
            break
    for i in rows.tolist():
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(low[starts[i] + _TOGETHER : ends[i]].tobytes(), 7))
    return out


def _of_words(words) -> np.ndarray:
    data = [w.encode() for w in sorted(words)]
    ends = np.cumsum([len(w) for w in data])
    starts = np.concatenate([[0], ends[:-1]])
    return np.sort(_hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends))


_UNIT_HASHES, _TOUCHING_HASHES, _FUNCTION_HASHES = _of_words(UNITS), _of_words(TOUCHING), _of_words(FUNCTION_WORDS)
_NUMBER_HASH, _NAME_HASH, _UNIT_HASH = (np.uint64(xxhash.xxh64_intdigest(s, 7)) for s in (NUMBER, NAME, UNIT))


def _borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether a number) of the tokens of texts that stand one after another in `data`."""
    n = len(data)
    digit = _DIGIT[data]
    inside = digit | _LETTER[data]
    cut = np.zeros(n + 4, bool)
    cut[offsets] = True

    def at(*bytes_: int) -> np.ndarray:
        """Places of a first byte that two more follow"""
        return np.flatnonzero(np.isin(data[: max(0, n - 2)], bytes_))

    for i in (np.flatnonzero(data[: max(0, n - 1)] == 0xC2),):  # U+0080 to U+00BF: blanks and marks
        inside[i] = inside[i + 1] = False
    wide = at(0xE2, 0xE3, 0xEF)
    first, second, third = data[wide], data[wide + 1], data[wide + 2]
    marks = (second == 0x80) & (first != 0xEF)  # U+2000 to U+203F, U+3000 to U+303F
    marks |= (first == 0xE2) & (second == 0x88) & (third == 0x92)  # minus
    marks |= (first == 0xEF) & (second == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)))  # full width
    for k in range(3):
        inside[wide[marks] + k] = False
    single = at(0xE0, *range(0xE3, 0xEA))  # scripts that leave no blanks between words: a token a character
    first, second = data[single], data[single + 1]
    single = single[inside[single] & ((first != 0xE0) | ((second >= 0xB8) & (second <= 0xBB)))]
    cut[single] = cut[single + 3] = True

    point = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    point = point[(point > 0) & (point < n - 1)]
    point = point[digit[point - 1] & digit[point + 1] & ~cut[point] & ~cut[point + 1]]
    inside[point] = True
    numeric = digit
    numeric[point] = True

    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1 : n + 1])) + 1
    other = np.append(np.flatnonzero(inside & ~numeric), n + 1)
    stop = other[np.searchsorted(other, starts)]  # where the number that a token starts with ends
    split = stop[(stop > starts) & (stop < ends)]
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
        stop = other[np.searchsorted(other, starts)]
    return starts, ends, stop >= ends


class Tokens:
    """Template tokens of texts: hash, whether a placeholder, text number, and where they stand.

    Texts are split at everything but digits, letters and characters beyond ASCII (of these, blanks,
    dashes, quotes and the punctuation of East Asian scripts split as well); a character of a
    script without blanks is a token. Digits, also with points and commas between digits, are a
    number, and what is glued to their end is a token of its own. After a number a known unit
    is a unit. A capitalised word other than a function word is a name, also where it starts a
    sentence, so that a text may name others there. Everything else is a word, A-Z lower-cased.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, b"")
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.low = _LOWER[data]
        self.starts, self.ends, numbers = _borders(data, offsets)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.spelled = _hashes(self.low, self.starts, self.ends)
        self.hashes = self.spelled.copy()

        upper = _UPPER[data]
        pairs = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF))
        upper[pairs[_UPPER_POINT[((data[pairs] & 31).astype(np.int64) << 6) | (data[pairs + 1] & 63)]]] = True
        names = np.flatnonzero(upper[self.starts]) if len(self.starts) else np.zeros(0, np.int64)
        names = names[self.ends[names] - self.starts[names] > np.where(data[self.starts[names]] < 128, 1, 2)]
        where = np.flatnonzero(upper)
        names = names[np.searchsorted(where, self.ends[names]) - np.searchsorted(where, self.starts[names]) == 1]
        names = names[~_known(_FUNCTION_HASHES, self.spelled[names])]

        units = np.flatnonzero(numbers[:-1] & ~numbers[1:]) + 1
        units = units[self.text[units] == self.text[units - 1]]
        units = units[_known(_UNIT_HASHES, self.spelled[units])]
        touching = self.starts[units] == self.ends[units - 1]
        units = units[touching | ~_known(_TOUCHING_HASHES, self.spelled[units])]

        self.slots, self.named = numbers.copy(), np.zeros(len(numbers), bool)
        self.named[names] = True
        self.slots[names] = self.slots[units] = True
        self.hashes[numbers], self.hashes[names], self.hashes[units] = _NUMBER_HASH, _NAME_HASH, _UNIT_HASH

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def whole(self, i: int, width: int) -> int:
        """Hash of `width` tokens from `i` as they are spelled, with the marks between them but without blanks."""
        parts = []
        for k in range(i, i + width):
            parts.append(self.word(k))
            if k + 1 < i + width:
                parts.append(b"".join(self.low[self.ends[k] : self.starts[k + 1]].tobytes().split()) or b" ")
        return xxhash.xxh64_intdigest(b"".join(parts), 11)

    def openings(self) -> np.ndarray:
        """Hash of the spelling of each token and those that follow it, LEAST_TOKENS in all."""
        return _mixed(self.spelled, LEAST_TOKENS)


def _known(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        mixed = (mixed ^ hashes[k : k + n]) * _MIX
        mixed ^= mixed >> _SHIFT
    return mixed


def windows(tokens: Tokens, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of each window inside a text with enough plain words."""
    mixed = _mixed(tokens.hashes, width)
    n = len(mixed)
    if not n:
        return mixed, np.zeros(0, np.int64)
    plain, names = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for k in range(width):
        plain += ~tokens.slots[k : k + n]
        names += tokens.named[k : k + n]
    at = np.flatnonzero((plain >= LEAST_PLAIN) & (plain + names >= LEAST_WORDS) & (tokens.text[:n] == tokens.text[width - 1 :]))
    return mixed[at], at


_WINDOWS = "window long, size long, places array<int>, slots array<array<string>>"


class _Wanted:
    """The windows and whole items that documents are searched for."""

    def __init__(self, known: np.ndarray | None, openings: dict[int, list[int]] | None, widths: list[int]):
        self.known, self.openings, self.widths = known, openings, widths
        self.first = np.array(sorted(openings or ()), np.uint64)
        if known is not None:  # most windows of a text are told from all of the table by 22 bits
            self.some = np.zeros(1 << 22, bool)
            self.some[known >> np.uint64(42)] = True

    def windows(self, found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known is None:
            return found, at
        hit = np.flatnonzero(self.some[found >> np.uint64(42)])
        hit = hit[_known(self.known, found[hit])]
        return found[hit], at[hit]

    def items(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first token) of sequences as long as an item without windows, where such an item may stand."""
        if not self.widths:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        opening = tokens.openings()
        starts = np.arange(len(opening)) if self.openings is None else np.flatnonzero(_known(self.first, opening))
        stop = np.searchsorted(tokens.text, tokens.text[starts], "right")  # the end of the text a start is in
        found = [
            (tokens.whole(i, width), i)
            for i, key, end in zip(starts.tolist(), opening[starts].tolist(), stop.tolist())
            for width in (self.widths if self.openings is None else self.openings[key])
            if i + width <= end
        ]
        return np.array([f for f, _ in found], np.uint64), np.array([i for _, i in found], np.int64)


def _rows(batch: pa.RecordBatch, n_keys: int, tokens: Tokens, found: np.ndarray, at: np.ndarray, whole: bool) -> list[pa.Array]:
    """Columns (keys, window, size, places, slots), a row per distinct window of a text."""
    order = np.lexsort((at, found, tokens.text[at]))
    found, at = found[order], at[order]
    rows = tokens.text[at]
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]))
    total = np.bincount(rows[new], minlength=batch.num_rows)
    begins = np.searchsorted(tokens.text, rows)
    places, values = [], []
    for begin, end in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
        some = not whole and tokens.slots[at[begin] : at[begin] + WINDOW].any()
        starts = at[begin:end].tolist() if some else []
        places.append((at[begin:end] - begins[begin]).tolist() if some else [])
        values.append([[tokens.word(i).decode(errors="replace") for i in range(start, start + WINDOW) if tokens.slots[i]] for start in starts])
    columns = [batch.column(i).take(pa.array(rows[new])) for i in range(n_keys)]
    columns += [pa.array(found[new].view(np.int64)), pa.array(total[rows[new]])]
    return [*columns, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.list_(pa.string())))]


def _found(keys: list[str], wanted):
    """Function over batches (keys, text): one row per distinct window of a text that is wanted.

    size counts these. A window with placeholders has, for each time it
    stands in the text, the place of its first token and the values; others have neither, nor have
    the places where a whole item without windows stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = wanted.value
        for batch in _slices(batches, len(keys)):
            tokens = Tokens(batch.column(len(keys)))
            for whole in (False, True):
                found, at = sought.items(tokens) if whole else sought.windows(*windows(tokens))
                if len(found):
                    columns = _rows(batch, len(keys), tokens, found, at, whole)
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "window", "size", "places", "slots"])

    return run


_ITEMS = "item_id long, item_key long, " + _WINDOWS + ", opening long, width int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items; of an item without any the whole of it, with its opening and number of tokens."""
    names = [c.split()[0] for c in _ITEMS.split(", ")]
    for batch in _slices(batches, 2):
        tokens = Tokens(batch.column(2))
        found, at = windows(tokens)
        if len(found):
            columns = _rows(batch, 2, tokens, found, at, False)
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))], names=names)
        counts = np.bincount(tokens.text, minlength=batch.num_rows)
        bare = np.setdiff1d(np.flatnonzero(counts >= LEAST_TOKENS), tokens.text[at])
        if len(bare):
            begins = np.searchsorted(tokens.text, bare)
            whole = [tokens.whole(i, n) for i, n in zip(begins.tolist(), counts[bare].tolist())]
            columns = _rows(batch, 2, tokens, np.array(whole, np.uint64), begins, True)
            columns += [pa.array(tokens.openings()[begins].view(np.int64)), pa.array(counts[bare].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of some megabytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = int(sizes[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + PIECE_BYTES)))
            yield batch.slice(begin, end - begin)
            begin = end


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, window, size, places, slots, opening, width): the distinct windows of each item, size of them in all.

    Of an item without a window of enough plain words (a short one, or one of numbers) the whole is
    its one window, as it is spelled; width is its number of tokens then, otherwise 0. Items with a
    null id or text or of less than LEAST_TOKENS tokens have none. Of several rows of one id each
    distinct text counts on its own under the id.
    """
    rows = benchmark.where("item_id is not null").select("item_id", F.xxhash64("text").alias("item_key"), F.col("text").cast("binary").alias("text"))
    return rows.dropDuplicates(["item_id", "item_key"]).mapInArrow(_items, _ITEMS)


def _wanted(items: DataFrame, bound: int) -> _Wanted:
    """What to search for; tables of over `bound` hashes are left out, and then everything is emitted."""

    def some(df: DataFrame) -> pa.Table | None:
        rows = df.distinct().limit(bound + 1).toArrow()  # at most 12 bytes times the bound
        return rows if len(rows) <= bound else None

    found = some(items.where("width = 0").select("window"))
    known = None if found is None else np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))
    whole = items.where("width > 0")
    widths = [r["width"] for r in whole.select("width").distinct().collect()]  # at most the tokens of the longest item
    pairs = some(whole.select("opening", "width"))
    openings: dict[int, list[int]] | None = None if pairs is None else {}
    if pairs is not None:
        for opening, width in zip(pairs.column(0).to_numpy().astype(np.int64).view(np.uint64).tolist(), pairs.column(1).to_pylist()):
            openings.setdefault(opening, []).append(width)
    return _Wanted(known, openings, sorted(widths))


def _covered(hits: list[dict]) -> tuple[int, bool]:
    """(windows that count, whether a value differs) where the document covers an item best.

    Windows that stand as far from their place in the item form one copy. Each copy says what an
    item value stands for (where it does not, the nearest copy; of several values the most frequent
    one), and the windows of the document that agree with it count. Verbatim values, and over the
    whole document the most frequent ones, are tried as well. What one copy says does not depend on
    others that stand farther away than its own parts, so these cannot lower the coverage.
    """
    plain, slotted = 0, []
    copies: dict[str, dict[int, dict[str, int]]] = {}
    overall: dict[str, dict[str, int]] = {}
    shifts = set()
    for hit in hits:
        if not hit["item_slots"]:
            plain += 1
            continue
        items, docs = [[tuple(v) for v in hit[k]] for k in ("item_slots", "slots")]
        slotted.append((set(items), set(docs)))
        for at, item in zip(hit["item_places"], items):
            for place, doc in zip(hit["places"], docs):
                shifts.add(place - at)
                for a, b in zip(item, doc):
                    counts = copies.setdefault(a, {}).setdefault(place - at, {})
                    counts[b] = counts.get(b, 0) + 1
        for item, doc in product(*slotted[-1]):
            for a, b in zip(item, doc):
                counts = overall.setdefault(a, {})
                counts[b] = counts.get(b, 0) + 1

    def top(counts: dict[str, int]) -> str:
        return min(counts, key=lambda b: (-counts[b], len(b), b))

    values = sorted(copies)
    said = [(sorted(copies[a]), {shift: top(counts) for shift, counts in copies[a].items()}) for a in values]

    def near(own: list[int], shift: int) -> int:
        i = bisect_left(own, shift)
        return min(own[max(0, i - 1) : i + 1], key=lambda x: abs(x - shift))

    tries = {tuple(values), tuple(top(overall[a]) for a in values)}
    tries |= {tuple(of[near(own, shift)] for own, of in said) for shift in shifts}
    best = (-1, False)
    for chosen in tries:
        meant = dict(zip(values, chosen))
        count, same = plain, True
        for items, docs in slotted:
            agreeing = [item for item in items if tuple(meant[a] for a in item) in docs]
            count += bool(agreeing)
            same &= all(meant[a] == a for item in agreeing for a in item)
        best = max(best, (count, same))
    return best[0], not best[1]


_JUDGED = "doc_id long, text_key long, item_id long, item_key long, n_windows long, n_matched long, changed boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_covered(hits.as_py()) for hits in batch.column(5)]
        columns = [*batch.columns[:5], pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _JUDGED.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_matched, coverage, changed) of each leak.

    n_matched counts the item's windows that are in the document with values consistent with one
    copy of the item, the one that covers most; coverage is its share, at least `similarity`;
    changed says that some value differs from the item's (a re-parameterised question). Null and
    empty texts leak nothing. Repeated rows with the same id and text are one document. No rows of
    either table give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items, _ = scratch.write(item_windows(benchmark), "items")
    rows = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    wanted = spark.sparkContext.broadcast(_wanted(items, broadcast_windows))
    found = rows.mapInArrow(_found(["doc_id", "text_key"], wanted), "doc_id long, text_key long, " + _WINDOWS)
    sought = items.select("item_id", "item_key", "window", F.col("size").alias("n_windows"), F.col("places").alias("item_places"), F.col("slots").alias("item_slots"))
    matched = found.select("doc_id", "text_key", "window", "places", "slots").join(sought, "window")
    hit = F.struct("window", "item_places", "item_slots", "places", "slots")
    pairs = matched.groupBy("doc_id", "text_key", "item_id", "item_key", "n_windows").agg(F.collect_set(hit).alias("hits"))
    result = pairs.where(F.size("hits") / F.col("n_windows") >= similarity).mapInArrow(_judged, _JUDGED)
    result = result.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= similarity)
    best = F.max_by(F.struct("n_windows", "n_matched", "coverage", "changed"), F.struct("coverage", "n_windows", "item_key")).alias("b")
    return result.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that leak no item, with their columns."""
    found, _ = Scratch(docs.sparkSession).write(leaks(docs, benchmark).select("doc_id", "text_key").distinct(), "leaks")
    id_, key = fresh(docs, "id", "key")
    bad = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    return docs.join(bad, same, "left_anti")
