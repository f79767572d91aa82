"""Token ids of a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by one Python worker; beyond it the cache starts anew. It changes speed only.
CACHE_WORDS = 600_000
ENCODED_BYTES = 12 << 20

# Words of these characters alone are split as the file's own pre-tokenizer splits them; all other
# words pass through the whole tokenizer. The contractions and classes are fixed values of the file.
_LATIN = "a-zà-öø-ÿ"
_PLAIN = rf"^[\t-\r -~{_LATIN}À-ÖØ-Þ]*$"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9\n]+")


def _hidden() -> dict[str, str]:
    """The letters that stand for bytes of accented letters without a visible one."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {chr(b): chr(256 + n) for n, b in enumerate(hidden) if b >= 128}


_HIDDEN = _hidden()
# A letter before a mark always ends a piece, unless an apostrophe may start a contraction.
_LETTER_MARK = rf"([{_LATIN}])([!-&(-/:-@\[-`{{-~])"


class Encoder:
    """Ids of whole texts, equal to the tokenizer file's `encode(text, add_special_tokens=False)`.

    White space separates tokens in the file's vocabulary and is dropped, so a text is the sequence
    of its words. Words not in the cache are encoded together. The cache has two generations: a
    full one becomes the old one, from which words still in use move on.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spelled = Tokenizer(self.tokenizer.model)  # for pieces that are split and spelled already
        self.spelled.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closes = self.endings("</w>$")  # the vocabulary marks the ends of pieces
        self.spelled.model._resize_cache(cache_words // 4)
        self.limit, self.words, self.old = cache_words // 2, {"": b""}, {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        odd = pc.invert(self._plain(pa.array(words, pa.string()))).to_pylist()
        self.words.update((w, self._whole(w)) for w, o in zip(words, odd) if o)
        plain = [w for w, o in zip(words, odd) if not o]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            text = _PIECE.sub(r"\g<0> ", "\n".join(some).lower())
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for byte, letter in _HIDDEN.items():
                    text = text.replace(byte, letter)
            counts = [line.count(" ") for line in text.split("\n")]
            found = self.spelled.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            closing = np.nonzero(self.closes[ids])[0]  # the last id of each piece
            ends = (closing[np.cumsum(counts) - 1] + 1) * self.dtype.itemsize
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist()):
                self.words[word] = data[begin:end]
                begin = end

    def _plain(self, texts: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(texts, _PLAIN)
        for special in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, special)))
        return plain

    def _table(self, words: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words, self.old = {"": b""}, self.words
        found = list(map(self.words.get, words))
        unseen = [i for i, ids in enumerate(found) if ids is None]
        if unseen:
            kept = [self.old.get(words[i]) for i in unseen]
            self.words.update((words[i], ids) for i, ids in zip(unseen, kept) if ids is not None)
            self._learn([words[i] for i, ids in zip(unseen, kept) if ids is None])
            for i in unseen:
                found[i] = self.words[words[i]]
        return found

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array; none for a null or blank one."""
        texts = pc.fill_null(texts, "")
        split = pc.replace_substring_regex(pc.utf8_lower(texts), _LETTER_MARK, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(self._plain(texts), split, texts))
        words = lists.flatten().dictionary_encode()
        known = pa.array(self._table(words.dictionary.to_pylist()), pa.large_binary())
        _, offsets, data = known.take(words.indices).buffers()  # the ids of all words, one after another
        flat = np.frombuffer(data if data is not None else b"", self.dtype)
        ends = np.frombuffer(offsets, np.int64) // self.dtype.itemsize
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the rows (doc_id, text), encoded some megabytes at a time."""
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(ids):
                before = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + ENCODED_BYTES)))
                yield from zip(ids[begin:end], self.batch(texts.slice(begin, end - begin)))
                begin = end

    def endings(self, pattern: str) -> np.ndarray:
        """Whether the token's string matches, by id."""
        found = re.compile(pattern)
        table = np.zeros(max(self.tokenizer.get_vocab_size(), 1 << 16), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            table[i] = bool(found.search(token))
        return table


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
