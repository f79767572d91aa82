"""License scans by template markup compiled into token automata.

A template is the wording of a license or notice with two kinds of marked regions:

    <<beginOptional>> ... <<endOptional>>      wording that may be left out
    <<var;name=holder;words=0-8>>              any words, as many as given

It is compiled into an automaton over words; a text matches where a run of its words is accepted,
so that all mandatory wording stands there exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import ship_package

# Phrases that give a base label wherever their words stand next to each other.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License wording with optional and replaceable regions, by label.
TEMPLATES = {
    "gpl-notice": """<<beginOptional>>This <<var;name=what;words=1-3>> is<<endOptional>> licensed under the
        <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        version <<var;name=version;words=1-2>>""",
    "gpl-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version <<var;name=version;words=1-2>>
        of the License, or (at your option) any later version.""",
    "apache-2.0": """Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0
        <<beginOptional>>(the "License"); you may not use this file except in compliance with the License.<<endOptional>>""",
    "cc-by-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY 4.0",
    "cc-by-nc-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY-SA 4.0",
    "mit-notice": "<<var;name=verb;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit": """<<beginOptional>>Copyright <<var;name=holder;words=1-12>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name=what;words=1-6>> and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
        portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.""",
}

# Bytes of words as they are, A-Z lower-cased, all others as blanks.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """States are numbers; `step` by word, `free` by any word, `skip` by none. 0 starts, `end` accepts."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    end: int = 0
    anchors: tuple[bytes, ...] = ()

    def state(self) -> int:
        self.step.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """With the states reached by skips; each keeps the earliest start it was reached from."""
        todo = list(states.items())
        while todo:
            at, start = todo.pop()
            for to in self.skip[at]:
                if states.get(to, start + 1) > start:
                    states[to] = start
                    todo.append((to, start))
        return states

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of accepted runs: the earliest, then the longest, none overlapping."""
        found: dict[int, int] = {}
        firsts = self.closure({0: 0})
        entry = {w for s in firsts for w in self.step[s]}
        anything = any(self.free[s] is not None for s in firsts)
        active: dict[int, int] = {}
        for i, word in enumerate(words):
            if anything or word in entry:
                for s in firsts:
                    active.setdefault(s, i)
            moved: dict[int, int] = {}
            for s, start in active.items():
                for to in (self.step[s].get(word), self.free[s]):
                    if to is not None and moved.get(to, start + 1) > start:
                        moved[to] = start
            active = self.closure(moved)
            if self.end in active:
                start = active[self.end]
                found[start] = i + 1
        out: list[tuple[int, int]] = []
        for start, end in sorted(found.items()):
            if not out or start >= out[-1][1]:
                out.append((start, end))
        return out


_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; ValueError if its marks are unbalanced or nothing is mandatory."""
    auto = Automaton(label)
    at = auto.state()
    opened: list[int] = []
    mandatory: list[bytes] = []
    pieces = _MARK.split(markup)
    for text, mark in zip(pieces[::2], [*pieces[1::2], ""]):
        for word in words_of(text.encode()):
            to = auto.state()
            auto.step[at][word] = to
            at = to
            if not opened:
                mandatory.append(word)
        if mark == "beginOptional":
            to = auto.state()  # a state of its own, so that a skip leaves only this region out
            auto.skip[at].append(to)
            opened.append(to)
            at = to
        elif mark == "endOptional":
            if not opened:
                raise ValueError(f"{label}: an optional region ends that did not begin")
            to = auto.state()
            auto.skip[at].append(to)
            auto.skip[opened.pop()].append(to)
            at = to
        elif mark.startswith("var;"):
            given = dict(p.split("=", 1) for p in mark.split(";")[1:])
            least, most = map(int, given.get("words", "1-1").split("-"))
            exits = []
            for k in range(most):
                if k >= least:
                    exits.append(at)
                to = auto.state()
                auto.free[at] = to
                at = to
            last = auto.state()
            for s in [*exits, at]:
                auto.skip[s].append(last)
            at = last
    if opened:
        raise ValueError(f"{label}: an optional region does not end")
    if not mandatory:
        raise ValueError(f"{label}: no mandatory wording")
    auto.end = at
    auto.anchors = tuple(dict.fromkeys(mandatory))
    return auto


def _places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts in words padded by one blank each."""
    out, at = [], padded.find(phrase)
    while at >= 0:
        out.append(padded.count(b" ", 0, at))
        at = padded.find(phrase, at + 1)
    return out


COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,start:long,end:long>>"
)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text), see COLUMNS.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z
    lower-cased; a null or empty text has none. n_base counts the places of base phrases,
    first_word and last_word are the first and last word they start at (null if none). matches are
    the runs that templates accept, and labels names both kinds. score is 1 with a template match,
    0.5 with base phrases alone, else 0. Each text is read once; no words leave the task.
    """
    ship_package(docs.sparkSession)
    compiled = [compile_template(*t) for t in (TEMPLATES if templates is None else templates).items()]
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
    types = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py() or b"")
                padded = b" " + b" ".join(words) + b" "
                base, labels = [], set()
                for phrase, label in phrases:
                    if phrase in padded:
                        base += _places(padded, phrase)
                        labels.add(label)
                found = []
                for auto in compiled:
                    if all(b" " + w + b" " in padded for w in auto.anchors):
                        found += [{"label": auto.label, "start": a, "end": b} for a, b in auto.find(words)]
                more = labels | {m["label"] for m in found}
                rows.append(
                    (
                        len(words), len(base), min(base, default=None), max(base, default=None),
                        ",".join(sorted(labels)), ",".join(sorted(more)),
                        1.0 if found else 0.5 if base else 0.0, sorted(found, key=lambda m: (m["start"], m["label"])),
                    )
                )
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), types]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, COLUMNS)
