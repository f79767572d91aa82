"""License scans against a plain search for phrases and a regular-expression reading of templates."""

import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import licenses
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    words = plain_words(text)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def as_pattern(markup):
    out = ""
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            least, most = re.search(r"words=(\d+)-(\d+)", part).groups()
            out += rf"(?:\S+ ){{{least},{most}}}"
        else:
            out += "".join(re.escape(w) + " " for w in plain_words(part))
    return re.compile(r"(?<!\S)" + out)


def template_labels(text):
    joined = "".join(w + " " for w in plain_words(text))
    return {label for label, markup in licenses.TEMPLATES.items() if as_pattern(markup).search(joined)}


def check(texts, rows):
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(texts)
    for i, text in texts.items():
        r = got[i]
        want = base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        own = template_labels(text)
        assert r["labels"] == ",".join(sorted(own | set(filter(None, want[-1].split(",")))))
        assert r["score"] == (1.0 if own else 0.5 if want[1] else 0.0)


def test_query_matches_plain_search(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_license_scan"](spark, sf).collect()
    check(texts, rows)
    assert any(r["score"] == 1.0 for r in rows)


MIT = """Copyright (c) 2020 Some Holder
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_edge_cases(spark):
    texts = [
        None, "", " ., ", "MIT License MIT license mit-license", "cc by cc by cc", "apache\nlicense", "x" + MIT, "x " + MIT,
        MIT.replace("hereby ", ""), MIT.replace("notice shall", "notice (including the next paragraph) shall"),
        "Licensed under CC BY-NC 4.0.", "under the terms of the GNU General Public License version 2", "licensed under the GNU General Public License, Version 3.0 or more",
        "w " * 100_000 + "Released under the MIT License.", "é" * 50_000, "mitlicense mit licenses", "This This work is licensed under the GNU General Public License version 3",
    ]
    rows = list(enumerate(texts)) + [(None, "MIT License")]
    docs = local_frame(spark, rows, "doc_id long, text string").withColumn("labels", F.lit("x"))
    check(dict(rows), licenses.scan(docs.union(docs.limit(0))).collect())
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert "mit" in [m["label"] for m in got[7]["matches"]] and not [m for m in got[8]["matches"] if m["label"] == "mit"]
    assert licenses.scan(docs.limit(0)).count() == 0
    twice = licenses.scan(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and twice[0]["n_base"] == 3


def test_templates_and_runs():
    auto = licenses.compile_template("t", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;name=x;words=0-2>> e")
    for text, want in {
        "a d e": [(0, 3)], "a b d x e": [(0, 5)], "a b c d x y e": [(0, 7)], "a c d e": [], "a d x y z e": [], "a a d e a d e": [(1, 4), (4, 7)], "a d e e": [(0, 4)],
    }.items():
        assert auto.find([w.encode() for w in text.split()]) == want
    for bad in ("<<endOptional>> a", "<<beginOptional>> a", "<<var;words=1-2>>", ""):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)
