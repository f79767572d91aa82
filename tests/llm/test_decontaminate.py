"""Decontamination against brute force over templates, and re-parameterised questions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import decontaminate
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame


_CHARACTER = r"[\u0e00-\u0eff\u3040-\u9fff]"  # Thai and Lao, kana and ideographs
_INSIDE = r"[A-Za-z\u00c0-\u0dff\u0f00-\u1fff\u2040-\u2211\u2213-\u2fff\ua000-\uff00\uff10-\uff19\uff21-\U0010ffff]"
_TEMPLATE = re.compile(rf"([0-9]+(?:[.,][0-9]+)*)|({_CHARACTER}|{_INSIDE}(?:{_INSIDE}|[0-9]|(?<=[0-9])[.,](?=[0-9]))*)")


def template(text):
    """(token, value or None) by the rules, one token at a time"""
    out, number_end = [], None
    for m in _TEMPLATE.finditer(text or ""):
        body = m[0]
        low = "".join(c.lower() if c.isascii() else c for c in body)
        name = len(body) > 1 and body[0].isupper() and not any(c.isupper() for c in body[1:])
        if m[1]:
            out.append((decontaminate.NUMBER, low))
        elif number_end is not None and low in decontaminate.UNITS and (number_end == m.start() or low not in decontaminate.TOUCHING):
            out.append((decontaminate.UNIT, low))
        elif name and low not in decontaminate.FUNCTION_WORDS:
            out.append((decontaminate.NAME, low))
        else:
            out.append((low, None))
        number_end = m.end() if m[1] else None
    return out


def spans(text):
    t = template(text)
    found = {}
    for i in range(len(t) - 4):
        w = t[i : i + 5]
        plain = sum(v is None for _, v in w)
        if plain >= 2 and plain + sum(k == decontaminate.NAME for k, _ in w) >= 3:
            found.setdefault(tuple(k for k, _ in w), []).append([v for _, v in w if v is not None])
    return found


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = {r["item_id"]: spans(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for r in docs:
        have = spans(r["text"])
        hit = {i for i, w in items.items() if w and len(w.keys() & have.keys()) >= 0.8 * len(w)}
        if hit:
            want[r["doc_id"]] = len(hit)
    got = {r["doc_id"]: r["n_items"] for r in QUERIES["op9_decontamination"](spark, sf).collect()}
    assert got == want and want


QUESTION = "Alice walks 12 km in 3 hours and then Bob walks 12 km more. How many km does Alice walk in all before the shop closes at noon?"


def bench(spark, *texts):
    return local_frame(spark, [(i, t) for i, t in enumerate(texts)], "item_id long, text string").withColumn("text_key", F.lit(0))


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_reparameterised_questions(spark, bound):
    filler = "nothing of interest stands here at all in this text. "
    cases = {
        0: filler + QUESTION + " " + filler,
        1: filler + QUESTION.replace("12", "45").replace("Alice", "Carol").replace("3 hours", "7 hours").replace("Bob", "Dan") + filler,
        2: filler + QUESTION.replace("12 km in", "45 miles in").replace("Bob walks 12 km", "Bob walks 99 feet").replace("many km", "many kg"),
        3: filler * 5,
        4: " ".join(QUESTION.split()[:12]),
        5: None, 6: "", 7: QUESTION.upper(),
    }
    docs = local_frame(spark, [(k, v) for k, v in cases.items()] + [(0, cases[0]), (None, QUESTION)], "doc_id long, text string")
    docs = docs.withColumn("item_id", F.lit("x")).withColumn("size", F.lit(1))
    items = bench(spark, QUESTION, "too short", None, "", QUESTION)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items, broadcast_windows=bound).collect()}
    assert {k for k in got if k[1] == 0} >= {(0, 0), (1, 0), (None, 0)} and {i for _, i in got} == {0, 4}
    assert not got[0, 0]["changed"] and got[0, 0]["coverage"] >= 0.9 and got[1, 0]["changed"]
    assert not {3, 4, 5, 6} & {d for d, _ in got}
    if (2, 0) in got:  # 12 km cannot be both 45 miles and 99 feet
        assert got[2, 0]["coverage"] < got[0, 0]["coverage"]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5, 6} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (0, 1)").count() == 0
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_long_and_repeated_texts(spark):
    long = "word0 " * 200_000
    texts = [long, "a b c d e " * 3000 + QUESTION, "1 2 3 4 5 6 7 8 9", "é " * 500, "x" * 300_000]
    docs = local_frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontaminate.leaks(docs, bench(spark, QUESTION, "1 2 3 4 5 6 7")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1)}


def test_further_copies_do_not_lower_the_coverage(spark):
    variant = QUESTION.replace("12 km", "45 kg").replace("many km", "many kg").replace("3 hours", "7 days").replace("Bob", "Dan").replace("Alice", "Carol")
    third = QUESTION.replace("12 km", "8 miles").replace("many km", "many miles").replace("3 hours", "20 min").replace("Bob", "Zed").replace("Alice", "Abe")
    mixed = QUESTION.replace("Bob walks 12 km", "Bob walks 99 kg")
    edited = variant.replace("and then", "and right then")
    texts = [QUESTION, variant, f"{QUESTION} {variant}", f"{variant} {QUESTION}", f"{variant} {third}", f"{third} some more words {variant} {third}",
             edited, f"{third} {edited} {QUESTION}", mixed, " ".join(QUESTION.replace("12 km", f"{n} kg") for n in range(100, 160))]
    docs = local_frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, bench(spark, QUESTION), similarity=0.1).collect()}
    alone = {i: got[i]["n_matched"] for i in (0, 1, 6, 8)}
    assert got.keys() == set(range(len(texts))) and alone[0] == got[0]["n_windows"] > alone[8]
    assert got[2]["n_matched"] == got[3]["n_matched"] == alone[0] and not got[2]["changed"] and not got[3]["changed"]
    assert got[4]["n_matched"] >= alone[1] and got[5]["n_matched"] >= alone[1] and got[4]["changed"]
    assert got[7]["n_matched"] >= max(alone[0], alone[6]) and got[9]["n_matched"] >= alone[1] - 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZtom in5kg7.,  -!\n\u00e9\u00c9\u0416\u0436\u00a0\u2212\u201c\u3002\u4ef7\uff0c\u0e2a\ud55c\U0001f600")), max_size=60), max_size=4))
def test_tokens_match_the_rules(texts):
    got = decontaminate.Tokens(pa.array([t.encode() for t in texts], pa.binary()))
    have = [[] for _ in texts]
    for i, t in enumerate(got.text.tolist()):
        have[t].append((got.word(i).decode(), bool(got.slots[i])))
    want = [[(k if v is None else v, v is not None) for k, v in template(t)] for t in texts]
    lower = [[("".join(c.lower() if c.isascii() else c for c in w), s) for w, s in t] for t in want]
    assert have == lower


def test_hashes_tell_tokens_apart():
    words = ["a", "aa", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 66, "b" * 200, "a" * 65 + "b", "", "ab", "ba"]
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    found = decontaminate._hashes(flat, ends - [len(d) for d in data], ends)
    assert len(set(found.tolist())) == len(words)
    again = decontaminate._hashes(np.concatenate([np.full(3, 7, np.uint8), flat]), ends - [len(d) for d in data] + 3, ends + 3)
    assert (found == again).all()


MISSED = [
    # an item, what it is varied to, and a different text
    ("The ship carries 1,200 boxes of 3.5 kg each and loses 5km of rope on every 7th day at sea.",
     "The ship carries 950 boxes of 12 kg each and loses 7km of rope on every 3rd day at sea.".replace("3rd", "9th"),
     "The ship carries 950 boxes of paint and the crew eats 12 kg of rice on every second day of rest."),
    ("Carl ran 12 km before lunch. Carl then rested for an hour. Tom ran the same way but stopped at every bridge.",
     "Anna ran 17 km before lunch. Anna then rested for an hour. Yusuf ran the same way but stopped at every bridge.",
     "Anna ran home. Yusuf stopped at every bridge to look at the water for an hour."),
    ("12 + 30 - 7 = 35 ?", "so 12+30 -7=35 is right", "12, 30, 7, 35 and 12 + 30 - 7 = 350"),
    ("\u5c0f\u660e\u670912\u4e2a\u82f9\u679c\uff0c\u4ed6\u5403\u4e86\u4e09\u4e2a\uff0c\u8fd8\u5269\u4e0b\u51e0\u4e2a\uff1f", "\u5c0f\u660e\u670945\u4e2a\u82f9\u679c\uff0c\u4ed6\u5403\u4e86\u4e09\u4e2a\uff0c\u8fd8\u5269\u4e0b\u51e0\u4e2a\uff1f",
     "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u73a9\u3002"),
    ("Name the largest planet", "now name the\nlargest  planet please", "name the largest moon or planet"),
]


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_values_of_all_kinds_and_items_without_windows(spark, bound):
    filler = " nothing of interest stands here at all in this text. "
    texts = [(3 * i + k, filler + t + filler) for i, case in enumerate(MISSED) for k, t in enumerate(case)]
    docs = local_frame(spark, texts, "doc_id long, text string")
    got = decontaminate.leaks(docs, bench(spark, *[m[0] for m in MISSED], "one two"), broadcast_windows=bound).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3 * i + k, i) for i in range(len(MISSED)) for k in (0, 1)}
    assert {r["doc_id"] for r in got if r["changed"]} == {1, 4, 10}


def test_recall_of_generated_variants(spark):
    """Questions from frames of words; names, numbers and units are drawn anew for the documents."""
    rng = np.random.default_rng(5)
    words = "boat river market lamp rope quay grain stone cart wheel garden bridge oven candle paper clock".split()
    verbs = "carries sells paints moves counts mends hides weighs".split()
    names = "Tom Anna Yusuf Maria Chen Olga Pedro Leila Ivan Noor".split()

    def question():
        parts = []
        for _ in range(rng.integers(2, 5)):
            noun = rng.choice(words, 4)
            parts.append(f"{{n}} {rng.choice(verbs)} {{v}} {{u}} of {noun[0]} past the {noun[1]} and the {noun[2]} near a {noun[3]}.")
        return " ".join(parts) + " How much is that in all?"

    def fill(q):
        while "{" in q:
            q = q.replace("{n}", rng.choice(names), 1).replace("{v}", rng.choice([f"{rng.integers(1, 99)}", f"{rng.integers(1, 9)},{rng.integers(100, 999)}", f"{rng.integers(1, 9)}.5"]), 1)
            q = q.replace("{u}", rng.choice(["kg", "lb", "miles", "km"]), 1)
        return q

    frames = [question() for _ in range(120)]
    items = bench(spark, *[fill(q) for q in frames])
    docs = local_frame(spark, [(i, fill(q)) for i, q in enumerate(frames)], "doc_id long, text string")
    got = decontaminate.leaks(docs, items).where("doc_id = item_id").count()
    assert got >= 0.9 * len(frames)
