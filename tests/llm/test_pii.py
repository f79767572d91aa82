"""Personal data against the rules restated in Python, and what contexts add to them."""

import hashlib
import re

from pyspark.sql import functions as F

from sieveline.llm import pii
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    spans = {k: [] for k in PLAIN}
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans[kind].append((m.start(), m.end()))
    return spans


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)


def test_query_matches_the_rules(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op5_personal_data"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want, have = base(r["text"]), got[r["doc_id"]]
        assert [len(v) for v in want.values()] == [have[f"n_{k}"] for k in PLAIN]
        assert have["base_sha256"] == hashlib.sha256(spelled(want).encode()).hexdigest()
        listed = set(have["spans"].split(",")) - {""}
        assert set(spelled(want).split(",")) - {""} <= listed
        for x in listed:
            kind, a, b = x.split(":")
            if kind == "secret":
                assert re.search("[0-9]", r["text"][int(a) : int(b)])


ODD = [
    None, "", "no digits", "a@b.c_d@e.f x@y", "1.2.3.4.5 256.1.1.1 0001.2.3.4 99999999999999999999.1.1.1", "é 4111 1111 1111 1111 é",
    "4111-1111-1111-1112 +1 (377) 555-0271 +49 30 123456789012345", "+1 2", "a" * 20000 + "@" + "b" * 10 + ".c" * 6000, "1" * 20000, "1 " * 9000,
    "u@v.w " * 900, "+1 (222) 333-4444\n" * 150 + "10.0.0.1", "@@@ a@.b a@b. ..@-.- 1.1.1.1@1.1.1.1", "日本 192.168.0.1、日本", "\n\t 7",
]


def test_edge_cases(spark):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(3, ODD[3], 5), (None, "x@y.zz", 5)]
    docs = local_frame(spark, rows, "doc_id long, text string, n_chars long").withColumn("email", F.lit("x")).withColumn("more", F.lit(1))
    found = pii.find(docs).select("doc_id", *pii.RULES, pii.listed(True).alias("spans")).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        want = base(texts[r["doc_id"]])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in PLAIN} == want
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert len(masked) == len(rows) - 1
    assert masked[None]["text"] == "<EMAIL>" and masked[None]["n_chars"] == 7
    assert masked[2]["text"] == "no digits" and masked[2]["n_chars"] == 5 and masked[0]["text"] is None
    assert masked[14]["text"] == "日本 <IP>、日本" and masked[5]["text"] == "é <CARD> é"
    assert pii.mask(docs).columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0


def test_contexts_find_what_no_rule_knows(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)]
    rows = [(i, f'words before token = "{h}" and after {i} more') for i, h in enumerate(hexes)]
    rows += [(100, 'here TOKEN = "Zx9-unseen-FORM" is new'), (101, "version 3 of things"), (102, "version 4 of things")]
    rows += [(200 + i, f"write to the clerk at clerk{i}@mail.example.com today") for i in range(20)]
    rows += [(300, "write to the clerk at clerk7(at)mail today")]
    docs = local_frame(spark, rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).select("doc_id", pii.listed(True).alias("spans")).collect()}
    text = dict(rows)
    kind, a, b = found[100].split(":")
    assert kind == "secret" and text[100][int(a) : int(b)] == "Zx9-unseen-FORM"
    kind, a, b = found[300].split(":")
    assert kind == "email" and text[300][int(a) : int(b)] == "clerk7(at)mail"
    assert found[101] == found[102] == ""
    for i, h in enumerate(hexes):
        kind, a, b = found[i].split(":")
        assert kind == "secret" and text[i][int(a) : int(b)] == h


def test_many_spans_in_one_text(spark):
    """Quadratic work on 40,000 addresses would need some gigabytes and minutes."""
    one = "".join(f"u{i}@v.w " for i in range(40000))
    mixed = "".join(f"x{i} +49 30 1234{i:05d}\n10.0.0.{i % 250} é " for i in range(4000))
    docs = local_frame(spark, [(1, one), (2, mixed), (3, "é" * 1500 + " a1@b.c " + "日" * 1500)], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[1] == "<EMAIL> " * 40000
    assert masked[3] == "é" * 1500 + " <EMAIL> " + "日" * 1500
    want, end, out = sorted((a, b, k) for k, own in base(mixed).items() for a, b in own), 0, []
    for a, b, k in want:
        if a >= end:
            out += [mixed[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    assert masked[2] == "".join(out) + mixed[end:]


def test_overlaps_of_ordered_spans(spark):
    spans = [(3, 5), (5, 6), (9, 14)]
    rows = [(a, b) for a in range(0, 17) for b in range(a + 1, 18)]
    held = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    none = F.array().cast("array<struct<start:int,end:int>>")
    df = local_frame(spark, rows, "start int, end int").select("*", F.struct("start", "end").alias("m"))
    for r in df.select("start", "end", pii._overlaps(held, F.col("m")).alias("met"), pii._overlaps(none, F.col("m")).alias("no")).collect():
        assert r["met"] == any(a < r["end"] and b > r["start"] for a, b in spans) and r["no"] is False


def test_addresses_without_a_digit_are_seeds(spark):
    names = ["anna", "bert", "cora", "dirk", "emil", "fred", "gina", "hugo", "ines", "jens"]
    rows = [(i, f"write to the clerk at {n}@mail.example") for i, n in enumerate(names)] + [(50, "write to the clerk at q7x(at)mail.example")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(local_frame(spark, rows, "doc_id long, text string")).select("doc_id", pii.listed(True).alias("spans")).collect()}
    assert found[50] == "email:22:41"
    assert all(found[i] == f"email:22:{22 + len(n) + 13}" for i, n in enumerate(names))


def test_no_plan_of_the_graph_doubles_with_the_rounds(spark, monkeypatch):
    joins = []

    class Watched(pii.Scratch):
        def write(self, df, name):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
            return super().write(df, name)

    occurrences = local_frame(spark, [(1, "i", ["p", "q"], "email")], "doc_id long, instance string, patterns array<string>, seed string")
    pii.sure_patterns(occurrences, Watched(spark))
    assert max(joins) <= 2


def test_the_graph_at_hot_keys_equals_a_plain_one(spark, monkeypatch):
    """Every pattern and instance hot, or none: the same patterns; and the rounds restated in Python."""
    rows = []
    for i in range(60):
        seeded = i % 5 != 0
        rows.append((i, f"i{i % 23}", [f"p{i % 3}", f"q{i % 7}"], "email" if seeded else None))
    occurrences = local_frame(spark, rows, "doc_id long, instance string, patterns array<string>, seed string")
    got = []
    for share in (1, 1000):
        monkeypatch.setattr(pii, "HOT_SHARE", share)
        frame = pii.sure_patterns(occurrences, pii.Scratch(spark))
        got.append({r["pattern"]: (round(r["confidence"], 9), r["support"], r["kind"]) for r in frame.collect()})
    assert got[0] == got[1]
    n, seeded = {}, {}
    for _, x, patterns, seed in rows:
        for p in patterns:
            n[p, x] = n.get((p, x), 0) + 1
            seeded[p, x] = seeded.get((p, x), 0) + (seed is not None)
    sure = {e: seeded[e] / n[e] for e in n}

    def confidence():
        return {p: sum(n[e] * sure[e] for e in n if e[0] == p) / (sum(n[e] for e in n if e[0] == p) + pii.PRIOR) for p, _ in n}

    for _ in range(pii.ROUNDS):
        of = confidence()
        reached = {x: sum(n[e] * of[e[0]] for e in n if e[1] == x) / sum(n[e] for e in n if e[1] == x) for _, x in n}
        sure = {e: max(seeded[e] / n[e], reached[e[1]]) for e in n}
    want = {}
    for p, c in confidence().items():
        support = sum(e[0] == p and (seeded[e] > 0 or sure[e] >= pii.CONFIDENCE) for e in n)
        if c >= pii.CONFIDENCE and support >= pii.SUPPORT:
            want[p] = (round(c, 9), support, "email")
    assert want and got[1] == want
