"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are what fixed rules accept: e-mail addresses, IPv4 addresses, card numbers that pass Luhn,
phone numbers, and quoted hexadecimal secrets. Every word with a digit or an @ is an instance, so
whatever a rule accepts lies in one; the words around it are its lexical patterns. Pattern and instance counts form a bipartite graph over the
whole corpus. Starting from the seeds, confidence flows from instances to the patterns they stand
in and back for a fixed number of rounds; a pattern that is sure enough and rests on enough
different sure instances then marks whatever stands in it, seen by the rules or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch, fresh, let, row_key, text_key

# The rules by kind, in order. Loops are possessive and a match starts where a run of
# its characters starts or where the match before ended; neither changes what is found, and both
# keep the time linear and the stack flat on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
RULES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Kind of what is known from its context and from no rule of its own.
SECRET = "secret"
SECRET_SEED = r"^[\"'][0-9a-f]{32,}[\"']"
_WORD = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"

ROUNDS = 3
#: A pattern's confidence is its sure occurrences over all of them plus this.
PRIOR = 1.0
CONFIDENCE = 0.8
#: Different sure instances a pattern must rest on.
SUPPORT = 5
CONTEXT_CHARS = 80
#: A pattern or instance with over 1/HOT_SHARE of the graph's edges is looked up by broadcast.
HOT_SHARE = 1000
_BLOCK = 64
_TEXT_BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, before, after) of the matches of `pattern`, in code points.

    before and after are the text between a match and its neighbours. The starts are running sums
    of lengths, in two levels so that their cost stays close to linear.
    """

    def placed(hits: Column, parts: Column) -> Column:
        n = F.size(hits)
        widths = F.transform(hits, lambda h, i: F.length(F.get(parts, i)) + F.length(h))

        def located(widths: Column) -> Column:
            add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
            blocks = F.aggregate(
                F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                F.array(F.lit(0)),
                lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + add(F.slice(widths, b * _BLOCK + 1, F.lit(_BLOCK))))),
            )

            def spans(blocks: Column) -> Column:
                def one(h: Column, i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    left = F.get(blocks, block) + add(F.slice(widths, block * _BLOCK + 1, i % _BLOCK))
                    start = left + F.length(F.get(parts, i))
                    return F.struct(
                        start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"),
                        F.get(parts, i).alias("before"), F.get(parts, i + 1).alias("after"),
                    )

                return F.transform(hits, one)

            return let(blocks, spans)

        return let(widths, located)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    found = let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda p: placed(h, p))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, is divisible by ten."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)))
    total = F.aggregate(places, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def _accepted(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        low = lambda p: F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255
        return F.forall(F.split(hit, r"\."), lambda p: part(p) & low(p))
    if kind == "card":
        return let(_digits(hit), lambda d: F.length(d).between(13, 19) & _luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, RULES[kind]), lambda m: _accepted(kind, m["hit"]))
    found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    needs = NEEDS[kind]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(none)


def _context(instances: Column) -> Column:
    """Instances with the patterns `left two words` and `left word, right word`, digits written 9."""

    def plain(words: Column) -> Column:
        return F.regexp_replace(F.lower(words), "[0-9]", "9")

    def one(m: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get(instances, i - 1)["hit"]).otherwise("")
        left = F.concat(F.right(previous, F.lit(CONTEXT_CHARS)), F.right(m["before"], F.lit(CONTEXT_CHARS)))
        following = F.coalesce(F.get(instances, i + 1)["hit"], F.lit(""))
        right = F.concat(F.left(m["after"], F.lit(CONTEXT_CHARS)), F.left(following, F.lit(CONTEXT_CHARS)))
        words = F.filter(F.split(plain(left), r"\s+"), lambda w: w != "")
        last = F.filter(F.split(plain(right), r"\s+"), lambda w: w != "")
        two = let(words, lambda w: F.concat_ws(" ", F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2))))
        near = F.concat_ws(" ", F.coalesce(F.get(words, F.size(words) - 1), F.lit("")), F.lit("_"), F.coalesce(F.get(last, F.lit(0)), F.lit("")))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"), two.alias("left"), near.alias("near"))

    return F.transform(instances, one)


def entities(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): base spans by kind, and instances with their context.

    Columns: doc_id, text_key, one array per kind, instances. A null text has none of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*row_key(), text.alias("_t"))
    some = F.regexp_like("_t", F.lit("[0-9@]"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string,left:string,near:string>>")
    return rows.select(
        "doc_id",
        "text_key",
        *[_base(F.col("_t"), kind).alias(kind) for kind in RULES],
        F.when(some, let(matches(F.col("_t"), _WORD), _context)).otherwise(none).alias("instances"),
    )


def _place(spans: Column, below: Callable[[Column], Column]) -> Column:
    """How many spans satisfy `below`, which no span does after one that does not: halving, so that
    texts with many spans stay close to linear."""

    def halve(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["lo"] + range_["hi"]) / 2).cast("int")
        step = lambda m: F.when(below(F.get(spans, m)), F.struct((m + 1).alias("lo"), range_["hi"].alias("hi")))
        return let(middle, lambda m: step(m).otherwise(F.struct(range_["lo"].alias("lo"), m.alias("hi"))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve)["lo"]


def _overlaps(spans: Column, m: Column) -> Column:
    """Whether one of the ordered, disjoint spans shares a place with `m`."""
    first = F.get(spans, _place(spans, lambda s: s["end"] <= m["start"]))
    return (F.size(spans) > 0) & F.coalesce(first["start"] < m["end"], F.lit(False))


def _occurrences(found: DataFrame) -> DataFrame:
    """Each instance of each row with the kind that seeds it (null: none) and its span.

    Seeds are found before the instances become rows, so no row carries its text's span arrays.
    An instance is named by its md5.
    """

    def seeded(m: Column) -> Column:
        kinds = [F.when(_overlaps(F.col(kind), m), F.lit(kind)) for kind in RULES]
        seed = F.coalesce(*kinds, F.when(F.regexp_like(m["hit"], F.lit(SECRET_SEED)), F.lit(SECRET)))
        return F.struct(*[m[c].alias(c) for c in ("start", "end", "hit", "left", "near")], seed.alias("seed"))

    rows = found.select("doc_id", "text_key", F.explode(F.transform("instances", seeded)).alias("m"))
    hit = F.col("m.hit")
    lead = F.length(F.regexp_extract(hit, r"^[^\p{L}\p{N}+]*+", 0))
    tail = F.length(F.regexp_extract(hit, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", 0))
    return rows.select(
        "doc_id",
        "text_key",
        F.md5(hit).alias("instance"),
        F.array("m.left", "m.near").alias("patterns"),
        F.col("m.seed").alias("seed"),
        (F.col("m.start") + lead).alias("start"),
        (F.col("m.end") - tail).alias("end"),
    )


def _looked_up(edges: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """`edges` with the value of their `key`; hot keys, fewer than HOT_SHARE, come by broadcast."""
    hot = F.col(f"hot_{key}")
    rare = edges.where(~hot).join(values.where(~hot).drop(f"hot_{key}"), key)
    return rare.unionByName(edges.where(hot).join(F.broadcast(values.where(hot).drop(f"hot_{key}")), key))


def sure_patterns(occurrences: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, confidence, support, kind) of the patterns that may mark instances.

    The graph holds counts per (pattern, instance), summed before the shuffle. A pattern with many
    instances, or an instance in many patterns, is summed in part before each shuffle and gets its
    value by broadcast. A seeded instance has confidence 1 throughout; another gets the mean of its
    patterns, weighted by how often it stands in each. Support counts the instances that a rule
    seeds and those that the rounds made as sure as a pattern must be.
    """
    edges = (
        occurrences.select(F.explode("patterns").alias("pattern"), "instance", "seed")
        .groupBy("pattern", "instance")
        .agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeded"), F.min("seed").alias("kind"))
    )
    counted, counted_path = scratch.write(edges, "pii-counts")
    n_edges = counted.count()
    marked = counted
    for key in ("pattern", "instance"):
        # fewer than HOT_SHARE keys can have more than that share of the edges each
        hot = counted.groupBy(key).count().where(F.col("count") * HOT_SHARE > n_edges).select(key, F.lit(True).alias("hot"))
        marked = marked.join(F.broadcast(hot), key, "left").withColumn(f"hot_{key}", F.coalesce("hot", F.lit(False))).drop("hot")
    edges, path = scratch.write(marked, "pii-graph")
    scratch.drop(counted_path)
    score = edges.withColumn("sure", F.col("seeded") / F.col("n"))
    flow_path = None
    for _ in range(ROUNDS):
        # a lookup names its values twice, so a plan that went on through the rounds would double with each
        patterns = score.groupBy("pattern", "hot_pattern").agg(
            (F.sum(F.col("n") * F.col("sure")) / (F.sum("n") + PRIOR)).alias("confidence")
        )
        patterns, patterns_path = scratch.write(patterns, "pii-confidence")
        if flow_path:
            scratch.drop(flow_path)
        flow = _looked_up(edges, patterns, "pattern").groupBy("instance", "hot_instance").agg(
            (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("reached")
        )
        flow, flow_path = scratch.write(flow, "pii-reached")
        scratch.drop(patterns_path)
        score = _looked_up(edges, flow, "instance").withColumn("sure", F.greatest(F.col("seeded") / F.col("n"), "reached"))
    known = (F.col("seeded") > 0) | (F.col("sure") >= CONFIDENCE)
    patterns = (
        score.groupBy("pattern")
        .agg(
            (F.sum(F.col("n") * F.col("sure")) / (F.sum("n") + PRIOR)).alias("confidence"),
            F.count_if(known).alias("support"),
            F.mode("kind").alias("kind"),
        )
        .where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
    )
    patterns, _ = scratch.write(patterns, "pii-patterns")
    scratch.drop(path, *[flow_path] if flow_path else [])
    return patterns


def discovered(occurrences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, text_key, more): spans (kind, start, end) that only their context gives away.

    An instance that a base span overlaps is known already; secrets have no base rule, so seeded
    ones are listed too.
    """
    open_ = occurrences.where(F.col("seed").isNull() | (F.col("seed") == SECRET))
    by_context = open_.withColumn("pattern", F.explode("patterns")).join(patterns.select("pattern", F.col("kind").alias("found")), "pattern")
    seeds = open_.where(F.col("seed").isNotNull()).withColumn("found", F.lit(SECRET))
    columns = ["doc_id", "text_key", "found", "start", "end"]
    spans = by_context.select(*columns).union(seeds.select(*columns)).where("start < end")
    one = spans.groupBy("doc_id", "text_key", "start", "end").agg(F.min("found").alias("kind"))
    return one.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, one array of (start, end) per base kind, more) per row of `docs`.

    `more` holds the discovered (kind, start, end), null if none. Null and empty texts have no
    spans; repeated rows are found alike. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    found, _ = scratch.write(entities(docs), "pii-entities")
    some = found.where(F.size("instances") > 0).dropDuplicates(["doc_id", "text_key"])
    occurrences, path = scratch.write(_occurrences(some), "pii-occurrences")
    more, _ = scratch.write(discovered(occurrences, sure_patterns(occurrences, scratch)), "pii-more")
    scratch.drop(path)
    other = more.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "more")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    return found.drop("instances").join(other, same, "left").drop("_id", "_key")


KINDS = (*RULES, SECRET)


def listed(with_more: bool) -> Column:
    """The row's spans as kind:start:end, by kind as listed and then start, comma-joined."""
    arrays = []
    for kind in KINDS:
        base = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) if kind in RULES else None
        extra = F.filter(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")), _is_kind(kind))
        extra = F.transform(extra, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        own = [a for a in (base, extra if with_more else None) if a is not None]
        if own:
            arrays.append(F.transform(F.array_sort(F.concat(*own)), _spelled(kind)))
    return F.array_join(F.concat(*arrays), ",")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _spelled(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def _joined(blocks: Column, start: Column, end: Column) -> Column:
    """The text from `start` to `end`, from the blocks that hold it."""
    first = F.floor(start / _TEXT_BLOCK).cast("int")
    held = F.slice(blocks, first + 1, F.floor(end / _TEXT_BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(held, ""), start % _TEXT_BLOCK + 1, end - start)


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with each stretch of found spans replaced by its first kind, as <EMAIL>.

    n_chars, if there, becomes the new length. Spans that overlap are one stretch. Rows
    meet their spans by id and text, so repeated rows are masked alike.
    """
    found = find(docs)
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    arrays = [F.transform(kind, _with_kind(kind)) for kind in RULES]
    arrays.append(F.array_sort(F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    names = [f"s{i}" for i in range(len(arrays))]  # the spans of one name are ordered and disjoint
    spans = found.select("doc_id", "text_key", *[a.alias(n) for a, n in zip(arrays, names)])
    spans = spans.select("*", F.array_sort(F.concat(*names)).alias("spans")).where(F.size("spans") > 0)

    def reach(start: Column) -> Column:
        """Where the spans before `start` end."""
        ends = [F.coalesce(F.get(n, _place(F.col(n), lambda s: s["start"] < start) - 1)["end"], F.lit(0)) for n in names]
        return F.greatest(*ends)

    def placed(s: Column, i: Column) -> Column:
        again = (i > 0) & (F.get("spans", i - 1)["start"] == s["start"])
        return F.struct(reach(s["start"]).alias("after"), s["start"].alias("start"), s["kind"].alias("kind"), again.alias("again"))

    stretches = F.filter(F.transform("spans", placed), lambda s: ~s["again"] & (s["start"] >= s["after"]))
    ends = F.greatest(*[F.coalesce(F.get(n, F.size(n) - 1)["end"], F.lit(0)) for n in names])
    id_, key, marks = fresh(docs, "id", "key", "marks")
    found_marks = spans.select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.struct(stretches.alias("stretches"), ends.alias("end")).alias(marks)
    ).dropDuplicates([id_, key])
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))

    def rewritten(blocks: Column) -> Column:
        pieces = F.transform(
            F.col(marks)["stretches"],
            lambda s: F.concat(_joined(blocks, s["after"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
        )
        return F.concat(F.array_join(pieces, ""), _joined(blocks, F.col(marks)["end"], F.length("text")))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}+"), F.lit(0))
    masked = F.when(F.col(marks).isNotNull(), let(blocks, rewritten)).otherwise(F.col("text"))
    out = docs.join(found_marks, same, "left").withColumn("text", masked)
    if "n_chars" in docs.columns:
        length = F.when(F.col(marks).isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.drop(id_, key, marks)


def _with_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
