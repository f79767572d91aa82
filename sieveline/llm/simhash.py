"""SimHash near-duplicates by multi-index hashing.

Texts are hashed to 64-bit fingerprints; fingerprints within `max_bits` differing bits are linked.
A fingerprint is cut into segments. By the pigeonhole principle two linked fingerprints agree up to
a small number of bits in at least one segment, so each fingerprint asks a table of segment values
for all values in a small Hamming ball around its own, and the matches' whole distance is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch, fresh, row_key, text_key
from sieveline.llm.components import components

#: Fingerprints in one segment bucket above which pairs are not enumerated.
CROWD = 32
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for a null, empty or blank one.

    Words are runs without ASCII white space, A-Z lower-cased; each shingle of `width` words,
    repeats included, votes with the bits of its XXH64 (seed 42). A bit needs over half the votes.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    rows = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _masks(width: int, bits: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(width), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]):
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _segment(at: int, ones: int):
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(_signed(ones)).cast("long"))


def _ball(s: int, value, masks: list[int]):
    """Keys of segment `s` around `value`, for masks whose lowest bit is unset in it."""
    pairs = F.array(
        *[F.struct(F.lit(_signed(m)).cast("long").alias("m"), F.lit(_signed(m & -m)).cast("long").alias("low")) for m in masks]
    )
    sent = F.filter(pairs, lambda x: value.bitwiseAND(x["low"]) == 0)
    return F.transform(sent, lambda x: F.struct(F.lit(s).alias("s"), value.bitwiseXOR(x["m"]).alias("v")))


def links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(src, dst) links that connect all distinct `fp` within `max_bits` of each other.

    The first (max_bits mod segments) + 1 segments are probed with balls of max_bits // segments
    bits, the others with one bit less. Of a ball only the masks whose lowest bit is unset in the
    value are sent, since the partner sends the others.

    A bucket with more than CROWD fingerprints is not enumerated. Fingerprints that hold or probe
    such a bucket send the ball of half the distance around their whole value; two of them meet
    under a common centre exactly if they are linked, and a centre has at most as many members as
    its ball, so that connecting them to the least one (for an odd distance: verified pairs)
    keeps every link without pairs of a crowd.
    """
    width = 64 // segments
    extra = 64 - width * segments
    rows = []
    for s in range(segments):
        radius = max_bits // segments - (s > max_bits % segments)
        if radius >= 0:
            w = width + (extra if s == segments - 1 else 0)
            rows.append((s, s * width, (1 << w) - 1, radius, w))
    held = F.array(*[F.struct(F.lit(s).alias("s"), _segment(at, ones).alias("v")) for s, at, ones, _, _ in rows])
    asked = [_ball(s, _segment(at, ones), _masks(w, radius)) for s, at, ones, radius, w in rows]
    table = fps.select("fp", F.explode(held).alias("k")).select("fp", "k.s", "k.v")
    probes = fps.select(F.col("fp").alias("probe"), F.explode(F.concat(*asked)).alias("k")).select("probe", "k.s", "k.v")
    crowds = table.groupBy("s", "v").count().where(F.col("count") > CROWD).select("s", "v")
    crowds, crowd_path = scratch.write(crowds, "crowds")

    found = (
        probes.join(table.join(crowds, ["s", "v"], "left_anti"), ["s", "v"])
        .where("probe <> fp")
        .where(F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= max_bits)
        .select(F.least("probe", "fp").alias("src"), F.greatest("probe", "fp").alias("dst"))
    )
    touching = (
        probes.join(crowds, ["s", "v"], "left_semi").select(F.col("probe").alias("fp"))
        .union(table.join(crowds, ["s", "v"], "left_semi").select("fp"))
        .distinct()
    )
    ball = _longs(_masks(64, (max_bits + 1) // 2))
    centres = (
        touching.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
        .groupBy("centre")
        .agg(F.array_sort(F.collect_list("fp")).alias("near"))
        .where(F.size("near") > 1)
    )
    if max_bits % 2 == 0:
        crowded = centres.select(F.col("near")[0].alias("src"), F.explode(F.slice("near", 2, 1 << 30)).alias("dst"))
    else:
        crowded = centres.select("near", F.explode("near").alias("src")).select("src", F.explode("near").alias("dst"))
        crowded = crowded.where("src < dst").where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
    out, _ = scratch.write(found.union(crowded.distinct()), "links")
    scratch.drop(crowd_path)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, component_id, component) for every row of `docs` (doc_id, text, others unused).

    component_id is the least doc_id reachable over links, component a fingerprint of the component
    that no other has, also where ids are null or repeated. Null, empty and blank texts have
    fingerprint 0 and are linked like any other. Equal fingerprints are one node, so copies never
    form pairs. A component whose ids are all null has a null component_id. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    prints, _ = scratch.write(fingerprints(docs, width), "prints")
    classes, _ = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = links(classes.select("fp"), scratch, max_bits, segments)
    labels = components(linked, scratch).withColumnRenamed("node", "fp")
    joined = classes.join(labels, "fp")
    firsts = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    merged = joined.join(firsts, "label").select("fp", "component_id", "label")
    of_class = classes.join(merged, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("label", "fp").alias("component")
    )
    of_class, _ = scratch.write(of_class, "of_class")
    return prints.join(of_class, "fp").select("doc_id", "text_key", "fp", "component_id", "component")


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """One row of `docs` per component, one with the component's least doc_id, with all columns.

    Of several texts of that id the one with the least text_key stays, of its repeated rows one.
    Rows without an id have no place in that order and go unless all rows of the component have
    none. An id stays once per component that it is the least of.
    """
    found = near_duplicates(docs, width, max_bits, segments)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = found.where(first).groupBy("component", "component_id", "text_key").count()
    kept = kept.groupBy("component", "component_id").agg(F.min(F.struct("text_key", "count")).alias("k"))
    id_, key, n = fresh(docs, "id", "key", "n")
    kept = kept.select(F.col("component_id").alias(id_), F.col("k.text_key").alias(key), F.col("k.count").alias(n))
    kept, _ = Scratch(docs.sparkSession).write(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    if kept.where(F.col(n) > 1).isEmpty():
        return docs.join(kept, same, "left_semi")
    alone = docs.join(kept.where(F.col(n) == 1), same, "left_semi")
    return alone.unionByName(docs.join(kept.where(F.col(n) > 1), same, "left_semi").dropDuplicates(["doc_id", "text"]))
