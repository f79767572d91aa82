"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from sieveline.llm import decontaminate, pii
from tests.llm.test_decontaminate import spans
from tests.llm.test_pii import base
from tests.llm.test_quality import base as quality_base
from tests.llm.test_simhash import grouped, plain_print


def masked(text, found):
    out, end = [], 0
    for start, stop, kind in found:
        out += [text[end:start], f"<{kind.upper()}>"]
        end = stop
    return "".join(out) + text[end:]


def test_stages_and_run(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [spans(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # this table has too few labels for a cutoff, so the base rules decide
    kept = {i: t for i, t in docs.items() if not quality_base(t)[-1]}
    prints = [(i, plain_print(t)) for i, t in kept.items()]
    kept = {i: kept[i] for (i, _), g in zip(prints, grouped(prints, 2)) if i == g}
    for i in list(kept):
        have = spans(kept[i])
        if any(w and len(w.keys() & have.keys()) >= decontaminate.SIMILARITY * len(w) for w in items):
            del kept[i]
    want = {}
    for i, t in kept.items():
        merged = []
        for start, stop, kind in sorted((a, b, k) for k, own in base(t).items() for a, b in own):
            if merged and start < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]), merged[-1][2])
            else:
                merged.append((start, stop, kind))
        want[i] = masked(t, merged)

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = frame.columns
        frame = stage(spark, frame, sf)
        assert frame.columns == columns
    got = {r["doc_id"]: r["text"] for r in frame.collect()}
    secret = f"<{pii.SECRET.upper()}>"
    assert got.keys() == want.keys()
    assert all(t == want[i] or secret in t for i, t in got.items())

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in got.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == sizes[r["doc_id"]]
    assert total == sizes
