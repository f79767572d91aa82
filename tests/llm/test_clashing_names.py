"""Filtering stages over tables whose other columns have names that the stages could use inside."""

import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, pii, quality, simhash
from sieveline.session import local_frame

NAMES = ["_id", "_key", "_s", "_n", "id", "KEY", "marks", "n", "component", "text_key", "window", "spans", "stratum", "kept", "more", "email", "_t", "_row"]
TEXT = "one two three four five six seven eight nine ten eleven a1@b.c and more words of the text"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en", 88), (1, TEXT, "en", 88), (2, TEXT, "en", 88), (None, "", None, 0), (3, None, "en", None)]
    df = local_frame(spark, rows, "doc_id long, text string, lang string, n_chars long")
    return df.select("*", *[F.lit(n).alias(n) for n in NAMES])


def stages(spark):
    benchmark = local_frame(spark, [(7, TEXT)], "item_id long, text string")
    labels = local_frame(spark, [], "doc_id long, quality int, toxic int")
    return {
        "keep_one": lambda d: simhash.keep_one(d),
        "clean": lambda d: decontaminate.clean(d, benchmark),
        "mask": pii.mask,
        "filter": lambda d: quality.filter_documents(d, labels),
    }


@pytest.mark.parametrize("name, kept", [("keep_one", 2), ("clean", 2), ("mask", 5), ("filter", 3)])
def test_columns_and_rows(spark, docs, name, kept):
    out = stages(spark)[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == kept and all(r[n] == n for r in rows for n in NAMES)
    assert stages(spark)[name](docs.limit(0)).count() == 0
