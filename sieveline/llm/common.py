"""What the corpus operators share: tables, written stages, row keys, let-bound expressions."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import scratch_path, ship_package

#: Separators of words, as a Java character class (fixed values).
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables under the shared folder, with an owner that can drop those no longer needed.

    A result that is returned lazily keeps the tables it reads; the others go with `drop`,
    and Spark's shuffle files go once nothing on the driver refers to them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship_package(spark)

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)

    def release(self) -> None:
        """Let Spark's cleaner take the shuffle files of finished jobs."""
        gc.collect()
        self.spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_key(text: str = "text") -> Column:
    """Hash of a text, by which rows of one id are told apart; a null text has one as well."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def row_key(text: str = "text") -> list[Column]:
    """Columns under which rows with the same id and the same text meet."""
    return [F.col("doc_id"), text_key(text).alias("text_key")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of `names` that `df` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod
