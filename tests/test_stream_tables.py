"""Streams over a table by name, which is one file or a folder of files."""

import pytest

from sieveline.streaming import flows


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["events.parquet", "even*.parquet"])
def test_named_table_is_read_whole(spark, tmp_path, files, name):
    table, folder = spark.range(30).withColumnRenamed("id", "event_id"), tmp_path / "tables"
    table.repartition(files).write.parquet(str(folder / "events.parquet"))
    table.write.parquet(str(folder / "events.parquet.old"))
    if files == 1:  # the same table as a bare file
        (part,) = (folder / "events.parquet").glob("part-*")
        folder = tmp_path / "bare"
        folder.mkdir()
        part.rename(folder / "events.parquet")
    out = str(tmp_path / "out")
    stream = flows.file_stream(spark, str(folder), table.schema, name=name)
    flows.score_stream(stream, lambda rows: rows, path=out, checkpoint=str(tmp_path / "state"), by_batch=True).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(30))
