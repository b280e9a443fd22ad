from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tomeloom.sources import tables


def write(folder, files, groups, rows=4000):
    rng = random.Random(1)
    folder.mkdir()
    for k in range(files):
        table = pa.table({"doc_id": list(range(rows)), "text": ["".join(rng.choices("abcdefghij", k=3000)) for _ in range(rows)]})
        pq.write_table(table, folder / f"{k}.parquet", row_group_size=rows // groups)
    return str(folder)


def shuffles(df):
    return "Exchange RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_spread_by_row_groups_and_bytes(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    many = spark.read.parquet(write(tmp_path / "many", 2, 8))
    assert len(many.inputFiles()) < cores and tables.row_groups(spark, many.inputFiles()) == 16
    assert not shuffles(tables.spread(many))
    few = spark.read.parquet(write(tmp_path / "few", 1, 1))
    assert shuffles(tables.spread(few)) and tables.spread(few).count() == few.count()
    monkeypatch.setattr(tables, "SPLIT_BYTES", 1000)  # as a table of so many bytes for each core
    assert not shuffles(tables.spread(few))
    many_files = spark.read.parquet(write(tmp_path / "files", cores + 1, 1, 1500))
    assert not shuffles(tables.spread(many_files))
    assert tables.spread(spark.range(10, numPartitions=1)).count() == 10
