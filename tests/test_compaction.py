from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.jobs import main
from wardline.session import scratch_path
from wardline.sources import compaction
from wardline.sources.compaction import compact, files, manifest, read
from wardline.streaming.runs import write_stream


def made(spark, first, last):
    return spark.range(first, last).selectExpr(
        "CASE WHEN id % 11 = 0 THEN NULL ELSE timestamp_seconds(1700000000 + id * 60) END AS at",
        "CASE WHEN id % 13 = 0 THEN NULL ELSE lpad(CAST(pmod(hash(id), 997) AS STRING), 4, '0') END AS id", "CAST(id AS DOUBLE) AS amount")


class Running:
    """A stream that appends what arrives to a table, batch by batch."""

    def __init__(self, spark):
        self.root = scratch_path(spark, "test-compaction")
        self.path, self.store = f"{self.root}/table", f"{self.root}/store"
        self.rows = made(spark, 0, 0)
        self.schema = self.rows.schema

    def append(self, rows, files=6):
        rows.repartition(files).write.mode("append").parquet(f"{self.root}/arriving")
        stream = rows.sparkSession.readStream.schema(self.schema).option("maxFilesPerTrigger", 2).parquet(f"{self.root}/arriving")
        write_stream(stream, self.path, f"{self.root}/checkpoint", every=None).awaitTermination()
        self.rows = self.rows.union(rows)

    def whole(self, spark):
        found = read(spark, self.path, self.store, self.schema)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, self.rows.collect()))
        return found


def test_a_stream_writes_on_and_nothing_is_lost(spark):
    table = Running(spark)
    table.append(made(spark, 0, 500))
    started = table.whole(spark)
    many = len(started.inputFiles())
    assert many > 3 and compact(spark, table.path, table.store, table.schema, ["at", "id"]) == 1
    assert len(table.whole(spark).inputFiles()) == 1
    assert started.count() == 500  # a reader from before the swap goes on
    table.append(made(spark, 500, 900))
    table.append(made(spark, 0, 50))  # repeated rows stay repeated
    assert len(table.whole(spark).inputFiles()) > 1
    assert compact(spark, table.path, table.store, table.schema, ["at", "id"]) == 2
    assert len(table.whole(spark).inputFiles()) == 1
    assert compact(spark, table.path, table.store, table.schema, ["at", "id"]) == 2  # nothing small is left to gather
    assert spark.read.parquet(table.path).count() == 950  # the stream's own files are untouched


def test_large_files_stay(spark):
    table = Running(spark)
    table.append(made(spark, 0, 20_000), files=1)
    table.append(made(spark, 20_000, 20_100), files=4)
    large, = [r["path"] for r in files(spark, table.path).collect() if r["length"] > 50_000]
    assert compact(spark, table.path, table.store, table.schema, ["at"], target=100_000) == 1
    now = {r["path"]: r["taken"] for r in manifest(spark, table.store)[1].collect()}
    assert now[large] is False and sum(now.values()) >= 2
    table.whole(spark)


def test_a_compaction_that_died_before_the_swap(spark, monkeypatch):
    table = Running(spark)
    table.append(made(spark, 0, 300))

    def dies(spark, path):
        if "/data/" in path:
            raise RuntimeError("lost")
        return files(spark, path)

    monkeypatch.setattr(compaction, "files", dies)
    with pytest.raises(RuntimeError):
        compact(spark, table.path, table.store, table.schema, ["at", "id"])
    assert manifest(spark, table.store)[0] == 0
    table.whole(spark)
    monkeypatch.undo()
    assert compact(spark, table.path, table.store, table.schema, ["at", "id"]) == 1
    table.whole(spark)


def test_files_can_be_skipped_on_either_column(spark):
    table = Running(spark)
    table.rows = made(spark, 0, 20_000).where("at IS NOT NULL AND id IS NOT NULL")
    table.rows.repartition(60).write.parquet(table.path)
    size = sum(r["length"] for r in files(spark, table.path).collect())
    compact(spark, table.path, table.store, table.schema, ["at", "id"], target=size // 16)
    rows = table.whole(spark)
    spans = rows.groupBy(F.input_file_name()).agg(*[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("at", "id")]).collect()
    assert len(spans) >= 12
    middle = rows.agg(F.percentile_approx(F.unix_seconds("at"), 0.3).alias("at"), F.percentile_approx(F.col("id").cast("int"), 0.3).alias("id")).first()
    on_time = [s for s in spans if s["minat"].timestamp() <= middle["at"] <= s["maxat"].timestamp()]
    on_id = [s for s in spans if int(s["minid"]) <= middle["id"] <= int(s["maxid"])]
    assert 0 < len(on_time) <= 0.6 * len(spans) and 0 < len(on_id) <= 0.6 * len(spans)


def test_empty_table_and_unknown_table(spark, capsys):
    table = Running(spark)
    table.append(made(spark, 0, 0), files=1)
    assert compact(spark, table.path, table.store, table.schema, ["at", "id"]) in (0, 1)
    assert table.whole(spark).count() == 0
    with pytest.raises(SystemExit):
        main(["compact", "--checkpoint", "/x", "--out", "/y", "--table", "nothing"])
    assert "compact needs --table" in capsys.readouterr().err
