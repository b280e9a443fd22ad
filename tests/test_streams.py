from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomeloom.streaming import tasks

SCHEMA = "task_id long, at timestamp, seq long, kind string, stage string"
START = datetime(2024, 1, 1)


def log(rng, n, tasks_n=12):
    """Events of several tasks, with a bias to sensible orders, minutes to hours apart."""
    out, at = [], START
    for i in range(n):
        at += timedelta(minutes=rng.randint(1, 40), microseconds=rng.randint(0, 999_999))
        kind = rng.choice([*tasks.KINDS, "create", "claim", "claim", "stage", None])
        out.append((rng.randint(0, tasks_n - 1), at, i, kind, rng.choice(["distill", "export", None])))
    return out


def plain(rows):
    return sorted((r.task_id, r["at"], r.status, r.stage, r.cancel_requested, r.delete_requested) for r in rows)


def test_fold_in_columns_equals_the_rule_in_python(spark):
    rng = random.Random(1)
    rows = log(rng, 600)
    for lease in (timedelta(hours=3), timedelta(days=30)):
        until = rows[-1][1] + timedelta(hours=1)
        life, expected = tasks.TaskLife(lease), {}
        for t, at, _, kind, stage in rows:
            micros = int((at - datetime(1970, 1, 1)) / timedelta(microseconds=1))
            expected[t] = tasks.applied(life._lapsed(expected.get(t, (0, tasks.GONE, "", False, False)), micros), micros, kind or "", stage or "")
        end = int((until - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        expected = {t: life._lapsed(s, end) for t, s in expected.items()}
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = tasks.states(df, lease, F.lit(until)).withColumn("at", F.unix_micros("at")).collect()
        assert plain(got) == sorted((t, *s) for t, s in expected.items() if s[1] != tasks.GONE)
    assert len({s[1] for s in expected.values()}) >= 3
    assert tasks.states(df.where("false")).count() == 0


def test_every_transition(spark):
    at = lambda k: START + timedelta(minutes=k)
    lives = {
        "pending queued": ["create"], "running prune": ["create", "claim"], "running distill": ["create", "claim", "stage"], "cancelled cancelled": ["create", "cancel"],
        "cancelled cancelled again": ["create", "claim", "cancel", "recover"], "pending resume": ["create", "claim", "recover"], "cancelled cancelled at end": ["create", "claim", "cancel", "done"],
        "done done": ["create", "claim", "done", "retry"], "error error": ["create", "claim", "error"], "pending queued anew": ["create", "claim", "error", "retry"], "running deleting": ["create", "claim", "delete", "stage"],
    }
    gone = [["create", "delete"], ["create", "claim", "delete", "done"], ["create", "claim", "delete", "recover"], ["claim"], ["create", "cancel", "delete", "retry"]]
    rows = [(i, at(k), k, kind, "distill") for i, kinds in enumerate([*lives.values(), *gone]) for k, kind in enumerate(kinds)]
    got = {r.task_id: f"{r.status} {r.stage}" for r in tasks.states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: " ".join(name.split()[:2]) for i, name in enumerate(lives)}


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_stream_of_states_equals_the_fold_after_a_restart(spark, tmp_path):
    tasks.use_rocksdb(spark)
    rng = random.Random(2)
    rows, lease = log(rng, 260, 6), timedelta(hours=5)
    late = list(rows)
    for k in range(0, len(late) - 3, 7):  # out of order, but within the watermark's delay
        late[k], late[k + 2] = late[k + 2], late[k]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        q = tasks.kept(tasks.live_states(stream, lease, "4 hours"), out, checkpoint)
        q.awaitTermination()

    def expected(upto):
        mark = max(r[1] for r in upto) - timedelta(hours=4)
        mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
        passed = spark.createDataFrame([r for r in upto if r[1] <= mark], SCHEMA)
        return plain(tasks.states(passed, lease, F.lit(mark)).collect())

    for part in (slice(0, 130), slice(130, 260)):  # the second run is a restart from the checkpoint
        write(spark, late[part], folder, f"part{part.start}")
        run()
        got = tasks.latest(spark, out, "task_id").where(F.col("status") != tasks.GONE).collect()
        assert plain(got) == expected(late[: part.stop])
    write(spark, [late[0]], folder, "late")  # far behind the watermark: dropped
    run()
    assert plain(tasks.latest(spark, out, "task_id").where(F.col("status") != tasks.GONE).collect()) == expected(late)


def test_repeated_requests_within_the_watermark(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    schema = "book_id long, request string, at timestamp"
    first = [(1, "a", at(0)), (2, "b", at(5)), (1, "a", at(20)), (3, "c", at(30))]
    second = [(2, "b", at(40)), (1, "a", at(50)), (1, "z", at(51)), (4, "d", at(400))]  # repeats across the restart
    third = [(1, "a", at(3)), (4, "d", at(410)), (5, "e", at(420))]  # the first is later than the watermark
    folder, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    seen = []
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        once = tasks.requests_once(stream, ["book_id", "request"])
        once.writeStream.foreachBatch(tasks.batch_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        seen += rows
    got = sorted((r.book_id, r.request) for r in spark.read.parquet(out).collect())
    batch = tasks.first_requests(spark.createDataFrame([r for r in seen if r not in third[:1]], schema), ["book_id", "request"]).collect()
    assert got == sorted((r.book_id, r.request) for r in batch) == [(1, "a"), (1, "z"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_a_batch_that_fails_half_way_counts_once(spark, tmp_path):
    schema, folder, out, checkpoint = "unit_id long, text string", *(str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([(i, f"t{i}") for i in range(40)], schema).repartition(4).write.parquet(folder)
    marker = tmp_path / "failed once"

    def condense(rows):
        def work(batches):
            for batch in batches:
                yield batch
                if any(i == 17 for i in batch.column("unit_id").to_pylist()) and not marker.exists():
                    marker.touch()
                    raise ValueError("half way")

        return rows.select("unit_id", F.upper("text").alias("output")).mapInArrow(work, "unit_id long, output string")

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        return stream.writeStream.foreachBatch(tasks.batch_writer(out, condense)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    retries = spark.conf.get("spark.task.maxFailures", "1")
    assert retries in ("1", "4")
    with pytest.raises(Exception, match="half way"):
        run().awaitTermination()
    run().awaitTermination()
    spark.createDataFrame([(3, "again")], schema).write.mode("append").parquet(folder)
    run().awaitTermination()
    got = {r.unit_id: r.output for r in tasks.latest(spark, out, "unit_id").collect()}
    assert got == {i: "AGAIN" if i == 3 else f"T{i}" for i in range(40)} and spark.read.parquet(out).count() == 41
