"""Long work under control: its progress as metrics of the running plan, and a stop that keeps what is finished."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.store import Runs


def observed(outputs: DataFrame, name: str = "condensing") -> tuple[DataFrame, Observation]:
    """outputs (attempts, error, output) with an observation of chunks, failed, calls and chars.

    The numbers are counted by the job that writes or reads the frame, and are there when it ends;
    they take no pass of their own. A job that is run again for a lost executor counts once.
    """
    watched = Observation(name)
    sums = {"chunks": F.count(F.lit(1)), "failed": F.count_if(F.col("error") != ""), "calls": F.coalesce(F.sum("attempts"), F.lit(0)), "chars": F.coalesce(F.sum(F.length("output")), F.lit(0))}
    return outputs.observe(watched, *[c.cast("long").alias(n) for n, c in sums.items()]), watched


def work_in_batches(
    chunks: DataFrame,
    condense: Callable[[DataFrame], DataFrame],
    done: Runs,
    stop: Callable[[], bool],
    batches: int,
    tag: str = "condensing",
    told: Callable[[int, dict[str, int]], None] = lambda number, metrics: None,
    poll: float = 0.5,
) -> bool:
    """Condenses chunks in ``batches`` jobs, each stored as a run of its own; whether all is done.

    Units are dealt over the batches whole, and a unit that is stored isn't worked on again, so a
    later call goes on where this one stopped. ``stop`` is asked before each batch and, by a watcher,
    while one runs: then the jobs with the tag are cancelled, the batch that they were working on
    leaves nothing, and the finished ones stay. told gets each batch's number and metrics.
    """
    spark = chunks.sparkSession
    sc = spark.sparkContext
    of = F.pmod(F.xxhash64("book_id", "unit_ix"), F.lit(batches))
    for number in range(batches):
        if stop():
            return False
        due = chunks.where(of == number)
        if done.numbers():
            due = due.join(done.last().select("book_id", "unit_ix").distinct(), ["book_id", "unit_ix"], "left_anti")
        if due.isEmpty():
            continue
        rows, watched = observed(condense(due), f"{tag}-{number}")
        over = threading.Event()

        def watch(over: threading.Event = over) -> None:
            while not over.wait(poll):
                if stop():
                    sc.cancelJobsWithTag(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        sc.addJobTag(tag)
        try:
            done.write(rows)
        except Exception:
            if stop():
                return False
            raise
        finally:
            sc.removeJobTag(tag)
            over.set()
            watcher.join()
        told(number, watched.get)
    return True
