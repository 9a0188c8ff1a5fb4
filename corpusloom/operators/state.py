"""Mutable state without updates in place: changes are appended, views take what holds now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "run_id long, step string, params string, event string, at timestamp, processed long, success long, failed long, notes string"


def update_by_key(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``state`` with the columns that the latest change of its key gives; a null in a change leaves the value as it is.

    Keys that ``state`` lacks are no rows of it.  Columns that it lacks are added, null where nothing was given.
    """
    names = [c for c in changes.columns if c not in (key, version)]
    last = changes.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(version))).alias(f"_new_{c}") for c in names))
    out = state.join(last, key, "left")
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in state.columns]
    return out.select(*kept, *(F.col(f"_new_{c}").alias(c) for c in names if c not in state.columns))


def replace_rows(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and what ``state`` has under other keys; ``rows`` must have one row for a key."""
    return state.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def with_columns(state: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``state`` with null columns (name: type) that it lacks; the others stay as they are."""
    have = {c.lower() for c in state.columns}
    return state.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name.lower() not in have))


def if_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that ``df`` has, in the order wanted."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(have[c.lower()] for c in wanted if c.lower() in have))


def renamed(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under one name each, from the first of several spellings that has a value; those without any are left out."""
    out = [F.coalesce(*(F.col(s) for s in spellings if s in df.columns)).alias(name) for name, spellings in names.items() if any(s in df.columns for s in spellings)]
    return df.select(*out)


def started(spark, run_id: int, step: str, params: str | None = None) -> DataFrame:
    """The row that opens a run in the log."""
    return spark.createDataFrame([(run_id, step, params)], "run_id long, step string, params string").select("*", F.lit("start").alias("event"), F.current_timestamp().alias("at"))


def finished(spark, run_id: int, processed: int = 0, success: int = 0, failed: int = 0, notes: str | None = None) -> DataFrame:
    row = spark.createDataFrame([(run_id, processed, success, failed, notes)], "run_id long, processed long, success long, failed long, notes string")
    return row.select("*", F.lit("finish").alias("event"), F.current_timestamp().alias("at"))


def run_log(log: DataFrame) -> DataFrame:
    """One row for each run: what its opening row says, and what its last closing row does, null while it runs."""
    opened = lambda c: F.min_by(c, F.when(F.col("event") == "start", F.col("at"))).alias(c)
    closed = lambda c: F.max_by(c, F.when(F.col("event") == "finish", F.col("at"))).alias(c)
    return log.groupBy("run_id").agg(
        opened("step"), opened("params"), F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished_at"),
        *(closed(c) for c in ("processed", "success", "failed", "notes")),
    )


def look_up(wanted: DataFrame, source: DataFrame, key: str, columns: list[str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, missing) values of the wanted keys: what ``known`` has is not looked up again."""
    todo = wanted.select(key).distinct()
    if known is not None:
        todo = todo.join(known.select(key), key, "left_anti")
    found = source.join(todo, key, "left_semi").select(key, *columns).dropDuplicates([key])
    missing = todo.join(found.select(key), key, "left_anti")
    return (found if known is None else known.select(key, *columns).unionByName(found)), missing


def with_budget(queue: DataFrame, order: list, cost: str, budget: float, step: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, batch: int = 1000) -> DataFrame:
    """Work through ``queue`` (column ``uid``) in batches until the saved results' ``cost`` reaches ``budget``.

    ``save`` stores results and returns all of them read back, so a stopped run goes on where it ended; every batch is
    one commit.
    """
    results = done
    while True:
        spent = 0.0 if results is None else results.agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
        todo = queue if results is None else queue.join(results.select("uid"), "uid", "left_anti")
        part = todo.orderBy(*order).limit(batch)
        if spent >= budget or part.isEmpty():
            return queue.limit(0) if results is None else results
        results = save(step(part))
