"""Pipelines of stages (DataFrame to DataFrame) and registries for search types and stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]
_searches: dict[str, Callable[..., DataFrame]] = {}
#: Words a guarded statement may not begin with after WITH or SELECT are not needed: the analysed plan decides.
_COMMANDS = ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "SetCatalog", "SetNamespace", "CacheTable")


@dataclass(frozen=True)
class Task:
    """A stage with a name; ``enriches`` says that it adds to its input instead of replacing it."""

    name: str
    run: Stage
    enriches: bool = False


def task(name: str, enriches: bool = False) -> Callable[[Stage], Task]:
    return lambda run: Task(name, run, enriches)


def chained(df: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """All stages in turn, as one lazy plan."""
    for t in tasks:
        df = df.transform(t.run)
    return df


def side_by_side(df: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """All stages on the same input, their rows together."""
    out = None
    for t in tasks:
        found = t.run(df).withColumn("_task", F.lit(t.name))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def not_done(items: DataFrame, done: DataFrame, pipeline: str) -> DataFrame:
    """Items (data_id) that a pipeline has not processed yet."""
    return items.join(done.where(F.col("pipeline") == pipeline).select("data_id"), "data_id", "left_anti")


def use_search(name: str, plan: Callable[..., DataFrame]) -> None:
    """Registers a search type."""
    _searches[name] = plan


def search(name: str, *args, **named) -> DataFrame:
    if name not in _searches:
        raise KeyError(f"no search type {name}; known: {', '.join(sorted(_searches))}")
    return _searches[name](*args, **named)


def guarded_sql(spark: SparkSession, sql: str, most: int) -> tuple[DataFrame, bool]:
    """Rows of one read-only statement, at most ``most``, and whether there were more. Anything but a query is refused."""
    if sql.strip().rstrip(";").count(";"):
        raise ValueError("one statement only")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    names = [parsed.nodeName()] if parsed.children().isEmpty() else [parsed.nodeName(), *(parsed.children().apply(k).nodeName() for k in range(parsed.children().size()))]
    if any(c in n for n in names for c in _COMMANDS):
        raise ValueError("read-only statements only")
    rows = spark.sql(sql.strip().rstrip(";"))
    return rows.limit(most), rows.limit(most + 1).count() > most
