"""Sources: files by kind, CSV, relational tables, JSON archives, pages."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions.ids import content_hash
from skeinlake.functions.moments import parsed
from skeinlake.functions.shared import written
from skeinlake.functions.text import row_text

#: Delimiters in the order in which they are tried.
DELIMITERS = (",", ";", "\t", "|")
# fixed values: document kinds by extension
KINDS = {"pdf": "pdf", "csv": "csv", "txt": "text", "md": "text", "json": "text", "html": "text", "xml": "text", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "mp3": "audio", "wav": "audio", "ogg": "audio", "flac": "audio", "mp4": "video", "mov": "video", "py": "code", "js": "code", "ts": "code", "java": "code", "go": "code", "rs": "code", "c": "code", "cpp": "code", "sql": "code"}

Loader = Callable[[SparkSession, str], DataFrame]
_loaders: dict[str, Loader] = {}


def use_loader(kind: str, loader: Loader) -> None:
    """Registers a loader for a kind of document, before those built in."""
    _loaders[kind] = loader


def kind_of(path: str) -> str:
    return KINDS.get(PurePosixPath(path).suffix.lstrip(".").lower(), "unstructured")


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """path, text (or content) of the files below a path, by the loader of their kind."""
    kind = kind or kind_of(path)
    return _loaders.get(kind, _BUILT_IN.get(kind, texts))(spark, path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, content_hash: whole files, folders recursively."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("text"), content_hash(F.col("value")).alias("content_hash"))


def binaries(spark: SparkSession, path: str, transcribe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, content of media files; an injected function makes text of them."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return transcribe(read) if transcribe else read


def delimiter(lines: list[str], sample: int = 20) -> str:
    """The first delimiter that splits the first non-blank lines into one number of columns above one."""
    rows = [x for x in lines if x.strip()][:sample]
    for d in DELIMITERS:
        counts = {len(r) for r in csv.reader(rows, delimiter=d)}
        if len(counts) == 1 and counts.pop() > 1:
            return d
    return ","


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header and inferred types; the delimiter is told from its first lines."""
    first = [r["value"] for r in spark.read.text(path).limit(200).collect()]
    return spark.read.option("header", True).option("inferSchema", True).option("sep", delimiter(first)).csv(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return rendered(spark.read.option("header", True).option("sep", delimiter([r["value"] for r in spark.read.text(path).limit(200).collect()])).csv(path))


def rendered(table: DataFrame, order: str | None = None) -> DataFrame:
    """number, text: each row as ``Row N:`` and its ``name: value`` pairs.

    Numbers follow ``order`` or the order of the file, from counts per partition: no window
    over all rows.
    """
    columns = table.columns
    placed = table.orderBy(order) if order else table
    # written, because the numbers are read twice and have to be the same both times
    kept = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "rows")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_at") - F.col("_first") + 1
    return kept.join(F.broadcast(bases), "_part").select(number.alias("number"), row_text(number, columns).alias("text"))


def jdbc_table(spark: SparkSession, url: str, query: str, column: str | None = None, parts: int = 1, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A relational query; with a column and bounds it is read in parts."""
    read = spark.read.format("jdbc").option("url", url)
    if column and bounds:
        return read.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts).load()
    return read.option("query", query).load()


def cells(table: DataFrame, name: str, key: str) -> DataFrame:
    """row_id, column_name, value: one row per cell that is not null."""
    rest = [c for c in table.columns if c != key]
    long = table.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("row_id"), *(F.col(c).cast("string").alias(c) for c in rest))
    return long.unpivot("row_id", rest, "column_name", "value").where("value is not null")


def table_graph(tables: Mapping[str, DataFrame], keys: Mapping[str, str], foreign: Mapping[tuple[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """Nodes for tables, rows and distinct cell values; edges for membership, cells and foreign keys."""
    node = lambda df, i, n, t: df.select(i.alias("id"), n.alias("name"), F.lit(t).alias("type"))
    nodes = edges = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for name, table in tables.items():
        row = F.concat(F.lit(f"{name}:"), F.col(keys[name]).cast("string"))
        nodes = add(nodes, node(table.limit(1), F.lit(f"table:{name}"), F.lit(name), "TableType"))
        nodes = add(nodes, node(table, row, row, "TableRow"))
        edges = add(edges, table.select(row.alias("source_id"), F.lit(f"table:{name}").alias("target_id"), F.lit("is_part_of").alias("relationship_name")))
        value = F.concat(F.lit(f"value:{name}."), F.col("column_name"), F.lit("="), F.col("value"))
        held = cells(table.drop(*(c for t, c in foreign if t == name)), name, keys[name])
        nodes = add(nodes, node(held.select("column_name", "value").distinct(), value, F.col("value"), "ColumnValue"))
        edges = add(edges, held.select(F.col("row_id").alias("source_id"), value.alias("target_id"), F.col("column_name").alias("relationship_name")))
    for (name, column), target in foreign.items():
        row = F.concat(F.lit(f"{name}:"), F.col(keys[name]).cast("string"))
        edges = add(edges, tables[name].where(F.col(column).isNotNull()).select(row.alias("source_id"), F.concat(F.lit(f"{target}:"), F.col(column).cast("string")).alias("target_id"), F.lit(column).alias("relationship_name")))
    return nodes, edges


def schema_rows(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of each column."""
    return [(t, c, k) for t, df in tables.items() for c, k in df.dtypes]


def fresh(stored: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Stored rows that the manifest still names."""
    return stored.join(manifest.select(key), key, "left_semi")


def archive(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Records of one kind of a JSON-lines archive; times may be ISO or epochs."""
    read = spark.read.schema(schema).json(f"{folder.rstrip('/')}/{kind}.jsonl")
    return read.withColumns({c: parsed(F.col(c)) for c in read.columns if c.endswith("_at") and dict(read.dtypes)[c] == "string"})


def memories(spark: SparkSession, path: str, source: str) -> DataFrame:
    """external_id, text, user_id, created_at of foreign memory exports, one JSON record per line."""
    # fixed values: field names of the exports
    fields = {
        "mem0": ("id", "memory", "user_id", "created_at"),
        "letta": ("id", "text", "agent_id", "created_at"),
        "zep": ("uuid", "fact", "group_id", "valid_at"),
        "langmem": ("key", "value.content", "namespace", "created_at"),
    }[source]
    read = spark.read.json(path)
    has = lambda c: c.split(".")[0] in read.columns
    key, text, user, time = (F.col(c).cast("string") if has(c) else F.lit(None).cast("string") for c in fields)
    return read.select(key.alias("external_id"), text.alias("text"), user.alias("user_id"), parsed(time).alias("created_at")).where("text is not null")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, query of each url."""
    url = F.col("url")
    return pages.select("page_id", F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"))


_BUILT_IN: dict[str, Loader] = {"text": texts, "code": texts, "csv": csv_rows, "image": binaries, "audio": binaries, "video": binaries, "pdf": binaries}
