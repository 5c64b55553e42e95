"""The bounded sample of labelled documents that the two classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import crc_fold, whole_text

#: Rows a classifier learns from at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, label (0/1 int) of at most ``rows`` labelled ids outside the held-out fold (crc32 mod 5 = 0).

    Null labels and ids teach nothing; an id with several labels has the largest. The ids
    are bounded by ``rows``, so they are broadcast and the texts are not shuffled. Rows that
    share an id teach as often as they occur, while that makes ``rows`` at most; of more, those
    with the smallest hash of their text do.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold() != 0))
    known = known.groupBy("doc_id").agg((F.max(F.col(column).cast("int")) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "label")
    named = docs.select(F.col("doc_id").alias("_doc"), whole_text().alias("text"))
    found = named.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "label", F.xxhash64("text", "_doc").alias("_order"))
    if found.select("_order").count() <= rows:
        return found.select("text", "label")
    return found.orderBy("_order").limit(rows).select("text", "label")
