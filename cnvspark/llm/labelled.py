"""The labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by :data:`FOLDS`. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, *, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class, of at most ``longest`` code points, from rows that are not held out.

    They are the ids of least hash. The bounds limit what the driver holds, however often an id is repeated. Ids are drawn
    from the labels alone, so only a bounded table of ids is sent to the documents, and only drawn texts are shuffled. Rows
    without id or label are left out; of repeated labels the greatest counts, of repeated ids the least text.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    drawn = [known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(ids), "_id")
    found = rows.where(F.length("_text") <= longest).groupBy("_id", "_label").agg(F.min("_text").alias("_text")).toLocalIterator()
    return [(t, y) for _, y, t in sorted(found)]
