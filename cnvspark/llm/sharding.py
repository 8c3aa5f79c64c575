"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import cut, small_table

#: Ring positions lie in [0, RING); they are the first 60 bits of an MD5 sum.
RING = 1 << 60


def ring_position(key: Column) -> Column:
    """The place of a string key on the ring."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 15), 16, 10).cast("long")


def virtual_nodes(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    from hashlib import md5

    return sorted((int(md5(f"shard-{s}-{r}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for r in range(replicas))


def fill(arcs: list[tuple[int, int]], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which keys of each arc go where: (arc, first rank, end rank, shard, slot of the first).

    ``arcs`` are (arc, keys in it) in ring order, ``owners`` the shard of the node that ends each arc, ``room`` the bound
    of each shard. Keys come in ring order; when the shard is full, they go on clockwise to the next one with room.
    """
    room, used, out = list(room), [0] * len(room), []
    for arc, keys in arcs:
        rank, at = 0, arc
        while rank < keys:
            shard = owners[at % len(owners)]
            if take := min(keys - rank, room[shard]):
                out.append((arc, rank, rank + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
            at += 1
    return out


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, replicas: int = 128, partitions: int | None = None) -> DataFrame:
    """Puts every row into one of ``shards`` shards; row counts differ by at most one.

    A row's key is its text, so equal texts meet on the ring and stay together as far as the bounds allow; keys at one
    position go in order of id. A key belongs to the first virtual node clockwise. Every shard is bounded by its equal
    share of the rows (the first ``rows % shards`` shards by one more), and keys that overflow continue clockwise.
    Returns id, ``size`` (UTF-8 bytes plus 1; a null text has none), ``text_crc32``, ``shard``, ``slot`` (gapless from 0
    in each shard). Null ids stay null and come first among ties; repeated rows are placed one by one; an empty
    table gives no rows; other columns are ignored.

    Rows without their text are range-partitioned by place on the ring and checkpointed once. Only counts by
    partition and arc, of which there are at most partitions + ``shards * replicas``, come to the driver, whatever the
    input; no window runs over all rows, so one text that holds a third of the rows is spread like any other.
    """
    spark, text = docs.sparkSession, docs[text_col]
    nodes = virtual_nodes(shards, replicas)
    owners = [s for _, s in nodes]
    slim = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").__add__(F.lit(1)).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ring_position(text).alias("position"),
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["position", "doc_id", "text_crc32"]
    placed = cut(slim.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    arc = _search(F.col("position"), [p for p, _ in nodes])
    rows = placed.withColumn("arc", arc).withColumn("part", F.shiftright("at", 33)).withColumn("index", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first")).orderBy("arc", "part").collect()
    arcs: dict[int, int] = {}
    before = []
    for arc_no, part, n_rows, first in counts:
        before.append((arc_no, part, arcs.get(arc_no, 0) - first))  # rank of a row in its arc: this plus its index
        arcs[arc_no] = arcs.get(arc_no, 0) + n_rows
    total = sum(arcs.values())
    plan = fill(sorted(arcs.items()), owners, [total // shards + (s < total % shards) for s in range(shards)])
    before_df = small_table(spark, before, "arc int, part long, shift long")
    plan_df = small_table(spark, plan, "arc int, low long, high long, shard int, base long")
    ranked = rows.join(F.broadcast(before_df), ["arc", "part"]).withColumn("rank", F.col("index") + F.col("shift"))
    found = ranked.join(F.broadcast(plan_df), (ranked["arc"] == plan_df["arc"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def _search(value: Column, bounds: list[int], width_bits: int = 48) -> Column:
    """The index of the first bound that is at least ``value``; beyond the last: 0, as the ring closes.

    The ring is cut into equal cells. An array tells how many bounds lie before each cell, and the few bounds in the
    value's own cell are compared one by one.
    """
    cells = RING >> width_bits
    before, inside = [0] * (cells + 1), [0] * cells
    for b in bounds:
        inside[b >> width_bits] += 1
    for c in range(cells):
        before[c + 1] = before[c] + inside[c]
    padded = [*bounds, *[RING] * (max(inside) + 1)]
    low = F.element_at(_array(before), F.shiftright(value, width_bits).cast("int") + 1)
    steps = [F.when(F.element_at(_array(padded), (low + (i + 1)).cast("int")) < value, 1).otherwise(0) for i in range(max(inside))]
    found = low
    for s in steps:
        found = found + s
    return F.when(found >= len(bounds), 0).otherwise(found).cast("int")


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<long>")
