"""Greedy selections set at a time: what a loop in order of priority would keep, found in rounds of joins.

In each round the rows stay that have no earlier open neighbour; their neighbours go. That is the loop's own result, since
nothing later can change either. The number of rounds is the longest chain of rows that wait for each other: a logarithm of
the rows for priorities that do not follow the neighbourhood, as p-values do, and long where they run along it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import written


def independent(rows: DataFrame, links: DataFrame, priority: list[str], id: str = "v") -> DataFrame:
    """The rows that stay: by ascending priority (ties by id), one goes if it is linked to one that stayed.

    links (a, b): undirected, any number of times; loops and ids that rows do not have are left out. Null priorities come
    last; ids are distinct."""
    key = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in priority], F.col(id)).alias("key")
    order = rows.select(F.col(id).alias("id"), key)
    a, b = order.select(F.col("id").alias("a"), F.col("key").alias("ka")), order.select(F.col("id").alias("b"), F.col("key").alias("kb"))
    first = F.col("ka") < F.col("kb")
    open_ = links.select("a", "b").where("a <> b").join(a, "a").join(b, "b")
    open_ = written(open_.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
    gone = rows.select(F.col(id).alias("b")).limit(0)
    while not open_.isEmpty():
        stays = open_.select("a").distinct().join(open_.select("b"), F.col("a") == F.col("b"), "left_anti")
        out = written(open_.join(stays, "a", "left_semi").select("b").distinct())
        gone = gone.union(out)
        open_ = written(open_.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti"))
    return rows.join(gone.select(F.col("b").alias(id)), id, "left_anti")


def apart(rows: DataFrame, distance: int, priority: list[str]) -> DataFrame:
    """The rows (chr, pos, ...) that stay: by ascending priority, then pos, one goes if one that stayed is within distance on
    its chr. Rows alike in all of these are taken in some order.

    Bins are as wide as the distance, so the first row of a bin is the only one of it that can be next; it stays unless a row
    of the two bins beside it is nearer than the distance and earlier. No pairs are made but of a row and the first rows of
    three bins. Rows without chr or pos are left out."""
    width = max(distance, 1)
    columns = rows.columns
    key = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in priority], F.col("pos"), F.col("_row")).alias("_key")
    open_ = rows.where("chr IS NOT NULL AND pos IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    open_ = written(open_.withColumn("_bin", F.floor(F.col("pos") / width)))
    all_, kept = open_, None
    held = open_.select("chr", "pos", "_bin", "_row", key)
    held = written(held)
    while not held.isEmpty():
        first = held.groupBy("chr", "_bin").agg(F.min("_key").alias("_first"))
        first = written(first.select("chr", F.col("_bin").alias("_home"), "_first", F.col("_first.pos").alias("_at")))
        near = first.withColumn("_bin", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)))
        met = near.join(held, ["chr", "_bin"]).where(F.abs(F.col("pos") - F.col("_at")) <= distance)
        waits = met.where(F.col("_key") < F.col("_first")).select("chr", "_home").distinct()
        stays = written(first.join(waits, ["chr", "_home"], "left_anti"))
        kept = stays.select(F.col("_first._row").alias("_row")) if kept is None else kept.union(stays.select(F.col("_first._row").alias("_row")))
        reach = stays.withColumn("_bin", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)))
        out = reach.join(held, ["chr", "_bin"]).where(F.abs(F.col("pos") - F.col("_at")) <= distance).select("_row").distinct()
        held = written(held.join(out, "_row", "left_anti"))
    return all_.join(kept, "_row", "left_semi").select(*columns) if kept is not None else rows.limit(0)
