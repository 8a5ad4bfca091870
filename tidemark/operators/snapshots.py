"""What changed between consecutive full snapshots.

Each snapshot is reduced to one row per canonical path, its hash to bytes. Within a path's
uninterrupted presence the last known hash stays in force. A full outer join of every snapshot
with the one delivered before it, on (path, position), then gives the changes: a missing side is
an addition or a removal, unequal hashes are a change.

Every shuffle is keyed by path (and position), so a documentId that holds a large share of the rows
does not matter, and a path has at most one row per snapshot after the first aggregation.

Defined cases: null paths are left out; of rows of one path in one snapshot the latest processedAt
counts (null is the oldest; on a tie a known hash before a null one, then the greater hash); an empty
table gives no rows; a snapshot listed in ``delivered`` without rows removes all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_path(path: Column | str) -> Column:
    """Forward slashes, no scheme or host, percent codes decoded (only where the path is a URI), single slashes."""
    raw = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    uri = raw.rlike("^[A-Za-z][A-Za-z0-9+.-]+:")
    bare = F.regexp_replace(raw, "^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?", "")
    encoded = bare.rlike("%[0-9A-Fa-f]{2}")
    # url_decode also turns + into a space, and fails on a stray percent sign; both are protected first.
    safe = F.regexp_replace(F.regexp_replace(bare, "\\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(encoded, F.try_url_decode(safe)).otherwise(bare)
    return F.regexp_replace(F.when(uri | encoded, F.coalesce(decoded, bare)).otherwise(raw), "/{2,}", "/")


def snapshot_states(snapshots: DataFrame, delivered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, order): one row per path and snapshot with the hash in force, and each snapshot's position."""
    numbers = snapshots.select("snapshotNo")
    if delivered is not None:
        numbers = numbers.unionByName(delivered.select(F.col("snapshotNo").cast("int").alias("snapshotNo")))
    # One row per snapshot: a single-partition window over them is bounded by the deliveries, not by the data.
    order = numbers.filter("snapshotNo is not null").distinct().withColumn("pos", F.row_number().over(Window.orderBy("snapshotNo")))
    rows = snapshots.select(
        "snapshotNo",
        canonical_path("filePath").alias("path"),
        F.unhex(F.lower(F.trim("contentHash"))).alias("hash"),
        F.coalesce(F.col("processedAt"), F.lit(-(2**62))).alias("at"),
    ).filter("path is not null and snapshotNo is not null")
    latest = rows.groupBy("path", "snapshotNo").agg(F.max(F.struct("at", "hash")).alias("last"))
    placed = latest.join(F.broadcast(order), "snapshotNo").select("path", "pos", F.col("last.hash").alias("hash"))
    by_path = Window.partitionBy("path").orderBy("pos")
    island = F.col("pos") - F.row_number().over(by_path)
    in_force = F.last("hash", ignorenulls=True).over(Window.partitionBy("path", "island").orderBy("pos"))
    return placed.withColumn("island", island).withColumn("hash", in_force).select("path", "pos", "hash"), order


def snapshot_changes(snapshots: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """``snapshotNo, filePath, changeType`` for every snapshot but the first."""
    states, order = snapshot_states(snapshots, delivered)
    cur = states.select("path", "pos", F.col("hash").alias("now"), F.lit(True).alias("here"))
    old = states.select("path", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("before"), F.lit(True).alias("was"))
    joined = cur.join(old, ["path", "pos"], "full_outer").filter("pos > 1")
    kind = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("here").isNull(), "removed")
        .when(F.col("before").isNotNull() & (F.col("now") != F.col("before")), "changed")
    )
    found = joined.withColumn("changeType", kind).filter(F.col("changeType").isNotNull())
    # The position after the last snapshot has no number: the inner join drops what "left" it.
    return found.join(F.broadcast(order), "pos").select("snapshotNo", F.col("path").alias("filePath"), "changeType")
