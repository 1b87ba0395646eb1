"""Keeping a keyed table fresh from full snapshots: what is new or changed is upserted, what is missing is removed.

Batch: a whole history of snapshots becomes one operation log.  Streaming: each micro-batch's snapshots are applied in
order to versioned Parquet tables; the last snapshot that was applied is part of the state, so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconcile(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Operations (i, pos, op, key): entries (snapshot_id, pos, key, version) of snapshots (snapshot_id), of which some may be
    empty. Versions compare null-safely; within a snapshot later entries of a key win; removals have no pos."""
    # the ids alone are gathered for numbering: one row a snapshot
    index = snapshots.select("snapshot_id").distinct().withColumn("i", F.row_number().over(W.orderBy("snapshot_id")))
    rows = entries.join(F.broadcast(index), "snapshot_id")
    w = W.partitionBy("key").orderBy("i", "pos")
    seen = rows.withColumns({"li": F.lag("i").over(w), "lv": F.lag("version").over(w)})
    ups = seen.where(F.col("li").isNull() | (F.col("li") < F.col("i") - 1) | ~F.col("version").eqNullSafe(F.col("lv"))).select("i", "pos", F.lit("upsert").alias("op"), "key")
    held = rows.select("i", "key").distinct().withColumn("ni", F.lead("i").over(W.partitionBy("key").orderBy("i")))
    last = index.agg(F.max("i").alias("last"))
    gone = held.crossJoin(F.broadcast(last)).where((F.col("i") < F.col("last")) & (F.col("ni").isNull() | (F.col("ni") > F.col("i") + 1)))
    return ups.unionByName(gone.select((F.col("i") + 1).alias("i"), F.lit(None).cast("int").alias("pos"), F.lit("remove").alias("op"), "key"))


def final_state(operations: DataFrame) -> DataFrame:
    """Of each key its last operation, where that is an upsert."""
    w = W.partitionBy("key").orderBy(F.desc("i"), F.desc("pos"))
    return operations.withColumn("n", F.row_number().over(w)).where("n = 1 and op = 'upsert'").select("key", "i", "pos")


def apply_snapshot(state: DataFrame, snapshot: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, upserted, removed keys). state (key, version, ...); embed sees only the rows that are upserted."""
    w = W.partitionBy("key").orderBy(F.desc("pos"))
    new = snapshot.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "pos")
    known = state.select("key", F.col("version").alias("__old"), F.lit(True).alias("__known"))
    changed = new.join(known, "key", "left").where(F.col("__known").isNull() | ~F.col("version").eqNullSafe(F.col("__old"))).drop("__known", "__old")
    upserted = embed(changed) if embed else changed
    removed = state.select("key").join(new.select("key"), "key", "left_anti")
    kept = state.join(new.select("key"), "key", "left_semi").join(changed.select("key"), "key", "left_anti")
    return kept.unionByName(upserted), upserted, removed


class Synced:
    """A table under `path` that follows a stream of snapshots (snapshot_id, pos, key, version, ...)."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] | None = None):
        from sparkseek.sources.storage import Folder

        self.spark, self.embed, self.folder = spark, embed, Folder(spark, path)

    def read(self) -> DataFrame | None:
        now = self.folder.json("now")
        return None if now is None else self.spark.read.parquet(self.folder.at(now["table"]))

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """For foreachBatch. Snapshots that are not after the last one applied are skipped."""
        del batch_id
        now = self.folder.json("now")
        last = None if now is None else now["snapshot"]
        ids = [r[0] for r in batch.select("snapshot_id").distinct().orderBy("snapshot_id").collect()]  # a handful a batch
        for sid in ids:
            if last is not None and sid <= last:
                continue
            rows = batch.where(F.col("snapshot_id") == sid).where("key is not null").drop("snapshot_id")
            state = self.read()
            if state is None:
                first = rows.drop("pos").limit(0)
                state = self.embed(first) if self.embed else first
            table = f"state-{sid}"
            apply_snapshot(state, rows, self.embed)[0].write.mode("overwrite").parquet(self.folder.at(table))
            self.folder.put_json("now", {"snapshot": sid, "table": table})
            last = sid

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
