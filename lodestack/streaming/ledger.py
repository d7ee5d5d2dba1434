"""Streaming forms of two batch operators: an idempotent intake and the orphan state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.orphans import OrphanStore, parent_rows, reference_rows


def intake(spark: SparkSession, folder: str, schema: T.StructType, key: str, sink: str, checkpoint: str):
    """Stream JSON lines from ``folder`` into the parquet table ``sink``, each key once:
    a batch is joined against what the sink holds, so replays after a failure add nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            rows = rows.join(batch.sparkSession.read.parquet(sink).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(sink)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OrphanStream:
    """Applies micro-batches of parents and references, told apart by ``kind``, to an
    orphan state in a folder; use ``take`` with foreachBatch. A batch that is replayed
    after a failure is known by its number, and a new stream on the same folder goes on."""

    def __init__(self, spark: SparkSession, root: str, snapshot: Callable[[DataFrame], None] | None = None, parts: int = 64):
        self.store, self.snapshot = OrphanStore(spark, root, parts), snapshot

    def take(self, batch: DataFrame, number: int) -> None:
        """A batch has kind ('parent' or 'reference'), key, id, at (timestamp), deleted."""
        p = parent_rows(batch.where("kind = 'parent'"), "key", "key", "at", "id", "deleted")
        r = reference_rows(batch.where("kind = 'reference'"), "reference", "id", "key", "key", "at")
        self.store.apply(r, p, number)
        if self.snapshot:
            self.snapshot(self.store.counts())
