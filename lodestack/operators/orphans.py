"""References to records that do not exist (problem 3).

Keyed pending-orphan state, kept incrementally. A batch brings new parent rows
and new references. New references probe the parent index; parents that arrive
resolve waiting orphans; deletions reopen references that were settled; at any
time the open references and their counts by table and period can be read.

``OrphanState`` runs a few batches in one query; its tables are
``parents``  target, key -> first_at, last_at, last_seq, last_deleted
``open``     references that are orphans now, with a reason
``settled``  references that resolve now; a later batch probes again only those
             whose key it touches

``OrphanStore`` keeps the same state in a folder for any number of batches, parted
by a hash of the key. A batch reads and rewrites only the parts its keys are in,
and the counts of those; what it wrote becomes the state by one small manifest,
so a batch that failed half-way or comes twice changes nothing, and a restarted
driver goes on from the folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .skew import join_unique

REF = ["table_name", "row_id", "field_name", "ref_key", "target", "key", "ref_at"]


def norm_key(c: Column) -> Column:
    """Keys are compared without outer blanks and letter case; blank is null."""
    k = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(k) > 0, k)


def _time(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.typeName()
    return F.try_to_timestamp(F.col(col)) if kind == "string" else F.col(col).cast("timestamp")


def parent_rows(df: DataFrame, target: str, key: str, at: str, seq: str, deleted: str) -> DataFrame:
    """Rows of a parent table in the state's form. ``seq`` breaks ties of ``at``;
    a null ``deleted`` counts as not deleted; a null time as before all others."""
    return df.select(
        F.lit(target).alias("target"),
        norm_key(F.col(key)).alias("key"),
        _time(df, at).alias("at"),
        F.col(seq).cast("long").alias("seq"),
        F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"),
    ).where(F.col("key").isNotNull())


def reference_rows(df: DataFrame, table: str, row_id: str, column: str, target: str, at: str) -> DataFrame:
    """References of a column (a string, or an array of strings: one each).
    Null and blank references are none; repeated ones of a row are one."""
    is_array = df.schema[column].dataType.typeName() == "array"
    ref = F.explode(F.array_distinct(F.col(column))) if is_array else F.col(column)
    out = df.select(
        F.lit(table).alias("table_name"),
        F.col(row_id).cast("long").alias("row_id"),
        F.lit(column).alias("field_name"),
        ref.alias("ref_key"),
        F.lit(target).alias("target"),
        _time(df, at).alias("ref_at"),
    )
    return out.withColumn("key", norm_key(F.col("ref_key"))).where(F.col("key").isNotNull()).select(*REF)


def _fold(parents: DataFrame) -> DataFrame:
    """State of each key from rows or from states; partial aggregation keeps hot keys small."""
    last = F.struct(F.col("last_at").isNotNull().alias("t"), "last_at", "last_seq", "last_deleted")
    return (
        parents.groupBy("target", "key")
        .agg(F.min("first_at").alias("first_at"), F.max(last).alias("l"))
        .select("target", "key", "first_at", "l.last_at", "l.last_seq", "l.last_deleted")
    )


def _as_state(rows: DataFrame) -> DataFrame:
    return rows.select(
        "target", "key", F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.col("seq").alias("last_seq"), F.col("deleted").alias("last_deleted")
    )


def _probe(refs: DataFrame, state: DataFrame) -> DataFrame:
    """References with the reason why they are orphans; null for those that resolve."""
    reason = (
        F.when(F.col("last_deleted").isNull(), F.lit("missing"))
        .when(F.col("last_deleted"), F.lit("deleted"))
        .when(F.col("first_at") > F.col("ref_at"), F.lit("late"))
    )
    return join_unique(_tag(refs), _tag(state), "tag").select(*REF, reason.alias("reason"))


@dataclass(frozen=True)
class OrphanState:
    """Immutable handle on the three state tables; ``apply`` returns the next one."""

    parents: DataFrame | None = None
    open: DataFrame | None = None
    settled: DataFrame | None = None

    def apply(self, refs: DataFrame, parents: DataFrame, last: bool = False) -> OrphanState:
        """Take in a batch. ``last``: no further batch follows, so that only the
        open references are wanted and nothing needs be kept for later probes."""
        delta = _fold(_as_state(parents))
        state = delta if self.parents is None else _fold(self.parents.unionByName(delta))
        if not last:
            state = settle(state, "parents")
        probe = refs.select(*REF)
        quiet = None
        if self.open is not None:
            probe = probe.unionByName(self.open.select(*REF))
            touched = delta.select("target", "key").withColumn("touched", F.lit(True))
            again = join_unique(_tag(self.settled), _tag(touched), "tag")
            probe = probe.unionByName(again.where("touched").select(*REF))
            quiet = again.where("touched is null").select(*REF)
        probed = _probe(probe, state)
        if last:
            return replace(self, parents=state, open=probed.where("reason is not null"), settled=None)
        probed = settle(probed, "probed")
        done = probed.where("reason is null").select(*REF)
        # written, so that no later batch joins again for what this one left alone
        kept = done if quiet is None else settle(done.unionByName(quiet), "settled")
        return replace(self, parents=state, open=probed.where("reason is not null"), settled=kept)

    def counts(self, unit: str = "month") -> DataFrame:
        """Open references for each table, field, reason and period of the citing
        row: table_name, field_name, reason, period (null where it has no time), n."""
        return self.open.groupBy("table_name", "field_name", "reason", F.date_trunc(unit, "ref_at").alias("period")).agg(F.count(F.lit(1)).alias("n"))


class OrphanStore:
    """Durable state in ``root``, a folder that all executors see. ``parts`` is fixed
    when the folder is first used; about as many rows of state a part as a task
    should hold. One writer at a time."""

    STATE = "target string, key string, first_at timestamp, last_at timestamp, last_seq long, last_deleted boolean, part int"
    REFS = "table_name string, row_id long, field_name string, ref_key string, target string, key string, ref_at timestamp, reason string, part int"
    COUNTS = "table_name string, field_name string, reason string, period timestamp, n long, part int"

    def __init__(self, spark: SparkSession, root: str, parts: int = 64, unit: str = "month"):
        self.spark, self.root, self.unit = spark, root.rstrip("/"), unit
        self.fs = _Folder(spark, self.root)
        last = self.fs.newest("manifest")
        made = {"version": 0, "parts": parts, "where": {}, "applied": None}
        self.manifest = json.loads(spark.read.text(last).first()[0]) if last else made

    def _read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        where = {int(k): v for k, v in self.manifest["where"].items()}
        paths = [f"{self.root}/{name}/v={where[k]}/part={k}" for k in (sorted(where) if parts is None else parts) if k in where]
        # a part may have rows of one table only
        paths = [x for x in paths if self.fs.exists(x)]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("part")
        return self.spark.read.schema(schema.rsplit(", part int", 1)[0]).parquet(*paths)

    def apply(self, refs: DataFrame, parents: DataFrame, batch: int | str) -> bool:
        """Take in a batch; False if ``batch`` was the last one taken in, so that nothing is done."""
        if self.manifest["applied"] == str(batch):
            return False
        n = self.manifest["parts"]
        part = F.pmod(F.xxhash64("target", "key"), F.lit(n)).cast("int").alias("part")
        delta, new = settle(_fold(_as_state(parents)), "delta"), settle(refs.select(*REF), "refs")
        touched = sorted(r[0] for r in delta.select(part).unionByName(new.select(part)).distinct().collect())
        version = self.manifest["version"] + 1
        if touched:
            state = settle(_fold(self._read("parents", self.STATE, touched).unionByName(delta)), "state")
            probed = settle(_probe(self._read("refs", self.REFS, touched).select(*REF).unionByName(new), state), "probed")
            self._write(state.select("*", part), "parents", version)
            self._write(probed.select("*", part), "refs", version)
            open_ = probed.where("reason is not null").groupBy("table_name", "field_name", "reason", F.date_trunc(self.unit, "ref_at").alias("period"), part).agg(F.count(F.lit(1)).alias("n"))
            self._write(open_.select("table_name", "field_name", "reason", "period", "n", "part"), "counts", version)
        old = self.manifest["where"]
        self.manifest = {"version": version, "parts": n, "where": {**old, **{str(k): version for k in touched}}, "applied": str(batch)}
        self.spark.createDataFrame([(json.dumps(self.manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{version:012d}")
        # what the new manifest doesn't name any more
        for k in touched:
            if str(k) in old:
                for name in ("parents", "refs", "counts"):
                    self.fs.delete(f"{self.root}/{name}/v={old[str(k)]}/part={k}")
        self.fs.delete(f"{self.root}/manifest/{version - 2:012d}")
        return True

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{name}/v={version}")

    def open(self) -> DataFrame:
        """References that are orphans now, with their reasons."""
        return self._read("refs", self.REFS).where("reason is not null")

    def counts(self) -> DataFrame:
        """As OrphanState.counts, added up from the counts of the parts: no reference is read."""
        rows = self._read("counts", self.COUNTS)
        return rows.groupBy("table_name", "field_name", "reason", "period").agg(F.sum("n").alias("n"))

    def snapshot(self, at) -> None:
        """Append the counts as they are now, under the time ``at``."""
        self.counts().withColumn("taken_at", F.lit(at)).write.mode("append").parquet(f"{self.root}/snapshots")


class _Folder:
    """What the store asks of its file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def newest(self, name: str) -> str | None:
        """The last folder that was written to its end."""
        done = self.fs.globStatus(self.path(f"{self.root}/{name}/*/_SUCCESS"))
        found = sorted(x.getPath().getParent().toString() for x in (done or []))
        return found[-1] if found else None


def _tag(df: DataFrame) -> DataFrame:
    """One joinable column for (target, key); on the parent side the only columns kept besides it are the state's."""
    tagged = df.withColumn("tag", F.concat_ws("\u0001", "target", "key"))
    return tagged if "ref_key" in df.columns else tagged.drop("target", "key")


def find_orphans(refs: DataFrame, parents: DataFrame, cuts: list | None = None) -> OrphanState:
    """Run the state over the batches that ``cuts`` (ascending times) part the
    rows into; rows without a time come with the first batch. Without cuts all
    is one batch. However the rows are parted, the open references at the end
    are the same: those whose key no row has (missing), whose key's last row is
    deleted, or whose key's first row is later than the citing row.

    Empty tables give no references, or only missing ones. Rows repeated as a
    whole count as themselves; columns beyond those named have no influence.
    """
    state = OrphanState()
    bounds = [None, *(cuts or []), None]
    for lo, hi in zip(bounds, bounds[1:]):
        state = state.apply(_between(refs, "ref_at", lo, hi), _between(parents, "at", lo, hi), last=hi is None)
    return state


def _between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    c, keep = F.col(col), F.lit(True)
    if lo is not None:
        keep = keep & (c >= F.lit(lo))
    if hi is not None:
        keep = keep & (c < F.lit(hi))
    return df.where(keep if lo is not None else keep | c.isNull())
