"""Tables on shared storage.

Tables are Parquet directories partitioned by ``as_of_date`` and entity.  A
job never overwrites what its own plan reads: each write goes to a new
version directory ``version={n}`` and becomes current when Spark commits it
(the ``_SUCCESS`` marker); readers pick the highest committed version.  A
write with a tag goes to ``version={n}_{tag}`` and is skipped if a version with
that tag is committed, so a repeated micro-batch (tag: query id and batch id) is a
no-op, while other writers' versions and resets never stand in its way.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import POSITIONS_SCHEMA, RUNLOG_DETAIL_SCHEMA, RUNLOG_SCHEMA

PARTITIONS = ["as_of_date", "load_bb_entity_name"]
SOURCES = {"current": "positions", "history": "history"}
_VERSION = re.compile(r"version=(\d+)(?:_(.+))?")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


@dataclass
class VersionedTable:
    spark: SparkSession
    root: str
    schema: T.StructType = POSITIONS_SCHEMA
    partition_by: tuple[str, ...] = tuple(PARTITIONS)

    def committed(self) -> dict[int, str]:
        """Committed versions and their tags (empty if none)."""
        fs, p, jvm = _fs(self.spark, self.root)
        if not fs.exists(p):
            return {}
        out = {}
        for st in fs.listStatus(p):
            m = _VERSION.fullmatch(st.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out[int(m[1])] = m[2] or ""
        return dict(sorted(out.items()))

    def versions(self) -> list[int]:
        return list(self.committed())

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def path(self, version: int) -> str:
        tag = self.committed().get(version, "")
        return self._path(version, tag)

    def _path(self, version: int, tag: str) -> str:
        return f"{self.root.rstrip('/')}/version={version}" + (f"_{tag}" if tag else "")

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current_version() if version is None else version
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(v))

    def write(self, df: DataFrame, tag: str = "") -> int:
        """Write the next version, unless one with this tag is committed (a retry).

        ``rebalance`` gathers an entity's rows and, unlike a repartition, lets
        AQE split a large entity over several files."""
        have = self.committed()
        for v, t in have.items():
            if tag and t == tag:
                return v
        v = max(have, default=0) + 1
        (df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
         .hint("rebalance", *self.partition_by)
         .write.mode("overwrite").partitionBy(*self.partition_by).parquet(self._path(v, tag)))
        return v

    def reset(self) -> int:
        """A new empty version (truncate; history stays readable)."""
        return self.write(self.spark.createDataFrame([], self.schema))


@dataclass
class DailyVersionedTable:
    """A table whose days are versioned independently.

    Every key of the positions and inbound tables includes ``as_of_date``, so
    a day is a self-contained table: ``root/as_of_date=D/version=N``
    (partitioned by entity inside).  A job rewrites only the days it touches;
    other days are not read or copied.  Reads take each day's latest version
    as one Parquet relation (``basePath`` = root), so ``as_of_date`` is a
    partition column and date filters prune directories.  A day whose version
    with a batch's tag is committed is skipped, so a retried micro-batch
    applies once."""

    spark: SparkSession
    root: str
    schema: T.StructType = POSITIONS_SCHEMA
    inner_partition: tuple[str, ...] = ("load_bb_entity_name",)

    def _day(self, day) -> VersionedTable:
        inner = T.StructType([f for f in self.schema.fields if f.name != "as_of_date"])
        return VersionedTable(self.spark, f"{self.root.rstrip('/')}/as_of_date={day}", inner,
                              self.inner_partition)

    def days(self) -> list[str]:
        fs, p, _ = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        return sorted(st.getPath().getName().split("=", 1)[1] for st in fs.listStatus(p)
                      if st.getPath().getName().startswith("as_of_date="))

    def read(self, days=None) -> DataFrame:
        """Latest committed version of each requested day (all days if None)."""
        wanted = [str(d) for d in (self.days() if days is None else days)]
        paths = []
        for d in wanted:
            day = self._day(d)
            v = day.current_version()
            if v is not None:
                paths.append(day.path(v))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType(list(self.schema.fields)
                            + [T.StructField("version", T.StringType())])
        return (self.spark.read.schema(full).option("basePath", self.root)
                .parquet(*paths).select(*self.schema.names))

    def reset(self) -> None:
        """Every day gets a new empty version (history stays readable)."""
        for d in self.days():
            self._day(d).reset()

    def write(self, df: DataFrame, days, tag: str = "") -> None:
        """Write the given days of ``df`` as each day's next version (days that
        have a committed version with this tag are skipped)."""
        for d in sorted({str(x) for x in days}):
            day = self._day(d)
            part = df.where(F.col("as_of_date") == F.lit(d).cast("date")).drop("as_of_date")
            day.write(part, tag)


def positions_asof(positions: DataFrame, as_of_date, entity_name: str) -> DataFrame:
    """Positions of one date and entity *name* (type is not a filter).
    Both are partition columns, so the scan prunes to one directory."""
    return positions.where((F.col("as_of_date") == F.lit(as_of_date).cast("date"))
                           & (F.col("load_bb_entity_name") == entity_name))


def read_positions(spark: SparkSession, root: str, source: str, as_of_date,
                   entity_name: str) -> DataFrame:
    """S7 with the source switch: ``current`` (the table that the stream and the
    upsert jobs write) or ``history`` (see ``keep_history``), in any case.

    A root without that table is an error, not an empty result."""
    s = (source or "").strip().lower()
    if s not in SOURCES:
        raise ValueError(f"unknown positions source {source!r}: use current or history")
    path = f"{root.rstrip('/')}/{SOURCES[s]}"
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no {s} positions under {root}")
    table = DailyVersionedTable(spark, path)
    return positions_asof(table.read([as_of_date]), as_of_date, entity_name)


def keep_history(spark: SparkSession, root: str, days) -> None:
    """Copies the current positions of ``days`` into the history table."""
    base = root.rstrip("/")
    current = DailyVersionedTable(spark, f"{base}/{SOURCES['current']}").read(days)
    DailyVersionedTable(spark, f"{base}/{SOURCES['history']}").write(current, days)


SAVE_POLICIES = ("always", "onfailure", "never")


def save_compare_csv(expected: DataFrame, actual: DataFrame, out_dir: str, phase: int,
                     policy: str, success: bool) -> dict | None:
    """``phaseN/expected`` and ``phaseN/actual`` CSV directories by policy
    (Always / OnFailure / Never, any case).  Returns the paths written."""
    p = (policy or "").strip().lower()
    if p not in SAVE_POLICIES:
        raise ValueError(f"unknown save policy {policy!r}")
    if p == "never" or (p == "onfailure" and success):
        return None
    base = f"{out_dir.rstrip('/')}/phase{phase}"
    paths = {"expectedCsv": f"{base}/expected.csv", "actualCsv": f"{base}/actual.csv"}
    expected.write.mode("overwrite").option("header", True).csv(paths["expectedCsv"])
    actual.write.mode("overwrite").option("header", True).csv(paths["actualCsv"])
    return paths


def copy_tables(spark: SparkSession, pairs: list[tuple[str, str]], truncate: bool = True,
                fmt: str = "parquet") -> int:
    """Copy each (source, destination) table; returns rows copied."""
    total = 0
    for src, dst in pairs:
        df = spark.read.format(fmt).load(src)
        df.write.mode("overwrite" if truncate else "append").format(fmt).save(dst)
        total += spark.read.format(fmt).load(dst).count() if truncate else df.count()
    return total


@dataclass
class RunLog:
    """Job + detail tables (append-only Parquet)."""

    spark: SparkSession
    root: str

    def _append(self, rows, schema, name):
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(
            f"{self.root.rstrip('/')}/{name}")

    def start(self, procedure: str, parameters: str = "", job_id: str | None = None) -> str:
        job_id = job_id or uuid.uuid4().hex
        now = _dt.datetime.now(_dt.UTC).replace(tzinfo=None)
        self._append([(job_id, now, None, 0, "started")], RUNLOG_SCHEMA, "job")
        self.status(job_id, procedure, parameters, "start")
        return job_id

    def status(self, job_id: str, procedure: str, parameters: str, text: str) -> None:
        now = _dt.datetime.now(_dt.UTC).replace(tzinfo=None)
        self._append([(job_id, procedure, parameters, text, now)], RUNLOG_DETAIL_SCHEMA, "detail")

    def end(self, job_id: str, code: int = 1, description: str = "completed") -> None:
        now = _dt.datetime.now(_dt.UTC).replace(tzinfo=None)
        self._append([(job_id, None, now, code, description)], RUNLOG_SCHEMA, "job")

    def jobs(self) -> DataFrame:
        """Latest state per job (start and end rows folded)."""
        j = self.spark.read.schema(RUNLOG_SCHEMA).parquet(f"{self.root.rstrip('/')}/job")
        return j.groupBy("job_id").agg(
            F.min("date_job_start").alias("date_job_start"),
            F.max("date_job_end").alias("date_job_end"),
            F.max("job_status_code").alias("job_status_code"),
            F.max_by("job_status_description", "job_status_code").alias("job_status_description"))

    def details(self) -> DataFrame:
        return self.spark.read.schema(RUNLOG_DETAIL_SCHEMA).parquet(
            f"{self.root.rstrip('/')}/detail")
