"""foreachBatch sink: messages → inbound → upsert, keyed by query and batch id.

The batch comes from ``release_stream``: initial rows are in it only once their session is released, and waiting
rows are the state store's business.  Per micro-batch: (1) the initial and intraday rows are loaded; (2) the initial
upsert runs, then the intraday one, over the loaded rows and the days they touch; (3) those days of positions are
written, and the loaded rows are appended to ``inbound`` with their processed flags.  Messages that cannot be
parsed, updates that came too late, and initial rows whose session expired (or was never released) go to
``quarantine``, so loaded + quarantined + waiting = received (zero positions, markers and heartbeats aside).  Every
run is logged and closed after its writes.

A batch that is run again brings the same rows.  Everything it writes carries the tag (query id, batch id):
positions skip a day whose version with that tag is committed, and the batch's own folders of ``inbound`` and
``quarantine`` are overwritten with the same rows, so a retried batch neither applies twice nor loses any.  One
streaming query owns the tables; another one (a new checkpoint) is refused, because it would replay what has been
applied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.colmap import ColumnMap
from ..operators.messages import zero_filter
from ..plans.upsert_job import run_upsert
from ..schemas import SESSION_KEY
from ..session import cut
from ..sources.inbound import load_inbound
from ..sources.tables import DailyVersionedTable, RunLog, _fs

MESSAGE_COLUMNS = [*SESSION_KEY, "stream_order", "json_stream", "phase"]
#: Phases of rows that no job loads, and the reason that quarantine gives.
UNLOADED = {"late": "late", "expired": "expired"}


@dataclass
class StreamTables:
    spark: SparkSession
    root: str
    inbound_schema: T.StructType

    def __post_init__(self):
        self.base = self.root.rstrip("/")
        self.positions = DailyVersionedTable(self.spark, f"{self.base}/positions")
        self.log = RunLog(self.spark, f"{self.base}/runlog")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.base}/{name}"
        fs, p, _ = _fs(self.spark, path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def inbound(self) -> DataFrame:
        """All loaded rows, batch after batch (append-only)."""
        return self._read("inbound", self.inbound_schema)

    def quarantine(self) -> DataFrame:
        """Messages that no job loaded, with the reason."""
        return self._read("quarantine", _message_schema("reason"))

    def claim(self, query_id: str) -> None:
        """Makes ``query_id`` the owner of the tables; raises if another query owns them."""
        fs, p, jvm = _fs(self.spark, f"{self.base}/_owner")
        if fs.exists(p):
            stream = fs.open(p)
            owner = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if owner != query_id:
                raise RuntimeError(f"{self.root} belongs to streaming query {owner}; start with its checkpoint, "
                                   f"or use another folder (this query is {query_id})")
            return
        stream = fs.create(p, False)
        stream.write(bytearray(query_id, "utf-8"))
        stream.close()


def _message_schema(extra: str) -> T.StructType:
    types = {"as_of_date": T.DateType(), "stream_order": T.LongType()}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in [*MESSAGE_COLUMNS, extra]])


def inbound_schema(spark: SparkSession, cmap: ColumnMap | None = None) -> T.StructType:
    probe = spark.createDataFrame([], "as_of_date date, load_bb_entity_type string, "
                                      "load_bb_entity_name string, msg_request_id string, "
                                      "stream_order long, json_stream string, phase string")
    return load_inbound(probe, cmap).rows.schema


def _query_id(spark: SparkSession) -> str:
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"


def make_sink(tables: StreamTables, cmap: ColumnMap | None = None, policy: str | None = None,
              query_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function.  ``policy`` is for keys that repeat among initial rows."""
    spark = tables.spark

    def sink(batch: DataFrame, batch_id: int) -> None:
        owner = query_id or _query_id(spark)
        tables.claim(owner)
        tag = f"{owner}-{batch_id}"
        batch = batch.cache()
        msg = lambda df: df.select(*MESSAGE_COLUMNS)
        phase = F.col("phase")
        initial = zero_filter(batch.where((phase == "initial") & F.col("released")))
        loaded = load_inbound(msg(initial).unionByName(msg(batch.where(phase == "intraday"))), cmap)
        rows = cut(loaded.rows)
        reason = F.create_map(*[F.lit(x) for pair in UNLOADED.items() for x in pair])[phase]
        reason = F.when((phase == "initial") & ~F.col("released"), "unreleased").otherwise(reason)
        unloaded = batch.withColumn("reason", reason).where("reason IS NOT NULL").select(*MESSAGE_COLUMNS, "reason")
        (msg(loaded.quarantine).withColumn("reason", F.lit("malformed")).unionByName(unloaded)
         .write.mode("overwrite").parquet(f"{tables.base}/quarantine/batch={tag}"))
        ended = batch.where(phase == "session_end").count()
        # The days this batch touches (a handful of dates, not data).
        days = [r.as_of_date for r in rows.select("as_of_date").distinct().collect()]
        job = tables.log.start("stream_batch", tag)
        try:
            if days:
                first = run_upsert(rows, tables.positions.read(days), False, cmap, policy, keep=cut)
                second = run_upsert(first.inbound, first.positions, True, cmap, keep=cut)
                tables.positions.write(second.positions, days, tag)
                second.inbound.write.mode("overwrite").parquet(f"{tables.base}/inbound/batch={tag}")
                for out, phase in ((first, "initial"), (second, "intraday")):
                    for r in out.counts.collect():
                        tables.log.status(job, "stream_batch", tag, f"{phase} {r.kind}: {r.n}")
            if ended:
                tables.log.status(job, "stream_batch", tag, f"sessions_expired: {ended}")
            tables.log.end(job)
        except Exception as e:
            tables.log.end(job, 2, f"failed: {str(e).splitlines()[0][:500]}")
            raise
        finally:
            batch.unpersist()

    return sink


def run_archive_stream(spark: SparkSession, archive_dir: str, archive_schema: T.StructType,
                       root: str, checkpoint: str, cmap: ColumnMap | None = None,
                       max_files_per_trigger: int = 1, policy: str | None = None, idle_ms: int | None = None):
    """Replay archive files as a stream (availableNow) into the tables."""
    from .release import DAY_MS, drained, release_stream
    tables = StreamTables(spark, root, inbound_schema(spark, cmap))
    src = (spark.readStream.schema(archive_schema)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(archive_dir))
    with drained(spark):
        q = (release_stream(src, idle_ms=idle_ms or DAY_MS).writeStream.foreachBatch(make_sink(tables, cmap, policy))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return tables
