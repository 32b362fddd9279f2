"""Change feeds and subscriptions on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumengraph.model import DELETE, INSERT, LOG, RDF_TYPE
from lumengraph.operators.state import state
from lumengraph.sources.mapping import logged
from lumengraph.sources.rdf import rejected, statements

#: Files of the log that a micro-batch takes at most, and the time between batches.
FILES_PER_BATCH, EVERY = 100, "1 second"
#: Records of a change that an event holds at most.
RECORDS_PER_EVENT = 25_000


def log_stream(spark: SparkSession, path: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """The log's records as they are appended."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path)


def grouped(batch: DataFrame, size: int = RECORDS_PER_EVENT) -> DataFrame:
    """(change_id, page, inserts, deletes, records): the events of a batch. A change gives one for each ``size`` of its records
    that a task has read, at most, so that a bulk load is many rows in many tasks; one over several batches gives some in each."""
    paged = batch.withColumn("page", F.floor(F.monotonically_increasing_id() / size))
    return paged.groupBy("change_id", "page").agg(
        F.count_if(F.col("sign") == INSERT).alias("inserts"),
        F.count_if(F.col("sign") == DELETE).alias("deletes"),
        F.sort_array(F.collect_list(F.struct("subject", "predicate", "object", "datatype", "language", "graph", "sign"))).alias("records"),
    )


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to ``each``. The checkpoint is the resume token: with a known one a feed goes on where it was,
    with a new one it starts from the beginning. With ``once`` it ends when all that is there has been read."""
    trigger = {"availableNow": True} if once else {"processingTime": EVERY}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def trigger_sign(kind: str | None, name: str) -> int | None:
    """What a subscription field waits for: its stated kind, else what its name ends with; None for any change."""
    low = (kind or name).lower()
    if low.endswith(("insert", "inserted", "added")):
        return INSERT
    if low.endswith(("delete", "deleted", "removed")):
        return DELETE
    return None


def triggered(batch: DataFrame, sign: int | None, cls: str | None = None, predicates: Sequence[str] = (RDF_TYPE,), objects: Sequence[str] | None = None) -> DataFrame:
    """The distinct subjects of the records that a subscription waits for; objects default to the class it returns, and an
    empty list restricts nothing."""
    wanted = [cls] if objects is None and cls else list(objects or ())
    rows = batch if sign is None else batch.where(F.col("sign") == sign)
    if predicates:
        rows = rows.where(F.col("predicate").isin(*predicates))
    if wanted:
        rows = rows.where(F.col("object").isin(*wanted))
    return rows.select("subject").distinct()


def seen_by(log: DataFrame, batch: DataFrame, sign: int | None) -> DataFrame:
    """The state that a batch's subscribers see: that after its last change; for deletions, that before its first."""
    if sign == DELETE:
        first = batch.agg(F.min("change_id")).first()[0]
        before = log.where(F.col("change_id") < first).agg(F.max("change_id")).first()[0]
        return state(log, at=before if before is not None else "")
    return state(log, at=batch.agg(F.max("change_id")).first()[0])


def subscription(read_log: Callable[[], DataFrame], query: Callable[[DataFrame], DataFrame], sink: str, sign: int | None, cls: str, **pattern) -> Callable[[DataFrame, int], None]:
    """A batch handler: runs ``query`` over the state for the subjects that triggered it and writes its rows, with the batch's
    number, below ``sink``. A batch that is handled again after a failure replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            hit = triggered(batch, sign, cls, **pattern)
            if hit.limit(1).count():
                out = query(seen_by(read_log(), batch, sign))
                out.join(hit, out["id"] == hit["subject"], "left_semi").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    return each


def persisted(sink: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps a feed's events, one folder a batch, so that a repeated batch replaces itself."""
    return lambda batch, number: grouped(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")


def ingested(spark: SparkSession, folder: str, log: str, base: str, change_id: Callable[[int], str], time: Callable[[int], str] | None = None, refused: str | None = None) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """(stream, batch handler) that turn uploaded N-Triples files into insertions: a batch is a change, named by ``change_id``
    from its number, so that a repeated batch gives the same records; the same times too if ``time`` names them, else the
    time of writing. Lines that are no statements go to a table below ``refused``, beside the log if no folder is given."""
    refused = refused or f"{log.rstrip('/')}-refused"
    stream = spark.readStream.format("text").load(folder).withColumn("file", F.input_file_name())

    def each(batch: DataFrame, number: int) -> None:
        rows = statements(batch, base, document=F.col("file"), strict=False)
        at = F.lit(time(number)) if time else F.current_timestamp()
        logged(rows, F.lit(change_id(number)), at).write.mode("overwrite").parquet(f"{log}/batch={number}")
        rejected(batch).write.mode("overwrite").parquet(f"{refused}/batch={number}")

    return stream, each


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window and keys, with a watermark for late rows. An extra: the graph model itself has none."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
