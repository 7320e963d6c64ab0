"""The pipeline over whatever files arrived since the last run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tradewind.functions.columns import utc_now
from tradewind.functions.columns import as_of_timestamp
from tradewind.operators import validation
from tradewind.plans import ingest, pipeline
from tradewind.rules import TableNames
from tradewind.session import path_exists
from tradewind.sources import ops


def arrivals(
    spark: SparkSession, folder: str, schema: StructType, file_format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Files of ``folder`` as a stream; ``maxFilesPerTrigger`` bounds a batch."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(folder)


def load_arrivals(
    stream: DataFrame, path: str, source: str, after: Callable[[], None] | None = None
) -> DataFrame:
    """Validate and store all files not seen yet, then stop; return the accepted rows.

    A batch goes to a folder named after its number and replaces what a failed
    attempt left there, so a batch that runs twice is stored once. ``after``
    runs once per batch, for checks and models over the rows stored so far.
    """
    accepted, refused = f"{path}/accepted", f"{path}/quarantine"

    def store(batch: DataFrame, number: int) -> None:
        run_id, at = f"batch-{number}", utc_now()
        checked = validation.with_reason(batch)
        good = ingest.add_lineage(validation.accepted(checked), source, run_id, at)
        good.write.mode("overwrite").parquet(f"{accepted}/_batch={number}")
        bad = validation.quarantine_rows(checked, run_id, source, as_of_timestamp(at))
        bad.write.mode("overwrite").parquet(f"{refused}/_batch={number}")
        if after is not None:
            after()

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(accepted)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


#: Of a stored batch, in microseconds: the newest moment of all rows, oldest and newest of those in time.
_SPAN = ("newest", "first", "last")


def _stored_spans(stream: DataFrame, stored: str, spans: str, moment: str) -> dict[int, tuple]:
    """``_SPAN`` by batch; of batches stored without a span, that of their rows."""
    spark, found = stream.sparkSession, {}
    number = StructField("_batch", LongType())
    if path_exists(spark, spans):
        kinds = StructType([*(StructField(n, LongType()) for n in _SPAN), number])
        found = {r["_batch"]: tuple(r[n] for n in _SPAN) for r in spark.read.schema(kinds).parquet(spans).collect()}
    if path_exists(spark, stored):
        rows = spark.read.schema(StructType([*stream.schema, number])).parquet(stored)
        at = F.unix_micros(F.col(moment).cast("timestamp"))
        known_at = F.coalesce(at, F.lit(0))
        rest = rows.filter(~F.col("_batch").isin(list(found))).groupBy("_batch").agg(
            F.max(at), F.min(known_at), F.max(known_at))
        found |= {n: tuple(span) for n, *span in rest.collect()}
    return found


def distinct_arrivals(
    stream: DataFrame, path: str, keys: Sequence[str], moment: str, delay: str
) -> tuple[DataFrame, int]:
    """Store the rows of all files not seen yet, repeats once; (all rows stored, rows too late).

    Rows with equal ``keys`` whose ``moment`` is at most ``delay`` apart are one. What is stored tells
    which keys were seen; a key counts until the newest moment is ``delay`` ahead of it, and stored
    batches that are past that, or hold no moment of the batch at hand, are not read. Both are joined
    by sorting, so neither has to fit in memory. Rows older than that are counted and
    left out, since their first copy may be forgotten; time moves on from batch to batch. With ``keys`` that identify a row,
    newest rows per key of what is stored are those of all rows in time.

    Time is that of Spark's watermarks: a batch is judged by the batches up to the last but one before
    it, the first batch of a call by all before it, and nothing is in time up to 1970.
    """
    stored, spans = f"{path}/distinct", f"{path}/distinct-spans"
    spark = stream.sparkSession
    timed = stream.withColumn("_moment", F.col(moment).cast("timestamp"))
    checked = timed.withWatermark("_moment", delay).schema["_moment"]
    delay_us = checked.metadata["spark.watermarkDelayMs"] * 1000
    seen = _stored_spans(stream, stored, spans, moment)
    late: dict[int, int] = {}

    def limit(until: int) -> int:
        """The moment up to which rows are late, judged by the batches before ``until``."""
        newest = [s[0] for n, s in seen.items() if n < until and s[0] is not None]
        return max(0, max(newest, default=0) // 1000 * 1000 - delay_us)

    def store(batch: DataFrame, number: int) -> None:
        over = limit(number - 1 if late else number)
        at = F.unix_micros("_moment")
        in_time = at.isNull() | (at > over)
        newest, first, last, undated, too_late = batch.agg(
            F.max(at), F.min(F.when(in_time, at)), F.max(F.when(in_time, at)),
            F.count_if(at.isNull()), F.count_if(~in_time),
        ).first()
        if undated:  # they count as 1970
            first, last = min(0, first or 0), max(0, last or 0)

        def may_repeat(span: tuple) -> bool:
            """The batch stored has keys that still count, of moments as in this one."""
            _, start, end = span
            if first is None or start is None or end + delay_us <= over:
                return False
            return moment not in keys or (start <= last and first <= end)

        code, columns = F.xxhash64(*map(_named, keys)), [(_named(k), f"_known_{i}") for i, k in enumerate(keys)]
        fresh = batch.filter(in_time).withColumn("_code", code)
        before = [f"{stored}/_batch={n}" for n, span in seen.items() if n < number and may_repeat(span)]
        if before:
            known_at = F.coalesce(F.unix_micros(F.col(moment).cast("timestamp")), F.lit(0))
            counts = known_at + delay_us > over
            if moment in keys:
                counts &= known_at.between(first, last)
            known = batch.sparkSession.read.schema(stream.schema).parquet(*before).filter(counts).select(
                code.alias("_known"), *(c.alias(n) for c, n in columns))
            same = reduce(Column.__and__, (c.eqNullSafe(F.col(n)) for c, n in columns))
            fresh = fresh.join(known.hint("merge"), (F.col("_code") == F.col("_known")) & same, "left_anti")
        once = fresh.dropDuplicates(["_code", *keys]).drop("_code", "_moment")
        once.write.mode("overwrite").parquet(f"{stored}/_batch={number}")
        seen[number], late[number] = (newest, first, last), too_late
        span = zip(_SPAN, seen[number], strict=True)
        batch.sparkSession.range(1, numPartitions=1).select(
            *(F.lit(v).cast("long").alias(n) for n, v in span)
        ).write.mode("overwrite").parquet(f"{spans}/_batch={number}")

    query = (
        timed.writeStream.option("checkpointLocation", f"{path}/distinct-progress")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(stored), sum(late.values())


def publish(spark: SparkSession, path: str, table: str) -> None:
    """Make what ``load_arrivals`` stored under ``path`` readable as a Bronze table."""
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=f"{path}/accepted", source="parquet")
    spark.catalog.recoverPartitions(table)


def stream_cycle(
    spark: SparkSession, streams: dict[str, DataFrame], path: str, as_of=None,
    names: TableNames = TableNames(), options: pipeline.Options = pipeline.Options(),
) -> dict:
    """One round over new files of each entity: store, check Bronze, rebuild Silver and Gold."""
    for entity, stream in streams.items():
        table = names.bronze(entity)
        load_arrivals(stream, f"{path}/{entity}", f"FILES_{entity.upper()}")
        publish(spark, f"{path}/{entity}", table)
    health = pipeline.check_quality(spark, [names.bronze(e) for e in streams], as_of, code=names.code)
    ops.compact(spark)
    transform = pipeline.run_all(spark, as_of, names, options=options)
    return {"health": health, "transform": transform}


def run_cycle(
    spark: SparkSession, origin, as_of=None, names: TableNames = TableNames(),
    options: pipeline.Options = pipeline.Options(),
) -> dict:
    """One round: sync every source table, check Bronze, rebuild Silver and Gold."""
    synced = ingest.sync_all(spark, origin)
    health = pipeline.check_all_bronze(spark, as_of, names.code)
    ops.compact(spark)
    return {
        "tables_synced": len(synced),
        "health": health,
        "transform": pipeline.run_all(spark, as_of, names, options=options),
    }
