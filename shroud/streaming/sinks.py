"""Several sinks from one pass over a stream, each batch committed once.

Every micro-batch is worked out once and written to all sinks, each in its own
folder `<base>/<sink>/batch_id=<n>`. Writing overwrites that folder, so a batch
that is done again after a failure replaces what its first try left behind. When
all sinks are written, the batch's row in `<base>/commits` makes it visible:
readers take committed batches only, so they see a batch in all sinks or in none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def run_sinks(stream: DataFrame, base: str, outputs: dict[str, Callable[[DataFrame], DataFrame]],
              prepare: Callable[[DataFrame, int | None], DataFrame] | None = None, high_water: Column | None = None) -> None:
    """Drains the stream into the sinks. `prepare(batch, mark)` is worked out first
    and shared by the sinks; `mark` is the largest `high_water` (a bigint aggregate)
    of the batches committed before, None at the start. Nothing of it is kept in
    memory between batches: a restarted query reads the marks from the commits."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if high_water is not None and (done := committed(spark, base)) is not None:
            mark = done.where(F.col("batch_id") < batch_id).agg(F.max("mark")).first()[0]
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        shared = batch if prepare is None else prepare(batch, mark).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, of in outputs.items():
                of(shared).write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
            reached = F.lit(None).cast("bigint") if high_water is None else high_water.cast("bigint")
            batch.agg(reached.alias("mark")).write.mode("overwrite").parquet(f"{base}/commits/batch_id={batch_id}")
        finally:
            shared.unpersist()
            batch.unpersist()

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def committed(spark: SparkSession, base: str) -> DataFrame | None:
    """(batch_id, mark) of the committed batches, None before the first."""
    try:
        return spark.read.schema("mark bigint, batch_id bigint").parquet(f"{base}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_sink(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of all committed batches of a sink."""
    return spark.read.parquet(f"{base}/{name}").join(committed(spark, base).select("batch_id"), "batch_id", "left_semi").drop("batch_id")
