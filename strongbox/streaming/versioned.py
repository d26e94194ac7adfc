"""State of a stream that is kept as one table version per micro-batch."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strongbox.filesystem import delete_folder, folders

Emit = Callable[[DataFrame, DataFrame], DataFrame]  # batch, state before -> output
Carry = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]  # batch, state before, output -> state after


@dataclass(frozen=True)
class VersionedState:
    """Version n is what micro-batch n left behind.

    A batch that is run again reads version n - 1 and replaces its own output and version, so the
    result is the same as if it had run once.
    """

    folder: str
    schema: T.StructType

    def version(self, spark: SparkSession, batch: int) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.folder}/state/version={batch:09d}")

    def run(self, stream: DataFrame, carry: Carry, emit: Emit | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Starts the stream. The state after a batch is derived from its output as written."""

        def each(batch: DataFrame, n: int) -> None:
            spark, output = batch.sparkSession, None
            before = self.version(spark, n - 1)
            if emit is not None:
                emitted, path = emit(batch, before), f"{self.folder}/output/batch={n:09d}"
                emitted.write.mode("overwrite").parquet(path)
                output = spark.read.schema(emitted.schema).parquet(path)
            after = carry(batch, before, output).select(*self.schema.names)
            after.write.mode("overwrite").parquet(f"{self.folder}/state/version={n:09d}")
            # Batch n can only be repeated from version n - 1.
            delete_folder(f"{self.folder}/state/version={n - 2:09d}")

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def last(self, spark: SparkSession) -> DataFrame:
        """The state after the last batch: the newest of the two versions that are kept."""
        kept = [int(p.rsplit("=", 1)[1]) for p in folders(f"{self.folder}/state")]
        return self.version(spark, max(kept, default=-1))

    def output(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """What all batches have put out."""
        return spark.read.schema(schema).parquet(f"{self.folder}/output").select(*schema.names)
