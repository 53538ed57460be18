"""An audit log of a stream: bounded, in files of bounded size, of which the last are kept.

Each micro-batch writes its own folder, named by the batch's id, and a line of counts. A batch
that is run again after a restart overwrites what it wrote before, so that nothing is lost and
nothing is there twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# 1000 waiting rows, 2 MiB a file, five files.
MOST_ROWS, FILE_BYTES, KEEP_FILES = 1000, 2 << 20, 5


@dataclass
class AuditLog:
    """folder/log/batch=N/file=K/part-*: lines of JSON; folder/counts/batch=N: batch, came, written, dropped.

    Of a batch the first most_rows rows by `order` are written, the others counted as dropped.
    Only `fields` are written, as far as the stream has them. A file holds at most file_bytes,
    but for a line that alone is longer; only the last keep_files files stay.
    """

    folder: str
    fields: list[str]
    order: list[str]
    most_rows: int = MOST_ROWS
    file_bytes: int = FILE_BYTES
    keep_files: int = KEEP_FILES

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = [f for f in self.fields if f in batch.columns]
        line = F.to_json(F.struct(*names)) if names else F.lit("{}")
        batch = batch.persist()
        came = batch.count()
        first = batch.orderBy(*self.order).limit(self.most_rows).select(line.alias("value"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(self.order)))
        sized = first.withColumn("_bytes", F.octet_length("value") + 1)
        every = Window.partitionBy()  # at most most_rows rows
        ends = F.sum("_bytes").over(every.orderBy(*(f"_o{i}" for i in range(len(self.order))), "value").rowsBetween(Window.unboundedPreceding, 0))
        # lines whose ends lie in one step of file_bytes, less the longest line, fit a file together
        stride = F.greatest(F.lit(self.file_bytes) - F.max("_bytes").over(every) + 1, F.lit(1))
        filed = sized.withColumn("file", F.floor((ends - 1) / stride))
        filed = filed.repartition("file").sortWithinPartitions("file", *(f"_o{i}" for i in range(len(self.order))), "value")
        filed.select("value", F.format_string("%09d", "file").alias("file")).write.mode("overwrite").partitionBy("file").text(f"{self.folder}/log/batch={batch_id:09d}")
        written = min(came, self.most_rows)
        spark.createDataFrame([(batch_id, came, written, came - written)], "batch long, came long, written long, dropped long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/counts/batch={batch_id:09d}")
        batch.unpersist()
        self._prune(spark)

    def files(self, spark: SparkSession) -> list[str]:
        """The log's files, oldest first."""
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/batch=*/file=*")
        found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top)
        return sorted(s.getPath().toString() for s in found)

    def _prune(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        for old in self.files(spark)[: -self.keep_files]:
            path = jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Runs the log: until the input is used up, or for ever."""
        writer = stream.writeStream.foreachBatch(write or self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
