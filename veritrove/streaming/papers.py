"""Papers as a stream.

The analyzers are column expressions without a shuffle, so they run on a stream as they are; a report
row leaves as soon as its paper has come in.  Counts over time are windowed, with a watermark for
late papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrove.analyzers import ANALYZERS, papers
from veritrove.sources.scratch import Scratch
from veritrove.sources.tables import table


def table_stream(spark: SparkSession, folder: str, name: str, files_at_once: int = 16) -> DataFrame:
    """The table ``name`` of ``folder`` read file by file as a stream."""
    schema = table(spark, folder, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def reports(stream: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The report of one analyzer for every paper of a stream."""
    return ANALYZERS[name](papers(stream, id_col, text_col, **columns))


def flag_counts(stream: DataFrame, name: str, time_col: str, window: str = "7 days", late: str = "2 days", **columns: str) -> DataFrame:
    """Papers and flags by window of ``time_col``; rows later than ``late`` behind the newest are left out.

    A replayed paper (same id and time) counts once: duplicates are dropped within the watermark.
    """
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).where("_at is not null")
    timed = timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["doc_id", "_at"])
    # the time goes along with the id through the analyzer
    carried = papers(timed.withColumn("_key", F.struct(F.col("doc_id"), F.col("_at"))), "_key", **columns)
    report = ANALYZERS[name](carried).select(F.col("id._at").alias("_at"), F.size("flags").alias("n"), "risk_level")
    return report.groupBy(F.window("_at", window), "risk_level").agg(F.count("*").alias("n_papers"), F.sum("n").alias("n_flags"))


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now, and give what it wrote."""
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{scratch.root}/out").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.root}/out")


def run_updates(stream: DataFrame, key: str, label: str) -> DataFrame:
    """Run a stream of aggregates over what is there now, and give the last state of every ``key``.

    The stream hands over what has changed in each batch, so windows that are still open are there as well, and
    state behind the watermark is dropped as usual.  A batch that is run again replaces what it wrote before.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    shape = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    spark.createDataFrame([], shape).write.parquet(f"{scratch.root}/out/none")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{scratch.root}/out/{number}")

    query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(f"{scratch.root}/out")
    columns = [c for c in stream.columns if c != key]
    last = written.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("last"))
    return last.select(key, *(f"last.{c}" for c in columns)).select(*stream.columns)
