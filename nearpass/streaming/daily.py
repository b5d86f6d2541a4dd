"""Daily files processed as they arrive, one checkpoint per batch."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..functions.text import file_stem
from ..operators.cleaning import clean_reports
from ..operators.grid import leg_to_grid, with_motion
from ..settings import Airport
from ..sources.files import typed_reports
from ..sources.sinks import write_days


def follow_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, schema, airport: Airport, files_per_batch: int = 8):
    """Start a query that turns every new daily Parquet file into grid rows.

    Each micro-batch holds whole files, hence whole days, so the batch operators
    apply unchanged; a repeated batch overwrites the same day partitions.
    """
    raw = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)
        .withColumn("day", file_stem(F.col("_metadata.file_path")))
    )

    def write(batch, _):
        write_days(with_motion(leg_to_grid(clean_reports(typed_reports(batch), airport))), out)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
