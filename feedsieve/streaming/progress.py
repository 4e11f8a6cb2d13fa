"""What each batch did: number, outcome, rows per stage, rows stored."""

from dataclasses import dataclass

from pyspark.sql import types as T

from ..session import path_exists
from ..sources.post_tables import ALL_FILES, batch_path

STAGES = ("found", "extracted", "scraped", "classified", "appended")

PROGRESS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
        *(T.StructField(stage, T.LongType()) for stage in STAGES),
        T.StructField("stored", T.LongType()),
    ]
)


@dataclass(frozen=True)
class ProgressTable:
    """Parquet folder with one row per batch; an attempt replaces the one before it.

    ``stored`` is counted in the files of the batch, not on the way to them.  The counts
    per stage are null for a batch that went to the dead letters.
    """

    path: str

    def record(self, spark, run_id, batch_id, outcome, counts, sink):
        stored = sink.batch_total(spark, run_id, batch_id)
        row = (run_id, batch_id, outcome, *(counts.get(stage) for stage in STAGES), stored)
        table = spark.createDataFrame([row], PROGRESS).coalesce(1)
        table.write.mode("overwrite").parquet(batch_path(self.path, run_id, batch_id))

    def read(self, spark):
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], PROGRESS)
        return spark.read.schema(PROGRESS).options(**ALL_FILES).parquet(self.path)
