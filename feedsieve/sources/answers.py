"""Answers of the model that outlive a run, so that no text is asked for twice."""

import uuid
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

ANSWER = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("label", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)

# Output of a task is kept as soon as the task ends, also where its job fails later.
_KEEP_FINISHED_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


@dataclass
class AnswerTable:
    """Parquet folder of ``(key, label, error, run)``; rows are only ever added.

    The key is the digest of prompt, reply schema and text.  Rows without a label are
    requests that failed in a run; they tell that run why, and are asked again by the
    next.  Where two runs at a time answered one text differently, the smaller label
    counts, for all readers alike.
    """

    path: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def add(self, answered):
        """Store ``(key, label, error)`` rows as those of this run."""
        self.run = uuid.uuid4().hex
        rows = answered.select("key", "label", "error", F.lit(self.run).alias("run"))
        rows.write.mode("append").options(**_KEEP_FINISHED_TASKS).parquet(self.path)

    def _rows(self, spark):
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], ANSWER)
        return spark.read.schema(ANSWER).parquet(self.path)

    def known(self, spark):
        """Keys that have an answer."""
        return self._rows(spark).where("label is not null").select("key")

    def latest(self, spark):
        """One row per key: its answer, or why the last run has none."""
        rows = self._rows(spark).where((F.col("label").isNotNull()) | (F.col("run") == self.run))
        return rows.groupBy("key").agg(F.min("label").alias("label"), F.max("error").alias("error"))
