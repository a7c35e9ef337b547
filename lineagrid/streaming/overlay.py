"""Edit events over schema trees: the last event of a file wins.

Batch: one pass with an aggregate by file. Stream: each micro-batch upserts
the open buffers, and the projects it touched are checked anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import projects
from ..sources.files import overlaid

EVENTS = "seq bigint, project string, file string, event string, text string"


def latest(events: DataFrame) -> DataFrame:
    """``project, file, content`` of open buffers: the last event by ``seq``, unless it closes the file."""
    last = events.groupBy("project", "file").agg(F.max_by(F.struct("event", "text"), "seq").alias("e"))
    text = F.replace(F.col("e.text"), F.lit("\r\n"), F.lit("\n"))
    return last.where("e.event != 'close'").select("project", "file", F.encode(text, "UTF-8").alias("content"))


class OverlaySession:
    """Keeps the buffers of a stream of edit events and re-checks what they touch.

    Buffers are a table beside the checkpoint, written anew by each micro-batch
    under its number, so a restarted or repeated batch finds what the one
    before it left. ``publish(batch_id, diagnostics)`` receives the diagnostics
    of the touched projects. A batch that cannot be checked is reported and
    does not stop the stream.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, publish: Callable[[int, DataFrame], None], state: str):
        self.spark, self.files, self.publish, self.state = spark, files, publish, state.rstrip("/")
        self.failures: list[tuple[int, str]] = []

    def buffers(self, before: int | None = None) -> DataFrame:
        """The last event of each file after all batches, or those before a number."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        held = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        whole = {int(p.getName()): p for p in held if p.getName().isdigit() and fs.exists(p.suffix("/_SUCCESS"))}
        numbers = [n for n in whole if before is None or n < before]
        if not numbers:
            return self.spark.createDataFrame([], EVENTS)
        for n in sorted(numbers)[:-2]:
            fs.delete(whole[n], True)
        return self.spark.read.schema(EVENTS).parquet(f"{self.state}/{max(numbers)}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        held = batch.select("seq", "project", "file", "event", "text")
        every = self.buffers(batch_id).unionByName(held)
        last = every.groupBy("project", "file").agg(F.max_by(F.struct("seq", "event", "text"), "seq").alias("e"))
        kept = last.select("e.seq", "project", "file", "e.event", "e.text")
        kept.write.mode("overwrite").parquet(f"{self.state}/{batch_id}")
        touched = held.select("project").distinct()
        try:
            now = overlaid(self.files, latest(self.buffers(batch_id + 1))).join(touched, "project", "left_semi")
            self.publish(batch_id, projects.check(now))
        except Exception as e:  # one bad batch must not end the session
            self.failures.append((batch_id, str(e)))

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
