"""Follow directories of outline files with Structured Streaming.

The file source reports files that appear; edits in place and deletions it does not see. Each micro-batch is therefore
only the signal for a refresh, which compares all files with the manifest and touches what changed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from outlinelake.plans.catalog import refresh


def watch(spark: SparkSession, directory: str, path: str, checkpoint: str, pattern: str = "*.org", **trigger) -> StreamingQuery:
    """Refresh the database at path whenever new files appear; trigger as for DataStreamWriter.trigger()."""
    arrivals = spark.readStream.schema("value string").format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    return arrivals.writeStream.foreachBatch(lambda *_: refresh(spark, [directory], path, pattern) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
