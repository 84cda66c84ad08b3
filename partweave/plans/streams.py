"""A streaming query run to its end over the table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.session import Workspace
from partweave.streaming.reviews import windowed_counts


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, read as a stream and written to the shared folder; in append mode a window comes out
    once the watermark has passed it, so the last day of the data stays open."""
    source = f"{folder}/events.parquet"
    schema = spark.read.parquet(source).schema
    ws = Workspace(spark, "stream")
    out, name = f"{ws.root}/windows", uuid.uuid4().hex
    stream = spark.readStream.schema(schema).parquet(f"{source}*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed_counts(stream, late="0 seconds", width="1 day")
    query = counted.writeStream.queryName(f"w{name}").outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{ws.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {"stream_windows": stream_windows}

SQL = {
    "stream_windows": """WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
}
