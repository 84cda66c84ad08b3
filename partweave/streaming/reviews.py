"""Streaming extensions: decisions as they arrive become rules; log rows are counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partweave.functions.text import norm_canonical
from partweave.operators.rules import decision_of


def rules_from_decisions(decisions: DataFrame) -> DataFrame:
    """(rule_type, store_key, supplier_key) of readable decisions on (store_part_number, supplier_part_number,
    decision); works on a batch and on a stream."""
    status = decision_of(F.col("decision"))
    rows = decisions.select(
        F.when(status == "CONFIRMED", "POSITIVE_MAP").when(status == "REJECTED", "NEGATIVE_BLOCK").alias("rule_type"),
        norm_canonical(F.col("store_part_number")).alias("store_key"),
        norm_canonical(F.col("supplier_part_number")).alias("supplier_key"),
    )
    return rows.filter("rule_type is not null and store_key <> '' and supplier_key <> ''")


def learn_stream(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rules of each micro-batch to the table at ``path``; a batch run again overwrites its own part only,
    so each decision counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        rules_from_decisions(batch).distinct().write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, kind, n, total): counts and sums in tumbling windows of event time; rows later than ``late`` are out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), kind, "n", "total")
