"""The unified schema as a stream: label counts over event time, and translation batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexeum.operators.translation import Translator


def label_counts(stream: DataFrame, time: str, label: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Annotated and positive rows in tumbling windows; rows later than the watermark are left out."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("window")).agg(F.count(label).alias("total"), F.count_if(F.col(label) == 1.0).alias("positive")).select("window.start", "window.end", "total", "positive")


def translate_stream(stream: DataFrame, translator: Translator, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the translator and its cache to a folder of its own, so that a batch run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        translator.translate(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
