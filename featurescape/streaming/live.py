"""Streaming use of the exploration operators.

The reference has no streaming (no watermark, window or state).  What
carries over is that a fitted :class:`EncodeModel` and the filters are
stateless Column logic: they apply unchanged to a streaming DataFrame
(the label dictionary is a stream-static join).  ``surviving_counts``
adds the one stateful piece a live view needs -- total and surviving
items per snapshot window -- as a watermarked windowed aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.operators import filters
from featurescape.operators.encode import EncodeModel


def mark_passive_stream(stream: DataFrame, model: EncodeModel, flt: list,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and flag a micro-batch stream with a model fitted on history;
    ``keep`` carries extra raw columns (an event time, say) through."""
    enc = model.transform(stream, keep)
    return filters.mark_passive(enc, flt)


def surviving_counts(marked: DataFrame, ts_col: str, window: str = "1 day",
                     watermark: str = "1 hour") -> DataFrame:
    """AGG-8 per event-time window, late data bounded by the watermark."""
    return (marked.withWatermark(ts_col, watermark)
                  .groupBy(F.window(ts_col, window).alias("window"))
                  .agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("passive")).alias("surviving")))
