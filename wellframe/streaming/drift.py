"""An extension: image summaries of objects as they arrive.

Exact medians need all of an image's rows, so images are summarised once the
watermark has passed them; late rows beyond it are left out, as the watermark says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_summaries(objects: DataFrame, time: str, image: str, features: Sequence[str], late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window, image, n_objects and the mean of each feature, for a streaming (or plain) DataFrame."""
    timed = objects.withWatermark(time, late) if objects.isStreaming else objects
    return timed.groupBy(F.window(time, window), image).agg(F.count(F.lit(1)).alias("n_objects"), *[F.avg(F.col(f).cast("double")).alias(f) for f in features])
