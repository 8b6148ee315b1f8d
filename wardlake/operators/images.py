"""Medical image intake and metrics.

Spark's ``image`` data source decodes the files (BGR bytes per pixel).  The
per-image gray mean/std is a numpy reduction over each image's pixel buffer,
run with ``mapInPandas`` on Arrow batches; the decision rule (H34) then is a
plain column expression over the metrics table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C

METRICS_SCHEMA = "origin string, width int, height int, brightness double, contrast double"


def read_images(spark: SparkSession, path: str, max_bytes: int = K.IMAGE_MAX_BYTES) -> DataFrame:
    """Decodable images under ``path`` no larger than ``max_bytes``."""
    sizes = (spark.read.format("binaryFile").load(path)
             .filter(F.col("length") <= max_bytes).select(_uri(F.col("path")).alias("_u")))
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return img.join(sizes, _uri(F.col("origin")) == F.col("_u"), "left_semi")


def _uri(c):
    """One spelling for local file URIs (file:/x and file:///x)."""
    return F.regexp_replace(c, "^file:/+", "file:///")


def _metrics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for origin, w, h, n, data in zip(pdf["origin"], pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"]):
            px = np.frombuffer(bytes(data), dtype=np.uint8).astype(np.float64)
            if n >= 3:
                px = px.reshape(-1, n)
                gray = 0.299 * px[:, 2] + 0.587 * px[:, 1] + 0.114 * px[:, 0]  # BGR order
            else:
                gray = px
            rows.append((origin, int(w), int(h), float(gray.mean()) if gray.size else 0.0,
                         float(gray.std()) if gray.size else 0.0))
        yield pd.DataFrame(rows, columns=["origin", "width", "height", "brightness", "contrast"])


def image_metrics(images: DataFrame) -> DataFrame:
    """brightness = mean gray level, contrast = population std."""
    return images.select("origin", "width", "height", "nChannels", "data").mapInPandas(_metrics, METRICS_SCHEMA)


def image_findings(metrics: DataFrame, modality: str | None = None) -> DataFrame:
    """Modality normalisation, abnormal flag and confidence per image."""
    m = F.lit(modality) if modality is not None else F.lit(K.IMAGE_DEFAULT_MODALITY)
    return metrics.select(
        "origin", C.image_modality(m).alias("modality"), "brightness", "contrast",
        F.when(C.image_abnormal(F.col("brightness"), F.col("contrast")), "abnormal").otherwise("normal").alias("category"),
        F.round(C.image_confidence(F.col("brightness")), 3).alias("confidence"))
