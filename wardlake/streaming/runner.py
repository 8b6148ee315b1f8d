"""Starting a streaming query with a durable checkpoint.

The checkpoint (offsets, commits, state store) goes under the shared folder
named by ``spark.checkpoint.dir`` unless the caller names one, so a restarted
query resumes where it stopped after an executor or driver loss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardlake.session import scratch_dir


def start(df: DataFrame, sink: str, mode: str, name: str | None = None, checkpoint: str | None = None,
          available_now: bool = True, path: str | None = None) -> StreamingQuery:
    """Start ``df`` into ``sink`` ('memory', 'parquet', ...) in output ``mode``."""
    name = name or f"wardlake_{uuid.uuid4().hex[:8]}"
    checkpoint = checkpoint or scratch_dir(df.sparkSession, f"streams/{name}")
    w = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
    if path:
        w = w.option("path", path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
