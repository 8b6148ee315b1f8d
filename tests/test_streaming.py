"""Structured Streaming variants give the batch answers (availableNow)."""

import os
import uuid

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from wardlake.operators import chat as CH
from wardlake.operators import dashboard as D
from wardlake.sources import fixtures as V
from wardlake.streaming.sessions import session_state_stream
from wardlake.streaming.trends import REPORT_STREAM_SCHEMA, emergency_trend_stream, report_stream


def _run(df, mode, tmp_dir, name):
    from wardlake.streaming.runner import start

    q = start(df, "memory", mode, name=name, checkpoint=os.path.join(tmp_dir, "ckpt-" + name))
    q.awaitTermination(600)
    return df.sparkSession.table(name)


def test_emergency_trend_stream_equals_batch(spark, tmp_dir):
    reports = V.reports_v(spark, SF_SMALL).select("case_id", "priority", "generated_at")
    folder = os.path.join(tmp_dir, "reports")
    # appended in several files, as a report service would
    reports.repartition(4).write.parquet(folder)
    name = "trend_" + uuid.uuid4().hex[:8]
    out = _run(emergency_trend_stream(report_stream(spark, folder, REPORT_STREAM_SCHEMA, max_files=1)),
               "complete", tmp_dir, name)
    batch = D.emergency_trends(V.reports_v(spark, SF_SMALL))
    assert "unknown" in {r["date"] for r in batch.collect()}
    assert sorted(rows(out, "date", "priority", "count")) == sorted(rows(batch, "date", "priority", "count"))


def test_session_state_stream_equals_batch(spark, tmp_dir):
    m = V.messages_v(spark, SF_SMALL)
    folder = os.path.join(tmp_dir, "messages")
    # two arrivals, turns of a session out of order
    m.filter("(turn + session_id) % 2 = 0").write.parquet(folder + "/a=1")
    m.filter("(turn + session_id) % 2 = 1").write.parquet(folder + "/a=2")
    src = (spark.readStream.schema("session_id long, turn long, message string")
           .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder))
    name = "sessions_" + uuid.uuid4().hex[:8]
    out = _run(session_state_stream(src), "append", tmp_dir, name)
    last = out.groupBy("session_id", "turn").agg(F.max_by("state", "revision").alias("state"))
    assert sorted(rows(last)) == sorted(rows(CH.session_states(m), "session_id", "turn", "state"))
