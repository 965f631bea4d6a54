"""Streaming L1–L5/L8 equal the batch operators on the same lines."""

import time

from svcseam.operators import logs as L
from svcseam.sources import fixtures as FX
from svcseam.streaming import logs as SL


def test_stream_equals_batch(spark, sf_small, tmp_path):
    lines = FX.log_lines(spark, sf_small)
    src = str(tmp_path / "lines")
    # four files appended in line order (the file source reads oldest first),
    # so each micro-batch continues every session where the previous one ended
    bounds = lines.selectExpr("percentile_approx(line_no, array(0.25, 0.5, 0.75))").collect()[0][0]
    edges = [-1, *bounds, 1 << 62]
    for lo, hi in zip(edges, edges[1:]):
        lines.filter((lines.line_no > lo) & (lines.line_no <= hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ev = SL.stream_events(stream)
    ck = str(tmp_path / "ck")
    q1 = (SL.stream_correlation(ev).writeStream.format("memory").queryName("corr_out")
          .option("checkpointLocation", ck + "/a").outputMode("append").start())
    q2 = (SL.stream_table_frequency(ev).writeStream.format("memory").queryName("tf_out")
          .option("checkpointLocation", ck + "/b").outputMode("complete").start())
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
    finally:
        q1.stop()
        q2.stop()
    got = spark.sql("SELECT * FROM corr_out")
    want = L.log_correlation(L.log_events(spark.read.parquet(src)))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    tf = spark.sql("SELECT * FROM tf_out")
    want_tf = L.table_frequency(L.log_events(spark.read.parquet(src)))
    assert tf.exceptAll(want_tf).count() == 0 and want_tf.exceptAll(tf).count() == 0
