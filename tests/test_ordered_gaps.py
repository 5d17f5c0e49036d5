"""Counter gaps in event time: rows that come in other micro-batches than their neighbours give no false gap."""

import random
from datetime import datetime, timedelta

from kinespark.streaming import streams


def test_late_rows_take_their_place(spark, tmp_path):
    rng = random.Random(3)
    start, rows = datetime(2024, 1, 1), []
    for key in (1, 2, 3):
        lost = set(rng.sample(range(5, 390), 12))
        rows += [(key, start + timedelta(seconds=10 * k), k) for k in range(400) if k not in lost]
    # batches by arrival: up to five minutes after the event
    arrival = sorted((t + timedelta(seconds=rng.randrange(300)), k, t, c) for k, t, c in rows)
    size = len(arrival) // 6 + 1
    for b in range(6):
        part = [(k, t, c) for _, k, t, c in arrival[b * size : (b + 1) * size]]
        spark.createDataFrame(part, "device long, at timestamp, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # a row far ahead for every device moves the watermark over all others; a hopelessly late one is left out
    end = start + timedelta(days=1)
    spark.createDataFrame([(k, end, 10**6) for k in (1, 2, 3)], "device long, at timestamp, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, start, 0), (None, None, None)], "device long, at timestamp, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("device long, at timestamp, n long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    made = streams.ordered_gap_stream(source, "device", "at", "n")
    made.writeStream.format("memory").queryName("ordered_gaps").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.device, r.prev, r.next) for r in spark.table("ordered_gaps").collect() if r.next < 10**6)
    want = []
    for key in (1, 2, 3):
        kept = sorted(c for k, _, c in rows if k == key)
        want += [(key, a, b) for a, b in zip(kept, kept[1:], strict=False) if b != a + 1]
    assert got == sorted(want)
