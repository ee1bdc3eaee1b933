"""The life of tasks in a stream, across restarts."""

import datetime as dt

from quillspark.streaming import lifecycle

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_leases_hold_expired_tasks(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def step(*rows):
        """One more file, then the stream from its checkpoint: each call is a restart."""
        spark.createDataFrame([(t, s, k, lease, at(h)) for t, s, k, lease, h in rows], lifecycle.CHANGES).coalesce(1).write.mode("append").parquet(source)
        changes = spark.readStream.schema(lifecycle.CHANGES).parquet(source)
        return lifecycle.run(changes, out, state, retention_seconds=24 * 3600, delay="0 seconds")

    events = step((1, 1, "pending", None, 0), (1, 2, "processing", None, 1), (1, 3, "completed", None, 2), (1, 4, "acquire", "a", 3), (1, 5, "acquire", "b", 3), (2, 1, "pending", None, 0), (2, 3, "failed", None, 2), (2, 2, "processing", None, 1), (3, 1, "pending", None, 0), (4, 9, "acquire", "x", 0))
    live = {r.task_id: (r.status, r.readers, r.started_at is not None) for r in lifecycle.live(events).collect()}
    assert live == {1: ("completed", 2, True), 2: ("failed", 0, True), 3: ("pending", 0, False)}
    # a terminal status stays, an older change has no effect; the watermark passes the retention of 1 and 2
    events = step((3, 2, "processing", None, 40), (1, 6, "processing", None, 40), (2, 2, "pending", None, 40))
    events = step((3, 3, "processing", None, 41))
    live = {r.task_id: (r.status, r.readers) for r in lifecycle.live(events).collect()}
    assert live == {1: ("completed", 2), 3: ("processing", 0)}
    assert [(r.task_id, r.at) for r in events.where("event = 'removed'").collect()] == [(2, at(26).replace(tzinfo=None))] or [r.task_id for r in events.where("event = 'removed'").collect()] == [2]
    # the first of two leases given back: it stays; a lease that is none changes nothing
    events = step((1, 7, "release", "a", 42), (1, 8, "release", "zzz", 42))
    assert {r.task_id: r.readers for r in lifecycle.live(events).collect()} == {1: 1, 3: 0}
    events = step((1, 9, "release", "b", 43))
    assert {r.task_id for r in lifecycle.live(events).collect()} == {3}
    assert sorted(r.task_id for r in events.where("event = 'removed'").collect()) == [1, 2]
    # what comes after the removal is a new task
    events = step((1, 10, "pending", None, 44))
    assert {r.task_id: r.status for r in lifecycle.live(events).collect()} == {1: "pending", 3: "processing"}


def test_windows_of_pages_in_any_order(spark, tmp_path):
    """Windows of a stream equal those of the table, also across restarts; an error cancels what is open and later."""
    import random

    from pyspark.sql import functions as F

    from quillspark.operators import layout
    from quillspark.streaming import windows

    rng = random.Random(4)
    sizes = {1: 20, 2: 3, 3: 8, 4: 17, 5: 1, 6: 30}
    rows = [(d, p, n, None) for d, n in sizes.items() for p in range(n)]
    rows += rows[:9]
    rng.shuffle(rows)
    rows.append((6, 25, 30, "late"))
    rows.insert(40, (4, 9, 17, "broken"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.STORE)
    try:
        for part in (rows[:40], rows[40:70], rows[70:]):
            spark.createDataFrame(part, windows.PAGES).repartition(2).write.mode("append").parquet(source)
            found = windows.page_windows(spark.readStream.schema(windows.PAGES).parquet(source), 8, 2, 17)
            found.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    events = spark.read.parquet(out).collect()
    failed = {r.doc: r.error for r in events if r.event == "failed"}
    assert failed == {4: "broken", 6: "late"} and len([r for r in events if r.event == "failed"]) == 2
    table = layout.page_windows(spark.createDataFrame(list(sizes.items()), "doc long, n_pages long"), "n_pages", F.lit(2), F.lit(17), 8)
    want = {(r.doc, r.window_id, r.a, r.b) for r in table.groupBy("doc", "window_id").agg(F.min("page_idx").alias("a"), F.max("page_idx").alias("b")).collect()}
    got = [(r.doc, r.window_id, r.first, r.last) for r in events if r.event == "window"]
    assert len(got) == len(set(got)) and set(got) <= want and {w for w in want if w[0] not in failed} <= set(got)
    assert not {w for w in got if w[0] == 4 and w[1] == 1}
