"""A stream over several files, one late and one run twice, ends in the batch result."""

from loomgraph.streaming import changes

ROWS = [(i, f"p{i % 3}", f"2024-01-01 00:{(7 * i) % 60:02d}:00", float(i)) for i in range(30)]


def test_maintain_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id long, path string, ts string, size double").selectExpr("event_id", "path", "cast(ts as timestamp) ts", "size")
    for k in range(3):
        df.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    published = []
    for _ in range(2):  # a restart finds nothing new
        q = changes.maintain(changes.read_changes(spark, f"{tmp_path}/in", "1 hour"), f"{tmp_path}/state", f"{tmp_path}/ck", lambda d, i: published.append(i)).start()
        q.awaitTermination()
    got = {r.path: r.size for r in spark.read.parquet(f"{tmp_path}/state/gen={max(published)}").collect()}
    assert got == {r.path: r.size for r in changes.latest(df).collect()} and published == sorted(set(published))


def test_fold_by_quiet_time(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:05"), (3, "a", "2024-01-01 00:01:00")], "event_id long, path string, ts string").selectExpr("event_id", "path", "cast(ts as timestamp) ts")
    assert sorted(r.n for r in changes.fold(df, "10 seconds").collect()) == [1, 2]
