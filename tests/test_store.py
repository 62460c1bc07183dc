"""Snapshots: seen whole or not at all, and left alone while they are read."""

import threading

from pyspark.sql import functions as F

from graphloom.operators import store as T


def test_a_reader_sees_one_version_while_the_id_is_put_again(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    assert T.current_snapshot(spark, root) is None and T.snapshots(spark, root).count() == 0
    rows = lambda v: spark.range(50).select("id", F.lit(v).alias("v"))
    T.put_snapshot({"nodes": rows(1)}, "s", "2024-01-01", root)
    reader = T.of_snapshot(spark, root, "nodes", "s")
    T.put_snapshot({"nodes": reader.withColumn("v", F.lit(2))}, "s", "2024-01-02", root)  # from what it replaces
    assert [r["v"] for r in reader.select("v").distinct().collect()] == [1]
    assert [r["v"] for r in T.of_snapshot(spark, root, "nodes", "s").select("v").distinct().collect()] == [2]
    assert [(r["id"], r["created_at"]) for r in T.snapshots(spark, root).collect()] == [("s", "2024-01-02")]


def test_nothing_is_seen_before_its_commit(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    T.put_snapshot({"nodes": spark.range(3)}, "one", "2024-01-01", root)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    try:
        T.put_snapshot({"edges": spark.range(3), "nodes": bad}, "two", "2024-01-02", root)
    except Exception as failed:  # noqa: BLE001 (whatever a failed job raises)
        assert "no" in str(failed)
    assert T.current_snapshot(spark, root) == "one" and T.snapshots(spark, root).count() == 1


def test_a_number_is_taken_once(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    T.put_snapshot({"nodes": spark.range(1)}, "first", "2024-01-01", root)
    assert not T._publish(spark, root, 1, {"number": 1, "id": "late", "created_at": "2024-01-02", "data": "x", "tables": []})
    threads = [threading.Thread(target=T.put_snapshot, args=({"nodes": spark.range(i)}, f"t{i}", "2024-01-03", root)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = T.commits(spark, root).collect()
    assert sorted(r["number"] for r in rows) == [1, 2, 3, 4] and {r["id"] for r in rows} == {"first", "t0", "t1", "t2"}


def test_old_versions_are_swept(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    for v in range(3):
        T.put_snapshot({"nodes": spark.range(v + 1)}, "s", f"2024-01-0{v + 1}", root)
    assert len(T.swept(spark, root, 1)) == 2 and T.of_snapshot(spark, root, "nodes", "s").count() == 3
