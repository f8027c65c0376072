"""Keyed state: parents over batches, eviction by age and number, late rows."""

import pytest

from tracewell.streaming import flows, lookups

SCHEMA = "id long, ts long, host string, pid long, parentPid long, name string, parentName string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_parents_over_batches(rocks, tmp_path):
    minute = 60_000
    batches = [
        [(1, 0, "h", 10, None, "C:\\a.exe", None), (2, minute, "H", 11, 10, "b.exe", "D:\\A.EXE"), (3, 2 * minute, "h", 12, 10, "c", "other.exe"), (4, 2 * minute, "g", 13, 10, "c", None)],
        [(5, 3 * minute, "h", 10, 11, "new", None), (6, 3 * minute, "h", 14, 10, "x", "a.exe"), (7, 4 * minute, "h", 15, 10, "x", None), (8, 4 * minute, None, 10, 10, "x", None)],
        [(20 + i, (5 + i) * minute, "h", 30, 10, "many", None) for i in range(5)] + [(30, 11 * minute, "h", 31, 30, "x", None)],
        [(40, 200 * minute, "far", 1, None, "x", None)],
        [(41, 201 * minute, "far", 2, 1, "x", None), (42, 1 * minute, "h", 99, 10, "late", None)],
        [(43, 202 * minute, "h", 50, 10, "x", None), (44, 203 * minute, "h", 51, 30, "x", None)],
    ]
    (tmp_path / "in").mkdir()
    stream = flows.events(rocks, str(tmp_path / "in"), SCHEMA, files_a_trigger=1)
    found = lookups.parents(stream, within=100 * minute, late="5 minutes", kept=3)
    query = found.writeStream.format("memory").queryName("parents").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows in batches:
            rows = [(i, ts + minute, *rest) for i, ts, *rest in rows]  # no row is as old as the first watermark
            rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        got = {r.id: (r.parent, r.forgotten) for r in rocks.table("parents").collect()}
    finally:
        query.stop()
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: 1, 3: None, 4: None, 5: 2, 6: 1, 7: 5, **{20 + i: 5 for i in range(5)}, 30: 24, 40: None, 41: 40, 43: None, 44: None}
    assert got[30][1] == 0 and got[44][1] == 0  # counted before this batch's starts, and gone with the key
