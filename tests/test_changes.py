"""A follower's tables equal the source's."""

import json

from tessella.session import connect
from tessella.streaming.changes import Follower

READINGS = "CREATE TABLE readings (n INT PRIMARY KEY AUTO_INCREMENT, station VARCHAR(30) NOT NULL, level DOUBLE, day DATETIME, stamp TIMESTAMP, packet BLOB)"


def pair(spark, tmp_path):
    source = connect(spark, f"file://{tmp_path}/source", changes=True)
    target = connect(spark, f"file://{tmp_path}/target")
    return source, target, Follower(target.engine, source.engine.store.root)


def rows(s, table="readings"):
    return s.execute(f"SELECT * FROM {table} ORDER BY n").fetchall()


def test_rows_and_definitions(spark, tmp_path):
    source, target, follower = pair(spark, tmp_path)

    def synced(*statements):
        for sql in statements:
            source.execute(sql)
        follower.run()
        assert rows(target) == rows(source)
        return rows(target)

    assert synced(READINGS) == []
    assert len(synced("INSERT INTO readings (station, level, day, stamp, packet) VALUES ('weir', 1.25, '2024-02-29 23:59:59.000001', '2024-02-29T23:59:59+01:00', X'0a0d'), ('lock', NULL, NULL, NULL, NULL)")) == 2
    # Neighbouring changes of a table, of which the last wins for each row.
    got = synced("INSERT INTO readings (station) VALUES ('mill'), ('ford')", "UPDATE readings SET level = 7 WHERE station = 'mill'", "DELETE FROM readings WHERE station = 'ford'", "UPDATE readings SET level = 8 WHERE station = 'mill'")
    assert [(r["station"], r["level"]) for r in got] == [("weir", 1.25), ("lock", None), ("mill", 8.0)]
    assert synced() == got
    assert synced("BEGIN", "DELETE FROM readings", "ROLLBACK") == got
    got = synced("BEGIN", "INSERT INTO readings (station) VALUES ('quay')", "UPDATE readings SET level = 3 WHERE station = 'quay'", "DELETE FROM readings WHERE station = 'lock'", "COMMIT")
    assert [r["station"] for r in got] == ["weir", "mill", "quay"]
    assert synced("ALTER TABLE readings ADD COLUMN unit VARCHAR(4) DEFAULT 'cm'", "UPDATE readings SET unit = 'mm' WHERE level = 8")[1]["unit"] == "mm"
    assert synced("TRUNCATE readings", "INSERT INTO readings (station) VALUES ('pier')")[0]["n"] == 1
    source.execute("RENAME TABLE readings TO levels")
    source.execute("INSERT INTO levels (station) VALUES ('dam')")
    follower.run()
    assert rows(target, "levels") == rows(source, "levels") and len(rows(target, "levels")) == 2
    source.execute("DROP TABLE levels")
    assert synced(READINGS, "INSERT INTO readings (station) VALUES ('new')")[0]["station"] == "new"
    log = source.engine.changes
    log.prune(follower.applied)
    assert [r["log_id"] for r in log.read().select("log_id").distinct().collect()] == [follower.applied]


def test_entries_that_appear_out_of_order(spark, tmp_path):
    """An entry is held back until the one before it is there; none is lost."""
    source, target, follower = pair(spark, tmp_path)
    source.execute(READINGS)
    log, published = source.engine.changes, []
    log.publish, publish = published.append, log.publish
    for sql in ("INSERT INTO readings (station) VALUES ('a')", "UPDATE readings SET level = 1", "UPDATE readings SET level = 2"):
        source.execute(sql)
    publish(published[2])
    publish(published[1])
    follower.run()
    assert rows(target) == [] and follower.state["held"] == published[1:]
    publish(published[0])
    follower.run()
    assert rows(target) == rows(source) and rows(target)[0]["level"] == 2 and follower.state["held"] == []


def test_lost_writers(spark, tmp_path):
    """What was committed and not published is published when the log is opened again; what was not committed is thrown away once another version is there."""
    source, target, follower = pair(spark, tmp_path)
    source.execute(READINGS)
    log = source.engine.changes
    log.publish = lambda number: None
    source.execute("INSERT INTO readings (station) VALUES ('kept')")
    version = source._version("main", "readings")[1]
    lost = log.prepare("main", "readings", "INSERT", spark.createDataFrame([], version.schema), None, version.last_change, version.number)
    again = connect(spark, source.engine.store.root, changes=True)
    follower.run()
    assert [r["station"] for r in rows(target)] == ["kept"] == [r["station"] for r in rows(again)]
    assert again.engine.store.files.names(again.engine.changes.waiting) == [] and again.engine.changes.read().where(f"log_id = {lost}").isEmpty()
    waiting = again.engine.changes.prepare("main", "readings", "INSERT", None, None, 0, 99)
    again.engine.changes.recover()
    assert again.engine.store.files.exists(f"{again.engine.changes.waiting}/{waiting}.json")
    path = f"{again.engine.changes.waiting}/{waiting}.json"
    again.engine.store.files.replace(path, json.dumps(json.loads(again.engine.store.files.read(path)) | {"at": 0}))
    again.engine.changes.recover()
    assert not again.engine.store.files.exists(path)
