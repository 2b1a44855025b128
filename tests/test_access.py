import pytest

from tessella.errors import EngineError


def fails(db, sql, code):
    with pytest.raises(EngineError) as e:
        db.execute(sql)
    assert e.value.code == code


@pytest.fixture
def parcels(db):
    """Parcels by depot; bots may read their own depot's, clerks all that are not held. ``lists`` has no policy."""
    db.execute("CREATE TABLE parcels (n INT PRIMARY KEY AUTO_INCREMENT, depot VARCHAR(20))")
    db.execute("INSERT INTO parcels (depot) VALUES ('north'), ('south'), ('held')")
    db.execute("CREATE TABLE lists (n INT)")
    db.execute("INSERT INTO lists VALUES (1), (2), (3)")
    for sql in ("CREATE ROLE bot", "CREATE ROLE clerk", "GRANT bot TO clerk", "GRANT clerk TO ann", "GRANT ALL ON main.% TO bot", "GRANT SELECT ON par% TO bob"):
        db.execute(sql)
    db.execute("CREATE POLICY own ON parcels FOR ALL TO bot USING (depot = 'north')")
    db.execute("CREATE POLICY public ON parcels FOR SELECT USING (depot = 'south')")
    return db


def depots(s, table="parcels"):
    return sorted(r["depot"] for r in s.execute(f"SELECT depot FROM {table}"))


def test_policies_are_added_up(parcels):
    ann, bob = parcels.engine.session("ann"), parcels.engine.session("bob")
    assert depots(parcels) == ["held", "north", "south"] and depots(ann) == ["north", "south"] and depots(bob) == ["south"]
    assert ann.query("SELECT l.n AS k FROM lists AS l JOIN parcels AS p ON l.n = p.n").count() == 2
    assert ann.query("SELECT n FROM lists WHERE n IN (SELECT n FROM parcels)").count() == 2 and ann.query("SELECT n FROM lists").count() == 3


def test_policies_hold_for_writes(parcels):
    ann = parcels.engine.session("ann")
    fails(ann, "INSERT INTO parcels (depot) VALUES ('south')", "POLICY_VIOLATION")
    assert ann.execute("INSERT INTO parcels (depot) VALUES ('north')").affected_rows == 1
    fails(ann, "UPDATE parcels SET depot = 'east'", "POLICY_VIOLATION")
    fails(ann, "TRUNCATE parcels", "POLICY_VIOLATION")
    assert ann.execute("DELETE FROM parcels WHERE depot != 'south'").affected_rows == 2 and depots(parcels) == ["held", "south"]


def test_policies_go_with_their_table(parcels):
    parcels.execute("RENAME TABLE parcels TO parcels_old")
    ann = parcels.engine.session("ann")
    assert depots(ann, "parcels_old") == ["north", "south"]
    parcels.execute("DROP POLICY own ON parcels_old")
    assert depots(ann, "parcels_old") == ["south"]
    fails(parcels, "DROP POLICY own ON parcels_old", "POLICY_NOT_FOUND")
    parcels.execute("DROP POLICY own IF EXISTS ON parcels_old")
    for bad in ("n IN (SELECT n FROM lists)", "n = :which", "n = (SELECT n FROM lists)"):
        fails(parcels, f"CREATE POLICY q ON parcels_old FOR SELECT USING ({bad})", "SQL_SEMANTIC")


def test_privileges(parcels):
    bob = parcels.engine.session("bob")
    for sql in ("SELECT n FROM lists", "SELECT depot FROM parcels WHERE n IN (SELECT n FROM lists)", "DELETE FROM parcels", "GRANT ALL ON * TO bob"):
        fails(bob, sql, "ACCESS_DENIED")
    parcels.execute("REVOKE SELECT ON par% FROM bob")
    fails(bob, "SELECT depot FROM parcels", "ACCESS_DENIED")
    parcels.execute("DROP ROLE bot")
    fails(parcels.engine.session("ann"), "SELECT depot FROM parcels", "ACCESS_DENIED")


def test_variables(db):
    db.execute("SET SESSION sort_buffer_size = 4M")
    got = {r["variable_name"]: r["value"] for r in db.execute("SHOW SESSION VARIABLES LIKE '%buffer\\_size'")}
    assert got["sort_buffer_size"] == str(4 * 2**20) and got["join_buffer_size"] == "2097152"
    assert db.engine.session().query("SHOW VARIABLES").count() == 16
    for sql, code in (("SET nope = 1", "UNKNOWN_SYSTEM_VARIABLE"), ("SET GLOBAL thread_stack = 5", "READ_ONLY_VARIABLE"), ("SET query_cache_size = 5", "INVALID_VARIABLE_SCOPE"), ("SET sort_buffer_size = 'x'", "INVALID_SYSTEM_VARIABLE"), ("SET GLOBAL system_time_zone = 'Mars/Base'", "INVALID_SYSTEM_VARIABLE")):
        fails(db, sql, code)
    db.execute("SET GLOBAL skip_name_resolve = OFF")
    assert db.execute("SHOW GLOBAL VARIABLES LIKE 'skip%'").fetchall()[0]["value"] == "OFF"


def test_system_tables(parcels):
    assert [r["role"] for r in parcels.execute("SELECT role FROM system.roles ORDER BY role")] == ["bot", "clerk"]
    assert parcels.query("SELECT * FROM system.policies WHERE scope IS NULL").count() == 1
    assert parcels.query("SELECT grantee FROM system.privileges WHERE table_name LIKE '%\\%'").count() == 2
    assert parcels.query("SELECT * FROM system.role_assignments").count() == 2 and parcels.query("SELECT * FROM system.replication_log").count() == 0
    assert parcels.query("SELECT * FROM system.sys_config").count() == 16
    fails(parcels.engine.session("bob"), "SELECT * FROM system.privileges", "ACCESS_DENIED")


def test_logs(parcels, caplog):
    import json
    import logging

    with caplog.at_level(logging.INFO, logger="tessella"):
        parcels.execute("SELECT n FROM parcels WHERE depot = 'held' AND n > 5")
        parcels.execute("CREATE ROLE extra")
        fails(parcels, "SELECT 'x", "SQL_SYNTAX")
        fails(parcels, "SELECT nope FROM parcels", "UNKNOWN_COLUMN")
    lines = [json.loads(r.message) for r in caplog.records]
    assert [x["sql"] for x in lines if x["log"] == "general"] == ["SELECT n FROM parcels WHERE depot = ? AND n > ?", "CREATE ROLE extra", "(9 characters)", "SELECT nope FROM parcels"]
    assert [x["code"] for x in lines if x["log"] == "error"] == ["SQL_SYNTAX", "UNKNOWN_COLUMN"] and [x["outcome"] for x in lines if x["log"] == "audit"] == ["ok"]
    assert "held" not in caplog.text


def test_log_files(parcels, tmp_path):
    """A file for each kind of line; files are renamed before they grow too large."""
    from tessella import logs

    handlers = logs.to_files(str(tmp_path / "logs"), max_bytes=2000, keep=2)
    try:
        for k in range(30):
            parcels.execute(f"SELECT n FROM parcels WHERE n = {k}")
        parcels.execute("CREATE ROLE extra")
        fails(parcels, "SELECT nope FROM parcels", "UNKNOWN_COLUMN")
    finally:
        for h in handlers:
            logs.LOGGER.removeHandler(h)
            h.close()
    found = {p.name: p.read_text() for p in (tmp_path / "logs").iterdir()}
    assert {"general.log", "general.log.1", "general.log.2", "slow.log", "error.log", "audit.log"} == set(found) and all(len(t) <= 2000 for t in found.values())
    assert found["audit.log"].count("CREATE ROLE extra") == 1 and found["error.log"].count("UNKNOWN_COLUMN") == 1


def test_counters(parcels):
    before = dict(parcels.engine.counters)
    fails(parcels, "SELECT nope FROM parcels", "UNKNOWN_COLUMN")
    got = {r["metric_name"]: r["metric_value"] for r in parcels.query("SELECT * FROM system.performance_schema").collect()}
    assert got["statements"] == before["statements"] + 1 and got["errors"] == before["errors"] + 1 and got["uptime_seconds"] > 0
    assert [r["username"] for r in parcels.execute("SELECT username FROM system.users_schema ORDER BY username")] == ["ann", "bob", "root"]
    assert parcels.query("SELECT * FROM system.config_schema WHERE config_key = 'root'").first()["config_value"] == parcels.engine.store.root
