"""Change capture: each committed change is kept in a log of Parquet files, and a follower applies the log with Structured Streaming.

A change's rows (row id, and the columns after the change as JSON) are written beside the log first; the manifest that commits the change names its log number; then the files are moved into the log. So a change is in the log
if and only if it is committed: what a lost writer left behind is published or thrown away when the log is opened again. DROP, RENAME, MOVE, COPY and CREATE DATABASE have no manifest of their own and are logged right after.

Log numbers grow, and each entry names the table's entry before it. Files may appear in another order than their numbers; a follower holds an entry back until it has applied the one before. Applying an entry twice gives
the same rows.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lower import ROW_ID
from ..sources.tables import Version

if TYPE_CHECKING:
    from ..session import Engine

SCHEMA = "log_id long, previous long, logged_at timestamp, source_database string, source_table string, change_type string, row_id long, row string, change_sql string"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Seconds after which an entry whose version was never committed is thrown away.
ABANDONED = 24 * 3600


class ChangeLog:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.path, self.waiting = engine, f"{engine.store.root}/changes", f"{engine.store.root}/changes-waiting"
        for folder in (self.path, self.waiting, f"{engine.store.root}/log_ids"):
            engine.store.files.make(folder)
        self._next = 1 + max((int(n) for n in engine.store.files.names(f"{engine.store.root}/log_ids") if n.isdigit()), default=0)
        self.recover()

    def _claim(self) -> int:
        """A log number that no other writer has."""
        while not self.engine.store.files.create(f"{self.engine.store.root}/log_ids/{self._next:012d}", ""):
            self._next += 1
        self._next += 1
        return self._next - 1

    def prepare(self, database: str | None, table: str, kind: str, rows: DataFrame | None, sql: str | None, previous: int, version: int | None) -> int:
        """Write an entry that isn't in the log yet; its number. ``rows``: the row id and, but for deletions, the columns. ``version``: the one that will name the entry, if there is one."""
        number, spark = self._claim(), self.engine.spark
        if rows is None:
            data = spark.range(1).select(F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("string").alias("row"))
        else:
            columns = [c for c in rows.columns if c != ROW_ID]
            body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _JSON) if columns else F.lit(None).cast("string")
            data = rows.select(F.col(ROW_ID).alias("row_id"), body.alias("row"))
        out = data.select(
            F.lit(number).cast("long").alias("log_id"), F.lit(previous).cast("long").alias("previous"), F.lit(time.time()).cast("timestamp").alias("logged_at"), F.lit(database).cast("string").alias("source_database"),
            F.lit(table).alias("source_table"), F.lit(kind).alias("change_type"), "row_id", "row", F.lit(sql).cast("string").alias("change_sql"),
        )
        self.engine.store.files.replace(f"{self.waiting}/{number}.json", json.dumps({"database": database, "table": table, "version": version, "at": time.time()}))
        out.write.parquet(f"{self.waiting}/{number}")
        return number

    def publish(self, number: int) -> None:
        files = self.engine.store.files
        for p in files.parts(f"{self.waiting}/{number}"):
            files.move(p, f"{self.path}/part-{number:012d}-{p.rpartition('/part-')[2]}")
        self.discard(number)

    def discard(self, number: int) -> None:
        self.engine.store.files.delete(f"{self.waiting}/{number}")
        self.engine.store.files.delete(f"{self.waiting}/{number}.json")

    def recover(self) -> None:
        """Publish what a lost writer has committed, and throw away what it has not."""
        store = self.engine.store
        for name in store.files.names(self.waiting):
            if name.endswith(".json"):
                number, entry = int(name[:-5]), json.loads(store.files.read(f"{self.waiting}/{name}"))
                made = store.version(entry["database"], entry["table"], entry["version"]) if entry["version"] else None
                if made is not None and number in made.changes:
                    self.publish(number)
                elif made is not None or time.time() - entry["at"] > ABANDONED:
                    self.discard(number)

    def read(self) -> DataFrame:
        """The log as a table."""
        return self.engine.spark.read.schema(SCHEMA).parquet(self.path)

    def prune(self, before: int) -> None:
        """Forget the changes below a log number, which every follower has applied."""
        kept = self.read().where(F.col("log_id") >= before)
        fresh = f"{self.engine.store.root}/changes-{uuid.uuid4().hex}"
        kept.write.parquet(fresh)
        files = self.engine.store.files
        old = files.parts(self.path)
        for p in files.parts(fresh):
            files.move(p, f"{self.path}/{p.rpartition('/')[2]}")
        for p in old:
            files.delete(p)
        files.delete(fresh)


class Follower:
    """Applies another engine's log to an engine of its own. Its state: the last entry applied of each table, the last statement applied, and the entries that wait for one before them."""

    def __init__(self, engine: Engine, source: str) -> None:
        self.engine, self.source = engine, f"{source.rstrip('/')}/changes"
        self.path = f"{engine.store.root}/applied.json"

    @property
    def state(self) -> dict:
        return json.loads(self.engine.store.files.read(self.path)) if self.engine.store.files.exists(self.path) else {"tables": {}, "statement": 0, "held": []}

    @property
    def applied(self) -> int:
        """The greatest log number that was applied."""
        state = self.state
        return max([state["statement"], *state["tables"].values()])

    def run(self, checkpoint: str | None = None, available_now: bool = True):
        """Start the stream; with ``available_now`` it ends when all that is there has been applied."""
        spark = self.engine.spark
        checkpoint = checkpoint or f"{self.engine.store.root}/follower-checkpoint"
        writer = spark.readStream.schema(SCHEMA).parquet(self.source).writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        if available_now:
            query.awaitTermination()
        return query

    def _apply(self, batch: DataFrame, _: int) -> None:
        state = self.state
        steps = lambda rows: rows.select("log_id", "previous", "source_database", "source_table", "change_type", "change_sql").distinct().collect()  # noqa: E731  one row a change
        asked, source = steps(batch), batch
        if state["held"]:
            # Entries of earlier batches are read from the log itself.
            source = batch.sparkSession.read.schema(SCHEMA).parquet(self.source)
            asked += steps(source.where(F.col("log_id").isin(state["held"])))
        held, together = [], []
        for s in sorted({s["log_id"]: s for s in asked}.values(), key=lambda s: s["log_id"]):
            key = f"{s['source_database']}.{s['source_table']}"
            done = max(state["tables"].get(key, 0), state["statement"])
            if s["log_id"] <= state["tables"].get(key, 0) or (s["change_type"] == "DDL" and s["log_id"] <= state["statement"]):
                continue
            pending = together and together[-1]["log_id"] == s["previous"]
            if s["change_type"] != "DDL" and s["previous"] > done and not pending:
                held.append(s["log_id"])
                continue
            if together and (s["change_type"] in ("DDL", "TRUNCATE") or not pending):
                self._finish(source, together, state)
                together = []
            together.append(s)
            if s["change_type"] in ("DDL", "TRUNCATE"):
                self._finish(source, together, state)
                together = []
        if together:
            self._finish(source, together, state)
        self._save(state | {"held": held})

    def _save(self, state: dict) -> None:
        self.engine.store.files.replace(self.path, json.dumps(state))

    def _finish(self, source: DataFrame, steps: list, state: dict) -> None:
        """Apply one statement, or neighbouring changes of one table at once."""
        last = steps[-1]
        database, table = last["source_database"], last["source_table"]
        if last["change_type"] == "DDL":
            self.engine.session(database=database).execute(last["change_sql"])
            state["statement"] = last["log_id"]
        elif last["change_type"] == "TRUNCATE":
            version = self.engine.store.current(database, table)
            self.engine.store.commit(database, table, replace(version, files=(), next_row=1, next_auto=1), version.number)
        else:
            self._rows(database, table, source.where(F.col("log_id").isin([s["log_id"] for s in steps])))
        state["tables"][f"{database}.{table}"] = last["log_id"]
        self._save(state)

    def _rows(self, database: str, table: str, changes: DataFrame) -> None:
        store = self.engine.store
        version = store.current(database, table)
        # What the last of the changes has left of each row.
        rows = changes.groupBy(F.col("row_id").alias(ROW_ID)).agg(F.max_by(F.struct("change_type", "row"), "log_id").alias("last"))
        ids = rows.select(ROW_ID)
        files = version.files
        fresh: tuple[str, ...] = ()
        # Rows that are replaced, deleted or inserted a second time go; only files that hold some are written anew.
        touched = {r[0].rpartition("/data/")[2] for r in store.read(database, table, version).withColumn("__file", F.input_file_name()).join(ids, ROW_ID, "left_semi").select("__file").distinct().collect()} if files else set()
        old = tuple(f for f in files if f.removeprefix("data/") in touched)
        if old:
            fresh += store.write(database, table, store.read(database, table, version, old).join(ids, ROW_ID, "left_anti"), version)
        body = F.from_json("last.row", _body(version), _JSON)
        new = rows.where(F.col("last.change_type") != "DELETE").select(ROW_ID, body.alias("b")).select(ROW_ID, *[F.col(f"b.`{c.name}`") for c in version.columns])
        written = store.write(database, table, new, version)
        top = store.read(database, table, version, written).agg(F.max(ROW_ID), *([F.max(version.auto.name)] if version.auto else [])).first()
        last = max(version.next_row - 1, top[0] or 0)
        auto = max(version.next_auto, (top[1] or 0) + 1) if version.auto else version.next_auto
        store.commit(database, table, replace(version, files=tuple(f for f in files if f not in old) + fresh + written, next_row=last + 1, next_auto=auto, statistics=None), version.number)


def _body(version: Version):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(c.name, c.type.spark) for c in version.columns])
