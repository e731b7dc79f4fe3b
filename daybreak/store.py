"""State, ledger and archive: rows in folders, and a numbered pointer that is written last, so all of them change together or not at all."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.operators.state import upsert

SCHEMAS = {
    "trigger_runs": "run_id string, event_type string, profile_id string, occurred_at string, output_mode string, status string, created_at string",
    "connector_cursors": "connector_id string, cursor string, last_poll_at string, last_success_at string, last_error string",
    "source_registry_state": "registry_id string, last_poll_at string, last_seen_item_ids array<string>, last_promoted_item_ids array<string>, authority_tier string, notes string",
    "deliveries": "delivery_id string, run_id string, destination string, delivered_at string, status string",
    "suppression_history": "suppression_id string, run_id string, subject string, trigger_family string, reason string, cooldown_expires_at string, dismissal_status string, superseded_by_higher_authority boolean",
    "feedback_log": "feedback_id string, run_id string, category string, subject string, signal string, value string, recorded_at string",
    "approval_action_log": "action_id string, run_id string, action_kind string, subject string, approval_boundary_reached boolean, user_decision string, execution_result string, execution_details string, recorded_at string",
}
KEYS = {name: ddl.split()[0] for name, ddl in SCHEMAS.items()}
KEEP_OLD = {"connector_cursors": ("cursor",), "source_registry_state": ("notes",)}


class Appended(NamedTuple):
    """New rows of a table, which a commit writes beside its old ones."""

    rows: DataFrame


class Snapshot(NamedTuple):
    """The state as one pointer has it: its number, and the folders of every table."""

    number: int
    tables: dict[str, list[str]]


class Conflict(RuntimeError):
    """Another run has committed since the snapshot that a commit builds on."""


#: Folders of a table beyond which a commit writes it as one.
MOST_FOLDERS = 32
#: The ledger is lines by source, archives (archive/label) are JSON rows; every other table is Parquet.
LEDGER = "ledger"
ARCHIVE = "archive/"


class Store:
    """The state tables, the ledger and the archives below a folder that all executors reach.

    A commit writes its folders and then one numbered pointer that names the folders of every table. The newest pointer that can
    be read counts, so a commit that stops anywhere leaves the state before it; a pointer is made by a rename and never replaced. A
    commit that builds on a snapshot is refused once there is a newer pointer; `transact` then makes it anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and names of the pointers, the newest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(((int(m[1]), n) for n in names if (m := re.fullmatch(r"state-(\d+)\.json", n))), reverse=True)

    def snapshot(self) -> Snapshot:
        pointers = self._pointers()
        for _, name in pointers:
            try:
                return Snapshot(pointers[0][0], json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]))
            except (ValueError, TypeError):  # cut off: the one before it counts
                continue
        return Snapshot(pointers[0][0] if pointers else 0, {})

    def _folders(self, name: str, at: Snapshot | None) -> list[str]:
        return [f"{self.root}/{f}" for f in (at or self.snapshot()).tables.get(name, [])]

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """A state table's rows, the ledger's lines (value) or an archive's rows; the newest ones unless a snapshot is given."""
        folders = self._folders(name, at)
        if name == LEDGER:
            return self.spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folders) if folders else self.spark.createDataFrame([], "value string")
        if name.startswith(ARCHIVE):
            return self.spark.read.json(folders)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name.replace('/', '-')}-{uuid.uuid4().hex}"
        target = f"{self.root}/{folder}"
        if name == LEDGER:
            rows.write.partitionBy("of").text(target) if "of" in rows.columns else rows.write.text(target)
        elif name.startswith(ARCHIVE):
            write_snapshot(rows, target)
        else:
            rows.write.parquet(target)
        return folder

    def _point(self, number: int, tables: dict[str, list[str]]) -> None:
        made = self._path(f"{self.root}/next-{uuid.uuid4().hex}.json")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        pointer = self._path(f"{self.root}/state-{number:012d}.json")
        if self._fs.exists(pointer) or not self._fs.rename(made, pointer):
            self._fs.delete(made, False)
            raise Conflict("another run has committed meanwhile")

    def commit(self, tables: dict[str, DataFrame | Appended], at: Snapshot | None = None) -> None:
        """Replaces or extends these tables together."""
        at = at or self.snapshot()
        folders, new = dict(at.tables), []
        for name, given in tables.items():
            old = folders.get(name, [])
            if isinstance(given, Appended) and len(old) < MOST_FOLDERS:
                rows, kept = given.rows, old
            else:
                rows, kept = (self.read(name, at).unionByName(given.rows.drop("of")) if isinstance(given, Appended) else given), []
            new.append(self._write(name, rows))
            folders[name] = [*kept, new[-1]]
        try:
            self._point(at.number + 1, folders)
        except Conflict:
            for folder in new:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise

    def transact(self, make: Callable[[Snapshot], dict[str, DataFrame | Appended]], attempts: int = 5) -> None:
        """Commits what `make` builds on the newest snapshot, anew as long as others commit first."""
        for left in reversed(range(attempts)):
            at = self.snapshot()
            try:
                return self.commit(make(at), at)
            except Conflict:
                if not left:
                    raise

    def record(self, name: str, rows: list[dict], at: Snapshot | None = None) -> Appended:
        """These rows for a commit; a row's id is a hash of its content, so a repeated record adds nothing."""
        key = KEYS[name]
        fields = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        new = self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name])
        made = F.sha2(F.to_json(F.struct(*(f for f in fields if f != key)), {"ignoreNullFields": "false"}), 256)
        new = new.withColumn(key, F.coalesce(key, made)).dropDuplicates([key])
        return Appended(new.join(self.read(name, at).select(key), key, "left_anti").select(*fields))

    def updated(self, name: str, key: str, at: Snapshot | None = None, **changes: object) -> DataFrame:
        """The table with the named columns of one row set: a run's status, a suppression's status or flag, an approval's outcome."""
        this = F.col(KEYS[name]) == key
        return self.read(name, at).withColumns({c: F.when(this, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})

    def upserted(self, name: str, new: DataFrame) -> DataFrame:
        return upsert(self.read(name), new, KEYS[name], KEEP_OLD.get(name, ()))


def write_snapshot(items: DataFrame, path: str) -> None:
    """The items of a run as JSON lines, in place of an earlier snapshot there."""
    items.write.mode("overwrite").json(path)


def merged_notes(existing: str | None, last_error: str) -> str:
    """Registry notes with an error set: objects keep their keys, other text becomes a review note."""
    try:
        notes = json.loads(existing) if existing else {}
    except ValueError:
        notes = None
    if not isinstance(notes, dict):
        notes = {"review_note": existing}
    return json.dumps(notes | {"last_error": last_error}, ensure_ascii=False, sort_keys=True)
