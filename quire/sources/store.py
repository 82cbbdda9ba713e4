"""Relations on disk: written aside, checked, then named by a new manifest.

Every change writes new versions of the tables it changes and one manifest file,
``manifests/<number>.json``, that names the versions of all tables.  The live
manifest is the one of greatest number.  A manifest comes into being by a rename
to a name that isn't there yet: nothing is deleted first, so a failure at any
point leaves the tables as they were, and of two writers one fails.  Tables that
don't change are named again, not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "manifests"
#: Tables with this column are laid out in a folder for each of its values.
BUCKET = "bucket"


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


class Conflict(OSError):
    """Someone else changed the store in the meantime."""


class Store:
    """A folder of Parquet relations in any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests --------------------------------------------------------

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, number: int | None = None) -> dict:
        """What a manifest says: tables (name to folders) and notes."""
        numbers = self._numbers()
        if not numbers:
            return {"tables": {}, "schemas": {}, "notes": {}}
        path = f"{self.root}/{MANIFESTS}/{numbers[-1] if number is None else number:012d}.json"
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def generation(self) -> int | None:
        """Number of the live manifest."""
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def names(self) -> list[str]:
        return sorted(self._manifest()["tables"])

    def note(self, name: str) -> object:
        """A small value that was committed together with tables."""
        return self._manifest()["notes"].get(name)

    # --- tables -----------------------------------------------------------

    def read(self, name: str) -> DataFrame:
        now = self._manifest()
        if name not in now["tables"]:
            raise FileNotFoundError(f"{self.root} holds no {name}")
        return self.spark.read.schema(_schema(now["schemas"][name])).parquet(*[f"{self.root}/{f}" for f in now["tables"][name]])

    def parts(self, name: str) -> int:
        """How many folders hold a table."""
        return len(self._manifest()["tables"].get(name, []))

    def has(self, name: str) -> bool:
        return name in self._manifest()["tables"]

    def rebuild(self, tables: dict[str, DataFrame], **notes: object) -> int:
        """These tables and no others."""
        return self._commit(tables, {"tables": {}, "schemas": {}, "notes": {}}, self.generation(), notes)

    def update(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), **notes: object) -> int:
        """New versions of these tables; all others stay as they are."""
        seen = self.generation()
        now = self._manifest(seen)
        now["tables"] = {n: f for n, f in now["tables"].items() if n not in drop}
        return self._commit(tables, now, seen, notes)

    def append(self, tables: dict[str, DataFrame], **notes: object) -> int:
        """More rows of these tables, as folders beside those they have."""
        seen = self.generation()
        return self._commit(tables, self._manifest(seen), seen, notes, more=True)

    def _commit(self, tables: dict[str, DataFrame], now: dict, seen: int | None, notes: dict, more: bool = False) -> int:
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            writer = df.write
            (writer.partitionBy(BUCKET) if BUCKET in df.columns else writer).parquet(f"{self.root}/{folder}")
            schema = df.schema
            self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").limit(1).collect()  # readable before anything names it
            if more and name in now["tables"]:  # columns that are new come behind those there were
                known = _schema(now["schemas"][name])
                schema = StructType(known.fields + [f for f in schema.fields if f.name not in known.names])
            now["tables"][name] = [*(now["tables"].get(name, []) if more else []), folder]
            now["schemas"][name] = schema.json()
        now["notes"] |= notes
        number = 0 if seen is None else seen + 1
        live = self._path(f"{self.root}/{MANIFESTS}/{number:012d}.json")
        draft = self._path(f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self._fs.exists(live) or not self._fs.rename(draft, live):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.root} was changed by someone else")
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions that none of the last ``keep`` manifests names; how many."""
        numbers = self._numbers()
        kept = {f for n in numbers[-keep:] for folders in self._manifest(n)["tables"].values() for f in folders}
        old = {f for n in numbers[:-keep] for folders in self._manifest(n)["tables"].values() for f in folders} - kept
        for folder in old:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{MANIFESTS}/{n:012d}.json"), False)
        return len(old)
