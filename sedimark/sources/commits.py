"""Writes over several tables that become visible together, or not at all.

A set of tables is a folder. Rows are written to new data folders, which nobody reads
yet; then one manifest file, named by the next version, says which data folders make up
each table. Only one writer can take a version's name, so of two at once one goes
through and the other has to look again. Readers pin a version: its data folders are
never changed. What a writer leaves behind that fails before its manifest is an orphan,
which orphans() finds.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.operators.writes import replaced, without


class VersionTaken(Exception):
    """Another writer has taken the version; read the tables again and decide anew."""


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: append rows, replace all, or replace the rows of the keys that rows or dropped has."""

    kind: str
    rows: DataFrame | None = None
    keys: tuple[str, ...] = ()
    dropped: DataFrame | None = None


def append(rows: DataFrame) -> Change:
    return Change("append", rows)


def replace(rows: DataFrame) -> Change:
    return Change("replace", rows)


def replace_keys(rows: DataFrame, keys: list[str], dropped: DataFrame | None = None) -> Change:
    """All rows of the keys go, and rows come; keys of dropped go without any."""
    return Change("keys", rows, tuple(keys), dropped)


class Tables:
    """The tables below folder, a URI that driver and executors share.

    Its file system has to refuse a rename onto a file that is there, as HDFS does; on a
    local one a hard link does that.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._versions = f"{self.folder}/versions"
        self._fs.mkdirs(self._path(self._versions))

    # versions

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of what is in a folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(folder))]

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max((int(n[:-5]) for n, _ in self._names(self._versions) if re.fullmatch(r"\d{12}\.json", n)), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "notes": {}}
        stream = self._fs.open(self._path(f"{self._versions}/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, content: dict) -> None:
        target, draft = f"{self._versions}/{version:012d}.json", f"{self._versions}/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._path(p).toUri().getPath()
                try:
                    os.link(local(draft), local(target))
                except FileExistsError:
                    raise VersionTaken(version) from None
            else:
                files = self._jvm.org.apache.hadoop.fs
                options = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
                options[0] = files.Options.Rename.NONE
                try:
                    files.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf).rename(self._path(draft), self._path(target), options)
                except Exception:
                    if self._fs.exists(self._path(target)):
                        raise VersionTaken(version) from None
                    raise
        finally:
            self._fs.delete(self._path(draft), False)

    # reading and writing

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(self.version() if version is None else version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest, if none is given)."""
        table = self.manifest(self.version() if version is None else version)["tables"][name]
        schema = StructType.fromJson(table["schema"])
        if not table["data"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{d}" for d in table["data"]])

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/data/{part}")
        return part

    def commit(self, changes: dict[str, Change], expected: int | None = None, notes: dict | None = None) -> int:
        """Write the changes of several tables as version expected + 1 and return it.

        expected is the version that the changes rest on (the newest, if none is given). If
        another writer has taken the next one, VersionTaken is raised and nothing has
        changed. notes are kept from version to version; new ones replace old ones of their name.
        """
        base = self.version() if expected is None else expected
        old = self.manifest(base)
        tables = dict(old["tables"])
        for name, change in changes.items():
            had = tables.get(name)
            if change.kind == "keys" and had and had["data"]:
                before, rows = self.read(name, base), change.rows
                keys = list(change.keys)
                left = before if change.dropped is None else without(before, change.dropped, keys)
                data = [self._write(name, replaced(left, rows, keys))]
            else:
                data = [*(had["data"] if had and change.kind == "append" else []), self._write(name, change.rows)]
            schema = change.rows.schema if not had or change.kind == "replace" else StructType.fromJson(had["schema"])
            if had and change.kind != "replace" and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in change.rows.schema]:
                raise ValueError(f"rows of {name} don't have its columns")
            tables[name] = {"schema": schema.jsonValue(), "data": data}
        self._publish(base + 1, {"tables": tables, "notes": {**old["notes"], **(notes or {})}})
        return base + 1

    # housekeeping

    def orphans(self, older_than_s: float = 0) -> list[str]:
        """Data folders that no version names and that haven't changed for that many seconds; a longer time spares writers at work."""
        named = {d for n, _ in self._names(self._versions) if n.endswith(".json") for t in self.manifest(int(n[:-5]))["tables"].values() for d in t["data"]}
        return sorted(n for n, changed in self._names(f"{self.folder}/data") if n not in named and changed <= (time.time() - older_than_s) * 1000)

    def clean(self, older_than_s: float = 86_400) -> list[str]:
        """Delete the orphans."""
        gone = self.orphans(older_than_s)
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
        return gone


def publish_documents(tables: Tables, documents: DataFrame, pages: DataFrame, blocks: DataFrame, expected: int | None = None) -> int:
    """Replace whole documents (doc_id) with their pages and blocks in one version; a document without pages has none afterwards."""
    ids = documents.select("doc_id").distinct()
    return tables.commit({"documents": replace_keys(documents, ["doc_id"]), "pages": replace_keys(pages, ["doc_id"], ids), "blocks": replace_keys(blocks, ["doc_id"], ids)}, expected)


def append_entries(tables: Tables, entries: DataFrame, session: str = "session", seq: str = "seq", expected: int | None = None) -> int:
    """Append entries and replace the totals of their sessions (entries, last_seq) in one version.

    An entry that is there already, by session and seq, changes nothing, so a batch may come again.
    """
    base = tables.version() if expected is None else expected
    if "entries" in tables.names(base):
        entries = entries.join(tables.read("entries", base).select(session, seq), [session, seq], "left_anti").select(*entries.columns)
    entries = entries.dropDuplicates([session, seq])
    totals = entries.groupBy(session).agg(F.count("*").alias("entries"), F.max(seq).alias("last_seq"))
    if "totals" in tables.names(base):
        both = totals.unionByName(tables.read("totals", base).join(totals.select(session), session, "left_semi"))
        totals = both.groupBy(session).agg(F.sum("entries").alias("entries"), F.max("last_seq").alias("last_seq"))
    return tables.commit({"entries": append(entries), "totals": replace_keys(totals, [session])}, base)
