"""A stored vault: segments of entries, and manifests that say which of them count.

    STORE/key               the key that names placeholders, readable by its owner only
    STORE/manifests/N.json  version N: key id, segments and their renewals
    STORE/segments/ID/      entries of a segment, Parquet

A writer adds at most one segment and commits the next manifest by a rename that fails where that version
exists, so that of two writers one has to load again.  Readers hold to one version.  A renewal is a change of
the manifest: no entry is rewritten.  Small segments are merged as they become many; what no kept manifest
names is deleted.  So the number of files is bounded, whatever the number of batches.  (The rename must be atomic, as in
HDFS and local folders; a store of objects needs a committer that makes it so.)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .joins import cut_lineage
from .vault import TTL, VAULT, empty_vault, new_key

SEGMENTS = 6
ROWS_A_FILE = 1_000_000
KEPT_MANIFESTS = 3
ABANDONED = timedelta(hours=6)  # a segment without a manifest for so long has no writer any more
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class VaultConflict(Exception):
    """Another writer committed first: load again and repeat."""


class KeyMismatch(ValueError):
    """The store was written with another key."""


@dataclass(frozen=True)
class Segment:
    """Entries with their own times.  ``first`` and ``last`` renewal since, in microseconds; None before any."""

    name: str
    rows: int
    newest: int
    first: int | None = None
    last: int | None = None

    def alive_until(self, ttl: int) -> int:
        return (self.newest if self.last is None else self.last) + ttl

    def renewed(self, now: int) -> "Segment":
        return replace(self, first=now if self.first is None else self.first, last=max(now, self.last or now))


@dataclass(frozen=True)
class Manifest:
    version: int
    key_id: str
    segments: tuple[Segment, ...]


def key_id(key: bytes) -> str:
    """Tells keys apart without giving one away."""
    return hashlib.sha256(b"veilspan key " + key).hexdigest()[:16]


def micros(at: datetime) -> int:
    at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - EPOCH) // timedelta(microseconds=1)


def moment(us: int):
    return F.timestamp_micros(F.lit(us))


class SharedFiles:
    """Small files in a shared folder, each written as a whole under a name that nobody has taken."""

    def __init__(self, spark: SparkSession, path: str, folders: tuple[str, ...]):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._names = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        for folder in folders:
            self._files.mkdirs(self._at(folder))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> bytes:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, name: str, data: bytes, private: bool = False) -> bool:
        """Writes a file under a new name as a whole; False where the name is taken."""
        draft = self._at(f".draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        try:
            if private:
                self._files.setPermission(draft, self._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
            stream.write(bytearray(data))
        finally:
            stream.close()
        try:
            self._names.rename(draft, self._at(name), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:  # noqa: BLE001 - py4j wraps whatever the file system says
            self._files.delete(draft, False)
            if self._files.exists(self._at(name)):
                return False
            raise
        return True

    def _listed(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._at(folder))]


class VaultStore(SharedFiles):
    """A vault kept under ``path`` in a shared file system, with its key.

    key: must be the one the store was made with; None takes the stored one, or makes one for a new store.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None, ttl: timedelta = TTL, segments: int = SEGMENTS):
        super().__init__(spark, path, ("manifests", "segments"))
        self.ttl, self.segments = ttl // timedelta(microseconds=1), segments
        self.key = self._opened(key)

    def __repr__(self) -> str:
        return f"VaultStore({self.path!r}, key id {key_id(self.key)})"

    # --- files ---------------------------------------------------------------------------

    def _opened(self, key: bytes | None) -> bytes:
        if not self._files.exists(self._at("key")):
            self._put("key", (new_key() if key is None else key).hex().encode(), private=True)
        stored = bytes.fromhex(self._read("key").decode())
        current = self.manifest()
        if key is not None and key != stored or current.version and current.key_id != key_id(stored):
            raise KeyMismatch("the vault was written with another key")
        return stored

    # --- versions ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("manifests") if n[:-5].isdigit() and n.endswith(".json"))

    def manifest(self) -> Manifest:
        done = self.versions()
        if not done:
            return Manifest(0, "", ())
        raw = json.loads(self._read(f"manifests/{done[-1]}.json"))
        return Manifest(done[-1], raw["key_id"], tuple(Segment(**s) for s in raw["segments"]))

    def _commit(self, after: Manifest, segments: tuple[Segment, ...]) -> Manifest:
        new = Manifest(after.version + 1, key_id(self.key), segments)
        body = {"key_id": new.key_id, "segments": [s.__dict__ for s in segments]}
        if not self._put(f"manifests/{new.version}.json", json.dumps(body).encode()):
            raise VaultConflict(f"version {new.version} of the vault exists")
        return new

    def _vacuum(self) -> None:
        """Deletes what only manifests beyond the kept ones name, and complete segments that were never committed."""
        def names(versions: list[int]) -> set[str]:
            return {s["name"] for v in versions for s in json.loads(self._read(f"manifests/{v}.json"))["segments"]}

        done = self.versions()
        old, kept = names(done[:-KEPT_MANIFESTS]), names(done[-KEPT_MANIFESTS:])
        for name in self._listed("segments"):
            age = micros(datetime.now(timezone.utc)) // 1000 - self._files.getFileStatus(self._at(f"segments/{name}")).getModificationTime()
            if name not in kept and (name in old or age > ABANDONED.total_seconds() * 1000):
                self._files.delete(self._at(f"segments/{name}"), True)
        for version in done[:-KEPT_MANIFESTS]:
            self._files.delete(self._at(f"manifests/{version}.json"), False)

    # --- entries -------------------------------------------------------------------------

    def _entries(self, s: Segment, now: int) -> DataFrame:
        rows = self.spark.read.schema(VAULT).parquet(f"{self.path}/segments/{s.name}")
        if s.first is not None:
            rows = rows.where(F.col("at") >= moment(s.first - self.ttl)).withColumn("at", F.greatest("at", moment(s.last)))
        return rows.where(F.col("at") >= moment(now - self.ttl))

    def load(self, now: datetime | None = None, version: Manifest | None = None) -> DataFrame:
        """Live entries (placeholder, secret, at) of a version, the newest by default."""
        at = micros(now or datetime.now(timezone.utc))
        held = (version or self.manifest()).segments
        out = empty_vault(self.spark)
        for s in held:
            if s.alive_until(self.ttl) >= at:
                out = out.unionByName(self._entries(s, at))
        return out

    def _written(self, entries: DataFrame, rows: int) -> Segment:
        name = uuid.uuid4().hex
        entries.select("placeholder", "secret", "at").coalesce(1 + rows // ROWS_A_FILE).write.parquet(f"{self.path}/segments/{name}")
        seen = self.spark.read.schema(VAULT).parquet(f"{self.path}/segments/{name}").agg(F.count("*").alias("n"), F.unix_micros(F.max("at")).alias("newest")).first()
        return Segment(name, seen["n"], seen["newest"] or 0)

    def extend(self, added: DataFrame, after: Manifest, now: datetime | None = None) -> Manifest:
        """Adds entries (placeholder, secret) to the version they were made from, and renews what is alive.

        Raises ``VaultConflict`` if there is a newer version by now; nothing is changed then.
        """
        at = micros(now or datetime.now(timezone.utc))
        alive = [s for s in after.segments if s.alive_until(self.ttl) >= at]
        fresh = cut_lineage(added.select("placeholder", "secret").withColumn("at", moment(at)))
        rows = fresh.count()
        if rows:
            alive.append(self._written(fresh, rows))
        kept, merged = self._to_merge(alive)
        if merged:
            entries = [self._entries(s, at) for s in merged]
            whole = entries[0]
            for more in entries[1:]:
                whole = whole.unionByName(more)
            kept.append(self._written(whole, sum(s.rows for s in merged)))
        new = self._commit(after, tuple(s.renewed(at) for s in kept))
        self._vacuum()
        return new

    def _to_merge(self, alive: list[Segment]) -> tuple[list[Segment], list[Segment]]:
        """Merges the smaller segments once there are too many; a segment larger than all smaller ones together stays."""
        if len(alive) <= self.segments:
            return list(alive), []
        by_size = sorted(alive, key=lambda s: s.rows)
        total, stays = 0, []
        for i, s in enumerate(by_size):
            if i > 1 and s.rows > total:
                stays = by_size[i:]
                break
            total += s.rows
        if len(stays) >= self.segments:  # never more than the bound, however the sizes lie
            stays = []
        names = {s.name for s in stays}
        return [s for s in alive if s.name in names], [s for s in alive if s.name not in names]

    def clear(self) -> bool:
        """Removes entries and key; False when there were no entries."""
        had = bool(self.manifest().segments)
        self._files.delete(self._at(""), True)
        return had

    def file_count(self) -> int:
        files = self._files.listFiles(self._at(""), True)
        n = 0
        while files.hasNext():
            n += not files.next().getPath().getName().startswith((".", "_"))
        return n


__all__ = ["KeyMismatch", "Manifest", "Segment", "VaultConflict", "VaultStore", "key_id"]
