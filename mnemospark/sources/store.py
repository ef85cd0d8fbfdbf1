"""Snapshots of the store: immutable table folders and numbered version files that name the current version.

A commit writes all changed tables under a new folder and then creates the next numbered version file, which nobody else may
have created: a batch is seen whole or not at all, a crash leaves the version before, and of two writers that began with
the same version the second one fails. Unchanged tables are referred to, not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tables and their schemas.
SCHEMAS = {
    "memories": "id string, text string, vector array<double>, memory_type string, created_at bigint, updated_at bigint, expires_at bigint, is_superseded boolean, pinned boolean, parent_memory_id string, access_count bigint, last_accessed_at bigint",
    "entities": "id string, canonical_name string, kind string, first_seen bigint, last_seen bigint, merged_into_id string",
    "entity_aliases": "id string, entity_id string, surface_text string, normalized_text string, kind string, first_seen bigint, last_seen bigint",
    "entity_mentions": "memory_id string, alias_id string",
    "relationships": "id string, source_id string, target_id string, relation_type string, created_at bigint",
    "profile_cache": "profile_type string, content string, updated_at bigint",
    "embedding_cache": "hash string, vector array<double>, created_at bigint",
    "embedding_signature": "scope string, provider_id string, model_id string, dimensions int, updated_at bigint",
    "access_log": "id string, at bigint",
}


class Store:
    """A folder on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._begun: int | None = None
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")

    def _versions(self) -> list[int]:
        at = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _content(self, n: int) -> dict[str, str] | None:
        """What a version file says; None where its writer ended before it was whole."""
        s = self._fs.open(self._path(f"versions/{n:012d}"))
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            s.close()

    def current(self) -> dict[str, str]:
        """Table -> folder of the version begun, else of the newest whole one; empty for a new store."""
        for n in reversed(self._versions()):
            if (self._begun is None or n <= self._begun) and (got := self._content(n)) is not None:
                return got
        return {}

    def begin(self) -> None:
        """Read one version until the next commit, which fails if another one was made meanwhile."""
        self._begun = max(self._versions(), default=0)

    def read(self, table: str) -> DataFrame:
        """The current rows of a table; none, with its schema, where it was never written."""
        at = self.current().get(table)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{at}")

    def commit(self, **tables: DataFrame) -> dict[str, str]:
        """Write new versions of the given tables and make them current together; FileExistsError if another commit came between."""
        version, base, now = uuid.uuid4().hex, self._begun, self.current()
        if base is None:
            base = max(self._versions(), default=0)
        try:
            for name, df in tables.items():
                if name not in SCHEMAS:
                    raise ValueError(f"no such table: {name}")
                cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
                df.select(*cols).write.parquet(f"{self.root}/v-{version}/{name}")
                now[name] = f"v-{version}/{name}"
            if max(self._versions(), default=0) != base:
                raise FileExistsError(f"version {base + 1} was written by another commit")
            out = self._fs.create(self._path(f"versions/{base + 1:012d}"), False)
            out.write(bytearray(json.dumps(now).encode()))
            out.close()
        finally:
            self._begun = None
        return now

    def wipe(self) -> None:
        """All tables empty; the embedding signature stays."""
        now = self.current()
        self.commit(**{t: self.spark.createDataFrame([], SCHEMAS[t]) for t in now if t != "embedding_signature"})

    def reset(self) -> None:
        """Remove the store with all its versions."""
        self._fs.delete(self._path(""), True)

    def signature_matches(self, provider: str, model: str, dims: int) -> bool:
        r = self.read("embedding_signature").where("scope = 'memories'").select("provider_id", "model_id", "dimensions").first()
        return r is not None and tuple(r) == (provider, model, dims)
