"""A versioned store: each table is a series of Parquet snapshots, one pointer names the current ones.

A commit writes new snapshots beside the old and then moves the pointer by an
atomic rename, so readers see all of a commit or nothing, and no path that is
being read is overwritten. Older snapshots lacking newer columns are read with
nulls in them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES

VERSION = "1.0.0"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path))] if self._fs.exists(self._Path(self.path)) else []
        versions = sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and n.removeprefix("manifest-").isdigit())
        if not versions:
            return {"version": 0, "code": VERSION, "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifest-{versions[-1]}", wholetext=True).first()[0]
        found = json.loads(text)
        if tuple(map(int, found["code"].split("."))) > tuple(map(int, VERSION.split("."))):
            raise ValueError(f"the store was written by version {found['code']}, this is {VERSION}")
        return found

    def read(self, name: str) -> DataFrame:
        at = self._pointer()["tables"].get(name)
        schema = TABLES[name]
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{at}")

    def commit(self, **tables: DataFrame) -> int:
        """Write snapshots of the given tables (nulls for columns they lack) and make them current together."""
        old = self._pointer()
        new = {"version": old["version"] + 1, "code": VERSION, "tables": dict(old["tables"])}
        for name, df in tables.items():
            at = f"{name}/v{new['version']}-{uuid.uuid4().hex[:12]}"  # another writer's snapshot of the same version is another folder
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]
            df.select(*cols).write.parquet(f"{self.path}/{at}")
            new["tables"][name] = at
        draft, final = self._Path(f"{self.path}/.draft-{new['version']}-{uuid.uuid4().hex[:12]}"), self._Path(f"{self.path}/manifest-{new['version']}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError("another writer committed first")
        return new["version"]

    def get(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("k") == key).first()
        return row["v"] if row else None

    def put(self, key: str, value: str) -> None:
        kept = self.read("meta").where(F.col("k") != key)
        self.commit(meta=kept.unionByName(self.spark.createDataFrame([(key, value)], "k string, v string")))
