"""Stored tables that change in parts: versions, bucketed upserts and folded stream results.

A version is a small JSON file with a number.  Writers put their data beside what is
there, under names of their own, and then publish the next number; readers follow the
highest one.  A writer that dies before it publishes leaves files that nobody reads;
two writers cannot publish the same number.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tonearm.operators.catalogue import last_by


class Folder:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        fs, at = self._fs(), self._at(sub)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest version; (0, None) before the first."""
        numbers = [n for n in self.names("_versions") if n.endswith(".json")]
        if not numbers:
            return 0, None
        stream = self._fs().open(self._at(f"_versions/{numbers[-1]}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return int(numbers[-1].split(".")[0]), json.loads(text)

    def publish(self, number: int, content: dict) -> None:
        """Make ``content`` version ``number``; an error if another writer has."""
        fs, target, own = self._fs(), self._at(f"_versions/{number:012d}.json"), self._at(f"_versions/_{uuid.uuid4().hex}")
        stream = fs.create(own)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(own, target):
            fs.delete(own, False)
            raise RuntimeError(f"version {number} of {self.path} was published by another writer")


class KeyedTable:
    """A table by key in hash buckets; an upsert writes anew only the buckets that its keys fall into."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], version: str = "version", buckets: int = 64) -> "KeyedTable":
        """A new table; of several rows with one key the one of the highest version stays."""
        table = cls(rows.sparkSession, path)
        number, content = table.folder.latest()
        if content is not None:
            raise ValueError(f"{path} holds a table already")
        table._publish(number, {"keys": keys, "version": version, "n": buckets, "schema": rows.schema.json(), "buckets": {}}, last_by(rows, keys, [version]))
        return table

    def _bucket(self, rows: DataFrame, content: dict) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*content["keys"]), F.lit(content["n"])).cast("int"))

    def _publish(self, number: int, content: dict, rows: DataFrame) -> None:
        own = f"data/{uuid.uuid4().hex}"
        self._bucket(rows, content).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.path}/{own}")
        written = {n.split("=")[1]: f"{own}/{n}" for n in self.folder.names(own) if n.startswith("_bucket=")}
        self.folder.publish(number + 1, {**content, "buckets": {**content["buckets"], **written}})

    def _read(self, content: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        paths = [f"{self.folder.path}/{content['buckets'][b]}" for b in buckets if b in content["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        _, content = self.folder.latest()
        return self._read(content, list(content["buckets"]))

    def upsert(self, changes: DataFrame) -> int:
        """Last version per key wins; returns how many buckets were written."""
        number, content = self.folder.latest()
        changes = changes.select(*StructType.fromJson(json.loads(content["schema"])).fieldNames())
        touched = [str(r[0]) for r in self._bucket(changes, content).select("_bucket").distinct().collect()]  # at most the buckets there are
        if touched:
            old = self._read(content, touched)
            self._publish(number, content, last_by(old.unionByName(changes), content["keys"], [content["version"]]))
        return len(touched)

    def clean(self, keep: int = 2) -> int:
        """Delete the files that none of the last ``keep`` versions reads; returns the number of bucket folders deleted."""
        number, _ = self.folder.latest()
        used = set()
        for name in self.folder.names("_versions")[-keep:]:
            stream = self.folder._fs().open(self.folder._at(f"_versions/{name}"))
            used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"].values())
            stream.close()
        gone = [f"data/{own}/{b}" for own in self.folder.names("data") for b in self.folder.names(f"data/{own}")
                if b.startswith("_bucket=") and f"data/{own}/{b}" not in used]
        for name in gone:
            self.folder.delete(name)
        for name in self.folder.names("_versions")[:-keep]:
            self.folder.delete(f"_versions/{name}")
        return len(gone)


class FoldedEpochs:
    """Results of a stream: one folder per epoch, folded into a snapshot when ``fold`` of them are there.

    ``newest(rows)`` keeps of rows with their ``epoch`` those that still count.  The version
    names the snapshot and the last epoch in it; an epoch that is repeated after a restart and
    is in the snapshot already is left out.
    """

    def __init__(self, spark: SparkSession, path: str, newest: Callable[[DataFrame], DataFrame], fold: int = 8):
        self.spark, self.folder, self.newest, self.fold = spark, Folder(spark, path), newest, fold

    def _state(self) -> tuple[int, dict]:
        number, content = self.folder.latest()
        return number, content or {"through": -1, "snapshot": None}

    def _epochs(self, content: dict) -> list[int]:
        return sorted(e for e in (int(n.split("=")[1]) for n in self.folder.names() if n.startswith("epoch=")) if e > content["through"])

    def write(self, batch: DataFrame, epoch: int) -> None:
        number, content = self._state()
        if epoch <= content["through"]:
            return
        batch.write.mode("overwrite").parquet(f"{self.folder.path}/epoch={epoch}")
        open_ = self._epochs(content)
        if len(open_) >= self.fold:
            own = f"snapshot-{uuid.uuid4().hex}"
            self.read().write.parquet(f"{self.folder.path}/{own}")
            self.folder.publish(number + 1, {"through": open_[-1], "snapshot": own, "before": content["snapshot"]})
            # the snapshot before stays for those who read it; what it replaced and what is folded goes
            for name in [f"epoch={e}" for e in open_] + ([content["before"]] if content.get("before") else []):
                self.folder.delete(name)
            for name in self.folder.names("_versions")[:-2]:
                self.folder.delete(f"_versions/{name}")

    def read(self) -> DataFrame:
        """The rows that count, with their epoch."""
        _, content = self._state()
        parts = [self.spark.read.parquet(f"{self.folder.path}/{content['snapshot']}")] if content["snapshot"] else []
        parts += [self.spark.read.parquet(f"{self.folder.path}/epoch={e}").withColumn("epoch", F.lit(e)) for e in self._epochs(content)]
        if not parts:
            raise ValueError(f"{self.folder.path} holds no epoch")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self.newest(rows)
