"""Named corpora: a registry, pages as Parquet by corpus, and writes that do not overwrite another session's."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


class Conflict(Exception):
    """Another session has written since."""


class Store:
    """Corpora under a root folder that Spark and its file systems can reach.

    A generation of a corpus is a fresh folder; the pointer file that names it is written whole under a new name and then
    given its own, which fails if another has it: readers see one generation or the next, and of two writers one succeeds.
    A writer states the generation it read, and fails if it is not current.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/registry/{name}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def generation(self, name: str) -> int:
        return max(self._pointers(name), default=0)

    def _publish(self, name: str, generation: int, entry: dict) -> None:
        folder = f"{self.root}/registry/{name}"
        self._fs.mkdirs(self._path(folder))
        temporary, final = self._path(f"{folder}/{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{generation}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        taken = not self._name(temporary, final)
        self._fs.delete(temporary, False)
        if taken:
            raise Conflict(f"{name}: generation {generation} was written by another session")

    def _name(self, temporary, final) -> bool:
        """Give a whole file its name in one step, unless another has it. A local rename would replace the other, a
        link does not; elsewhere the rename without overwriting is the file system's own, atomic on HDFS."""
        try:
            if self._fs.getScheme() == "file":
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(temporary, final, none)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def create(self, name: str, pages: DataFrame, description: str = "", force: bool = False) -> int:
        """A new corpus; with force a new generation of an old one."""
        at = self.generation(name)
        if at and not force:
            raise Conflict(f"{name} exists")
        return self.write(name, pages, at, description)

    def write(self, name: str, pages: DataFrame, read_at: int, description: str = "") -> int:
        folder = f"{self.root}/pages/corpus={name}/{uuid.uuid4().hex}"
        pages.write.parquet(folder)
        self._publish(name, read_at + 1, {"name": name, "root": folder, "description": description})
        return read_at + 1

    def entry(self, name: str) -> dict:
        at = self.generation(name)
        if not at:
            raise KeyError(name)
        text = self.spark.read.text(f"{self.root}/registry/{name}/{at}.json").first()[0]
        return json.loads(text)

    def read(self, name: str) -> DataFrame:
        """The current pages of one corpus: only its own folder is read."""
        return self.spark.read.parquet(self.entry(name)["root"]).withColumn("corpus", F.lit(name))

    def registry(self) -> DataFrame:
        folder = self._path(f"{self.root}/registry")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        rows = [(e["name"], e["root"], e["description"], self.generation(e["name"]), None) for e in map(self.entry, names)]
        return self.spark.createDataFrame(rows, schemas.REGISTRY)


def mixed(local: DataFrame, captures: DataFrame) -> DataFrame:
    """Local files and web captures in one corpus."""
    return local.unionByName(captures, allowMissingColumns=True)


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose fingerprint has not been read."""
    return found.join(known.select("sha256"), "sha256", "left_anti")


def rebuild_urls(sources: DataFrame) -> DataFrame:
    """Distinct non-empty addresses of a saved list of documents (column documents); none is an error for the caller."""
    return sources.select(F.explode("documents").alias("d")).select(F.col("d.url").alias("url")).where("url IS NOT NULL AND url <> ''").distinct()
