"""The shared working folder, written tables and a target with atomically published versions.

Everything that outlives a job goes below the folder named by ``spark.checkpoint.dir``, which all
executors of a cluster share. Only on a single machine without that setting (tests, a laptop) a local
folder is made once for the session.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
SPLIT_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a session-local folder only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="notefold-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/notefold/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once below the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation of everything before this point.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evenly(rows: DataFrame) -> DataFrame:
    """A small input over all cores: a file of one row group is one task's, however many cores there are.

    By the plan's own estimate of its size; an input with ``SPLIT_BYTES`` for each core has splits
    enough, and is left as it lies: it is never shuffled for this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


class Scratch:
    """Tables that are needed only until a piece of work is done; then they are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, fresh_path(spark, "scratch")
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clustered(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """As ``table``, in hash buckets of ``key``, sorted within them.

        Aggregates and joins on ``key`` then need no shuffle of these rows, however often they are read.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
        rows.option("path", f"{self.root}/{table}").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        _Files(self.spark, self.root).delete(self.root)


class _Files:
    """The few file-system calls that publishing needs, through Hadoop, so any shared store works."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.Path(root).toUri(), conf)

    def names(self, folder: str) -> list[str]:
        path = self.Path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.Path(file))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, file: str, text: str) -> None:
        """All of the text or nothing, and never over a file that is there already."""
        part = f"{file}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.Path(part), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = getattr(rename, "NONE")
        try:
            self.context.rename(self.Path(part), self.Path(file), how)
        except Exception:
            self.fs.delete(self.Path(part), False)
            raise

    def sizes(self, folder: str, prefix: str) -> dict[str, int]:
        """Bytes below each folder of a name with this prefix, by the rest of its name."""
        names = [n for n in self.names(folder) if n.startswith(prefix)]
        return {n[len(prefix) :]: self.fs.getContentSummary(self.Path(f"{folder}/{n}")).getLength() for n in names}

    def delete(self, path: str) -> None:
        self.fs.delete(self.Path(path), True)


@dataclass(frozen=True)
class Version:
    """One published state: which segments hold the key state, which hold what the runs put out."""

    number: int
    state: tuple[str, ...]
    outputs: tuple[str, ...]
    meta: dict


class VersionedTarget:
    """A table of immutable segments whose versions are published by one rename.

    A version is a small JSON file that lists segments. Readers see a version wholly or not at
    all; a run that breaks off leaves a segment that no version lists, and ``vacuum`` deletes it.
    Two writers that start from the same version can't both publish: the second rename fails.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.files = _Files(spark, self.root)

    def current(self) -> Version:
        names = [n for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json")]
        if not names:
            return Version(0, (), (), {})
        d = json.loads(self.files.read(f"{self.root}/_versions/{names[-1]}"))
        return Version(d["number"], tuple(d["state"]), tuple(d["outputs"]), d["meta"])

    def _read(self, segments: tuple[str, ...]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s}" for s in segments))

    def state(self, version: Version | None = None) -> DataFrame:
        return self._read((version or self.current()).state)

    def outputs(self, version: Version | None = None) -> DataFrame:
        return self._read((version or self.current()).outputs)

    def write_segment(self, df: DataFrame, kind: str = "seg") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(f"{self.root}/{name}")
        return name

    def publish(self, base: Version, state: tuple[str, ...], outputs: tuple[str, ...], meta: dict) -> Version:
        new = Version(base.number + 1, state, outputs, meta)
        text = json.dumps({"number": new.number, "state": state, "outputs": outputs, "meta": meta})
        self.files.write_new(f"{self.root}/_versions/{new.number:010d}.json", text)
        return new

    def vacuum(self) -> list[str]:
        """Delete segments that the current version doesn't list; only when no run is under way."""
        now = self.current()
        dead = [n for n in self.files.names(self.root) if "-" in n and n not in {*now.state, *now.outputs}]
        for n in dead:
            self.files.delete(f"{self.root}/{n}")
        return dead
