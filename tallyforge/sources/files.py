"""Large files: places of lines, hashes of files of any size, and logs of records in segments."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import stored

#: Files up to this size are hashed by the executors in one piece; ``binaryFile`` holds a file in memory.
WHOLE = 1 << 28
CHUNK = 1 << 20
#: Chunks that one task reads.
STRETCH = 64


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, line) of text files; positions count from 0 in each file, blank lines too.

    A file's lines are read in splits by many tasks. The lines of each split are counted, and a split's first position is the sum over the
    splits of its file before it; inside a split the reader's own order gives the place. So no task sees a whole file.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = stored(lines)  # ids are given once
    splits = lines.groupBy("path", "start").agg(F.count("*").alias("many"), F.min("at").alias("first"))
    before = splits.withColumn("before", F.sum("many").over(Window.partitionBy("path").orderBy("start")) - F.col("many")).drop("many")  # a row for each split
    return lines.join(before, ["path", "start"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("position"), "line")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def streamed_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size and file system, as one stream of small buffers in the driver's JVM."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _empty(files: DataFrame) -> list[str]:
    """Files without a byte, which a reader of files leaves out."""
    every = {unquote(n).replace(":///", ":/") for n in files.inputFiles()}
    return sorted(every - {r.path for r in files.select("path").collect()})  # names only


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, size, sha256) of files. The executors hash those up to ``whole`` bytes; a larger one, which must be one stream, is read in small buffers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if none := _empty(files):
        small = small.unionByName(spark.createDataFrame([(n, 0, hashlib.sha256().hexdigest()) for n in none], "path string, size long, sha256 string"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("size")).collect()  # a few large files' names
    if not large:
        return small
    return small.unionByName(spark.createDataFrame([(r.path, r.size, streamed_sha256(spark, r.path)) for r in large], "path string, size long, sha256 string"))


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.chunk = json.loads(options["paths"]), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        step = self.chunk * STRETCH
        return [_Stretch(path, at, min(at + step, size)) for path, size in self.paths for at in range(0, size, step)] or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        if not partition.path:
            return
        fs, name = FileSystem.from_uri(partition.path)
        with fs.open_input_file(name) as f:
            for at in range(partition.start, partition.end, self.chunk):
                yield partition.path, at // self.chunk, hashlib.sha256(f.read_at(min(self.chunk, partition.end - at), at)).digest()


class FileChunks(DataSource):
    """A source of (path, place, sha256) rows of the chunks of files, each read by a task that holds one chunk at a time."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "path string, place long, sha256 binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


def tree_hashes(spark: SparkSession, path: str, chunk: int = CHUNK, fan: int = 1024) -> DataFrame:
    """(path, size, tree_sha256) of files of any size, hashed by many tasks: a tree of SHA-256 over chunks, ``fan`` children a node.

    A level is one grouping of the level below; an empty file has the hash of nothing. Files must lie where the executors' file systems reach them.
    """
    spark.dataSource.register(FileChunks)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = [(r.path, r.length) for r in files.select("path", "length").collect()] + [(n, 0) for n in _empty(files)]  # names only
    names = [(f"file://{n[5:]}" if n.startswith("file:/") and not n.startswith("file://") else n, size) for n, size in names]
    level = spark.read.format("file_chunks").option("paths", json.dumps([n for n in names if n[1]])).option("chunk", chunk).load()
    many = {n: -(-size // chunk) for n, size in names}
    sizes = spark.createDataFrame([(n, size, many[n]) for n, size in names], "path string, size long, many long")
    level = level.join(sizes.select("path", "many"), "path")
    for _ in range(next(i for i in range(99) if fan**i >= max(many.values(), default=0))):  # a file that has one node is at its root
        nodes = level.where("many > 1").groupBy("path", "many", F.floor(F.col("place") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "sha256"))).alias("x"))  # ``fan`` at most
        joined = F.unhex(F.array_join(F.transform("x", lambda v: F.hex(v["sha256"])), ""))
        up = nodes.select("path", F.col("up").alias("place"), F.unhex(F.sha2(joined, 256)).alias("sha256"), F.ceil(F.col("many") / fan).alias("many"))
        level = level.where("many = 1").unionByName(up)
    empty = hashlib.sha256().hexdigest()
    return sizes.join(level, "path", "left").select("path", "size", F.coalesce(F.lower(F.hex("sha256")), F.lit(empty)).alias("tree_sha256"))


class RecordLog:
    """A log of records as numbered segments of JSON lines in a folder.

    A writer lists the folder once, when it opens it; each append is one new file, made durable. A number that another writer took is
    passed over. ``compact`` puts whole runs of segments into one, under a name that says which numbers it covers; readers leave out what such a file covers, so they see
    each record once whenever they look. A segment that breaks off in its last line (the writer died in it) loses that line.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        p, self.fs = _fs(spark, self.folder)
        self.fs.mkdirs(p)
        self.next = max((last for _, last, _ in self._listed()), default=-1) + 1

    def _listed(self) -> list[tuple[int, int, str]]:
        """(first, last, path) of segments; those that a compacted one covers are left out."""
        p, _ = _fs(self.spark, self.folder)
        names = [f.getPath().getName() for f in self.fs.listStatus(p)]
        runs = sorted((*map(int, n.split(".")[0].split("-")), n) for n in names if n.endswith(".jsonl") and not n.startswith(("_", ".")))
        out: list[tuple[int, int, str]] = []
        for first, last, name in sorted(runs, key=lambda r: (r[0], -r[1])):
            if not out or first > out[-1][1]:
                out.append((first, last, f"{self.folder}/{name}"))
        return out

    def append(self, *records: dict) -> int:
        """Write records as one segment, durably, and return its number."""
        text = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n" for r in records)
        while True:
            n, self.next = self.next, self.next + 1
            path, _ = _fs(self.spark, f"{self.folder}/{n:020d}-{n:020d}.jsonl")
            try:
                out = self.fs.create(path, False)
                break
            except Py4JJavaError:
                if not self.fs.exists(path):
                    raise
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return n

    def lines(self) -> DataFrame:
        """(line) of all whole records."""
        paths = [path for _, _, path in self._listed()]
        if not paths:
            return self.spark.createDataFrame([], "line string")
        text = self.spark.read.text(paths).where(F.trim("value") != "").select(F.col("value").alias("line"))
        return text.where(F.json_object_keys("line").isNotNull())

    def read(self, schema: str) -> DataFrame:
        """All whole records."""
        return self.lines().select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    def compact(self, keep: int = 0) -> int:
        """Put all segments but the ``keep`` newest into one; returns how many there were. The new file is whole before it gets its name."""
        runs = self._listed()
        runs = runs[: len(runs) - keep] if keep else runs
        if len(runs) < 2:
            return len(runs)
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{runs[0][0]:020d}-{runs[-1][1]:020d}.jsonl")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        for _, _, path in runs:
            source = self.fs.open(jvm.org.apache.hadoop.fs.Path(path))
            text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source))
            source.close()
            out.write(bytearray(text[: text.rfind(b"\n") + 1]))  # a torn last line goes
        out.hsync()
        out.close()
        if not self.fs.rename(part, target):
            raise OSError(f"{target} is there already")
        for _, _, path in runs:
            self.fs.delete(jvm.org.apache.hadoop.fs.Path(path), False)
        return len(runs)
