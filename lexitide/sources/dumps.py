"""Compressed JSON-lines dumps: line readers, tolerant decoding, and the count of lines that failed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Numbers come as numbers or as strings, so they are decoded as strings first.
LINE = "id string, author string, created_utc string, title string, selftext string, body string, parent_id string, num_comments string"


def _files(path: str) -> list[str]:
    """The file, or what a folder holds but for names that Spark's readers pass over too."""
    if not os.path.isdir(path):
        return [path]
    found = sorted(e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith(("_", ".")))
    return [f for f in found if not f.endswith("._COPYING_")]


class _Files(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.window = int(options.get("window_log", 31))
        self.last = options.get("unterminated", "drop")

    def partitions(self):
        return [InputPartition(f) for p in self.paths for f in _files(p)]

    def read(self, partition):
        """Lines of one file, decoded a piece at a time; a piece may end inside a line or a character."""
        import zstandard

        if partition is None:  # Spark's stand-in where there is no file
            return
        with open(partition.value, "rb") as f, zstandard.ZstdDecompressor(max_window_size=1 << self.window).stream_reader(f, read_across_frames=True) as r:
            rest = b""
            while piece := r.read(1 << 24):
                *lines, rest = (rest + piece).split(b"\n")
                for x in lines:
                    yield (x.decode("utf-8", "replace"),)
            if rest and self.last == "keep":
                yield (rest.decode("utf-8", "replace"),)


class ZstLines(DataSource):
    """``spark.read.format("zst_lines")``: lines of Zstandard files with windows up to 2 GiB, one task a file.

    Options: path (files and folders, comma-separated), window_log (31), unterminated (drop or keep a last line without a line end).
    """

    @classmethod
    def name(cls):
        return "zst_lines"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return _Files(self.options)


def _whole_files(batches):
    import io

    import pyarrow as pa
    import zstandard

    for batch in batches:
        for content in batch.column(0):
            with zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(io.BytesIO(content.as_py()), read_across_frames=True) as r:
                rest = b""
                while piece := r.read(1 << 24):
                    *found, rest = (rest + piece).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in found], pa.string())], ["value"])


#: A Zstandard frame that readers skip, four bytes of magic and a length of 0; as a line end it closes a file without harm.
SKIPPED = "P*M\x18\0\0\0\0"


def _frames(batches):
    import pyarrow as pa
    import zstandard

    for batch in batches:
        text = "".join(f"{x}\n" for x in batch.column(0).to_pylist() if x is not None)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(text.encode())], pa.binary())], ["value"])


def write_zst(lines_: DataFrame, path: str) -> None:
    """Lines (the first column) as Zstandard files, a frame for each batch of rows; files commit as any other output."""
    frames = lines_.select(F.col(lines_.columns[0]).cast("string")).mapInArrow(_frames, "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", SKIPPED).text(path)


def _opens(spark: SparkSession, path: str) -> bool:
    """Whether open() gets at a path as Spark means it: it names no store, and the default store is the local one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.toUri().getScheme() is None and p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def lines(spark: SparkSession, path: str, long_window: bool = False, partitions: int | None = None, **options) -> DataFrame:
    """value: the lines of dumps. Spark's own reader does for plain windows and any store; files are not
    splittable, so what follows should run on more partitions. Long windows in a store that only Spark
    reads (a path with a scheme, or any where the default store is not the local one) go through whole files
    of at most 2 GiB, as compressed. A path may be a folder, as Spark writes them."""
    if long_window and not _opens(spark, path):
        df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_whole_files, "value string")
    elif long_window:
        spark.dataSource.register(ZstLines)
        df = spark.read.format("zst_lines").options(path=path, **options).load()
    else:
        df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


#: Spark's JSON reader takes lines with a longer string, 20 million characters otherwise, for broken ones.
LONGEST = {"maxStringLen": str(2**31 - 1)}


def decode(lines_: DataFrame, kind: str, need_parent: bool = False) -> DataFrame:
    """Decoded rows with kind and ok; ok is false where the line is not JSON or lacks a required field."""
    got = F.from_json("value", F.lit(f"{LINE}, __bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", **LONGEST})
    rows = lines_.select("value", got.alias("j")).select("value", "j.*")
    required = ["id", "author", "created_utc"] + (["title", "num_comments"] if kind == "submission" else []) + (["parent_id"] if need_parent and kind == "comment" else [])
    ok = F.col("__bad").isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return rows.withColumn("num_comments", F.col("num_comments").try_cast("long")).withColumn("kind", F.lit(kind)).withColumn("ok", ok).drop("__bad", "value")


def both(submissions: DataFrame, comments: DataFrame, need_parent: bool = True) -> DataFrame:
    return decode(submissions, "submission").unionByName(decode(comments, "comment", need_parent))


def bad_lines(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("kind").agg(F.count_if(~F.col("ok")).alias("bad_lines"), F.count("*").alias("lines"))
