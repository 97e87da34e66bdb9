"""Files by path: whole files and their lines in, one file a name out.

Reading goes through Spark's binaryFile source, so any store that Spark reads will do; small files are packed into partitions, and a
file is never split, as its lines are numbered. A leading byte-order mark is dropped. A file that is not UTF-8 gives one row with the reason in
`_corrupt` and no content.

Writing is in two steps. Tasks write each name's text below a hidden folder of the target. When all are done the files move to their own names; a move is one
call to the store's name service, whatever the file's size. If anything fails before, the hidden folder goes and the target is as it was.
Where the target is a mounted folder (file:), tasks write the files under their names and tasks move them: the driver sees counts only. A task that runs twice
replaces its own files. Other stores are reached through Spark's committed text writer, and the driver asks for the moves, as only its JVM can.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a line of a file read by lines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def stem(path: Column) -> Column:
    """A file's name without its last ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def folder(path: Column) -> Column:
    """The name of the folder a file is in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_files(spark: SparkSession, path: str, glob: str | None = None, media: Callable[[Column], Column] = stem) -> DataFrame:
    """(media_id, path, content, _corrupt) of the files at or below a path whose names match glob; media names a file's media by its path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return raw.select(media(F.col("path")).alias("media_id"), "path", plain.alias("content"), F.when(plain.isNull(), "not UTF-8").alias("_corrupt"))


def lines_of(files: DataFrame) -> DataFrame:
    """(media_id, line_no from 1, line, _corrupt) of read_files' rows; a corrupt file is one row without a line."""
    # a line end at the end of the file begins no further line
    body = F.regexp_replace("content", f"(?:{LINE_END})$", "")
    rows = files.select("media_id", "_corrupt", F.posexplode_outer(F.when(F.col("content") != "", F.split(body, LINE_END))).alias("pos", "line"))
    return rows.where("line IS NOT NULL OR _corrupt IS NOT NULL").select("media_id", (F.col("pos") + 1).alias("line_no"), "line", "_corrupt")


def read_lines(spark: SparkSession, path: str, glob: str | None = None, media: Callable[[Column], Column] = stem) -> DataFrame:
    return lines_of(read_files(spark, path, glob, media))


def readable(files: DataFrame, failfast: bool = False) -> DataFrame:
    """read_files' or read_lines' rows without the corrupt ones, or with failfast an error at the first of them."""
    if not failfast:
        return files.where("_corrupt IS NULL").drop("_corrupt")
    said = F.concat(F.lit("unreadable file: "), F.col("media_id").cast("string"), F.lit(", "), F.col("_corrupt"))
    # the filter that raises comes before any that could drop the row
    return files.where(F.when(F.col("_corrupt").isNull(), True).otherwise(F.raise_error(said).cast("boolean"))).drop("_corrupt")


def read_values(spark: SparkSession, path: str, glob: str | None = None, media: Callable[[Column], Column] = stem) -> DataFrame:
    """(media_id, value, _corrupt): a whole file a row."""
    return read_files(spark, path, glob, media).select("media_id", F.col("content").alias("value"), "_corrupt")


def unreadable(files: DataFrame) -> DataFrame:
    """(media_id, error) of the corrupt rows of any reader here."""
    return files.where("_corrupt IS NOT NULL").select("media_id", F.col("_corrupt").alias("error")).distinct()


def write_files(texts: DataFrame, path: str, mode: str = "error") -> int:
    """Writes texts(name, content), a file a row, named `name` below path (with folders if it has slashes); returns how many.

    mode error: the target must be new or empty; overwrite: files of the same names are replaced, others stay. A name that is null, empty, leaves
    the target or comes twice fails the write. A file ends with one line end, whether or not its content does."""
    if mode not in ("error", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    spark = texts.sparkSession
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = at(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "error" and fs.exists(target) and len(fs.listStatus(target)):
        raise FileExistsError(path)
    bad = F.col("name").isNull() | F.col("name").rlike(r"^/|/$|//|^$|(^|/)\.{1,2}(/|$)")
    checked = texts.select(F.when(bad, F.raise_error(F.concat(F.lit("bad file name: "), F.coalesce("name", F.lit("null"))))).otherwise(F.col("name")).alias("name"), F.regexp_replace(F.coalesce("content", F.lit("")), r"\n$", "").alias("value"))
    stage = f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    made = not fs.exists(target)
    try:
        uri = fs.makeQualified(target).toUri()
        n = _by_tasks(checked, uri.getPath(), stage) if uri.getScheme() == "file" else _by_driver(checked, path, stage, fs)
        fs.delete(at(stage), True)
        return n
    except BaseException:
        fs.delete(target if made else at(stage), True)
        raise


def _put(top: str):
    """A task's writer of (name, value) rows, sorted by name: each text in a file of its name below top. Gives the names and whether one came again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            again = []
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                again.append(name == last)
                last, to = name, f"{top}/{name}"
                os.makedirs(os.path.dirname(to), exist_ok=True)
                own = f"{to}.{uuid.uuid4().hex}"  # a file appears whole
                with open(own, "w", encoding="utf-8", newline="") as f:
                    f.write(value + "\n")
                os.replace(own, to)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(again, pa.bool_())], ["name", "again"])

    return run


def _move(top: str, target: str):
    """A task's mover of the files of its names; one that is there already was moved by an earlier run of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                folder, base = os.path.split(f"{target}/{name}")
                os.makedirs(folder, exist_ok=True)
                try:
                    os.replace(f"{top}/{name}", f"{folder}/{base}")
                except FileNotFoundError:
                    if not os.path.exists(f"{folder}/{base}"):
                        raise
                # the checksum that Hadoop's writer may have left is of the file before
                if os.path.exists(f"{folder}/.{base}.crc"):
                    os.remove(f"{folder}/.{base}.crc")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def _by_tasks(checked: DataFrame, folder: str, stage: str) -> int:
    """Files written and moved by tasks, in a folder that all of them have mounted."""
    top = f"{folder}/{stage.rsplit('/', 1)[1]}/files"
    # all rows of a name meet in one task
    put = checked.repartition("name").sortWithinPartitions("name").mapInArrow(_put(top), "name string, again boolean")
    put.write.parquet(f"{stage}/names")
    names = checked.sparkSession.read.schema("name string, again boolean").parquet(f"{stage}/names")
    twice = names.where("again").select("name").limit(1).collect()
    if twice:
        raise ValueError(f"file name twice: {twice[0][0]}")
    return names.select("name").mapInArrow(_move(top, folder), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n


def _by_driver(checked: DataFrame, path: str, stage: str, fs) -> int:
    """Files written by Spark's text writer, each in a folder, and moved by calls of the driver."""
    spark = checked.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    # names in hexadecimal are safe as folder names; all rows of a name meet in one task, which numbers them
    coded = checked.withColumn("f", F.hex(F.encode("name", "utf-8"))).drop("name").repartition("f")
    coded.write.partitionBy("f").text(stage)
    _one_row_each(spark, checked)
    names = [n for s in fs.listStatus(at(stage)) if (n := s.getPath().getName()).startswith("f=")]

    def move(coded: str) -> None:
        own = [s.getPath() for s in fs.listStatus(at(f"{stage}/{coded}")) if not s.getPath().getName().startswith(("_", "."))]
        to = at(f"{path.rstrip('/')}/{bytes.fromhex(coded[2:]).decode()}")
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            fs.delete(to, False)
        if not fs.rename(own[0], to):
            raise OSError(f"could not move {to}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, names))
    return len(names)


def _one_row_each(spark: SparkSession, checked: DataFrame) -> None:
    twice = checked.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name").limit(1).collect()
    if twice:
        raise ValueError(f"file name twice: {twice[0][0]}")
