"""Helpers shared by the operators: reading, durable intermediates, whole-text word counts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import ship

#: ASCII capitals and their small letters; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts longer than this are split into words piece by piece.
PIECE = 1 << 20
#: Of each frame that ``mapped`` made and that is still held: what it was made from, and the pass.
_MADE: WeakKeyDictionary[DataFrame, tuple[DataFrame, Callable]] = WeakKeyDictionary()
_SPACE_BYTE, _SPACE_CHAR = re.compile(rb"[\x20\x09-\x0D]"), re.compile(r"\s")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables, by Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; where it is unset and there is but one machine, a folder of our own."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp())
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table stands for the frame from here on, so its shuffle files go with the job
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def streamed(frame: DataFrame) -> DataFrame:
    """``frame``, after its session was told to hand Arrow batches of a few MB to Python, however long the texts are.

    The workers are sent this package, too.
    """
    ship(frame.sparkSession)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame


def mapped(frame: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``streamed(frame)`` through ``run`` by Arrow batches; if ``frame`` was made here itself, both passes go through one worker.

    Spark gives every pass of a stage workers of its own, which stay in memory with all they have learnt.
    """
    source, before = _MADE.get(frame, (frame, None))
    both = run if before is None else lambda batches: run(before(batches))
    made = streamed(source).mapInArrow(both, schema)
    _MADE[made] = source, both
    return made


def trimmed(batches: Iterator) -> Iterator:
    """The batches; after the last, what the allocator of this worker keeps goes back to the system, where it can."""
    yield from batches
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another system's C library
        pass


def discard(frame: DataFrame) -> None:
    """Removes what ``written`` wrote, once nothing reads it any more."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def word_pieces(text: bytes | str) -> Iterator[list]:
    """The words of ``text.split()``, those of about PIECE characters at a time."""
    space, at = (_SPACE_BYTE if isinstance(text, bytes) else _SPACE_CHAR), 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (found := space.search(text, at + PIECE)):
            end = found.start()
        yield (text[at:end] if at or end < len(text) else text).split()
        at = end


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` the text holds; 0 for null."""
    parts = F.split(text, SPACE)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.coalesce((F.size(parts) - edges).cast("long"), F.lit(0).cast("long"))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null where the key is null."""
    return F.crc32(key.cast("string")) % by
