"""Session-level helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it was measured and is below both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
# So few narrow rows need no measuring.
SMALL_ROWS = 50_000
# Spark pushes a row_number() limit below the shuffle up to this many rows
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# A key with more rows than this on the large side of a shuffle join is spread over several tasks.
HOT_ROWS = 5_000_000
SALTS = 64
# Up to this many values are given to a scan as a literal list, which prunes row groups. From longer lists the
# reader makes one range (spark.sql.parquet.pushdown.inFilterThreshold), which prunes next to nothing.
PUSHED_VALUES = 10


# Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Files that a task writes beside each other, so its rows need no sort by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Bytes that the files a task writes beside each other gather before they are written out.
WRITER_BYTES = 128 << 20

_LOCAL_BASE: dict[str, str] = {}
# By session and setting: the value before ``configured``, then those that hold.
_HELD: dict[tuple[int, str], list[str | None]] = {}


class _Here:
    """What belongs to a process; a function that is sent to a task finds a new one there."""

    def __init__(self):
        self.lock = threading.Lock()
        # folders that ``stored`` made in the innermost ``scratch_scope`` of a thread
        self.made: ContextVar[list[str] | None] = ContextVar("corpusmill_scratch", default=None)

    def __reduce__(self):
        return _Here, ()


_HERE = _Here()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, below the folder all executors share."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL_BASE.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="corpusmill-")
        _LOCAL_BASE[context.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``stored`` writes within, in this thread.

    For work whose results are written elsewhere before the end, such as a micro-batch.
    """
    token = _HERE.made.set([])
    try:
        yield
    finally:
        made = _HERE.made.get()
        _HERE.made.reset(token)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold within. Where threads overlap, the last to leave puts back what was."""
    own = id(spark._jsparkSession)
    with _HERE.lock:
        for key, value in settings.items():
            _HELD.setdefault((own, key), [spark.conf.get(key, None)]).append(value)
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _HERE.lock:
            for key, value in settings.items():
                held = _HELD[own, key]
                del held[len(held) - 1 - held[::-1].index(value)]
                if held[-1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[-1])
                if len(held) == 1:
                    del _HELD[own, key]


def write_parquet(df: DataFrame, path: str, by: str | None = None, mode: str = "error", file_rows: int = 0,
                  codec: str | None = None, pieces: int = 0) -> None:
    """Write ``df``; the shuffle files of that job go as it ends, not when the driver happens to collect garbage.

    ``file_rows`` bounds the rows of a file. A task that meets at most ``pieces`` values of ``by`` writes them beside
    each other, unsorted.
    """
    with configured(df.sparkSession, {CLEANUP: "true"} | ({WRITERS: str(pieces)} if pieces else {})):
        writer = df.write.mode(mode)
        writer = writer.option("maxRecordsPerFile", file_rows) if file_rows else writer
        writer = writer.option("compression", codec) if codec else writer
        writer = writer.option("parquet.block.size", WRITER_BYTES // pieces) if pieces else writer
        (writer.partitionBy(by) if by else writer).parquet(path)


def stored(df: DataFrame, purpose: str, session: SparkSession | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``session`` reads it, or that of ``df``; ``file_rows`` bounds the rows of a file.
    """
    path = scratch_dir(df.sparkSession, purpose)
    made = _HERE.made.get()
    if made is not None:
        made.append(path)
    write_parquet(df, path, file_rows=file_rows)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Pieces:
    """A table in the shared folder that is used up turn by turn, so it and what is made of it don't lie there whole."""

    table: DataFrame  # all of it, until the first turn ends
    path: str
    pieces: int

    def size(self) -> int:
        """Bytes of its files."""
        return self._folder(self.path, lambda files, path: files.getContentSummary(path).getLength())

    def turns(self, wanted: int) -> Iterator[DataFrame]:
        """Its rows in ``wanted`` parts or as many as there are pieces; a part is deleted when the next is asked for."""
        wanted = max(1, min(wanted, self.pieces))
        for i in range(wanted):
            here = [p for p in (f"{self.path}/piece={j}" for j in range(i, self.pieces, wanted))
                    if self._folder(p, lambda files, path: files.exists(path))]
            spark = self.table.sparkSession
            yield (spark.read.schema(self.table.schema).parquet(*here) if here
                   else spark.createDataFrame([], self.table.schema))
            for p in here:
                self._folder(p, lambda files, path: files.delete(path, True))

    def _folder(self, path: str, act):
        spark = self.table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return act(folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder)


def in_pieces(df: DataFrame, piece: Column, pieces: int, purpose: str, file_rows: int = 0) -> Pieces:
    """Write ``df`` to the shared folder, split by ``piece`` (from 0, below ``pieces``)."""
    path = scratch_dir(df.sparkSession, purpose)
    made = _HERE.made.get()
    if made is not None:
        made.append(path)
    write_parquet(df.withColumn("piece", piece), path, "piece", file_rows=file_rows, codec="zstd", pieces=pieces)
    return Pieces(df.sparkSession.read.schema(df.schema).parquet(path), path, pieces)


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, T.StringType):
        return F.greatest(F.size(column), F.lit(0)) * 8
    if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """Exact row count and approximate bytes of ``df``; one job returning one row."""
    width = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields], F.lit(16))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    n, b = measure(df)
    return n <= (BROADCAST_ROWS if rows is None else rows) and b <= (BROADCAST_BYTES if size is None else size)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                spread: list[str] | None = None, small: bool | None = None, counts: DataFrame | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """Join a possibly skewed ``left`` to a ``right`` side.

    The right side is broadcast when measured small. Beyond that both sides are shuffled. The few
    keys with more than ``hot_rows`` left rows, of which there cannot be many, are spread by the
    columns ``spread`` over as many tasks as they need, and only their right rows are copied.
    ``counts`` (key, n) saves counting the left rows per key.
    """
    if small if small is not None else is_small(right):
        return left.join(F.broadcast(right), on, how)
    if not spread:
        return left.join(right, on, how)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    rows = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = stored(rows.filter(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).alias("_tasks")), "hot-keys")
    if hot.isEmpty() or not is_small(hot):
        return left.join(right, on, how)  # beyond that many hot keys none holds much of the table
    tasks = F.coalesce("_tasks", F.lit(1))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), tasks))
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)))
    return salted.drop("_tasks").join(copies.drop("_tasks"), [*on, "_salt"], how).drop("_salt")


def folder_of(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def near(df: DataFrame, key: str, wanted: DataFrame, folders: int) -> DataFrame:
    """``df``, in folders by a hash of ``key``, reduced to the folders that hold keys of ``wanted``, however many.

    The folders are joined as a broadcast side, one row per folder at most, and Spark's dynamic partition
    pruning reads only those. Up to PUSHED_VALUES keys also prune row groups. Only a saving: callers still join.
    """
    # Spark prunes only by a side that has a filter.
    asked = wanted.select(folder_of(key, folders).alias("folder")).distinct().filter(F.col("folder") >= 0)
    values = [r[0] for r in wanted.select(key).distinct().limit(PUSHED_VALUES + 1).collect()]
    if len(values) <= PUSHED_VALUES:
        df = df.filter(F.col(key).isin(values))
    return df.join(F.broadcast(asked), ["folder"], "left_semi")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int,
                  spread: list[str], name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their 1-based rank.

    Spark limits each partition before the shuffle while ``n`` is at most ``GROUP_LIMIT``; above
    that, a first pass over salted groups does the same, so a group is never sorted whole in one task.
    """
    if n > GROUP_LIMIT:
        salted = Window.partitionBy(*by, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(salted)).filter(F.col("_pre") <= n).drop("_pre")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
