"""What the library needs from a session: a shared folder and size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is broadcast only after it was measured to be below both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


_own_dirs: dict[str, str] = {}
_stored_paths: dict[str, list[str]] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting (tests, a laptop) gets a folder of its
    own; on a cluster the setting must be there, as a local folder would be
    lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    local = context.master.startswith("local")
    if not local and (not named or named.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if named:
        return named
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="doclake-")
    return _own_dirs[context.applicationId]


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result is needed more than once: it cuts the lineage, survives
    lost executors, and the size of the table is known to later plans.
    """
    path = new_shared_path(df.sparkSession, name)
    scope = getattr(_scopes, "paths", None)
    if scope is None:
        scope = _stored_paths.setdefault(df.sparkSession.sparkContext.applicationId, [])
    scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Delete the tables this thread stores inside the block when the block ends.

    For jobs that go on for long, such as a stream: what a micro-batch stored on
    its way is gone when its results are written, also after a failure.
    """
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    try:
        yield
    finally:
        paths, _scopes.paths = _scopes.paths, outer
        _remove(spark, paths)


def remove_stored(spark: SparkSession) -> None:
    """Delete the intermediate tables this application has stored so far.

    To be called when the results built on them are written; tables that were
    stored earlier cannot be read afterwards.
    """
    _remove(spark, _stored_paths.pop(spark.sparkContext.applicationId, []))


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _bytes(value: Column, kind: T.DataType) -> Column | None:
    """The size of a value with all it holds; None for a type that is not known here."""
    zero = F.lit(0).cast("long")
    if isinstance(kind, _FIXED):
        return F.lit(16).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), zero)
    if isinstance(kind, T.StructType):
        sizes = [_bytes(value.getField(field.name), field.dataType) for field in kind.fields]
        return None if any(x is None for x in sizes) else sum(sizes, F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, _FIXED):
            return 16 * (F.lit(1) + F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long"))
        if _bytes(F.lit(None), kind.elementType) is None:
            return None
        total = F.aggregate(value, zero, lambda sofar, x: sofar + _bytes(x, kind.elementType))
        return F.lit(16) + F.coalesce(total, zero)
    if isinstance(kind, T.MapType):
        parts = [
            _bytes(part, T.ArrayType(one))
            for part, one in ((F.map_keys(value), kind.keyType), (F.map_values(value), kind.valueType))
        ]
        return None if any(x is None for x in parts) else parts[0] + parts[1]
    return None


def _elements(value: Column, kind: T.DataType) -> list[Column]:
    """How many rows an array or map, or one inside a struct, gives when it is exploded."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return [F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long")]
    if isinstance(kind, T.StructType):
        return [n for field in kind.fields for n in _elements(value.getField(field.name), field.dataType)]
    return []


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a table that may be small enough to broadcast (one tiny aggregate).

    Structs, arrays and maps are measured with all they hold; a column of a type
    whose size is not known makes the table too big.  An element of an array
    counts as a row of its own, so what is exploded out of a measured table fits
    as well.
    """
    sizes = [_bytes(F.col(f"`{field.name}`"), field.dataType) for field in df.schema.fields]
    if any(size is None for size in sizes):
        return False
    rows = sum((n for field in df.schema.fields for n in _elements(F.col(f"`{field.name}`"), field.dataType)), F.lit(1))
    size = sum(sizes, F.lit(16).cast("long"))
    zero = F.lit(0).cast("long")
    row = df.agg(F.coalesce(F.sum(rows), zero).alias("n"), F.coalesce(F.sum(size), zero).alias("bytes")).first()
    return row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES


def broadcast_if(few: bool, df: DataFrame) -> DataFrame:
    """Broadcast a table that a measured table bounds."""
    return F.broadcast(df) if few else df


def lookup_join(df: DataFrame, lookup: DataFrame, keys: str | list[str], how: str) -> DataFrame:
    """Join a table with a lookup that has few rows per key.

    The lookup is written to the shared folder and measured.  A small one is
    broadcast, so a key that holds a third of ``df`` costs nothing.  A larger
    one is shuffled straight from its table, which is the shape in which Spark
    splits the partition of a hot key at run time.
    """
    table = stored(lookup, "lookup")
    return df.join(broadcast_if(fits_broadcast(table), table), keys, how)
