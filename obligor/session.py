"""Session defaults and the shared scratch area used to cut long plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "tinyint": pa.int8(),
    "smallint": pa.int16(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
}

# The JVM compiles no method of more bytes than this; Spark's own limit is the largest one there can be.
COMPILED_BYTES = "8000"
_METHOD_LIMIT, _SPARK_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535"

# Arrow batches end at a number of rows or bytes; only with the largest limit are bytes not summed row by row.
_BATCH_BYTES, NO_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)
_unmeasured: dict[int, int] = {}
_unmeasured_lock = Lock()

_local_roots: dict[str, str] = {}
_scratch_paths: dict[str, list[str]] = {}


def get_spark(app: str = "obligor", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the library expects; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording a Python stack per expression dominates the making of wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        _METHOD_LIMIT: COMPILED_BYTES,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_compiled(spark: SparkSession) -> None:
    """Let no wide projection or aggregate run as one method that the JVM only interprets.

    Spark then runs its operators one by one, with methods that are compiled. A limit
    other than Spark's default is left as it is.
    """
    if spark.conf.get(_METHOD_LIMIT, _SPARK_LIMIT) == _SPARK_LIMIT:
        spark.conf.set(_METHOD_LIMIT, COMPILED_BYTES)


@contextmanager
def unmeasured_batches(spark: SparkSession) -> Iterator[None]:
    """Let jobs that hand rows of a few numbers to Python end their batches by rows alone.

    Spark else adds up the bytes of a batch before each row, which takes most of the time of
    such jobs. Not for rows that may be large, as blocks or texts are. A limit that was set
    before is left as it is. Blocks may overlap in threads: the last one restores the limit.
    """
    at = id(spark)
    with _unmeasured_lock:
        lifted = at in _unmeasured or spark.conf.get(_BATCH_BYTES, None) is None
        if lifted:
            _unmeasured[at] = _unmeasured.get(at, 0) + 1
            spark.conf.set(_BATCH_BYTES, NO_BATCH_BYTES)
    try:
        yield
    finally:
        if lifted:
            with _unmeasured_lock:
                _unmeasured[at] -= 1
                if not _unmeasured[at]:
                    del _unmeasured[at]
                    spark.conf.unset(_BATCH_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    app = context.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="obligor-")
        _local_roots[app] = root
        owner = os.getpid()
        atexit.register(lambda: os.getpid() == owner and shutil.rmtree(root, ignore_errors=True))
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch_paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns how many there were.

    Call it once results are stored: tables that were handed back may still read them.
    """
    paths = _scratch_paths.pop(spark.sparkContext.applicationId, [])
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    return len(paths)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    known = _scratch_paths.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def reach_workers(spark: SparkSession) -> None:
    """Put this package on the path of Python workers of the same machine.

    On a cluster the package is installed or handed over with ``--py-files``.
    """
    own = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if own not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [own, held]))


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` once to the scratch area and read it back.

    Operators that need several passes pin the few columns they use, so that the
    input plan runs once and a lost executor never replays it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, which is broadcast without a job."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrays = [
        pa.array([row[i] for row in rows], _ARROW[field.dataType.simpleString()])
        for i, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names))


def col(name: str) -> Column:
    """Column reference that is safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
