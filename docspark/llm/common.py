"""What several corpus operators need: shared storage, word patterns and small expressions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Intermediate tables need no marker file, and on a mounted folder no checksum files beside the pages' own: each
#: such file costs a process that the JVM forks to set its permissions. Other file systems do not read the last two.
_PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_own: dict[str, str] = {}
_made: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, a temporary folder takes its place; on a
    cluster executors would not see each other's files there, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not one_machine(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="docspark-")
    return _own[app]


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docspark-{uuid.uuid4().hex}"
    # Tasks after a shuffle as large as the session's advisory size, not one a core: a small table is one file.
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df.write.options(**_PLAIN).parquet(path)
    finally:
        spark.conf.set(name, was)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables ``keep`` has written so far and none has removed."""
    return len(_made)


def sweep(spark: SparkSession, since: int, but: int = 0) -> None:
    """Remove what ``keep`` wrote after the first ``since`` tables, but for the last ``but`` of them: for
    callers that need no more of it than those."""
    end = len(_made) - but
    for path in _made[since:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since:end]
    clean(spark)


def clean(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of frames that no one holds: it does so only when the driver
    collects its garbage, which a large heap puts off; that heap shrinks, too, and so does what lies beside it."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


#: The JVM's own operation, also known as ``jcmd System.trim_native_heap``.
_TRIM = "systemTrimNativeHeap"


def trim(spark: SparkSession) -> None:
    """Return to the system what the driver's JVM has freed outside its heap: compilers, collector and buffers allocate
    there, and the C library keeps it, an arena for a thread. A JVM without that operation goes on as it is."""
    jvm, lang = spark._jvm, spark._jvm.java.lang

    def array(kind: Any, *values: Any) -> Any:
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        # By reflection, for the class of the server is not open to callers.
        kinds = [lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", array(lang.Class, *kinds))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, bean, _TRIM, array(lang.Object), array(lang.String)))
    except (Py4JError, PySparkException):
        return


def relieve(spark: SparkSession) -> None:
    """``clean``, and the executors collect their garbage, too: a heap that has grown to its bound keeps what is free
    in it beside the Python workers, until a full collection gives it back. As many tasks as cores reach the executors."""
    clean(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


#: What drops the tables that a module keeps between calls.
_forget: list[Callable[[], None]] = []


def at_task_end(forget: Callable[[], None]) -> Callable[[], None]:
    """Call ``forget`` whenever a task ends."""
    _forget.append(forget)
    return forget


def give_back() -> None:
    """Return memory that is free to the system: Python workers live on from task to task, and so does what they hold."""
    import pyarrow as pa

    for forget in _forget:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows and bytes of an Arrow batch at most: a batch of long texts lies outside the JVM's heap, twice while it grows, and again in Python.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to these bounds, where they are larger or have none."""
    for name, most in _BATCH.items():
        now = int(spark.conf.get(name, str(most)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def tidy(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run`` for mapInArrow, with its memory given back at the end of each task and batches of bounded size."""
    session = SparkSession.getActiveSession()
    if session is not None:
        small_batches(session)

    def whole(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
