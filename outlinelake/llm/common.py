"""What the training-data operators share: tables, scratch space, row keys and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and U+0009 to U+000D, the set that bytes.split() uses too.
SPACES = "\\x20\\x09-\\x0D"

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one if the master is local, and an error if not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='outlinelake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def release_driver(spark: SparkSession) -> bool:
    """Give what the driver's JVM has freed outside its heap back to the system, and say whether it could.

    Planning and compiling take such memory in many threads, and the C library keeps what each of them frees for itself,
    so over the jobs of a session it adds up.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        types = gateway.new_array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = jvm.java.lang.Class.forName(name)
        # through the interface: the server's own class isn't open to callers
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM, or another C library
        return False
    return True


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_words() -> None:
    """Free what an earlier token stage remembers in this worker process."""
    if kept := sys.modules.get("_outlinelake_words"):
        kept.by_path.clear()


def release_memory() -> None:
    """Give what this worker process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def rows_at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is executed sends Arrow batches of as many rows at most to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(size, base & _MASK, dtype=_U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["p"], _powers["i"]


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start offset of every whitespace-separated word of the buffer."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    if not len(data):
        return np.empty(0, _U), np.empty(0, np.int64)
    space = _IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), starts
    power, inverse = _power_table(len(data))
    terms = _BYTE[data] * power[: len(data)]
    terms[space] = 0
    return mix(np.add.reduceat(terms, starts) * inverse[starts]), starts


def documents_in_chunks(texts: Iterable[bytes], target: int = 1 << 20) -> Iterator[list[bytes]]:
    """Group texts so that a group has about `target` bytes; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > target:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_SHINGLE = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `width` words as 64-bit hashes; with fewer words, the whole sequence is one."""
    words, starts = word_hashes(b" ".join(texts))
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    wide = np.zeros(max(0, len(words) - width + 1), dtype=_U)
    for k in range(width):
        wide += words[k : k + len(wide)] * _U(_SHINGLE[k % len(_SHINGLE)] + 2 * (k // len(_SHINGLE)))
    wide = mix(wide)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            short = _U(int(b - a) * 0x2545F4914F6CDD1D & _MASK)
            for k in range(a, b):
                short = mix(np.array([short ^ words[k]], dtype=_U))[0]
            out.append(np.array([short], dtype=_U))
        else:
            out.append(np.empty(0, _U))
    return out
