"""What the operators of this subpackage share: shared-folder tables, byte blocks, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the complement of ``[^\x20\x09-\x0D]``.
SEPARATORS = b" \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER_NP = np.frombuffer(_LOWER, np.uint8)


def ascii_lower(raw: bytes) -> bytes:
    """Lower-cases A-Z and nothing else."""
    return raw.translate(_LOWER)


# --- tables in the shared folder ---------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a machine-local one only in local mode, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Written tables that cut lineage, each under its own name in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.made: list[DataFrame] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the reader of what was written."""
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        # What was shuffled for the table goes as soon as the table is written.
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, None)
        self.spark.conf.set(clean, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(clean) if before is None else self.spark.conf.set(clean, before)
        # The driver's own heap: grown by plans and task reports, it does not shrink unless asked to.
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        if runtime.totalMemory() > runtime.maxMemory() // 2:
            runtime.gc()
        _give_back()
        back = self.spark.read.schema(df.schema).parquet(path)
        back._factloom_path = path
        self.made.append(back)
        return back

    def clear(self, *kept: DataFrame) -> None:
        """Deletes all tables of this workspace but those that a plan handed out still reads."""
        paths = {getattr(df, "_factloom_path", None) for df in kept}
        for df in self.made:
            if df._factloom_path not in paths:
                self.drop(df)
        self.made = [df for df in self.made if df._factloom_path in paths]

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table of :meth:`table` that no later plan reads."""
        path = getattr(df, "_factloom_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def worker_cache(key: str, make):
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = sys.__dict__.setdefault("_factloom_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shipped(spark: SparkSession, model):
    """A function that gives ``model`` on an executor; its attributes are broadcast, its class travels with the function.

    Only for models whose size has a bound. Attributes are arrays, numbers, texts and lists of them, or such models.
    """
    kind = type(model)
    plain = {k: v for k, v in vars(model).items() if not type(v).__module__.startswith(__package__)}
    parts = {k: shipped(spark, v) for k, v in vars(model).items() if k not in plain}
    sent = spark.sparkContext.broadcast(plain)

    def get():
        made = kind.__new__(kind)
        made.__dict__.update(sent.value)
        made.__dict__.update({k: part() for k, part in parts.items()})
        return made

    return get


def _give_back() -> None:
    """Returns memory that is held but unused to the system: Arrow's pool and the C library's free lists."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, caches: bool = False) -> Callable:
    """``run`` for mapInArrow, giving back unused memory after each batch and at its end, so that idle workers stay small.

    caches: whether the function uses :func:`worker_cache`; others free what an earlier function's tasks have left there.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        if not caches:
            sys.__dict__.pop("_factloom_worker", None)

        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                pool.release_unused()

        yield from run(each())
        _give_back()

    return wrapped


def lean_cached(run: Callable) -> Callable:
    return lean(run, caches=True)


# --- byte blocks ---------------------------------------------------------------------------------


class Block:
    """Some whole documents: ``data`` their bytes end to end, ``offsets`` where each begins and the end."""

    __slots__ = ("data", "first", "offsets")

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[Block]:
    """Cuts an Arrow string column into blocks of at most ``most`` bytes, or one longer document. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    bufs = texts.buffers()
    ends = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield Block(i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER_NP[data]


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of each word of a block."""
    if not len(block.data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_IS_SEP[block.data]
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    prev = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    nxt = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~prev)
    ends = np.flatnonzero(inside & ~nxt) + 1
    docs = np.searchsorted(block.offsets, starts, "right") - 1
    return starts, ends, docs


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pows: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pows or len(_pows[0]) < n:
        size = max(n, 1 << 19) + 1
        out = []
        for base in (_BASE, _INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _pows[:] = out
    return _pows[0], _pows[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a permutation of the 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over prefix sums, then :func:`mix` with the length."""
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` neighbouring hashes."""
    power, inverse = _powers(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
    return mix((sums[length:] - sums[:-length]) * inverse[: len(h) - length + 1])


def shingle_hashes(word_hash: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a document, and the index of its first word."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[j : j + n])
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return h[at], at


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns, whatever their names, never reach an operator.

    Columns are taken by place: a further column whose name differs only in case, or not at all, does no harm.
    """
    have = df.columns
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({n.lower() for n in have}) == len(have):
        return df.select(*[F.col(f"`{n}`") for n in names])
    placed = df.toDF(*[f"_{i}" for i in range(len(have))])
    return placed.select(*[F.col(f"_{have.index(n)}").alias(n) for n in names])
