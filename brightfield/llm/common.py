"""Shared helpers: written cuts in the shared folder, word rules, vectorised hashing of byte arrays."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: ASCII white space of the word rule, as a regular expression and as the characters themselves.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is set only where it is unset (local tests)."""
    ship_package(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brightfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Written(threading.local):
    """Folders of the cuts of this thread that are still there: queries may run side by side in threads of one driver."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


#: Spark's setting by which a finished execution deletes its shuffle files at once.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict[str, list] = {}  # by session: how many writes run, and what the setting was before
_freeing_lock = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions in here delete their shuffle files when they end; else those stay until the driver happens to collect its garbage.

    Only for executions that nothing repeats. Threads may be in here side by side; the last one restores the setting.
    """
    session = spark._jsparkSession.sessionUUID()
    with _freeing_lock:
        held = _freeing.setdefault(session, [0, spark.conf.get(FREE_SHUFFLES, None)])
        held[0] += 1
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            held[0] -= 1
            if not held[0]:
                del _freeing[session]
                spark.conf.unset(FREE_SHUFFLES) if held[1] is None else spark.conf.set(FREE_SHUFFLES, held[1])


def cut(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    The shuffle files of the write are deleted with it. ``few``: narrow rows of many tasks are gathered into files of the
    advisory size first, instead of a small file a task.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/cut-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        (df.hint("rebalance") if few else df).write.parquet(path)
    _written.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written.paths:
        _written.paths.remove(path)


def discard(*cuts: DataFrame) -> None:
    """Delete cuts that nothing reads any more: all that was made from them has itself been written."""
    for df in cuts:
        _delete(df.sparkSession, df._cut_path)


def cut_whole(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of ``make()``, without the cuts that it made on the way."""
    before = set(_written.paths)
    out = cut(make(), name)
    for path in [x for x in _written.paths if x not in before and x != out._cut_path]:
        _delete(out.sparkSession, path)
    return out


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until no column of the tables has it (upper and lower case are the same to Spark)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Array of the runs of ``[^\\x20\\x09-\\x0D]``; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what a Python worker holds at once: batches of few rows and bytes, however long the texts are."""
    ship_package(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(key, value)


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers (a multiply-xorshift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


#: A prime below 2**31 and a second base: modulo a power of two alone, texts of two letters in Thue-Morse order collide whatever the base.
PRIME = (1 << 31) - 1
BASE_P = 1_103_515_245
BASE_P_INV = pow(BASE_P, -1, PRIME)


def powers(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64 or a number below 2**32, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        if modulus < 1 << 64:
            out[have : have + take] %= np.uint64(modulus)
        have += take
        step = step * step % modulus
    return out[:n]


class Words:
    """Words of many texts at once: hash of each word, and which text it belongs to.

    ``texts`` are byte strings. Bytes A-Z count as a-z where ``fold`` is set. Equal words have equal hashes;
    the words of text ``i`` are those from ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: list[bytes], fold: bool = True):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        if fold:
            raw = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << np.uint8(5))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.raw = raw
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(raw))
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = segment_hash(raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def segment_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each ``raw[start:end]``, the same wherever the segment stands; starts and ends ascend.

    Two polynomials, one modulo 2**64 and one modulo a prime, are mixed into one number. Segments over two blocks long
    are hashed piece by piece.
    """
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # blocks keep the temporaries in cache and the sums below 2**64
        hi = min(int(np.searchsorted(start, start[lo] + block)), int(np.searchsorted(end, start[lo] + 2 * block, side="right")))
        if hi <= lo:
            cuts = np.arange(start[lo], end[lo], block)
            total = np.zeros(1, np.uint64)
            for h in segment_hash(raw, cuts, np.append(cuts[1:], end[lo]), block):
                total = mix64(total * np.uint64(BASE) + h)
            out[lo] = total[0]
            lo += 1
            continue
        a, b = int(start[lo]), int(end[hi - 1])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        text = raw[a:b].astype(np.uint64) + np.uint64(1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(text * powers(BASE, b - a), out=total[1:])
        first = mix64((total[e] - total[s]) * powers(BASE_INV, b - a + 1)[s] + (e - s).astype(np.uint64))
        np.cumsum(text * powers(BASE_P, b - a, PRIME), out=total[1:])
        second = (total[e] - total[s]) % np.uint64(PRIME) * powers(BASE_P_INV, b - a + 1, PRIME)[s] % np.uint64(PRIME)
        out[lo:hi] = mix64(first + second * np.uint64(BASE))
        lo = hi
    return out


def near_filter(rows: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23, others: bool = False) -> DataFrame:
    """Rows whose ``column`` may be in ``ids`` (one column of longs): all that are, and few others while ids are few.
    ``others``: the remaining rows instead, nulls among them.

    The ids' hashes set bits of one table of ``bits`` bits, at most ``bits / 64`` rows of two longs however many ids
    there are; that table is broadcast. It spares a join from shuffling rows that cannot match.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, flags, place = (free_name(x, rows) for x in ("near_word", "near_bits", "near_place"))
    table = ids.select(bit(F.col(ids.columns[0])).alias("p")).select(F.shiftright("p", 6).alias(word), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"))
    table = table.groupBy(word).agg(F.bit_or("b").alias(flags))
    marked = rows.withColumn(place, bit(F.col(column))).withColumn(word, F.shiftright(place, 6))
    hit = F.expr(f"({flags} & shiftleft(1L, CAST({place} & 63 AS INT))) <> 0")
    if others:
        hit = ~F.coalesce(hit & F.col(column).isNotNull(), F.lit(False))
    return marked.join(F.broadcast(table), word, "left" if others else "inner").filter(hit).drop(word, flags, place)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the ends of ``links`` (longs ``a, b``): root is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour (and that one's hook), merges hooked nodes into one, and keeps
    the links between what is left; they shrink until none is left. The smallest node of a component always stays, so
    it is the root. Every round is written, so a lost executor repeats one round at most.
    """
    edge = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = cut(links.filter("a <> b").select(*edge("a", "b")).distinct(), "links")
    labels = None
    while True:
        ends = edges.union(edges.select("b", "a")).toDF("node", "other")
        first = cut(ends.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("hook")), "hooks")
        hooks = cut(first.join(first.toDF("hook", "next"), "hook").select("node", F.col("next").alias("hook")), "hooks")
        merged = edges.join(hooks.toDF("a", "ha"), "a").join(hooks.toDF("b", "hb"), "b").filter("ha <> hb")
        left = cut(merged.select(*edge("ha", "hb")).distinct(), "links")
        discard(edges, first)
        edges = left
        if labels is None:
            labels = hooks
        else:
            new = cut(labels.toDF("node", "root").join(hooks.toDF("root", "hook"), "root", "left").select("node", F.coalesce("hook", "root").alias("root")), "labels")
            discard(labels, hooks)
            labels = new
        if not edges.limit(1).count():
            return labels.toDF("node", "root")


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is not in ``ids`` (one column of distinct longs). Only rows near ``ids`` are shuffled."""
    near, gone = near_filter(rows, column, ids), free_name("gone_id", rows)
    kept = near.join(ids.toDF(gone), near[column] == F.col(gone), "left_anti")
    return near_filter(rows, column, ids, others=True).unionByName(kept)
