"""What the operators share: tables, work folders, words and their hashes.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``, which are the bytes ``bytes.split``
cuts at. Hashes are taken over whole chunks of text with numpy, so that a task spends its
time in array operations and its memory follows the chunk, not the Arrow batch.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

# Text that a task turns into arrays at a time; one longer document is a chunk of its own.
CHUNK_BYTES = 2 * 1024 * 1024
# Bytes hashed at a time inside one document.
PIECE_BYTES = 1 * 1024 * 1024

_rng = np.random.default_rng(20261201)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; set here only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(frame.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """The Python helpers travel to tasks by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def once(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, built once per Python process: tasks of a reused worker share it.
    The module that keeps it is none of the package, whose functions each task unpickles anew."""
    kept = sys.modules.setdefault("_kept_by_process", types.ModuleType("_kept_by_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Sent:
    """An object that is broadcast with its class by value."""

    def __init__(self, spark: SparkSession, thing: object):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def get(self) -> object:
        return cloudpickle.loads(self.packed.value)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))


class _Tables(dict):
    """Power tables of a process; they do not travel with a pickled function."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def _power_table(name: str, base: np.uint64, count: int) -> np.ndarray:
    known = _tables.get(name)
    if known is None or len(known) < count:
        known = _tables[name] = _powers(base, max(count, 1 << 16))
    return known[:count]


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~_GAP[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_piece(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[buffer] * _power_table("b", _BASE, len(buffer)), out=sums[1:])
    inverse = _power_table("i", _INVERSE, len(buffer))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hash_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of UTF-8 bytes, equal words alike."""
    starts, ends = word_bounds(buffer)
    hashes = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(int(np.searchsorted(ends, base + PIECE_BYTES, side="right")), done + 1)
        piece = buffer[base : ends[upto - 1]]
        hashes[done:upto] = _hash_piece(piece, starts[done:upto] - base, ends[done:upto] - base)
        done = upto
    return starts, ends, hashes


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words: one for each start that leaves room."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power_table("w", _WORD_BASE, len(words)), out=sums[1:])
    inverse = _power_table("v", _WORD_INVERSE, count)
    return mix((sums[size:] - sums[:-size]) * inverse)


class Chunk:
    """Texts of some rows as one byte array with the words of all of them.

    ``bounds[i]:bounds[i + 1]`` are the words of text i. Texts are joined by a line end, so
    no word spans two of them.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.starts, self.ends, self.hashes = hash_words(self.buffer)
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows inside one text, and the word each starts at."""
        hashes = hash_windows(self.hashes, size)
        last = np.repeat(self.bounds[1:], self.counts)[: len(hashes)]
        at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
        return hashes[at], at


def covered(starts: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of ``count`` words lie in a window of ``size`` words at one of the starts."""
    step = np.zeros(count + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, count), -1)
    return np.cumsum(step[:-1]) > 0


def pieces(sizes: Iterable[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows of the given sizes into runs of at most ``limit``, one row at least."""
    first, held, last = 0, 0, 0
    for at, size in enumerate(sizes):
        if at > first and held + size > limit:
            yield first, at
            first, held = at, 0
        held += size
        last = at + 1
    if last > first:
        yield first, last


def by_chunk(
    work: Callable[[list], dict | None], names: list[str], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``work`` gets the named columns of some rows and gives columns.
    The first is the text, as a list of bytes with null ones empty; the others are arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = binary_sizes(batch.column(names[0]))
            for first, last in pieces(sizes):
                part = batch.slice(first, last - first)
                columns = [part.column(n) for n in names]
                columns[0] = [t or b"" for t in columns[0].to_pylist()]
                found = work(columns)
                if found is not None:
                    yield pa.RecordBatch.from_pydict(found, schema=schema)

    return run


def binary_sizes(column: pa.Array) -> list[int]:
    return [n or 0 for n in pa.compute.binary_length(column).to_pylist()]


def arrow_type(kind: DataType) -> pa.DataType:
    return to_arrow_schema(StructType([StructField("x", kind)])).field(0).type


def as_bytes(column: str) -> F.Column:
    """A text column as UTF-8 bytes: it reaches Python without being decoded."""
    return F.col(column).cast("binary")
