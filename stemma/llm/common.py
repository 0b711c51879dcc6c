"""What the text operators share: scratch tables, Arrow columns as bytes, word and shingle hashes."""

from __future__ import annotations

import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words per shingle and least Jaccard similarity or containment of near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts are hashed in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between the JVM and a worker; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


# -- scratch tables ---------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default is set only where the session has none and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/stemma"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    if ":" not in root.partition("/")[0]:
        # A path without a scheme lies in the cluster's default file system, for Spark and for pyarrow.fs.
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        root = ("file://" if default.startswith("file:") else default.rstrip("/")) + root
    return root.rstrip("/")


_scratch: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    root = f"{shared_dir(spark)}/stemma-{uuid.uuid4().hex}"
    _scratch.add(root)
    return f"{root}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard() -> None:
    """Deletes the scratch tables of this process. Results that still read them must have been written before."""
    spark = SparkSession.getActiveSession()
    for root in sorted(_scratch) if spark else ():
        _delete(spark, root)
    _scratch.clear()


def superseded(*frames: DataFrame) -> None:
    """Deletes the tables of frames that written() returned and that nothing will read again."""
    for frame in frames:
        _delete(frame.sparkSession, frame._scratch)
        _scratch.discard(frame._scratch)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path.rpartition("/")[0]
    return out


# -- rows with all their columns ----------------------------------------------------------------


def bundled(documents: DataFrame, *columns: Column) -> DataFrame:
    """The given columns beside each whole row in one struct, so that no column of the table can clash with an operator's own."""
    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_doc"), *columns)


def unbundled(rows: DataFrame, documents: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of documents again, some of them replaced."""
    return rows.select(*((replaced[c] if c in replaced else F.col("_doc")[c]).alias(c) for c in documents.columns))


# -- Arrow batches ------------------------------------------------------------------------------


def _give_back() -> None:
    """Returns what a task has freed to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of few rows and bytes, which bounds memory on both sides; the session's own limits hold if they are lower."""
    conf = df.sparkSession.conf
    for key, most in ((_BATCH_ROWS, BATCH_ROWS), (_BATCH_BYTES, BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not 0 < int(re.sub(r"\D", "", now) or 0) * (1 << 20 if now[-1:] in "mM" else 1) <= most:
            conf.set(key, str(most))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def filtered(documents: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text keep() marks, with all their columns, whatever their names; keep() takes the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0)
                yield pa.RecordBatch.from_arrays([rows.filter(pa.array(keep(pc.cast(pc.struct_field(rows, "text"), pa.large_string()))))], names=["_doc"])

    rows = bundled(documents)
    return unbundled(mapped(rows, run, rows.schema), documents)


# -- words and shingles as hashes -------------------------------------------------------------

#: Longest span that is hashed by lanes, and an odd number that lanes are multiplied by.
LANES_BYTES = 64
_LANE_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each input bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of [^\\x20\\x09-\\x0D]; runs end at the rows' ends too."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by its bytes alone.

    Spans of up to LANES_BYTES bytes are mixed eight bytes at a time, all spans at once; of longer ones the BLAKE2b digest is taken.
    No polynomial is involved, whose collisions are known for such strings as Thue and Morse's.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_LANE_STEP))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    at = np.flatnonzero(size <= LANES_BYTES)
    for lane in range(0, LANES_BYTES, 8):
        at = at[size[at] > lane]
        if not len(at):
            break
        left = np.minimum(size[at] - lane, 8).astype(np.uint64)
        value = words[starts[at] + lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mix((out[at] ^ value) * np.uint64(_LANE_STEP))
    for i in np.flatnonzero(size > LANES_BYTES):
        out[i] = digest64(data[starts[i] : ends[i]])
    return out


def digest64(value) -> int:
    """The first 64 bits of the BLAKE2b digest."""
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each row among them."""
    starts, ends = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, in order; a row of fewer words has one shingle of all of them, an empty row none."""
    counts = np.diff(offsets)
    has = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(has)])
    at = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], has) + np.repeat(offsets[:-1], has)
    width = np.repeat(np.minimum(counts, n), has)
    total = np.zeros(len(at), np.uint64)
    k = np.uint64(0xD6E8FEB86659FD93)
    for i in range(n):
        if i and len(width) and width.min() <= i:
            inside = width > i
            total = np.where(inside, total * k + words[np.minimum(at + i, len(words) - 1)], total)
        elif len(at):
            total = total * k + words[at + i]
    return mix(total + width.astype(np.uint64)), out_offsets


def minhash(hashes: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0x5EED) -> np.ndarray:
    """k minima of each non-empty row, as an array (k, rows). Rows without hashes must be left out by the caller."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, k, np.uint64)
    out = np.empty((k, len(offsets) - 1), np.uint64)
    for i in range(k):
        out[i] = np.minimum.reduceat(hashes * a[i] + b[i], offsets[:-1])
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(k, n) minima to (n, k // rows) hashes of bands, as signed 64-bit numbers."""
    out = []
    for i in range(0, len(signatures) - rows + 1, rows):
        h = np.full(signatures.shape[1], i + 1, np.uint64)
        for s in signatures[i : i + rows]:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + s)
        out.append(h)
    return np.stack(out, 1).view(np.int64)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that meet with probability `recall` at that similarity."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
