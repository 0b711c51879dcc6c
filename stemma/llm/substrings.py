"""Removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte covered by a LENGTH-byte string that also begins anywhere else, in the same document or another, is removed.

1. Strings are sorted into groups that are compared on their own. The least hash of a string's GRAM-byte parts is the
   same wherever the string begins; neighbouring strings share it, so a document is a sequence of runs of
   strings with one least hash at one place. A run's text is its strings' union, some LENGTH + LENGTH - GRAM bytes at most.
2. Runs with a least hash of their own hold no repeated string. Runs of equal text, by their digest within the group, repeat as a whole;
   they are counted, never gathered. Only runs that share their least hash with runs of other text are compared.
3. The texts of many groups are joined to one string, its suffixes sorted to depth LENGTH, and the common prefixes of
   neighbouring suffixes derived from the Burrows-Wheeler transform by breadth-first backward extension: intervals of
   strings of depth 1, 2, ... mark the ends where a prefix of that depth ends, each end once. What isn't marked before
   depth LENGTH is a common prefix of at least LENGTH bytes: a repeated string.
4. A group of more than GROUP_BYTES distinct texts, as of many near copies, doesn't meet in one task: its texts are cut again, by the least of other hashes, into
   runs of smaller groups, and those are counted and compared as in 2 and 3. The strings of groups that are still as large are hashed one by one and counted
   map-side. Both give the same answer.

Strings are told apart by 64-bit BLAKE2b digests within groups and by byte comparison in step 3; the rolling hash only makes groups.

Defined results: a null or empty text has 0 bytes and none removed. Texts shorter than LENGTH bytes keep all. Wholly equal rows
repeat each other. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest64, mapped, mix, written

LENGTH, GRAM = 400, 128
#: Distinct texts of a group that are compared in one task, and texts that are compared at once.
GROUP_BYTES, BATCH_BYTES = 1 << 20, 1 << 20
#: A long document is cut into runs so many strings at a time, which bounds a worker's memory.
CHUNK = 1 << 18
#: Symbols packed into the first sorting key; 257 symbols take nine bits.
_PACKED, _BITS = 7, 9


# -- runs -----------------------------------------------------------------------------------------


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of each part of `width` bytes. It only sorts strings into groups: equal parts have equal values, unequal ones need not differ."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _powers[1][: n - width])


def _digests(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit BLAKE2b digest of each range, which tells texts of a group apart."""
    view = memoryview(data)
    return np.asarray([digest64(view[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)], np.uint64)


def leftmost_least(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w values its least and where that first stands; by running minima from the borders of blocks of w."""
    n = len(values) - w + 1
    blocks = -(-len(values) // w)
    grid = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(values)] = values
    grid = grid.reshape(blocks, w)
    at = np.arange(blocks * w, dtype=np.int64).reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, 1)
    new = np.ones_like(grid, bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, at, 0), 1).ravel()[w - 1 : w - 1 + n]
    ahead = ahead.ravel()[w - 1 : w - 1 + n]
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]
    back_at = np.minimum.accumulate(np.where(grid == back, at, blocks * w)[:, ::-1], 1)[:, ::-1].ravel()[:n]
    back = back.ravel()[:n]
    left = back <= ahead
    return np.where(left, back, ahead), np.where(left, back_at, ahead_at)


def _split(data: np.ndarray, length: int, gram: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group (the least hash), first and last string of each run of strings whose least hash stands at one place."""
    hashes = _rolled(data, gram)
    group, at = leftmost_least(mix(hashes ^ np.uint64(seed)) if seed else hashes, length - gram + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return group[first], first, np.append(first[1:], len(at)) - 1


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (group, text key, first string, last string, last string of its repeats, repeats) of a document's runs.

    Neighbouring runs of one text, as in periodic parts, are one row with their number.
    """
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        group, first, last = _split(part, length, gram)
        key = _digests(part.tobytes(), first, last + length)
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        times = np.diff(np.append(head, len(first)))
        yield group[head].view(np.int64), key[head].view(np.int64), first[head] + begin, last[head] + begin, last[head + times - 1] + begin, times


# -- interval expansion ---------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of symbols below 2**9 in order of their first `depth` symbols at least, by prefix doubling of those that still tie."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(_PACKED, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(_PACKED):
        key = (key << _BITS) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.zeros(n + 1, np.int64)
    h = _PACKED
    places = np.arange(n)
    start = np.maximum.accumulate(np.where(new, places, 0))
    rank[order] = start + 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < depth and len(tied):
        own = order[tied]
        key = (rank[own] << 32) | rank[np.minimum(own + h, n)]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[tied] = own
        new = np.append(True, key[1:] != key[:-1])
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def long_common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order whether it shares `length` symbols or more with the one before it.

    Level by level, intervals of suffixes that begin with one string are extended by each symbol before them; the end of a
    new interval is where a common prefix of that level ends. An end is marked, and its interval extended further, once.
    Symbol 0 separates texts: no string is extended by it, except the empty one.
    """
    n = len(order)
    transform = text[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(transform, kind="stable")] = np.arange(n)
    marked = np.zeros(n + 1, bool)
    marked[0] = marked[n] = True
    owner = np.full(n + 2, -1, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)  # half-open
    for level in range(length):
        if not len(low):
            break
        size = high - low
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(of)) + np.repeat(low - begin, size)
        symbol = transform[row].astype(np.int64)
        if level:
            inside = symbol > 0
            row, of, symbol = row[inside], of[inside], symbol[inside]
        target = back[row]
        # Rows of one interval and symbol stay together: their ends are where the owner changes.
        tag = of * 512 + symbol
        owner[target + 1] = tag
        first = np.sort(target[owner[target] != tag])
        last = np.sort(target[owner[target + 2] != tag]) + 1
        owner[target + 1] = -1
        new = ~marked[last]
        low, high = first[new], last[new]
        marked[high] = True
    return ~marked[:n]


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts of its strings of that length that begin elsewhere too, in any of the texts."""
    sizes = np.asarray([len(t) for t in texts])
    joined = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(joined), bool)
    for b, t in zip(begin, texts, strict=True):
        joined[b : b + len(t)] = np.frombuffer(t, np.uint8)
        joined[b : b + len(t)] += 1
        valid[b : b + max(0, len(t) - length + 1)] = True
    order = suffix_order(joined, length)
    alike = long_common_prefixes(joined, order, length)
    alike[1:] &= valid[order[1:]] & valid[order[:-1]]
    alike[0] = False
    found = np.zeros(len(joined), bool)
    found[order[alike]] = True
    found[order[np.flatnonzero(alike) - 1]] = True
    at = np.flatnonzero(found)
    edge = np.searchsorted(at, np.append(begin, len(joined)))
    return [at[a:b] - s for a, b, s in zip(edge[:-1], edge[1:], begin, strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by strings that begin at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


# -- Spark ----------------------------------------------------------------------------------------

_PLACE = "doc_id long, text_key long"


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _all_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["group", "key", "first", "last", "reach", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            count = 0
            for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for part in runs(np.frombuffer(text.as_buffer(), np.uint8), length, gram):
                    held.append((doc_id.as_py(), key.as_py(), part))
                    count += len(part[0])
                if count > 100_000:
                    yield make(held)
                    held, count = [], 0
            if held:
                yield make(held)

    def make(held: list[tuple]) -> pa.RecordBatch:
        n = [len(part[0]) for _, _, part in held]
        ids = pa.array([d for d, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), n)))
        keys = pa.array(np.repeat(np.asarray([k for _, k, _ in held], np.int64), n))
        return pa.RecordBatch.from_arrays([ids, keys, *(pa.array(np.concatenate([part[i] for _, _, part in held]).astype(np.int64)) for i in range(6))], names=["doc_id", "text_key", *names])

    return mapped(rows, run, f"{_PLACE}, " + ", ".join(f"`{x}` long" for x in names))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["text_key"] == b["_key"])


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for their way through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t.as_buffer()) for t in batch.column(2)], pa.binary())], names=["doc_id", "text_key", "packed"])

    return mapped(rows, run, f"{_PLACE}, packed binary")


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


_AGAIN = 0x2545F4914F6CDD1D
_CUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("group", pa.int64()), ("first", pa.int64()), ("alone", pa.bool_()), ("last", pa.int64()), ("key", pa.int64()), ("text", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cut_texts(jobs: DataFrame, length: int, gram: int) -> DataFrame:
    """From (doc_id, text_key, packed, parts): the text of each part; of parts of large groups those of their runs, with their last strings and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, key, packed, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = _unpack(packed)
                for p in parts:
                    own = text[p["first"] : p["last"] + length]
                    size += len(own)
                    if p["large"]:
                        group, first, last = _split(np.frombuffer(own, np.uint8), length, gram, _AGAIN)
                        group = mix(group ^ mix(np.asarray([p["group"]]).view(np.uint64))).view(np.int64)
                        for g, a, b, k in zip(group.tolist(), first.tolist(), last.tolist(), _digests(own, first, last + length).view(np.int64).tolist(), strict=True):
                            rows.append((doc_id, key, g, p["first"] + a, p["alone"], p["first"] + b, k, own[a : b + length]))
                            size += b + length - a
                    else:
                        rows.append((doc_id, key, p["group"], p["first"], p["alone"], None, None, own))
                if size > 4 << 20:
                    yield _batch(rows, _CUT)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _CUT)

    return mapped(jobs, run, f"{_PLACE}, `group` long, first long, alone boolean, last long, key long, text binary")


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """The digest of each string of the texts, a row each."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("group", pa.int64()), ("start", pa.int64()), ("alone", pa.bool_()), ("string", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, group, first, alone, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.arange(len(text) - length + 1)
                rows += [(doc_id, key, group, first + i, alone, s) for i, s in enumerate(_digests(text, at, at + length).view(np.int64).tolist())]
                if len(rows) > 50_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return mapped(texts.select("doc_id", "text_key", "group", "first", "alone", "text"), run, f"{_PLACE}, `group` long, start long, alone boolean, string long")


def _of_large_groups(runs_: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans that repeat, and texts still to be compared, of the runs that large groups were cut into."""
    counted = runs_.groupBy("group", "key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "first", "alone", "text")).alias("r"))
    counted = written(counted.select("group", "key", "n", "r.doc_id", "r.text_key", "r.first", (F.col("r.alone") & (F.col("n") == 1)).alias("alone"), "r.text"), "counted")
    whole = runs_.where("alone").join(counted.where("n > 1").select("group", "key"), ["group", "key"], "left_semi").select("doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    groups = counted.groupBy("group").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("bytes")).where("texts > 1")
    groups = written(groups.select("group", (F.col("bytes") > GROUP_BYTES).alias("large")), "cut_groups")
    texts = counted.join(groups, "group")
    strings = written(_strings(texts.where("large"), length), "strings")
    twice = written(strings.groupBy("group", "string").agg(F.count("*").alias("n")).where("n > 1").select("group", "string"), "twice")
    one_by_one = strings.where("alone").join(twice, ["group", "string"], "left_semi").select("doc_id", "text_key", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(one_by_one), texts.where("not large").select("doc_id", "text_key", "group", "first", "alone", "text")


def _compared(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, start, end of what repeats within groups; texts are sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        last = None

        def compare() -> pa.RecordBatch:
            out = []
            for (doc_id, key, _, first, alone, _), starts in zip(held, repeated_starts([h[5] for h in held], length), strict=True):
                if alone:
                    out += [(doc_id, key, first + a, first + b) for a, b in _spans(starts, length)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_key", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH_BYTES and row[2] != last:
                    yield compare()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[2]
        if held:
            yield compare()

    return mapped(texts.select("doc_id", "text_key", "group", "first", "alone", "text"), run, f"{_PLACE}, start long, end long")


def _removed(documents: DataFrame, keep_text: bool) -> DataFrame:
    """From (doc_id, text_key, packed, spans): the result columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = _unpack(packed.as_py())
                kept, at, runs_, removed = [], 0, 0, 0
                end = -1
                for s in sorted((s["start"], s["end"]) for s in spans):
                    if s[0] > end:
                        runs_ += 1
                        kept.append(text[at : s[0]])
                    removed += s[1] - max(s[0], end) if s[1] > end else 0
                    end = at = max(end, s[1])
                kept.append(text[at:])
                rest = b"".join(kept)
                for column, v in zip(out, (doc_id, len(text), removed, runs_, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return mapped(documents.select("doc_id", "packed", "spans"), run, schema)


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of each document."""
    rows = _rows(documents)
    every = written(_all_runs(rows, length, gram), "runs")
    # The small side of a join on groups is stored first: both sides then are plain exchanges, whose large partitions Spark splits.
    shared = written(every.groupBy("group").agg(F.sum("times").alias("n")).where("n > 1").select("group"), "shared")
    live = written(every.join(shared, "group", "left_semi"), "live")
    texts = live.groupBy("group", "key").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "text_key", "first", "last")).alias("r"))
    texts = written(texts.select("group", "key", "n", "r.*"), "texts")
    groups = texts.groupBy("group").agg(F.count("*").alias("texts"), F.sum(F.col("last") - F.col("first") + length).alias("bytes")).where("texts > 1")
    groups = written(groups.withColumn("large", F.col("bytes") > GROUP_BYTES), "groups")
    parts = texts.join(groups, "group").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.struct("group", "first", "last", "large", (F.col("n") == 1).alias("alone")).alias("part")
    )

    # The texts of documents with shared groups, and what to cut from them.
    wanted = live.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    packed = _packed(rows)
    some = written(packed.join(wanted, _same(packed, wanted), "left_semi"), "packed")
    parts = parts.groupBy("_id", "_key").agg(F.collect_list("part").alias("parts"))
    cut = written(_cut_texts(some.join(parts, _same(some, parts)).select("doc_id", "text_key", "packed", "parts"), length, gram), "cut")
    ready = cut.where("last is null").select("doc_id", "text_key", "group", "first", "alone", "text")
    spans = live.join(texts.where("n > 1").select("group", "key"), ["group", "key"], "left_semi").select("doc_id", "text_key", F.col("first").alias("start"), (F.col("reach") + length).alias("end"))
    if not groups.where("large").isEmpty():
        repeated, more = _of_large_groups(cut.where("last is not null"), length)
        spans, ready = spans.unionByName(repeated), ready.unionByName(more)
    ready = ready.repartition("group").sortWithinPartitions("group")
    spans = spans.unionByName(_compared(ready, length))
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    changed = _removed(some.join(spans, _same(some, spans)), keep_text)
    same = rows.join(spans.select("_id", "_key"), _same(rows, spans), "left_anti") if keep_text else None
    if same is None:
        light = rows.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
        same = light.join(spans.select("_id", "_key"), _same(light, spans), "left_anti")
        same = same.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    else:
        zero = F.lit(0).cast("long")
        same = same.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    return changed.unionByName(same)


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """With text, the bytes that stay as a string; U+FFFD stands where a cut goes through a character, kept_sha256 is of the bytes."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
