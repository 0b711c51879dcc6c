"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

Items are partitioned by their number of shingles, each partition holding sizes up to twice its smallest. For a partition of
sizes up to s, a document's shingles are cut into windows of 2 s shingles that begin every s, so that an item's passage
lies whole in a window and its containment bounds the Jaccard similarity of window and item from below. The number of bands
(of one row) follows from that bound and RECALL. A passage in several pieces meets as likely, as its pieces' similarities
add up. A collision makes a candidate; verification counts the item's distinct shingles in the whole text, word for word.

Items are the query set: they go to the workers in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters (a longer item
is a block of its own), all documents are searched for each block. Blocks are made, searched and given back one after the other, so that driver and workers hold
one at a time, however large the benchmark is; a block keeps items as text and makes the n-grams of those that are looked at.

Defined results: null and empty texts hold no shingle and match nothing. An item or document of one to four words has one
shingle, of all its words. Wholly equal items count once; repeated documents each get rows. Empty tables give no rows.
Texts of any length are searched whole. Only doc_id and text, and item_id and text, are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, bands_for, bundled, filtered, mapped, minhash, shingle_hashes, slices, text_buffers, unbundled, word_hashes, written

RECALL = 0.9999
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 16 << 20
#: Items whose n-grams a worker remembers.
REMEMBERED = 4096
_WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str, n: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    w = _WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@dataclass
class Partition:
    size: int  # the most shingles of an item; windows have twice as many
    bands: int
    items: np.ndarray
    minima: np.ndarray  # (bands, items)


class Index:
    """Items of one block, by size."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity = similarity
        keep = [i for i, t in enumerate(texts) if _WORD.search(t)]
        self.ids, self.texts = [ids[i] for i in keep], [texts[i] for i in keep]
        self.sizes = sizes = np.asarray([len(shingles(t)) for t in self.texts], np.int64)
        self._known: dict[int, set[tuple[str, ...]]] = {}
        data, offsets = text_buffers(pa.array(self.texts, pa.string()))
        hashes, at = shingle_hashes(*word_hashes(data, offsets))
        self.partitions: list[Partition] = []
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int) if len(sizes) else sizes
        for x in np.unique(level):
            size, items = 1 << int(x), np.flatnonzero(level == x)
            least = size // 2 + 1 if x else 1
            bands = bands_for(similarity * least / (2 * size + (1 - similarity) * least), recall, 1)
            parts = [hashes[at[i] : at[i + 1]] for i in items]
            self.partitions.append(Partition(size, bands, items, minhash(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), bands)))
        self.bands = max((p.bands for p in self.partitions), default=0)

    def shingles(self, item: int) -> set[tuple[str, ...]]:
        if item not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[item] = shingles(self.texts[item])
        return self._known[item]

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of (row, item) that collide in a band."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(offsets)
        rows = np.flatnonzero(counts)
        if not len(rows) or not self.partitions:
            return found
        counts = counts[rows]
        smallest = self.partitions[0].size
        levels = []
        # Windows are made of blocks, blocks of those of the smallest partition.
        base = -(-counts // smallest)
        base_at = np.concatenate([[0], np.cumsum(base)])
        base_start = np.repeat(offsets[rows], base) + smallest * (np.arange(base_at[-1]) - np.repeat(base_at[:-1], base))
        for p in self.partitions:
            n = -(-counts // p.size)
            at = np.concatenate([[0], np.cumsum(n)])
            k = np.arange(at[-1]) - np.repeat(at[:-1], n)
            starts = np.repeat(base_at[:-1], n) + k * (p.size // smallest)
            levels.append((p, starts, np.repeat(rows, n), k + 1 < np.repeat(n, n)))
        # The parameters that minhash() draws for so many bands, for each partition.
        draws = {}
        for p in self.partitions:
            rng = np.random.Generator(np.random.PCG64(0x5EED))
            draws[p.bands] = (rng.integers(0, 1 << 63, p.bands, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, p.bands, np.uint64))
        for bands, (a, b) in draws.items():
            own = [x for x in levels if x[0].bands == bands]
            for i in range(bands):
                low = np.minimum.reduceat(hashes * a[i] + b[i], base_start)
                for p, starts, of, more in own:
                    m = low if p.size == smallest else np.minimum.reduceat(low, starts)
                    window = m.copy()
                    window[:-1][more[:-1]] = np.minimum(m[:-1], m[1:])[more[:-1]]
                    target = p.minima[i]
                    seen = np.zeros(1 << 16, bool)
                    seen[(target >> np.uint64(48)).astype(np.int64)] = True
                    maybe = np.flatnonzero(seen[(window >> np.uint64(48)).astype(np.int64)])
                    if len(maybe):
                        order = np.argsort(target)
                        values = window[maybe]
                        left, right = np.searchsorted(target[order], values, "left"), np.searchsorted(target[order], values, "right")
                        for j in np.flatnonzero(right > left):
                            found.update((int(of[maybe[j]]), int(p.items[x])) for x in order[left[j] : right[j]])
        return found

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles shared) of each item that a text contains."""
        data, offsets = text_buffers(texts)
        for i, j in slices(offsets):
            hashes, at = shingle_hashes(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            by_row: dict[int, list[int]] = {}
            for row, item in sorted(self.candidates(hashes, at)):
                by_row.setdefault(row, []).append(item)
            for row, items in by_row.items():
                own = shingles(data[offsets[i + row] : offsets[i + row + 1]].tobytes().decode())
                for item in items:
                    shared = len(self.shingles(item) & own)
                    if shared >= self.similarity * self.sizes[item]:
                        yield i + row, item, shared


def item_blocks(benchmark: DataFrame, similarity: float = SIMILARITY) -> tuple[int, Iterator[Index]]:
    """How many blocks there are, and the index of each as it is asked for."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").dropDuplicates(["item_id", "text"])
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))

    def made() -> Iterator[Index]:
        for k in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
            yield Index([r["item_id"] for r in rows], [r["text"] for r in rows], similarity)

    return blocks, made()


SCHEMA = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
_KEY = "doc_id long, text_key long"


def _searched(rows: DataFrame, benchmark: DataFrame, similarity: float, schema: str, found: Callable[[Index, pa.RecordBatch, list], pa.RecordBatch]) -> DataFrame:
    """What `found` makes of a batch's hits, for all blocks. Each block's rows are stored before the next one is made, and its broadcast is given back."""
    context, out = rows.sparkSession.sparkContext, None
    for index in item_blocks(benchmark, similarity)[1]:
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(shared.value.search(batch.column("text")))
                if hits:
                    yield found(shared.value, batch, hits)

        block = written(mapped(rows, run, schema), "hits")
        shared.destroy()
        out = block if out is None else out.unionByName(block)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and containment of each item in each document that holds it."""

    def found(index: Index, batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        row, item, n = zip(*hits, strict=True)
        sizes = [int(index.sizes[x]) for x in item]
        ids = pa.array([None if index.ids[x] is None else int(index.ids[x]) for x in item], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), ids, pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array([a / b for a, b in zip(n, sizes, strict=True)], pa.float64())],
            names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
        )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _searched(rows, benchmark, similarity, SCHEMA, found)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns.

    A single block filters in place; of several the rows found are gathered and left out by one join at the end.
    """
    blocks, indexes = item_blocks(benchmark, similarity)
    if blocks == 1:
        shared = documents.sparkSession.sparkContext.broadcast(next(indexes))

        def clean(texts: pa.Array) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[row for row, _, _ in shared.value.search(texts)]] = False
            return keep

        return filtered(documents, clean)

    def found(index: Index, batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        rows = pa.array(sorted({row for row, _, _ in hits}))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_key").take(rows)], names=["doc_id", "text_key"])

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    leaks = written(_searched(rows, benchmark, similarity, _KEY, found).distinct(), "leaks")
    every = bundled(documents, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    return unbundled(every.join(leaks, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_anti"), documents)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_SHINGLES = """
  SELECT r, {id}, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) WHEN len(w) > 0 THEN [w] ELSE [] END AS s
  FROM (SELECT row_number() OVER () AS r, {id}, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""
OP6_SQL = f"""
WITH d AS (SELECT DISTINCT r AS document, doc_id, unnest(s) AS s FROM ({_SQL_SHINGLES.format(id="doc_id", table="documents")})),
b AS (SELECT DISTINCT r AS item, item_id, unnest(s) AS s FROM ({_SQL_SHINGLES.format(id="item_id", table="(SELECT DISTINCT item_id, text FROM benchmark)")})),
n AS (SELECT item, count(*) AS n_shingles FROM b GROUP BY item)
SELECT any_value(doc_id)::BIGINT AS doc_id, any_value(item_id)::BIGINT AS item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles,
  count(*) / any_value(n_shingles)::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN n USING (item) GROUP BY document, item HAVING count(*) >= 0.8 * any_value(n_shingles)
"""
