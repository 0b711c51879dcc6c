"""N-gram Jaccard join: MinHash banding retrieves, full n-gram sets verify.

1. Each document becomes a 128-bit key of its set of word n-grams and the hashes of its bands; documents with one key are
   copies and are collapsed to a node. BANDS bands of ROWS rows meet with probability RECALL at the least similarity.
2. Nodes are dealt by band hash; each bucket links its nodes to its least one: a star, never all pairs. Connected
   components of the stars are the candidate groups.
3. The n-gram sets of nodes in groups are made once, from one text of each node, and stored. A group's sets are compared as
   products of sparse 0/1 blocks. A group of over BLOCK_NODES nodes or BLOCK_GRAMS n-grams is either cut into salted parts whose pairs
   are separate tasks' work, or compared bucket by bucket (buckets cut alike, a pair counts in the first band it shares), whichever sends fewer
   sets: a dense group of n near copies is the former, n * n / BLOCK_NODES sets, a chain of loosely joined documents the latter, at most one set for each
   band and part of its bucket. Either way a pair at the least similarity is compared with probability RECALL or more. Tasks emit a count of
   links for each node and a spanning forest of their links, both linear in the nodes, never the pairs.
4. Connected components of the forests are the classes.

Defined results: a null, empty or all-space text has no n-gram, no link and a class of its own. A text of fewer than
five words has one n-gram, of all its words. All n-grams of a text of any length count; a longer text is a slice, and a group of long texts a cut, of its own. Copies (equal n-gram sets) link to each other; repeated rows count as copies. The
class id is the least doc_id of the class, null if all are null. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, band_hashes, bands_for, bundled, mapped, minhash, mix, shingle_hashes, slices, superseded, text_buffers, unbundled, word_hashes, written

ROWS, RECALL = 4, 0.9999
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 20
#: Columns of a dense block in the product.
_WIDTH = 4096


def gram_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row, sorted by row and value."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(len(offsets)))


def set_keys(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit key of each set, the same for equal sets; rows without n-grams get b''."""
    has = np.flatnonzero(np.diff(offsets))
    out = [b""] * (len(offsets) - 1)
    if len(has):
        at = offsets[:-1][has]
        a = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
        b = np.bitwise_xor.reduceat(mix(grams + np.uint64(0x9E3779B97F4A7C15)), at) * np.uint64(3) + np.diff(offsets)[has].astype(np.uint64)
        for i, key in zip(has, np.stack([a, b], 1), strict=True):
            out[i] = key.tobytes()
    return out


def text_key() -> Column:
    """Tells apart rows of one doc_id and different texts."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def signatures(documents: DataFrame, similarity: float, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, node (null without n-grams), n_grams, bands."""
    bands = bands_for(similarity, RECALL, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                hashes, at = shingle_hashes(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                grams, at = gram_sets(hashes, at)
                has = np.diff(at) > 0
                found = np.zeros((j - i, bands), np.int64)
                if has.any():
                    found[has] = band_hashes(minhash(grams, np.append(at[:-1][has], len(grams)), bands * ROWS), ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * (j - i) + 1, bands), pa.int32()), pa.array(found.ravel()))
                keys = pa.array([k or None for k in set_keys(grams, at)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), keys, pa.array(np.diff(at)), lists], names=["doc_id", "text_key", "node", "n_grams", "bands"]
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return mapped(rows, run, "doc_id long, text_key long, node binary, n_grams long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of edges (a, b).

    Large-star and small-star steps in turn until nothing changes; each step shrinks paths to logarithmic length and is
    written to the shared folder. A hub's edges aggregate map-side, and least neighbours are written before they are joined:
    both sides of the join then are plain exchanges, whose large partitions Spark splits.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(64):
        # Large star: each node's larger neighbours move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        # Small star: a node and its smaller neighbours move to the least of them.
        superseded(least, edges)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        superseded(least, large)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of blocks of columns."""
    out = np.zeros((len(sets), len(others)), np.float32)
    values = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    # N-grams of a single set meet nothing.
    keep = count[column] > 1
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
    edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + _WIDTH + 1, _WIDTH))
    for low, high in zip(edge[:-1], edge[1:], strict=True):
        if high > low:
            block = np.zeros((len(sets) + len(others), _WIDTH), np.float32)
            block[owner[low:high], column[low:high] % _WIDTH] = 1
            out += block[: len(sets)] @ block[len(sets) :].T
    return out


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of a block's links, by global position."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = int(left[i]), int(right[j])
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
            if len(out) == len(left) + len(right) - 1:
                break
    return out


def compare(sets: list[np.ndarray], copies: np.ndarray, part: np.ndarray, parts: tuple[int, int], similarity: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each set the number of documents it links to, and spanning edges, of the pairs between two parts (or within one).

    earlier: hashes of the bands before this bucket's, a row for each set; pairs that share one have been counted there.
    """
    left = np.flatnonzero(part == parts[0])
    right = left if parts[0] == parts[1] else np.flatnonzero(part == parts[1])
    found = np.zeros(len(sets), np.int64)
    edges: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return found, edges
    due = None
    if earlier is not None and earlier.shape[1]:
        due = np.ones((len(left), len(right)), bool)
        for band in earlier.T:
            due &= band[left][:, None] != band[right][None]
        if not due.any():
            return found, edges
    sizes = np.asarray([len(s) for s in sets], np.float64)
    common = _counts([sets[i] for i in left], [sets[j] for j in right]) if left is not right else _counts([sets[i] for i in left], [sets[i] for i in left])
    union = sizes[left][:, None] + sizes[right][None] - common
    links = common >= similarity * union - 1e-9
    if due is not None:
        links &= due
    if left is right:
        np.fill_diagonal(links, False)
        found[left] = links @ copies[left]
        edges = _forest(np.triu(links), left, right)
    else:
        found[left] = links @ copies[right]
        found[right] = copies[left] @ links
        edges = _forest(links, left, right)
    return found, edges


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each whole."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and rows[a] != last:
                yield pa.concat_tables(held)
                held = []
            # A copy, so that a small run doesn't hold its whole batch.
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]) if b - a == batch.num_rows else pa.Table.from_batches([batch.take(pa.array(np.arange(a, b)))]))
            last = rows[a]
    if held:
        yield pa.concat_tables(held)


_JOB = ["root", "band", "hash", "left", "right"]


def gram_table(texts: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """From (node, text): node and its n-gram set, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                hashes, at = shingle_hashes(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                grams, at = gram_sets(hashes, at)
                sets = [grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "grams"])

    return mapped(texts, run, "node binary, grams binary")


def verified(jobs: DataFrame, similarity: float) -> DataFrame:
    """From (root, band, hash, left, right, part, node, copies, bands, grams): rows (node, n_links, other); other, if not null, is a link of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _streamed(batches, _JOB):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("grams")]
            node, band = group.column("node").to_pylist(), group.column("band")[0].as_py()
            earlier = np.asarray([x[:band] for x in group.column("bands").to_pylist()], np.int64).reshape(len(sets), band) if band > 0 else None
            parts = (group.column("left")[0].as_py(), group.column("right")[0].as_py())
            found, edges = compare(sets, group.column("copies").to_numpy(), group.column("part").to_numpy(), parts, similarity, earlier)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node[i] for i in at] + [node[a] for a, _ in edges], pa.binary()),
                    pa.array(np.concatenate([found[at], np.zeros(len(edges), np.int64)])),
                    pa.array([None] * len(at) + [node[b] for _, b in edges], pa.binary()),
                ],
                names=["node", "n_links", "other"],
            )

    return mapped(jobs, run, "node binary, n_links long, other binary")


def _cuts(nodes: Column, grams: Column) -> Column:
    """Parts of a group or bucket."""
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(grams / BLOCK_GRAMS)).cast("int")


def _jobs(sized: DataFrame) -> DataFrame:
    """Pieces of comparison work, a row for each node in each: root, band, hash, left, right, part, node, copies, bands.

    sized: a stored table (node, root, copies, n_grams, bands). A job of a whole group has band -1, one of a bucket an empty root.
    """
    total = sized.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n_grams").alias("grams"))
    total = written(total.select("root", "nodes", _cuts(F.col("nodes"), F.col("grams")).alias("cuts")), "totals")
    large = written(sized.join(total.where("cuts > 1").select("root"), "root", "left_semi").select("root", "node", "copies", "n_grams", "bands", F.posexplode("bands").alias("band", "hash")), "large")
    buckets = large.groupBy("root", "band", "hash").agg(F.count("*").alias("nodes"), F.sum("n_grams").alias("grams")).where("nodes > 1")
    buckets = written(buckets.select("root", "band", "hash", "nodes", _cuts(F.col("nodes"), F.col("grams")).alias("cuts")), "buckets")
    cheaper = buckets.groupBy("root").agg(F.sum(F.col("nodes") * F.col("cuts")).alias("sent")).join(total, "root").where("sent < nodes * cuts")
    cheaper = written(cheaper.select("root"), "by_bucket")

    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    job = [F.least("part", "k").alias("left"), F.greatest("part", "k").alias("right"), "part", "node", "copies"]
    groups = written(total.join(cheaper, "root", "left_anti").select("root", "cuts"), "cuts")
    whole = sized.join(groups, "root").withColumn("part", cut).withColumn("k", parts)
    whole = whole.select("root", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), *job, F.lit(None).cast("array<long>").alias("bands"))
    chosen = written(buckets.join(cheaper, "root", "left_semi").select("band", "hash", "cuts"), "chosen_buckets")
    single = large.join(chosen, ["band", "hash"]).withColumn("part", cut).withColumn("k", parts)
    return whole.unionByName(single.select(F.lit(b"").alias("root"), "band", "hash", *job, "bands"))


def classified(documents: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """The signatures of all documents, and a table of nodes: node, copy_id, copies, root (of its class), links."""
    signed = written(signatures(documents, similarity, n), "signatures")
    # The row that stands for a node: that of the least doc_id, and its text, as doc_ids may repeat.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = signed.where("node is not null").groupBy("node").agg(least_row.alias("least"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", F.col("least.doc_id").alias("copy_id"), "least.text_key", "copies", "n_grams", "bands"), "nodes")
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    least = dealt.groupBy("band", "hash").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").drop("last")
    stars = dealt.join(least, ["band", "hash"]).select(F.col("node").alias("a"), "b")
    groups = written(components(stars), "groups")

    sized = written(groups.join(nodes, "node"), "sized")
    # One text of each node, also where its row is repeated.
    chosen = sized.select("node", F.col("copy_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "text").dropDuplicates(["node"])
    sets = written(gram_table(texts, n), "sets")
    jobs = written(_jobs(sized), "jobs").join(sets, "node")
    jobs = jobs.repartition(*_JOB).sortWithinPartitions(*_JOB, "node")
    links = written(verified(jobs, similarity), "links")

    classes = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.where("other is null").groupBy("node").agg(F.sum("n_links").alias("links"))
    labelled = nodes.select("node", "copy_id", "copies").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return signed, written(labelled.join(counts, "node", "left"), "classes")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_copies for each document.

    class_id is the least doc_id linked to it, directly or by way of others; copy_id that of its copies; n_links the
    number of other documents at least as similar, n_copies of those that are copies.
    """
    signed, labelled = classified(documents, similarity, n)
    # Stored, as a node may stand for any number of copies: Spark splits large partitions only of plain exchanges.
    table = written(labelled.join(written(labelled.groupBy("root").agg(F.min("copy_id").alias("class_id")), "class_ids"), "root"), "labelled")
    out = signed.select("doc_id", "node").join(table, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
    )


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document of least doc_id of each class, with all its columns; texts without n-grams all stay."""
    signed, labelled = classified(documents, similarity)
    rows = signed.select("doc_id", "text_key", "node").join(labelled.select("node", "root"), "node", "left")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(key.alias("key"))).alias("m")).select("m.key.doc_id", "m.key.text_key")
    bare = rows.where("root is null").select("doc_id", "text_key").distinct()
    chosen = written(chosen, "chosen")
    repeated = signed.where("node is not null").join(chosen.withColumnRenamed("doc_id", "_id"), (F.col("_id").eqNullSafe(F.col("doc_id"))) & (signed["text_key"] == chosen["text_key"]), "left_semi")
    repeated = repeated.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    keys = chosen.unionByName(bare).select(F.col("doc_id").cast(documents.schema["doc_id"].dataType).alias("_id"), F.col("text_key").alias("_key"))
    kept = bundled(documents, F.col("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("_text_key"))
    kept = kept.join(keys, kept["doc_id"].eqNullSafe(keys["_id"]) & (kept["_text_key"] == keys["_key"]), "left_semi")
    if repeated:
        # Wholly equal keys: one row of each; bare texts stay as they are.
        has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.where(has_words).dropDuplicates(["doc_id", "_text_key"]).unionByName(kept.where(~has_words))
    return unbundled(kept, documents)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS MATERIALIZED (SELECT min(r) AS node, s, min(doc_id) AS copy_id, count(*) AS copies, len(s) AS size FROM s WHERE len(s) > 0 GROUP BY s),
g AS MATERIALIZED (SELECT node, unnest(s) AS g FROM n),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM (SELECT a.node AS x, b.node AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY ALL) p
  JOIN n a ON a.node = x JOIN n b ON b.node = y WHERE k >= 0.8 * (a.size + b.size - k)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, other) AS (SELECT node, node FROM n UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.other),
classes AS (SELECT reach.node, min(copy_id) AS class_id FROM reach JOIN n ON n.node = other GROUP BY ALL),
links AS (SELECT a AS node, sum(copies) AS links FROM u JOIN n ON n.node = b GROUP BY a)
SELECT s.doc_id::BIGINT AS doc_id, coalesce(class_id, s.doc_id)::BIGINT AS class_id, coalesce(copy_id, s.doc_id)::BIGINT AS copy_id,
  (coalesce(links, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links, (coalesce(copies, 1) - 1)::BIGINT AS n_copies
FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN classes USING (node) LEFT JOIN links USING (node)
"""
