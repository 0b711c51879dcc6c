"""Best-two-fit packing of tokenized documents into sequences.

Bins are filled greedily with the longest piece that fits; then a bin's smallest piece is replaced with
the two unpacked pieces that fill its expanded gap most tightly, if they fill it better. Pieces of one length
are interchangeable, so the plan is made on the histogram of lengths (at most `size` numbers, whatever the
corpus) and says how often each pattern of lengths is used. Each step takes a pattern as often as the
counts allow and so exhausts a length: the number of patterns is bounded by the number of lengths. Pieces
then get ranks within their length, salted so that a hot length is spread over tasks, and look up their place.

Defined results: a null or empty text is one piece, the end token alone. Repeated rows and repeated doc_ids
are packed each on its own; a text of any length is cut into pieces, all of which are packed. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import mapped, slices, text_buffers, written

MAX_TOKENS = 4096
END_TOKEN = 1
#: Pieces of one length that a task ranks, at least, and the most tasks beyond one a length.
RANK_ROWS, RANK_TASKS = 1 << 10, 1 << 17
#: Entries of a worker's table of known ids, and the longest key; longer ones are encoded each time.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# White space to str.split that isn't white space to the tokenizer.
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
# Below this character NFC changes nothing and lower case is by character, as the tokenizer takes it.
_PLAIN = "\u0250"


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """Ids as little-endian 32-bit bytes, equal to the tokenizer's.

    Its words never span white space, so ids are remembered by run of other characters; a plain run is put together
    from its words, which the tokenizer's own split pattern makes and its model turns to ids. Other runs, and texts
    with special tokens, go through the whole tokenizer. Vocabularies of another make always do. The table is filled on
    demand and emptied when it is full.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = sys.byteorder == "little" and kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"]).findall if self.by_word else None
        self.alphabet = _byte_alphabet()
        self.model = self.tokenizer.model.tokenize

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model(mapped)]).tobytes()

    def __missing__(self, run: str) -> bytes:
        """Of a run without white space, or of a word of a plain run."""
        if run.isascii() or max(run) < _PLAIN:
            low = run.lower()
            if low.isalpha():
                ids = self._word(low) if low == run else self[low]
            elif low[-1] in ".," and low[:-1].isalpha():
                ids = self[low[:-1]] + self._word(low[-1])
            else:
                ids = b"".join([self[x] if x.isalpha() else self._word(x) for x in self.words(low)])
        else:
            ids = self._whole(run)
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker, whatever the number of its tasks."""
    return WordEncoder(path)


def tokenized_pieces(documents: DataFrame, tokenizer: str, size: int = MAX_TOKENS, end: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    last = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(ids, batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                    b = encoder.encode(text or "") + last
                    for k, at in enumerate(range(0, len(b), 4 * size)):
                        part = b[at : at + 4 * size]
                        for column, v in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                arrays = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)][: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, _PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[int, list[int]]]:
    """Patterns of lengths and how often each is used, so that all pieces are in one bin each."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out = []

    def fitting() -> np.ndarray:
        """For each gap the longest length left that fits; 0 if none does."""
        return np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))

    best = fitting()
    while best[size]:
        bin_, gap = [], size
        while x := int(best[gap]):
            bin_.append(x)
            left[x] -= 1
            gap -= x
            if not left[x]:
                best = fitting()
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            wide = gap + smallest
            first = np.flatnonzero(left[: wide + 1])
            second = best[wide - first]
            same = (second == first) & (left[first] < 2)
            if same.any():
                below = best[np.maximum(first - 1, 0)]
                second = np.where(same, np.minimum(below, second), second)
            ok = second > 0
            if ok.any():
                sums = np.where(ok, first + second, 0)
                k = int(np.argmax(sums))
                if sums[k] > smallest:
                    a, b = int(first[k]), int(second[k])
                    left[smallest] += 1
                    left[a] -= 1
                    left[b] -= 1
                    bin_[-1:] = sorted((a, b), reverse=True)
        lengths, need = np.unique(bin_, return_counts=True)
        more = int((left[lengths] // need).min())
        left[lengths] -= need * more
        out.append((1 + more, bin_))
        best = fitting()
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, list[int]]:
    """For each length, consecutive ranges of ranks: where a range starts, and the first sequence and offset of its pieces."""
    rows: dict[str, list[int]] = {"length": [], "rank": [], "sequence_id": [], "offset": []}
    used: dict[int, int] = {}
    sequence = 0
    for times, bin_ in patterns:
        for length, offset in zip(bin_, accumulate([0, *bin_[:-1]]), strict=True):
            rank = used.get(length, 0)
            used[length] = rank + times
            for k, v in (("length", length), ("rank", rank), ("sequence_id", sequence), ("offset", offset)):
                rows[k].append(v)
        sequence += times
    return rows


def pack(pieces: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset.

    The pieces of a length are dealt to as many tasks as their number asks for, by their place in the stored table, whatever their ids.
    """
    pieces = written(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    # At most `size` rows.
    counted = [(r["length"], r["n"]) for r in lengths.collect()]
    total = sum(n for _, n in counted)
    each = max(RANK_ROWS, -(-total // RANK_TASKS))
    salts = pieces.sparkSession.createDataFrame([(x, -(-n // each)) for x, n in counted], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_at"), "_salts"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    # At most size + RANK_TASKS rows.
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    table = places(plan(dict(counted), size))
    order = np.lexsort((table["rank"], table["length"]))
    lengths, ranks, sequences, offsets = (np.asarray(table[k], np.int64)[order] for k in ("length", "rank", "sequence_id", "offset"))
    begin = np.searchsorted(lengths, np.arange(size + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((begin, ranks, sequences, offsets))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, ranks, sequences, offsets = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_first").to_numpy() + batch.column("_row").to_numpy() - 1
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                a, b = begin[x], begin[x + 1]
                at[rows] = a + np.searchsorted(ranks[a:b], rank[rows], "right") - 1
            kept = [c for c in batch.schema.names if c[0] != "_"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], names=[*kept, "sequence_id", "offset"]
            )

    row = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_at"))
    ranked = salted.withColumn("_row", row.cast("long")).join(F.broadcast(first.drop("n")), ["length", "_salt"])
    columns = [c for c in pieces.columns if c != "_at"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_at") + ", sequence_id long, offset long"
    return mapped(ranked.select(*columns, "_first", "_row"), look_up, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(tokenized_pieces(documents, tokenizer or default_tokenizer()))


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
