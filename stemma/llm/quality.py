"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

Viterbi decoding marks the lines; the share of words in content lines decides whether a document is kept.
The field is trained here, on a bounded sample of labelled documents (SAMPLE documents of each class, none over
SAMPLE_CHARS characters, chosen by a hash of doc_id). A document's verdict says nothing of its single lines, so labels are made in two
steps: a field without transitions learns from lines that carry their document's verdict, then each line is
labelled anew by that field's odds, moved by PRIOR towards the verdict; the full field learns from those labels.

Defined results: a null text has no words, so base_failed is true and kept false; so has an empty one. Texts of any length are measured and decoded whole. Repeated rows
each get a row. An empty table gives no rows. Only where a class has no labelled document with a word and at most SAMPLE_CHARS characters
is no field trained, and the base rules alone decide. Only doc_id and text are read, of labels doc_id and quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, mapped, mix, slices, span_hashes, text_buffers, word_bounds, written

SAMPLE, SAMPLE_CHARS = 400, 50_000
EPOCHS, RATE, DECAY, PRIOR = 150, 0.1, 1e-3, 1.0
#: Least share of a kept document's words in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Words of a line by which its weight grows.
LONG_LINE = 40
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[ord("a") : ord("z") + 1] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ord("0") : ord("9") + 1] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?@_=~^{}[]\\/")] = 1
# Cuts of each feature into buckets; a feature is true at or above its cut.
_CUTS = {
    "symbols": (0.01, 0.05, 0.15),
    "upper": (0.15, 0.4, 0.8),
    "marks": (0.02, 0.08),
    "digits": (0.1, 0.3),
    "repeats": (0.1, 0.3, 0.6),
    "echoes": (0.15, 0.4),
    "letters": (3.0, 7.0, 10.0),
    "words": (2, 6, 15, 60),
}
N_FEATURES = 2 + sum(map(len, _CUTS.values()))


@dataclass
class Measures:
    """Numbers of each row, and of each of their lines that hold a word."""

    base: dict[str, np.ndarray]
    lines: np.ndarray  # offsets of rows among the lines
    words: np.ndarray  # of each line
    features: np.ndarray


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    n = len(offsets) - 1
    starts, ends = word_bounds(data, offsets)
    wo = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n), np.diff(wo))
    hashes = span_hashes(data, starts, ends)

    def total(weights: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(weights[data])])

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = total(_SYMBOL)

    # Words in three-word windows that their row holds twice or more.
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        k = np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(row[:-2] == row[2:])
        window = mix(((hashes[at] * k + hashes[at + 1]) * k + hashes[at + 2]) ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(window)
        twice = window[order][1:] == window[order][:-1]
        found = np.zeros(len(at), bool)
        found[order[1:][twice]] = True
        found[order[:-1][twice]] = True
        for d in range(3):
            repeated[at[found] + d] = True

    # Lines; a row's end ends its last line.
    breaks = np.flatnonzero(data == 10)
    low = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    low = low[low < len(data)] if len(data) else low[:0]
    high = np.append(low[1:], len(data))
    high = high - (data[np.maximum(high - 1, 0)] == 10)
    first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
    has = last > first
    low, high, first, last = low[has], high[has], first[has], last[has]
    line_row = np.searchsorted(offsets, low, "right") - 1
    key = span_hashes(data, low, high) ^ mix(line_row.astype(np.uint64) + np.uint64(7))
    _, earliest = np.unique(key, return_index=True)
    dup = np.ones(len(low), bool)
    dup[earliest] = False

    words = last - first
    size = np.maximum(high - low, 1)
    share = lambda w: (lambda t: (t[high] - t[low]) / size)(total(w))
    upper, lower = share(_UPPER), share(_LOWER)
    in_words = lambda flags: (lambda t: (t[last] - t[first]) / words)(np.concatenate([[0], np.cumsum(flags)]))
    echo = np.zeros(len(starts), bool)
    for d in (1, 2, 3):
        echo[d:] |= (hashes[d:] == hashes[:-d]) & (row[d:] == row[:-d])
    chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    values = {
        "symbols": share(_SYMBOL),
        "upper": upper / np.maximum(upper + lower, 1e-9),
        "marks": share(_MARK),
        "digits": share(_DIGIT),
        "repeats": in_words(repeated),
        "echoes": in_words(echo),
        "letters": (chars[last] - chars[first]) / words,
        "words": words,
    }
    columns = [np.ones(len(low)), dup.astype(float)]
    columns += [(values[k] >= cut).astype(float) for k, cuts in _CUTS.items() for cut in cuts]
    sums = lambda flags, at: (lambda t: t[at[1:]] - t[at[:-1]])(np.concatenate([[0], np.cumsum(flags)]))
    lines = np.searchsorted(low, offsets)
    base = {
        "n_words": np.diff(wo),
        "word_chars": np.diff(chars[wo]),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": sums(dup, lines),
        "n_repeat_words": sums(repeated, wo),
    }
    # A longer line is more evidence: its features weigh up to three times as much.
    evidence = 1 + np.minimum(2, words / LONG_LINE)
    return Measures(base, lines, words, np.stack(columns, 1) * evidence[:, None] if len(low) else np.zeros((0, N_FEATURES)))


# -- the field ---------------------------------------------------------------------------------


@dataclass
class Field:
    """Scores of states 0 (boilerplate) and 1 (content): by feature, and by pair of neighbours."""

    weights: np.ndarray  # (N_FEATURES, 2)
    moves: np.ndarray  # (2, 2)

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best state of each line of one document."""
        scores = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.moves.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            p, q = b + t10 > a + t00, b + t11 > a + t01
            back.append((p, q))
            a, b = (b + t10 if p else a + t00) + x, (b + t11 if q else a + t01) + y
        state = int(b >= a)
        path = [state]
        for choice in reversed(back):
            state = int(choice[state])
            path.append(state)
        return np.asarray(path[::-1])


def _log_add(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def train(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, with_moves: bool = True) -> Field:
    """Conditional maximum likelihood by gradient steps; marginals by the forward-backward pass over all sequences at once."""
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: -len(sequences[i]))
    sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
    n, steps = len(sequences), len(sequences[0])
    lengths = np.asarray([len(s) for s in sequences])
    active = [int((lengths > t).sum()) for t in range(steps)]
    x = np.concatenate([np.stack([s[t] for s in sequences[: active[t]]]) for t in range(steps)])  # by step, then sequence
    y = np.concatenate([np.asarray([v[t] for v in labels[: active[t]]]) for t in range(steps)])
    at = np.concatenate([[0], np.cumsum(active)])
    # Each class weighs the same.
    weight = np.concatenate([np.asarray([1.0] * a) for a in active])
    share = np.bincount(y, minlength=2) / len(y)
    weight = np.asarray([0.5 / share[0], 0.5 / share[1]])[y] if share.min() > 0 else weight
    sequence_weight = np.asarray([weight[at[0] + i] for i in range(n)])
    weights, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for t in range(1, steps):
        np.add.at(seen, (y[at[t - 1] : at[t - 1] + active[t]], y[at[t] : at[t + 1]]), sequence_weight[: active[t]])
    observed = x.T @ (np.eye(2)[y] * weight[:, None])
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    for epoch in range(1, epochs + 1):
        e = x @ weights
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[: at[1]] = e[: at[1]]
        for t in range(1, steps):
            a = active[t]
            before = alpha[at[t - 1] : at[t - 1] + a]
            alpha[at[t] : at[t + 1]] = e[at[t] : at[t + 1]] + np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
        pair = np.zeros((2, 2))
        z = np.empty(n)
        for t in range(steps - 1, -1, -1):
            a, nxt = active[t], active[t + 1] if t + 1 < steps else 0
            z[nxt:a] = _log_add(alpha[at[t] + nxt : at[t] + a])
            if nxt:
                ahead = e[at[t + 1] : at[t + 2]] + beta[at[t + 1] : at[t + 2]]
                joint = alpha[at[t] : at[t] + nxt][:, :, None] + moves[None] + ahead[:, None, :]
                beta[at[t] : at[t] + nxt] = _log_add(moves[None] + ahead[:, None, :])
                pair += (np.exp(joint - z[:nxt, None, None]) * sequence_weight[:nxt, None, None]).sum(0)
        marginal = np.exp(alpha + beta - np.concatenate([z[:a] for a in active])[:, None])
        gradients = [(x.T @ (marginal * weight[:, None]) - observed) / len(y) + DECAY * weights, with_moves * (pair - seen) / len(y) + DECAY * moves]
        for i, (target, g) in enumerate(zip((weights, moves), gradients, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            target -= RATE * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-8)
    return Field(weights, moves)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    """A field trained on at most 2 * sample labelled documents; None if a class has none that can be used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where((F.length("text") <= sample_chars) & F.col("text").rlike(r"[^ \t-\r]"))
    # The sample is drawn from labels whose document can be used; only ids are joined. Of a document's several labels the greatest counts.
    usable = written(known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(texts, "doc_id", "left_semi"), "labelled")
    # limit after orderBy keeps `sample` rows a task: nothing unbounded meets in one place.
    some = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = {r["doc_id"]: r["quality"] for s in some for r in s.collect()}
    if len(set(picked.values())) < 2:
        return None
    rows = texts.where(F.col("doc_id").isin(list(picked))).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    data, offsets = text_buffers(pa.array([r["text"] for r in rows], pa.string()))
    m = measure(data, offsets)
    spans = [slice(a, b) for a, b in zip(m.lines[:-1], m.lines[1:], strict=True)]
    quality = [picked[r["doc_id"]] for r in rows]
    sequences = [m.features[s] for s in spans]
    first = train(sequences, [np.full(s.stop - s.start, q) for q, s in zip(quality, spans, strict=True)], with_moves=False)
    odds = first.weights[:, 1] - first.weights[:, 0]
    return train(sequences, [(x @ odds + (PRIOR if q else -PRIOR) > 0).astype(int) for q, x in zip(quality, sequences, strict=True)])


# -- decisions ---------------------------------------------------------------------------------

_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: pa.Array, field: Field | None) -> dict[str, np.ndarray]:
    """All columns but doc_id for a batch of texts."""
    parts: list[dict[str, np.ndarray]] = []
    data, offsets = text_buffers(texts)
    for i, j in slices(offsets):
        m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out = dict(m.base)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        content = np.ones(j - i)
        lines = np.diff(m.lines)
        for r in np.flatnonzero(lines):
            if field is not None:
                s = slice(m.lines[r], m.lines[r + 1])
                content[r] = m.words[s] @ field.viterbi(m.features[s]) / m.words[s].sum()
        out["kept"] = ~out["base_failed"] & (content >= CONTENT_SHARE)
        out["n_lines"], out["content_share"] = lines, np.where(lines > 0, content, 0.0)
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


SCHEMA = "doc_id long, " + ", ".join(f"{k} long" for k in _NUMBERS) + ", base_failed boolean, kept boolean, n_lines long, content_share double"


def quality(documents: DataFrame, field: Field | None) -> DataFrame:
    """A row for each document with its measures and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = judge(batch.column(1), field)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in out)], names=["doc_id", *out])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def keep_good(documents: DataFrame, field: Field | None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return filtered(documents, lambda texts: judge(texts, field)["kept"])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
