"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from byte histograms and word lists of whole texts; the
trees are grown on binned statistics and kept as flat arrays, which numpy walks
for all documents of a batch at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import cut

#: Labelled rows that the trees are fitted on at most (those of least hash).
MOST_LABELLED = 20_000
THRESHOLD = 0.7
_PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "upper": _mask(bytes(range(65, 91))), "lower": _mask(bytes(range(97, 123))), "digit": _mask(b"0123456789"), "space": _mask(b" \t\x0b\x0c\r"),
    "line": _mask(b"\n"), "stop": _mask(b".?"), "comma": _mask(b",;:"), "bang": _mask(b"!"), "bar": _mask(b"|"), "symbol": _mask(b"#$%&*+<=>@^_~\\/"),
    "bracket": _mask(b"()[]{}"), "quote": _mask(b"\"'`"), "lead": _mask(bytes(range(0xC2, 0xF5))), "control": _mask(bytes([*range(9), *range(14, 32), 127])),
}
_MASKS = np.stack(list(_CLASSES.values()), axis=1)
NAMES = [*_CLASSES, "log_words", "mean_word", "dev_word", "long_words", "short_words", "distinct", "top_word", "top_pair", "repeat_next", "dup_lines", "mean_line", "odd_ends", "caps_words", "log_lines", "entropy", "stopped_lines"]
#: Words, pairs and lines whose counts are held apart before they are added up.
_HELD = 1 << 18


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


class _Tally:
    """Counts of many different things by their 64-bit hashes, 16 bytes each."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, counts: dict[bytes, int]) -> None:
        self.held.append((np.fromiter(map(xxh3_64_intdigest, counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
        self.size += len(counts)
        if self.size > max(_HELD, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys, at = np.unique(np.concatenate([self.keys, *(k for k, _ in self.held)]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, *(c for _, c in self.held)]), len(keys)).astype(np.int64)
        self.keys, self.held, self.size = keys, [], 0

    def shape(self) -> tuple[int, int]:
        """How many different things there are, and the largest count."""
        self.settle()
        return len(self.keys), int(self.counts.max(initial=0))


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole UTF-8 text, in the order of NAMES.

    A long text is read in pieces of about 1 MB.  All counts go over the whole
    text: those of different words, pairs and lines are added up over the
    pieces by hash, so the size of a piece changes no statistic.
    """
    hist = np.zeros(256, np.int64)
    n = sums = squares = long = short = odd = caps = repeat = 0
    lines = stopped = 0
    one = len(text) <= _PIECE
    seen, pairs, rows_seen = _Tally(), _Tally(), _Tally()
    single: list[tuple[int, int]] = [(0, 0)] * 3
    last: list[bytes] = []
    for part in _pieces(text):
        hist += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        if not words:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n += len(words)
        sums += int(sizes.sum())
        squares += int((sizes * sizes).sum())
        long += int((sizes > 20).sum())
        short += int((sizes <= 2).sum())
        caps += sum(map(bytes.isupper, words))
        odd += sum(w[-1] in b"#$%&*|!" for w in words)
        chained = last + words
        repeat += sum(map(bytes.__eq__, chained, chained[1:]))
        counts, next_ = Counter(words), Counter(zip(chained, chained[1:], strict=False))
        if one:
            single[:2] = [(len(c), max(c.values(), default=0)) for c in (counts, next_)]
        else:
            seen.add(counts)
            pairs.add({b" ".join(k): v for k, v in next_.items()})
        last = words[-1:]
    held: Counter = Counter()
    for row in text.split(b"\n") if one else _rows(text):
        if row.strip():
            lines += 1
            stopped += row.rstrip()[-1:] in (b".", b"?", b"!", b'"')
            held[row if one or len(row) <= 64 else row[:64] + xxh3_128_digest(row)] += 1
            if not one and len(held) >= _HELD:
                rows_seen.add(held)
                held = Counter()
    if one:
        (words_kinds, top_word), (_, top_pair), row_kinds = *single[:2], len(held)
    else:
        rows_seen.add(held)
        (words_kinds, top_word), (_, top_pair), (row_kinds, _) = seen.shape(), pairs.shape(), rows_seen.shape()
    total = max(1, int(hist.sum()))
    m = max(1, n)
    mean = sums / m
    p = hist[hist > 0] / total
    return [
        *(hist @ _MASKS / total), math.log1p(n), mean, math.sqrt(max(0.0, squares / m - mean * mean)), long / m, short / m, words_kinds / m, top_word / m, top_pair / m,
        repeat / m, (lines - row_kinds) / max(1, lines), math.log1p(total / max(1, lines)), odd / m, caps / m, math.log1p(lines), float(-(p * np.log2(p)).sum()), stopped / max(1, lines),
    ]


def _rows(text: bytes) -> Iterator[bytes]:
    at = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(NAMES))


@dataclass
class Forest:
    """Flat trees: node i of all trees splits on ``feature[i]`` at ``limit[i]``
    (left: at most), with children ``left[i]`` and ``right[i]``; a leaf is its
    own child and adds ``value[i]``."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float, nodes: list) -> np.ndarray:
    """One tree, level by level, from histograms of gradients; appends to ``nodes`` and returns each row's value."""
    n, k = bins.shape
    width = max(len(e) for e in edges) + 1
    at = np.zeros(n, np.int64)
    open_nodes = {0: len(nodes)}
    nodes.append([0, math.inf, len(nodes), len(nodes), 0.0])
    value = np.zeros(n)
    columns = np.arange(k) * width
    for level in range(depth + 1):
        slots = sorted(open_nodes)
        if not slots:
            break
        place = np.full(max(slots) + 1, -1)
        place[slots] = np.arange(len(slots))
        live = np.flatnonzero((at >= 0) & (at <= max(slots)))
        live = live[place[at[live]] >= 0]
        own = place[at[live]]
        cells = (own[:, None] * (k * width) + columns + bins[live]).ravel()
        size = len(slots) * k * width
        gs, hs, cs = (np.bincount(cells, np.repeat(v, k), size).reshape(len(slots), k, width) for v in (g[live], h[live], np.ones(len(live))))
        gt, ht = gs[:, :1].sum(axis=2, keepdims=True), hs[:, :1].sum(axis=2, keepdims=True)
        gl, hl, cl = gs.cumsum(axis=2), hs.cumsum(axis=2), cs.cumsum(axis=2)
        ct = cs[:, :1].sum(axis=2, keepdims=True)
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(cl < least) | (ct - cl < least)] = 0
        for j in range(k):
            gain[:, j, len(edges[j]) :] = 0
        following: dict[int, int] = {}
        for slot in slots:
            s = place[slot]
            best = int(gain[s].argmax())
            f, b = divmod(best, width)
            mine = live[own == s]
            if level == depth or gain[s, f, b] <= 1e-6:
                v = -float(gt[s, 0, 0] / (ht[s, 0, 0] + ridge))
                nodes[open_nodes[slot]][4] = v
                value[mine] = v
                at[mine] = -1
                continue
            i = open_nodes[slot]
            nodes[i][0], nodes[i][1] = f, float(edges[f][b])
            for side in (0, 1):
                nodes[i][2 + side] = len(nodes)
                following[2 * slot + side] = len(nodes)
                nodes.append([0, math.inf, len(nodes), len(nodes), 0.0])
            at[mine] = 2 * slot + (bins[mine, f] > b)
        open_nodes = following
    return value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, most_bins: int = 48, least: int = 12, ridge: float = 3.0) -> Forest:
    """Trees for the log loss.  Without rows, or with one label, the score is constant."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(mean / (1 - mean))
    nodes: list = []
    roots: list[int] = []
    if len(y) > 2 * least and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(len(nodes))
            first = len(nodes)
            raw += rate * _grow(bins, edges, p - y, p * (1 - p), depth, least, ridge, nodes)
            for node in nodes[first:]:
                node[4] *= rate
    cols = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    return Forest(np.array(roots, np.int64), np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], float), base, depth)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold -1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, text, y) of at most ``most`` labelled rows outside fold ``held``.

    The sample is the rows of least hash of the id, then of the text, so it
    doesn't depend on the order of rows; equal rows count once.  Being bounded,
    its ids and hashes are broadcast to the documents, which is done without
    their texts first.
    """
    some = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held))
        .groupBy(F.col("doc_id").alias("_lid"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_lid"), "_lid")
        .limit(most)
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hashed = rows.join(F.broadcast(some), F.col("_id") == F.col("_lid")).select("_id", "y", F.xxhash64("text").alias("_th"))
    # cut: rows that are read again must be the same ones
    kept = cut(hashed.distinct().orderBy(F.xxhash64("_id"), "_id", "_th").limit(most)).select(F.col("_id").alias("_lid"), "y", F.col("_th").alias("_lth"))
    found = rows.join(F.broadcast(kept), (F.col("_id") == F.col("_lid")) & (F.xxhash64("text") == F.col("_lth")))
    return found.groupBy("_id", "_lth", "y").agg(F.first("text").alias("text")).select("_id", "text", "y")


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Forest:
    def run(batches):
        for b in batches:
            x = features(_binary(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = labelled(docs, labels, label, parts, held, most, doc_id, text).mapInArrow(run, "id string, y int, x array<double>").toArrow()
    return fit(*ordered(rows, len(NAMES)))


def ordered(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``rows`` (id, y, x) in the order of id and features, which reruns share."""
    ids, x, y = (rows.column(c).to_pylist() for c in ("id", "x", "y"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i]))
    return np.array([x[i] for i in order], float).reshape(len(ids), width), np.array([y[i] for i in order], float)


def scored(docs: DataFrame, forest: Forest, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and ``score``, the chance of label 1."""
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches):
        for b in batches:
            score = forest.score(features(_binary(b.column(len(columns)))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(score)], names=[*columns, "score"])

    return docs.select(*columns, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, threshold: float = THRESHOLD, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The trees learn from labelled rows outside the held-out fold only.  Null
    and empty texts are scored like any other; with no labels all scores are
    one half; an empty table gives no rows.
    """
    forest = train(docs, labels, label, parts, held, most, doc_id, text)
    return scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), forest, ["doc_id"]).select(
        "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged."""
    forest = train(docs, labels, text=text, **options)
    columns = docs.columns
    named = [f"_c{i}" for i in range(len(columns))]
    marked = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(columns, named, strict=True)], F.col(text).alias("_body"))
    return scored(marked, forest, named, "_body").filter(F.col("score") >= threshold).select(*[F.col(a).alias(c) for a, c in zip(named, columns, strict=True)])
