"""Approximate nearest neighbours by additive quantisation.

A vector's direction is the sum of one full-dimensional codeword from each of
several residual codebooks; a beam search picks the codewords, and the norm is
stored beside them.  A query's products with all codewords make a lookup table
that scores the stored codes; the best are reranked on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BOOKS = 16
WORDS = 256
BEAM = 4
#: Vectors that the codebooks are fitted on at most (those of least hash).
MOST_FITTED = 8192
#: Vectors of a block of codes.
BLOCK = 16_384
#: Candidates that a query reranks in each block.
RERANK = 200


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) whose codewords' sums come near ``x``: a beam search over the books."""
    m, k, d = books.shape
    out = np.empty((len(x), m), np.uint8)
    square = (books**2).sum(axis=2)
    for lo in range(0, len(x), 512):
        rest = x[lo : lo + 512, None, :].astype(np.float32)
        codes = np.zeros((len(rest), 1, 0), np.uint8)
        for j in range(m):
            n, b, _ = rest.shape
            error = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, b, k) + square[j]
            flat = error.reshape(n, b * k)
            width = min(beam, b * k)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < b * k else np.broadcast_to(np.arange(b * k), (n, b * k))
            from_beam, word = best // k, best % k
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, from_beam], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[rows, from_beam] - books[j][word]
        out[lo : lo + 512] = codes[np.arange(len(rest)), (rest**2).sum(axis=2).argmin(axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 1, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimension) for the directions ``x``: k-means on
    the residuals, then all books at once by least squares on beam-searched codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, out = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        rest -= centres[near]
        out.append(centres)
    found = np.stack(out)
    for _ in range(rounds):
        codes = encode(x, found, beam)
        spots = codes + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        right = np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(right, spots[:, a], x)
            for b in range(books):
                np.add.at(gram, (spots[:, a], spots[:, b]), 1)
        gram[np.diag_indices_from(gram)] += 0.05
        # unused words stay where k-means put them
        right += 0.05 * found.reshape(-1, x.shape[1])
        found = np.linalg.solve(gram, right).reshape(found.shape).astype(np.float32)
    return found


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v and row (a number of the row) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.monotonically_increasing_id().alias("row"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda e: e != 0), F.lit(False)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([column]).flatten(), np.float64).reshape(-1, d)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest, of equal ones the first."""
    if len(score) <= n:
        return np.arange(len(score))
    least = -np.partition(-score, n - 1)[n - 1]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: n - len(above)]])


def _packed(rows: np.ndarray) -> pa.Array:
    """A row of bytes as one binary value each."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


class Block:
    """A block of the index: ids in order, row numbers, vectors, codes by book and norms."""

    def __init__(self, parts: list[pa.RecordBatch], d: int):
        t = pa.Table.from_batches(parts).combine_chunks()
        self.ids, self.rows, self.norms = (np.array(t.column(c), kind) for c, kind in (("vec_id", np.int64), ("row", np.int64), ("norm", float)))
        self.v = _matrix(t.column("v").combine_chunks(), d)
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1).T)

    def ask(self, query: int, row: int, q: np.ndarray, books: np.ndarray, rerank: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` nearest among the ``rerank`` best codes."""
        lut = books @ q.astype(np.float32)
        score = lut[0].take(self.codes[0])
        for j in range(1, len(self.codes)):
            score += lut[j].take(self.codes[j])
        score *= self.norms
        lo, hi = np.searchsorted(self.ids, (query, query + 1))
        score[lo:hi][self.rows[lo:hi] == row] = -np.inf
        at = _best(score, rerank)
        at = at[self.rows[at] != row]
        exact = (self.v[at] * q).sum(axis=1)
        order = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at][order], exact[order]


def search(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, most_fitted: int = MOST_FITTED, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows nearest to
    each row whose id is divisible by ``every``.

    The score is the inner product in double precision.  All vectors are
    indexed and all blocks of codes are scored for each query; a query reranks
    the ``rerank`` best codes of each block on the original vectors.  Of equal
    scores the smaller id comes first.  Null, zero and non-finite vectors take
    no part.  Products are defined between vectors of one length only, so each
    length is searched by itself.  Rows that share an id are rows like others:
    each such query has a list of its own, in which the other rows of its id
    are candidates.  An empty table gives no rows.
    """
    good = usable(vectors, vec_id, embedding)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d, total in sorted((r.d, r.n) for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        found = found.unionByName(_search(good.filter(F.size("v") == d), d, total, every, k, rerank, most_fitted, block))
    return found


def _search(good: DataFrame, d: int, total: int, every: int, k: int, rerank: int, most_fitted: int, block: int) -> DataFrame:
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most_fitted).toArrow()
    x = np.array(some.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = fit(x, words=min(WORDS, max(1, len(x))))

    def code(batches):
        for b in batches:
            v = _matrix(b.column(1), d)
            norms = np.linalg.norm(v, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, _packed(encode(v / norms[:, None], books)), pa.array(norms)], names=["vec_id", "v", "row", "codes", "norm"])

    # cut: the rows' numbers must be the same where they are read again
    coded = cut(good.withColumn("v", F.col("v").cast("array<double>")).mapInArrow(code, "vec_id long, v array<double>, row long, codes binary, norm double"))
    blocks = -(-total // block)
    stored = coded.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "vec_id", "v", "row", "codes", "norm")
    asked = coded.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "row", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm")
    )

    def nearest(batches):
        """A block's vectors come before its queries, which stream past them."""
        held: list[pa.RecordBatch] = []
        at, index = None, None
        for b in batches:
            blocks, kinds = np.array(b.column(0)), np.array(b.column(1))
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    if index is not None or blocks[lo] != at:
                        held, index, at = [], None, blocks[lo]
                    held.append(part)
                    continue
                if blocks[lo] != at:
                    continue  # a block without vectors
                index = index or Block(held, d)
                ids, rows, q = np.array(part.column(2)), np.array(part.column(4)), _matrix(part.column(3), d)
                out = [index.ask(i, row, v, books, rerank, k) for i, row, v in zip(ids.tolist(), rows.tolist(), q, strict=True)]
                many = [len(x) for x, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, many)), pa.array(np.repeat(rows, many)), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([s for _, s in out]))], names=["query_id", "row", "vec_id", "score"]
                )

    found = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind", "vec_id").mapInArrow(nearest, "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
