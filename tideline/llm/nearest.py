"""Approximate nearest neighbours by additive quantisation, reranked exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import discard, prepare, stored


#: Queries that a task scores at a time.
SLICE = 256


@dataclass(frozen=True)
class Quantizer:
    """books: (M, K, dim) codewords of full dimension; a vector, less `center` and in units of `scale`, is about the sum of one
    codeword of each book."""

    books: np.ndarray
    center: np.ndarray
    scale: float

    def units(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.center) / self.scale

    def encode(self, vectors: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes (n, M) by beam search: the `beam` best partial sums go on from book to book."""
        n, vectors = len(vectors), self.units(vectors).astype(np.float32)
        sums = np.zeros((n, 1, vectors.shape[1]), np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            rest = vectors[:, None, :] - sums
            error = np.einsum("kd,kd->k", book, book)[None, None, :] - 2 * rest @ book.T + np.einsum("nbd,nbd->nb", rest, rest)[:, :, None]
            flat = error.reshape(n, -1)
            most = min(beam, flat.shape[1])
            best = np.argpartition(flat, most - 1, axis=1)[:, :most]
            from_, code = best // len(book), best % len(book)
            at = np.arange(n)[:, None]
            sums = sums[at, from_] + book[code]
            codes = np.concatenate([codes[at, from_], code[:, :, None].astype(np.uint8)], axis=2)
        error = ((vectors[:, None, :] - sums) ** 2).sum(axis=2)
        return codes[np.arange(n), error.argmin(axis=1)]

    def estimates(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances, in units, of each query from what the codes stand for, from tables of its inner products with all
        codewords."""
        x = self.units(queries)
        table = np.einsum("qd,mkd->mqk", x, self.books.astype(np.float64))
        inner = np.zeros((len(queries), len(codes)))
        for m in range(len(self.books)):
            inner += table[m][:, codes[:, m]]
        return (x**2).sum(axis=1)[:, None] + norms[None, :] - 2 * inner

    def words(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances, in units, of each vector from the words of the first book."""
        x, book = self.units(vectors), self.books[0].astype(np.float64)
        return (x**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None, :] - 2 * x @ book.T

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector the words of the first book, nearest first; the nearest one is the vector's cell."""
        return np.argsort(self.words(vectors), axis=1, kind="stable")

    def span(self, vectors: np.ndarray) -> float:
        """How long, in units, what is summed for these vectors can be; sums are right to a small part of it."""
        x = np.sqrt((self.units(vectors) ** 2).sum(axis=1).max(initial=0.0))
        held = (np.abs(vectors).max(initial=0.0) + np.abs(self.center).max()) / self.scale
        return 1.0 + x + held + np.sqrt((self.books.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m].astype(np.float64)[codes[:, m]] for m in range(len(self.books)))


def fit(sample: np.ndarray, books: int = 16, words: int = 64, rounds: int = 6, seed: int = 3) -> Quantizer:
    """Residual codebooks by k-means, each over what the books before it left."""
    rng = np.random.default_rng(seed)
    center = sample.mean(axis=0, dtype=np.float64)
    size = np.sqrt(((sample - center) ** 2).sum(axis=1))
    scale = float(next((x for x in (np.median(size), size.max()) if np.isfinite(x) and x > 0), 1.0))
    rest, out = ((sample - center) / scale).astype(np.float32), []
    for _ in range(books):
        book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            code = ((book**2).sum(axis=1)[None, :] - 2 * rest @ book.T).argmin(axis=1)
            n = np.bincount(code, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, code, rest)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        code = ((book**2).sum(axis=1)[None, :] - 2 * rest @ book.T).argmin(axis=1)
        rest -= book[code]
        out.append(book)
    return Quantizer(np.stack(out), center, scale)


def probes(quantizer: Quantizer, sample: np.ndarray, k: int, aim: float, most: int = 512) -> int:
    """How many cells a search has to open for `aim` of its nearest vectors: measured between up to `most` different vectors of
    the sample and all of the sample. Vectors of the whole table lie nearer to each other than those of a sample, hence
    rather in the same or in neighbouring cells. A sample of too few vectors asks for all cells."""
    different = np.unique(sample, axis=0)
    words = len(quantizer.books[0])
    if len(different) < 10 * k:
        return words
    asked = np.random.default_rng(5).permutation(len(different))[:most]
    far = (different**2).sum(axis=1)[None, :] - 2 * different[asked] @ different.T
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    cell = quantizer.cells(different)[:, 0]
    place = np.argsort(quantizer.cells(different[asked]), axis=1)
    found = np.bincount(np.take_along_axis(place, cell[near], axis=1).ravel(), minlength=words).cumsum() / near.size
    return int(np.searchsorted(found, min(aim, found[-1]))) + 1


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part.

    Left out: null ids and vectors; vectors that are empty, zero, or hold nulls or numbers that are not finite; vectors
    not of the most frequent length (of equally frequent lengths, the smallest). Of rows with one id, the smallest
    vector takes part.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (common[0]["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack(blocks: DataFrame, quantizer: Quantizer | None) -> DataFrame:
    """One row for each block (cell, part): its ids and vectors; of the index, its codes, the norms of what the codes stand for and
    how far the vectors are from that; of queries, how far their nearest are at most."""

    def each(key, table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.array(table.column("v").to_pylist())[order]
        if quantizer is not None:
            near = quantizer.encode(v)
            stands = quantizer.decode(near)
            more = {"codes": near, "norms": (stands**2).sum(axis=1), "errors": np.sqrt(((quantizer.units(v) - stands) ** 2).sum(axis=1))}
        else:
            more = {"reach": table.column("reach").to_numpy()[order]}
        where = {name: pa.array([x.as_py()], pa.int32()) for name, x in zip(("cell", "part"), key)}
        return pa.table(where | {name: pa.array([x.tobytes()], pa.binary()) for name, x in ({"ids": ids[order], "vectors": v} | more).items()})

    columns = ["ids", "vectors", *(["codes", "norms", "errors"] if quantizer is not None else ["reach"])]
    return blocks.groupBy("cell", "part").applyInArrow(each, ", ".join(["cell int, part int", *[f"{c} binary" for c in columns]]))


def reaches(quantizer: Quantizer, sample: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each asked vector, how far in units its k nearest other rows are at most: so far are k other rows of the sample."""
    out = np.full(len(asked), np.inf)
    if len(sample) <= k:
        return out
    rows, x = quantizer.units(sample), quantizer.units(asked)
    square = (rows**2).sum(axis=1)
    for i in range(0, len(x), 128):
        far = (x[i : i + 128] ** 2).sum(axis=1)[:, None] + square[None, :] - 2 * x[i : i + 128] @ rows.T
        far[own[i : i + 128, None] == ids[None, :]] = np.inf
        out[i : i + 128] = np.partition(far, k - 1, axis=1)[:, k - 1]
    span = max(quantizer.span(sample), quantizer.span(asked))
    return np.sqrt(np.maximum(out, 0) + 1e-13 * span**2) + 1e-12 * span


def opens(quantizer: Quantizer, asked: np.ndarray, reach: np.ndarray, held: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells (asked x words) may hold a row within reach: no row of a cell is nearer than the cell's radius leaves, nor
    than the plane half way to any other word, as it would lie in that word's cell."""
    far, book = quantizer.words(asked), quantizer.books[0].astype(np.float64)
    span = quantizer.span(asked) + radius.max(initial=0.0)
    within = ~(far > (reach[:, None] + radius[None, :] + 1e-12 * span) ** 2 + 1e-13 * span**2)
    between = np.sqrt(((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2))
    for b in range(len(book)):
        within &= ~(far - far[:, [b]] > 2 * between[b][None, :] * reach[:, None] + 1e-12 * span**2)
    return within & (held > 0)[None, :]


def _near(quantizer: Quantizer, rows: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, asked: np.ndarray, reach: np.ndarray, span: float, k: int, most: int) -> list[np.ndarray]:
    """For each asked vector, rows of a block (x: in units) among which its k nearest other ones of the block are, as far as these
    are within reach: those whose codes seem nearest, and what the errors of the codes leave in doubt."""
    if most >= len(rows):
        return [np.arange(len(rows))] * len(asked)
    far = quantizer.estimates(asked, codes, norms)
    best = np.argpartition(far, most - 1, axis=1)[:, :most]
    if most > k:  # an asked vector may be one of the rows itself
        reach = np.minimum(reach, [np.partition(np.sqrt(((rows[b] - a) ** 2).sum(axis=1)), k)[k] / quantizer.scale for a, b in zip(asked, best)])
    reach = reach[:, None] * (1 + 1e-9) + 1e-12 * span
    doubt = ~(far > (reach + errors[None, :]) ** 2 + 1e-12 * span**2)
    np.put_along_axis(doubt, best, False, axis=1)
    some = np.flatnonzero(doubt.any(axis=0))
    if len(some):
        there, here = x[some], quantizer.units(asked)
        apart = (here**2).sum(axis=1)[:, None] + (there**2).sum(axis=1)[None, :] - 2 * here @ there.T
        doubt[:, some] &= ~(apart > reach**2 + 1e-12 * span**2)
    return [np.append(b, np.flatnonzero(w)) for b, w in zip(best, doubt)]


def search(vectors: DataFrame, k: int = 10, every: int = 100, sample_rows: int = 16384, books: int = 16, words: int = 64, shortlist: int = 96, block_rows: int = 4096, query_rows: int = 8192, aim: float | None = None, exact: bool = False) -> DataFrame:
    """For each row whose id is divisible by `every`, its k nearest other rows by Euclidean distance.

    The quantizer is fitted on about sample_rows rows chosen by hash (a bound on what the driver receives); every row is
    indexed. A row's cell is the nearest word of the first codebook. A query's k nearest are no further than the k nearest of
    the sample, and it opens each cell that can hold a row so near (see opens()): vectors without any structure ask for most
    cells, vectors in clusters for few. With `aim`, it opens no more of them than `aim` of the sample's nearest rows ask for (see
    probes()), and more where these hold too few rows; then some are missed. The rows of a cell are dealt by hash into blocks
    of about block_rows, its queries into blocks of about query_rows, and these meet in one task for each pair of blocks.
    There, tables of inner products of queries and codewords, with the stored norms, score the block's codes; the `shortlist`
    best different vectors are measured exactly. A row is nearer to its code than its stored error, so a code that is further
    than the k nearest so far and this error can be left out; all others are checked exactly, and the block's k nearest go
    on. What a search finds is thus no matter of how well the codes fit the rows. With `exact` every cell is opened and every
    vector measured. Ties go to the smaller id; copies of a vector fill no more than one place of the shortlist. Defined cases:
    see usable(); tables without queries give an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stored(usable(vectors), "ann-rows")
    asking = F.pmod("vec_id", F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(asking, 1))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide = 1 << 30
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col("vec_id")), F.lit(wide)) < int(wide * min(1.0, sample_rows / n)))
    drawn = chosen.select("vec_id", "v").orderBy("vec_id").toArrow()
    drawn = drawn if drawn.num_rows else rows.select("vec_id", "v").orderBy("vec_id").limit(1).toArrow()
    ids, sample = drawn.column("vec_id").to_numpy(), np.array(drawn.column("v").to_pylist())
    quantizer = fit(sample, books, words)
    opened = words if exact or aim is None else probes(quantizer, sample, k, aim)
    most = max(shortlist, n) if exact else shortlist

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                cell = quantizer.cells(v)[:, 0]
                far = np.sqrt(((quantizer.units(v) - quantizer.books[0][cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "v", "cell", "far"])

    in_cells = rows.select("vec_id", "v").mapInArrow(placed, "vec_id long, v array<double>, cell int, far double")
    held, radius = np.zeros(words, np.int64), np.zeros(words)  # one number for each word of the first book
    for r in in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        held[r["cell"]], radius[r["cell"]] = r["n"], r["far"]

    def opening(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            order = quantizer.cells(v)
            reach = reaches(quantizer, sample, ids, v, batch.column("vec_id").to_numpy(), k)
            within = np.ones((len(v), words), bool) if exact else opens(quantizer, v, reach, held, radius)
            enough = (held[order].cumsum(axis=1) > k).argmax(axis=1)  # a query's own row is one of them
            last = np.where(held.sum() > k, np.maximum(enough + 1, opened), words)
            cells = [[int(c) for c in o[:m] if held[c] and w[c]] for o, m, w in zip(order, last, within)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "v", "reach", "cells"])

    asked = rows.filter(asking).select("vec_id", "v").mapInArrow(opening, "vec_id long, v array<double>, reach double, cells array<int>").select("vec_id", "v", "reach", F.explode("cells").alias("cell"))
    asked = stored(asked, "ann-asked")
    asks = np.zeros(words, np.int64)
    for r in asked.groupBy("cell").count().collect():
        asks[r["cell"]] = r["count"]
    parts, turns = -(-held // block_rows), -(-asks // query_rows)
    of_cell = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell") + 1)
    dealt = lambda seed, numbers: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), of_cell(numbers)).cast("int").alias("part")
    index = stored(_pack(in_cells.select("cell", dealt(1, parts), "vec_id", "v"), quantizer), "ann-index")
    queries = stored(_pack(asked.select("cell", dealt(2, turns), "vec_id", "v", "reach"), None), "ann-queries")
    discard(rows, asked)
    n_pairs = max(1, int((parts * turns).sum()))
    keys, tasks = ("cell", "part", "turn"), min(n_pairs, max(1024, n_pairs // 16))
    each = lambda numbers: F.explode(F.sequence(F.lit(0), (of_cell(numbers) - 1).cast("int")))
    left = index.filter(of_cell(turns) > 0).withColumn("turn", each(turns)).repartition(tasks, *keys)
    right = queries.select("cell", F.col("part").alias("turn"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "reach").withColumn("part", each(parts)).repartition(tasks, *keys)

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                v = np.frombuffer(r["vectors"]).reshape(len(ids), -1)
                q = np.frombuffer(r["q_vectors"]).reshape(len(q_ids), -1)
                codes, norms, errors = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["norms"]), np.frombuffer(r["errors"])
                reach = np.frombuffer(r["reach"])
                _, first, copy_of = np.unique(v.view([("", v.dtype)] * v.shape[1]).ravel(), return_index=True, return_inverse=True)
                order = np.argsort(copy_of, kind="stable")  # ids are sorted, so each vector's ids come in order
                begin = np.searchsorted(copy_of[order], np.arange(len(first)))
                end = np.append(begin[1:], len(ids))
                different = v[first]
                x = quantizer.units(different)
                span = max(quantizer.span(different), quantizer.span(q))
                out_q, out_v, out_d = [], [], []
                for i, own in enumerate(q_ids):
                    if i % SLICE == 0:
                        near_of = _near(quantizer, different, x, codes[first], norms[first], errors[first], q[i : i + SLICE], reach[i : i + SLICE], span, k, most)
                    near = near_of[i % SLICE]
                    d = np.sqrt(((different[near] - q[i]) ** 2).sum(axis=1))
                    pairs = []
                    for j in np.argsort(d, kind="stable"):
                        if len(pairs) >= k and d[j] > pairs[k - 1][0]:
                            break
                        c = near[j]
                        pairs += [(d[j], x) for x in ids[order[begin[c] : min(end[c], begin[c] + k + 1)]] if x != own]
                        pairs.sort()
                    out_q += [own] * min(k, len(pairs))
                    out_v += [x for _, x in pairs[:k]]
                    out_d += [x for x, _ in pairs[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_d, pa.float64())], ["query_id", "vec_id", "score"])

    pairs = left.join(right, list(keys))
    found = pairs.select("ids", "vectors", "codes", "norms", "errors", "q_ids", "q_vectors", "reach").mapInArrow(score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
