"""The k most similar vectors of every vector: additive quantisation, lookup-table scoring, exact reranking.

1. Equal vectors become one, with the smallest k + 1 names that carry it; so copies cost nothing and lose no neighbour.
2. A vector is the sum of one codeword from each of several full-dimensional codebooks. They are trained one after another on
   the residuals of a bounded sample; codes are found by a beam search over all codebooks, and the squared norm of the sum
   is stored with the codes.
3. The first codebook also says where to look: a vector is held against those nearest to the same first codeword and to the
   ``probes`` next ones. A crowded codeword is cut by centres of its own, fitted on a bounded sample of its vectors, as many as
   its rows ask for; a vector then looks into the nearest of these cells, COPIES in all. Codebook sizes follow the row count.
4. Within a cell scores come from a table of inner products of the query with all codewords; the best ``rerank`` are scored
   exactly, and the best k of all probed cells stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written

#: Vectors that the codebooks are fitted on, at most; a hash of the vector decides which.
SAMPLE = 65_536
BOOKS, WORDS, BEAM = 4, 128, 4
#: Codewords nearest to more vectors than CROWDED are cut into cells of about CELL_ROWS, by centres fitted on LOCAL vectors at most.
CROWDED, CELL_ROWS, LOCAL = 2048, 512, 16_384
#: Cells a vector is sent to, at most; blocks of a cell that one task compares.
COPIES, BLOCK_ROWS = 4, 8192
#: A cell's number is that of its codeword times WIDE, plus that of its own centre.
WIDE = 1 << 20


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        ids, starts = np.unique(own[order], return_index=True)
        centres[ids] = np.add.reduceat(x[order], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), ids)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


class AdditiveQuantiser:
    """Codebooks c_1..c_M over the whole dimension; a vector is approximated by the sum of one word of each."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.starts = np.cumsum([0, *[len(b) for b in books]])
        self.all = np.concatenate(books)
        self.gram = self.all @ self.all.T
        self.half = (self.all**2).sum(1) / 2

    @classmethod
    def fit(cls, x: np.ndarray, sizes: list[int], seed: int = 7) -> AdditiveQuantiser:
        rng, books, rest = np.random.default_rng(seed), [], x
        for size in sizes:
            books.append(kmeans(rest, size, rng).astype(np.float32))
            rest = rest - books[-1][nearest(rest, books[-1])]
        return cls(books)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, M), global word numbers, by beam search, and the squared norms of the sums."""
        n, rows = len(x), np.arange(len(x))[:, None]
        dots = x @ self.all.T
        # error of a partial sum s, without the norm of x: |s|^2 / 2 - x.s; a word w adds half(w) + s.w - x.w
        cost, codes = np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1, 0), dtype=np.int32)
        for m in range(len(self.books)):
            own = slice(self.starts[m], self.starts[m + 1])
            step = (self.half[own] - dots[:, own])[:, None, :] + cost[:, :, None]
            for j in range(m):
                step = step + self.gram[codes[:, :, j], own]
            flat = step.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost, words = flat[rows, best], own.stop - own.start
            codes = np.concatenate([codes[rows, best // words], (best % words + own.start).astype(np.int32)[:, :, None]], axis=2)
        top = cost.argmin(1)
        codes, cost = codes[np.arange(n), top], cost[np.arange(n), top]
        return codes, 2 * (cost + dots[np.arange(n)[:, None], codes].sum(1))


def cells(first: np.ndarray, x: np.ndarray, local: dict[int, np.ndarray], more: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The home cell of each row of x, and [(row numbers, cells)] of the other cells where to look for its neighbours."""
    half = (first**2).sum(1) / 2 - x @ first.T
    near = min(more + 1, len(first))
    best = np.argpartition(half, near - 1, axis=1)[:, :near]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(half, best, 1), axis=1, kind="stable"), 1)
    rows, found, cost, home = np.arange(len(x)), [], [], np.zeros(len(x), dtype=np.int64)
    for j, c in enumerate(best.T):
        cut = np.isin(c, list(local)) if local else np.zeros(len(x), dtype=bool)
        found.append(np.where(cut, -1, c.astype(np.int64) * WIDE))
        cost.append(np.where(cut, np.inf, half[rows, c]))
        own = [(np.full(len(x), -1), np.full(len(x), np.inf)) for _ in range(COPIES if cut.any() else 0)]
        for w in np.unique(c[cut]):
            at, centres = np.nonzero(cut & (c == w))[0], local[int(w)]
            d = (centres**2).sum(1) / 2 - x[at] @ centres.T
            for (cell, price), s in zip(own, np.argsort(d, axis=1, kind="stable")[:, :COPIES].T, strict=False):
                cell[at], price[at] = int(w) * WIDE + s + 1, d[np.arange(len(at)), s]
        found += [cell for cell, _ in own]
        cost += [price for _, price in own]
        if j == 0:
            home = found[0] if not own else np.where(cut, own[0][0], found[0])
    every, price = np.stack(found, 1), np.stack(cost, 1)
    price = np.where((every == home[:, None]) | (every < 0), np.inf, price)
    order = np.argsort(price, axis=1, kind="stable")[:, : max(more, COPIES - 1) if local else more]
    out = []
    for turn, at in enumerate(order.T):
        take = np.isfinite(price[rows, at])
        if turn >= more:  # beyond the plain number of probes only cut codewords give cells
            take &= every[rows, at] % WIDE > 0
        if take.any():
            out.append((rows[take], every[rows, at][take]))
    return home, out


def unit_rows(vectors: pa.ChunkedArray | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable vectors of a list column and these, at length 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    right = np.nonzero(lengths == size)[0]
    flat = np.asarray(vectors.take(pa.array(right)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, size)
    norms = np.sqrt((flat**2).sum(1))
    usable = np.isfinite(norms) & (norms > 0)
    return right[usable], (flat[usable] / norms[usable, None]).astype(np.float32)


def _units(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], ["name", "x"])

    return run


def _stack(column: pa.Array | pd.Series) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(map(bytes, data)), dtype=np.float32).reshape(len(data), -1)


def _first_words(first: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(_stack(b.column(1)), first).astype(np.int32))], ["vid", "x", "c1"])

    return run


def _centres(sizes: dict[int, int]):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = _stack(f["x"])
        found = kmeans(x, max(1, min(-(-sizes[key[0]] // CELL_ROWS), len(x) // 8)), np.random.default_rng(7)).astype(np.float32)
        return pd.DataFrame({"c1": key[0], "x": [r.tobytes() for r in found]})

    return run


def local_centres(classes: DataFrame, first: np.ndarray) -> dict[int, np.ndarray]:
    """Centres of each crowded codeword. Bounded: a row for each codeword, and a centre for each CELL_ROWS vectors, 256 bytes at 64
    numbers, so 50 MB for 100 million vectors; each codeword's are fitted by one task on LOCAL vectors at most."""
    words = classes.select("vid", "x").mapInArrow(_first_words(first), "vid long, x binary, c1 int")
    sizes = {r[0]: r[1] for r in words.groupBy("c1").count().where(F.col("count") > CROWDED).collect()}
    if not sizes:
        return {}
    share = classes.sparkSession.createDataFrame([(w, min(1.0, LOCAL / n)) for w, n in sizes.items()], "c1 int, share double")
    sample = words.join(F.broadcast(share), "c1").where(F.pmod(F.xxhash64(F.lit(5), "vid"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    out: dict[int, list[bytes]] = {}
    for r in sample.select("c1", "x").groupBy("c1").applyInPandas(_centres(sizes), "c1 int, x binary").collect():
        out.setdefault(r[0], []).append(bytes(r[1]))
    return {w: _stack(pd.Series(rows)) for w, rows in out.items()}


def _placed(known: Broadcast, more: int):
    """Each vector once with its codes, in its home cell, and once for each other cell that it is to be held against."""
    names = ["vid", "x", "cell", "code", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, local = known.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = _stack(part.column(1))
                codes, norms = model.encode(x)
                home, others = cells(model.books[0], x, local, more)
                code = pa.array([r.tobytes() for r in codes.astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home), code, pa.array(norms.astype(np.float32))], names)
                for at, cell in others:
                    rows = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.float32())], names)

    return run


def cell_neighbours(model: AdditiveQuantiser, queries: np.ndarray, qid: np.ndarray, data: np.ndarray, did: np.ndarray, codes: np.ndarray, norms: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, data ids, cosines): for each query its k best of one cell, not itself."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, k = len(data), min(k, len(data))
    length = np.sqrt(np.maximum(norms, 1e-12))
    step = max(1, 1_000_000 // max(n, 1))
    for i in range(0, len(queries) if n else 0, step):
        q = queries[i : i + step]
        if n <= rerank:
            exact = q @ data.T
            at = np.broadcast_to(np.arange(n), exact.shape)
        else:
            tables = q @ model.all.T  # inner products with every codeword
            score = tables[:, codes[:, 0]]
            for m in range(1, codes.shape[1]):
                score += tables[:, codes[:, m]]
            at = np.argpartition(-score / length, rerank - 1, axis=1)[:, :rerank]
            exact = np.einsum("qd,qrd->qr", q, data[at])
        exact = np.where(did[at] == qid[i : i + step, None], -2.0, exact)
        best = np.argpartition(-exact, k - 1, axis=1)[:, :k] if k < exact.shape[1] else np.broadcast_to(np.arange(exact.shape[1]), exact.shape)
        rows = np.arange(len(q))[:, None]
        value, found = exact[rows, best], did[at[rows, best]]
        real = value > -1.5
        out.append((np.broadcast_to(qid[i : i + step, None], value.shape)[real], found[real], value[real]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compared(model: Broadcast, k: int, rerank: int):
    """Neighbours within a cell: rows with codes are data; rows without, and those with codes unless asks is false, are queries."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        known = f["code"].notna().to_numpy()
        data, queries = f[known & f["answers"].to_numpy()], f[f["asks"].to_numpy()]
        if not len(queries) or not len(data):
            return pd.DataFrame({"vid": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float32")})
        codes = np.frombuffer(b"".join(map(bytes, data["code"])), dtype="<u2").reshape(len(data), -1).astype(np.int64)
        a, b, c = cell_neighbours(model.value[0], _stack(queries["x"]), queries["vid"].to_numpy(), _stack(data["x"]), data["vid"].to_numpy(), codes, data["norm"].to_numpy(), k, rerank)
        return pd.DataFrame({"vid": a, "other": b, "cosine": c.astype(np.float32)})

    return run


def book_sizes(n: int) -> list[int]:
    """The first codebook grows with the root of the rows, up to what the sample can fit."""
    first = 1
    while first * first < n and 64 * first < n and first < SAMPLE // 16:
        first *= 2
    return [first, *[WORDS] * (BOOKS - 1)]


def class_neighbours(classes: DataFrame, n: int, k: int, more: int, rerank: int) -> DataFrame:
    """(vid, other, cosine) of the k best others of each distinct vector (vid, x)."""
    share = min(1.0, SAMPLE / n)
    sample = classes if share >= 1 else classes.where(F.xxhash64(F.lit(3), "vid") <= int((2 * share - 1) * (2**63 - 1)))
    model = AdditiveQuantiser.fit(_stack(sample.select("x").toPandas()["x"]), book_sizes(n))
    local = local_centres(classes, model.books[0])
    known = classes.sparkSession.sparkContext.broadcast((model, local))
    placed = classes.select("vid", "x").mapInArrow(_placed(known, more), "vid long, x binary, cell long, code binary, norm float")
    keys = ["cell"]
    if local:
        placed = written(placed)
        # A cell of several blocks: every block of queries meets every block of data, in tasks of their own.
        parts = placed.groupBy("cell").agg(F.ceil(F.count("code") / BLOCK_ROWS).cast("int").alias("parts")).where("parts > 1")
        cut = placed.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        block = F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        asked = cut.withColumn("qb", block).withColumn("db", every).withColumn("asks", F.lit(True)).withColumn("answers", F.lit(False))
        data = cut.where("code is not null").withColumn("db", block).withColumn("qb", every).withColumn("asks", F.lit(False)).withColumn("answers", F.lit(True))
        placed, keys = asked.unionByName(data).drop("parts"), ["cell", "qb", "db"]
    else:
        placed = placed.withColumn("asks", F.lit(True)).withColumn("answers", F.lit(True))
    found = placed.groupBy(*keys).applyInPandas(_compared(known, k, rerank), "vid long, other long, cosine float")
    best = found.groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k).alias("best"))
    return best.select("vid", F.explode("best").alias("b")).select("vid", F.col("b.other").alias("other"), (-F.col("b.d")).alias("cosine"))


def nearest_neighbours(
    df: DataFrame, name: str = "content_hash", vector: str = "vector", size: int = 64, k: int = 5, probes: int = 1, rerank: int = 256,
) -> DataFrame:
    """(name, other, cosine): for each name with a usable vector, k others of the highest cosine, as far as found.

    Usable: ``size`` numbers, none null, NaN or infinite, length above zero. Vectors are told apart by a 64-bit hash of their
    float32 numbers at length 1. A name with several vectors takes the one with the smallest hash. Names with equal vectors
    are each other's nearest; among equals the smaller name comes first. Fewer than k others in all give as many as there are.
    Null names are left out. Empty input gives an empty result. Other columns play no part. Approximate: recall is measured
    in the tests and the README.
    """
    spark = df.sparkSession
    rows = df.where(F.col(name).isNotNull() & F.col(vector).isNotNull()).select(F.col(name).alias("name"), F.col(vector).alias("vector"))
    units = rows.mapInArrow(_units(size), "name string, x binary").withColumn("vid", F.xxhash64("x"))
    named = written(units.groupBy("name").agg(F.min("vid").alias("vid")))
    classes = units.select("vid", "x").dropDuplicates(["vid"])
    classes = written(classes)
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "name string, other string, cosine double")
    salted = named.groupBy("vid", F.pmod(F.xxhash64("name"), F.lit(16)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("name")), 1, k + 1).alias("names"))
    members = written(salted.groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("names"))), 1, k + 1).alias("names")))
    flat = class_neighbours(classes, n, k, probes, rerank)
    others = flat.join(members.select(F.col("vid").alias("other"), "names"), "other").select("vid", "cosine", F.explode("names").alias("name"))
    shared = members.where(F.size("names") > 1).select("vid", F.lit(1.5).cast("float").alias("cosine"), F.explode("names").alias("name"))
    lists = others.unionByName(shared).groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "name"))), 1, 2 * k + 1).alias("list"))
    each = named.join(lists, "vid").select("name", F.slice(F.filter("list", lambda y: y["name"] != F.col("name")), 1, k).alias("list"))
    return each.select("name", F.explode("list").alias("y")).select("name", F.col("y.name").alias("other"), F.least(-F.col("y.d").cast("double"), F.lit(1.0)).alias("cosine"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(hash_a, hash_b): pairs of which one at least has the other among its neighbours, the smaller first."""
    return found.select(F.least("name", "other").alias("hash_a"), F.greatest("name", "other").alias("hash_b")).distinct()
