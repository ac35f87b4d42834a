"""Hashed text embeddings, spherical k-means and its report."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tabularium.functions.text import tokens
from tabularium.functions.vectors import unit
from tabularium.session import stage, unstage

#: The multiplier of the 32-bit hash, its seeds for terms, and the seed for letter trigrams.
MULTIPLIER, TERM_SEEDS, GRAM_SEED = 0x5BD1E995, (0x9747B28C, 0x1B873593, 0x5BD1E995), 0x27D4EB2D
#: The weights of a term's three places, of its trigrams within the third, and of long terms.
TERM_WEIGHTS, GRAM_WEIGHT, LONG_WEIGHT = (1.0, 0.85, 0.35), 0.35, 1.25
_MASK = 0xFFFFFFFF


@lru_cache(maxsize=200_000)
def hash32(text: str, seed: int) -> int:
    """Public 32-bit mixing hash (MurmurHash2 family) of lower-case UTF-8, as an absolute value."""
    data = text.lower().encode()
    h = (seed ^ len(data)) & _MASK
    full = len(data) // 4 * 4
    for i in range(0, full, 4):
        k = int.from_bytes(data[i : i + 4], "little") * MULTIPLIER & _MASK
        k = (k ^ k >> 24) * MULTIPLIER & _MASK
        h = (h * MULTIPLIER & _MASK) ^ k
    if rest := data[full:]:
        h = (h ^ int.from_bytes(rest, "little")) * MULTIPLIER & _MASK
    h = (h ^ h >> 13) * MULTIPLIER & _MASK
    h ^= h >> 15
    return min(abs(h - (1 << 32) if h >> 31 else h), 0x7FFFFFFF)


def embed(words: list[str], dim: int = 128) -> list[float]:
    """The unit vector of a document's tokens: hashed terms, bigrams and letter trigrams; zeros without tokens."""
    counts: dict[str, int] = {}
    for w in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))]:
        counts[w] = counts.get(w, 0) + 1
    v = np.zeros(dim)
    for term, n in counts.items():
        weight = (1.0 + math.log(n)) * (LONG_WEIGHT if len(term) >= 5 else 1.0)
        for seed, scale in zip(TERM_SEEDS, TERM_WEIGHTS):
            h = hash32(term, seed)
            v[h % dim] += weight * scale * (-1 if h & 1 else 1)
        if len(term) >= 4 and "_" not in term:
            for i in range(len(term) - 2):
                h = hash32(term[i : i + 3], GRAM_SEED)
                v[h % dim] += weight * TERM_WEIGHTS[2] * GRAM_WEIGHT * (-1 if h & 1 else 1)
    size = float(np.sqrt(v @ v))
    return (v / size if size > 1e-12 else v).tolist()


def local_embeddings(docs: DataFrame, dim: int = 128) -> DataFrame:
    """(id, vetor) of docs (id, texto): tokens without stop words, or all tokens where none is left."""

    @F.pandas_udf("array<float>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: embed(list(w), dim))

    own = tokens(F.col("texto"))
    return docs.select("id", run(F.when(F.size(own) > 0, own).otherwise(tokens(F.col("texto"), stopwords=True))).alias("vetor"))


#: Embedding providers by name: docs -> (id, vetor). Others are added by ``register_provider``.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"local": local_embeddings}


def register_provider(name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
    """Make another embedding provider (a remote one, say) available by name."""
    PROVIDERS[name] = provider


class Lcg:
    """The public 48-bit linear congruential generator, for repeatable draws."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def integer(self, bound: int) -> int:
        """A uniform integer below bound."""
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            x = self.bits(31)
            r = x % bound
            if x - r + bound - 1 < 1 << 31:
                return r

    def real(self) -> float:
        """A uniform number below 1."""
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)


#: Bytes of a block of vectors (a longer vector is a block of its own), and the blocks that are multiplied, or sent to the driver, at once.
BLOCK_BYTES, SECTION = 8192, 256
#: Bytes of vectors for one task of a pass, unless cores would stay idle: a task costs more to start than to multiply a few MB.
TASK_BYTES = 1 << 27


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    """The elements of a column of vectors, all of one length; a null element counts as 0."""
    if (column.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"vectors of another length than {dim}")
    return pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.astype(float).reshape(-1, dim)
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    return v


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    """The elements of a column of blocks, in place."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, offsets[0])


def _sections(batches: Iterator[pa.RecordBatch], dim: int, kind: str | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(some rows of batches, the unit vectors of their last column): vectors, or blocks with elements of that kind."""
    step = SECTION if kind else 4096
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            column = part.column(part.num_columns - 1)
            yield part, _unit(_joined(column, kind) if kind else _flat(column, dim), dim)


def packed(ordered: DataFrame, dim: int, kind: str) -> DataFrame:
    """(parte, bloco, n, linhas): ordered (vetor) with the n vectors of a block as bytes, numbered by task and within it.

    A pass over blocks moves few fields; arrays would be converted element by element, again in each pass.
    """
    rows = max(1, BLOCK_BYTES // (dim * np.dtype(kind).itemsize))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = _flat(batch.column(0), dim).astype(kind).reshape(-1, dim)
            blocks = [v[i : i + rows] for i in range(0, len(v), rows)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(map(len, blocks), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["parte", "bloco", "n", "linhas"])
            done += n

    return ordered.select("vetor").mapInArrow(pack, "parte int, bloco bigint, n int, linhas binary")


def recentre(vectors: DataFrame, centroids: np.ndarray, kind: str | None = None, few: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the unit vectors nearest to each centroid, their numbers) of vectors (vetor: an array of numbers) of one length without nulls, or of blocks (linhas) with elements of that kind.

    few: the partial sums of all tasks are gathered as they are, without an exchange.
    """
    k, dim = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for _, v in _sections(batches, dim, kind):
            own = (v @ centroids.T).argmax(axis=1)
            hot = np.zeros((len(v), k))
            hot[np.arange(len(v)), own] = 1
            sums += hot.T @ v
            counts += np.bincount(own, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "n", "soma"])

    parts = vectors.select("linhas" if kind else "vetor").mapInArrow(partial, "k int, n bigint, soma array<double>")
    new, sizes = np.zeros((k, dim)), np.zeros(k)
    if few:
        for r in parts.collect():  # k rows of dim numbers for each task
            new[r["k"]] += r["soma"]
            sizes[r["k"]] += r["n"]
        return new, sizes
    # one row per cluster: element sums over the tasks
    summed = parts.select("k", "n", F.posexplode("soma").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    for r in summed.collect():  # k x dim numbers
        new[r["k"], r["i"]], sizes[r["k"]] = r["v"], r["n"]
    return new, sizes


def _far(v: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The squared distance of each unit vector to the nearest of the chosen ones."""
    return np.maximum(0.0, 1.0 - v @ chosen.T).min(axis=1) ** 2


def weigh(blocks: DataFrame, dim: int, kind: str, chosen: np.ndarray) -> list[tuple[int, int, float]]:
    """(parte, section, weight) in order: the squared distances to the nearest of chosen, summed for each SECTION blocks (2 MB, or so many long vectors)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _sections(batches, dim, kind):
            key = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy() // SECTION])
            first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            before = np.r_[0, np.cumsum(part.column(2).to_numpy())[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(key[0, first], pa.int32()), pa.array(key[1, first], pa.int64()), pa.array(np.add.reduceat(_far(v, chosen), before[first]))], names=["parte", "secao", "soma"])

    total: dict[tuple[int, int], float] = {}
    for r in blocks.select("parte", "bloco", "n", "linhas").mapInArrow(sums, "parte int, secao bigint, soma double").collect():  # a row for each section
        total[r["parte"], r["secao"]] = total.get((r["parte"], r["secao"]), 0.0) + r["soma"]
    return [(*key, total[key]) for key in sorted(total)]


def pick(blocks: DataFrame, dim: int, kind: str, weights: list[tuple[int, int, float]], goal: float, chosen: np.ndarray | None) -> np.ndarray:
    """The unit vector at which the cumulative weight reaches goal: 1 each, or with chosen the squared distance to the nearest of them.

    weights are those of the sections in order; the blocks of one section are gathered.
    """
    for part, section, own in weights:
        if goal <= own or (part, section, own) == weights[-1]:
            break
        goal -= own
    rows = blocks.filter((F.col("parte") == part) & F.col("bloco").between(section * SECTION, section * SECTION + SECTION - 1)).select("bloco", "linhas").collect()
    v = _unit(np.frombuffer(b"".join(r["linhas"] for r in sorted(rows, key=lambda r: r["bloco"])), kind), dim)
    w = np.cumsum(np.ones(len(v)) if chosen is None else _far(v, chosen))
    return v[min(int(np.searchsorted(w, goal)), len(v) - 1)]


def kmeans(vectors: DataFrame, k: int = 10, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Centroids (k x dim) of spherical k-means over vectors (id, vetor).

    The vectors are stored once in blocks, in the order of their ids. The start centroids are drawn over all rows in that
    order, one pass each: the next in proportion to the squared distance to the nearest one. Every round then runs over
    all rows, as one partial sum per task. An empty cluster is set to a row drawn evenly. k is cut to the number of rows;
    k < 1 is an error, an empty table gives no centroids. Mixed lengths and vectors without elements are errors. The
    driver gathers a number for every 2 MB of vectors, and one such part at a time.
    """
    if k < 1:
        raise ValueError("k must be positive")
    kind = "float32" if dict(vectors.dtypes)["vetor"] == "array<float>" else "float64"
    vectors = vectors.filter(F.col("vetor").isNotNull()).select("id", F.col("vetor").cast("array<float>" if kind == "float32" else "array<double>").alias("vetor"))
    shape = vectors.agg(F.count("*").alias("n"), F.min(F.size("vetor")).alias("a"), F.max(F.size("vetor")).alias("b")).first()
    if not shape["n"]:
        return np.zeros((0, 0))
    if shape["a"] != shape["b"] or not shape["a"]:
        raise ValueError("vectors of different lengths or without elements")
    dim, k = shape["a"], min(k, shape["n"])
    stored = stage(packed(vectors.repartitionByRange("id", "vetor").sortWithinPartitions("id", "vetor"), dim, kind), "vetores")
    blocks = stored.coalesce(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-shape["n"] * dim * np.dtype(kind).itemsize // TASK_BYTES)))
    section = F.floor(F.col("bloco") / SECTION).alias("secao")
    counts = [tuple(r) for r in blocks.groupBy("parte", section).agg(F.sum("n").alias("n")).orderBy("parte", "secao").collect()]  # a row for each section
    dice = Lcg(seed)
    centroids = pick(blocks, dim, kind, counts, dice.integer(shape["n"]) + 1, None)[None]
    while len(centroids) < k:
        weights = weigh(blocks, dim, kind, centroids)
        total = sum(w for _, _, w in weights)
        new = pick(blocks, dim, kind, weights, dice.real() * total, centroids) if total > 0 else pick(blocks, dim, kind, counts, dice.integer(shape["n"]) + 1, None)
        centroids = np.vstack([centroids, new])
    dice, few = Lcg(seed + 1), blocks.rdd.getNumPartitions() <= 32

    for _ in range(rounds):
        new, sizes = recentre(blocks, centroids, kind, few)
        for j in np.flatnonzero(sizes == 0):
            new[j] = pick(blocks, dim, kind, counts, dice.integer(shape["n"]) + 1, None)
        new = new / np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        moved = float((1 - (new * centroids).sum(axis=1)).max())
        centroids = new
        if moved < 1e-5:
            break
    unstage(stored)
    return centroids


def nearest(vectors: DataFrame, centroids: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, cluster, sim): the centroid (cluster, centro) of highest cosine; the lowest number among equals.

    At most ``most`` centroids are gathered and multiplied with the vectors in Arrow batches; more are an error.
    """
    rows = centroids.orderBy("cluster").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    if not rows:
        return vectors.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("sim"))
    numbers = F.array(*[F.lit(r["cluster"]) for r in rows])
    own = assign(vectors, np.array([r["centro"] for r in rows], dtype=float))
    return own.select("id", F.get(numbers, F.col("cluster")).alias("cluster"), "sim")


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, sim) by matrix products in Arrow batches; a null element counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _sections(batches, centroids.shape[1], None):
            s = v @ centroids.T
            own = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32()), pa.array(np.clip(s[np.arange(len(s)), own], -1, 1))], names=["id", "cluster", "sim"])

    rows = vectors.filter(F.col("vetor").isNotNull()).select("id", "vetor")
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("cluster", IntegerType()), StructField("sim", DoubleType())]))


def cluster_report(assigned: DataFrame, top: int = 5) -> DataFrame:
    """(cluster, tamanho, percentual, coesao, inercia, medoide, representantes) per cluster of (id, cluster, sim), largest first.

    Distances are 1 - sim, at least 0; the medoid is the nearest member, ties by id.
    """
    n = assigned.count()
    far = F.greatest(F.lit(0.0), 1.0 - F.col("sim"))
    w = Window.partitionBy("cluster").orderBy(F.round("sim", 9).desc(), "id")
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("tamanho"), F.round(F.avg("sim"), 6).alias("coesao"), F.round(F.sum(far * far), 6).alias("inercia"), F.min_by("id", F.struct((-F.round("sim", 9)).alias("m"), "id")).alias("medoide"))
    # per task of a cluster the best rows only, so that the final ranking sees few rows of a hot cluster
    part = Window.partitionBy("cluster", "parte").orderBy(F.round("sim", 9).desc(), "id")
    few = assigned.withColumn("parte", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= top)
    best = few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"].cast("string")), ",").alias("representantes"))
    return sums.join(best, "cluster").select("cluster", "tamanho", F.round(F.col("tamanho") * 100.0 / max(n, 1), 4).alias("percentual"), "coesao", "inercia", "medoide", "representantes")


def cluster_keywords(assigned: DataFrame, docs: DataFrame, top: int = 6, min_len: int = 4) -> DataFrame:
    """(cluster, termo, df, posicao): the terms that most documents of a cluster hold; ties by term."""
    terms = docs.select("id", F.explode(F.array_distinct(tokens(F.col("texto")))).alias("termo")).filter(F.length("termo") >= min_len)
    counts = assigned.select("id", "cluster").join(terms, "id").groupBy("cluster", "termo").agg(F.count("*").alias("df"))
    w = Window.partitionBy("cluster").orderBy(F.col("df").desc(), "termo")
    return counts.withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= top)


def normalized(vectors: DataFrame) -> DataFrame:
    """vectors with vetor scaled to unit length."""
    return vectors.withColumn("vetor", unit(F.col("vetor")))
