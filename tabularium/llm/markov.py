"""Grouping vectors by Markov clustering of a similarity graph.

1. Unit vectors are sorted by a signature of random hyperplanes, which brings similar ones together, and read in blocks.
2. Only dense regions are condensed: a vector with more than ``dense`` others of cosine ``edge`` in its block takes the
   nearest of them, so many that about ``dense`` nodes of its region stay. Sparse regions keep every vector as a node.
   This is repeated with other hyperplanes while it still helps, so that a group of any size leaves a bounded number
   of nodes, and never a single one.
3. Edges are the pairs of nodes whose cosine reaches ``edge``, searched in the blocks of several sorted orders. Their
   number follows from the number of blocks: enough for the wanted recall of a single pair (``passes_for``).
4. Markov clustering: the column-stochastic matrix is squared, inflated and pruned, as sparse joins, until the flow
   stands still. Rows that keep flow are attractors; the columns that flow to one are its cluster.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.session import small, stage, unstage

BLOCK, STRIP, BITS = 4096, 1024, 24
LOG = logging.getLogger(__name__)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of a list column: those of length dim, finite and not all zero, in order."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = (lengths == dim) & ~np.asarray(column.is_null())
    rows = np.flatnonzero(valid)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1][rows]
    vectors = flat[starts[:, None] + np.arange(dim)]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], (vectors[good] / norms[good, None]).astype(np.float32)


def _packed(vectors: np.ndarray) -> pa.Array:
    """Vectors as half-precision bytes: a cosine keeps three digits, and a shuffle carries half."""
    return pa.array([v.tobytes() for v in vectors.astype(np.float16)], pa.binary())


def _signs(vectors: np.ndarray, seed: int) -> np.ndarray:
    """The signature of each vector: on which side of BITS random hyperplanes it lies."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], BITS)).astype(np.float32)
    return ((vectors @ planes > 0) * (1 << np.arange(BITS, dtype=np.int64))).sum(axis=1)


_SIGNED = "passo int, sinal bigint, id bigint, vetor binary, peso bigint"
_SIGNED_ARROW = pa.schema([("passo", pa.int32()), ("sinal", pa.int64()), ("id", pa.int64()), ("vetor", pa.binary()), ("peso", pa.int64())])


def _signed(ids: np.ndarray, vectors: np.ndarray, packed: pa.Array, weights: np.ndarray, seeds: list[int]) -> Iterator[pa.RecordBatch]:
    for n, seed in enumerate(seeds):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n, np.int32)), pa.array(_signs(vectors, seed)), pa.array(ids.astype(np.int64)), packed, pa.array(weights.astype(np.int64))], schema=_SIGNED_ARROW)


def signed_rows(df: DataFrame, dim: int, seed: int) -> DataFrame:
    """df (id, vetor: array<float>) as signed unit vectors of weight 1; rows without a usable vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _matrix(batch.column(1), dim)
            if len(rows):
                ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
                yield from _signed(ids, unit, _packed(unit), np.ones(len(rows), np.int64), [seed])

    return df.select("id", "vetor").mapInArrow(run, _SIGNED)


def signed_nodes(nodes: DataFrame, seeds: list[int]) -> DataFrame:
    """Every node (id, vetor: bytes, peso) once per seed, with its signature by that seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch.column(1).to_pylist())
                yield from _signed(batch.column(0).to_numpy(), vectors, batch.column(1).cast(pa.binary()), batch.column(2).to_numpy(), seeds)

    return nodes.select("id", "vetor", "peso").mapInArrow(run, _SIGNED)


def _vectors(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float16).reshape(len(packed), -1).astype(np.float32)


def _in_order(signed: DataFrame, rows: int) -> DataFrame:
    """signed in the order of its signatures; equal ones are spread by id, so that copies don't fill one partition."""
    parts = min(rows // BLOCK + 1, 20_000)
    order = ("passo", "sinal", "id", "vetor")
    return signed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("bigint").alias("p"), "passo", "id", "vetor", "peso")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(partition, ids, vectors, weights) in blocks of at most BLOCK neighbouring rows of one order."""
    held: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
    size, part, step = 0, 0, None

    def out():
        nonlocal held, size
        ids, packed, weights = (np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]], np.concatenate([h[2] for h in held]))
        held, size = [], 0
        return part, ids, _vectors(packed), weights.astype(np.float64)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        steps, ids, packed, weights = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(steps)]
        for a, b in zip(cuts, cuts[1:]):
            if size and steps[a] != step:
                yield out()
            step = steps[a]
            while a < b:
                take = min(b, a + BLOCK - size)
                held.append((ids[a:take], packed[a:take], weights[a:take]))
                size += take - a
                a = take
                if size == BLOCK:
                    yield out()
    if size:
        yield out()


def condense_block(vectors: np.ndarray, edge: float, dense: int) -> np.ndarray:
    """The leader of each vector of a block; a vector that has at most ``dense`` similar ones leads itself.

    A leader takes its nearest free neighbours in dense regions only, one in ``dense`` of its region at most.
    """
    owner = np.arange(len(vectors))
    sims = vectors @ vectors.T
    degree = (sims >= edge).sum(axis=1) - 1
    free = degree > dense
    for i in np.flatnonzero(free):
        if free[i]:
            near = np.flatnonzero(free & (sims[i] >= edge))
            most = -(-int(degree[i]) // dense)
            if len(near) > most:
                near = near[np.argsort(-sims[i, near], kind="stable")[:most]]
            owner[near] = owner[i] = i
            free[near] = free[i] = False
    return owner


_NODES = "id bigint, vetor binary, peso bigint, filhos array<bigint>, cossenos array<float>"
_NODES_ARROW = pa.schema([("id", pa.int64()), ("vetor", pa.binary()), ("peso", pa.int64()), ("filhos", pa.list_(pa.int64())), ("cossenos", pa.list_(pa.float32()))])


def condense(ordered: DataFrame, edge: float, dense: int, level: int) -> DataFrame:
    """(id, vetor, peso, filhos, cossenos): the nodes of each block, with the mean direction of what they stand for.

    filhos are ids of the level before (of rows at level 0), at most BLOCK per node and level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for part, ids, vectors, weights in blocks(batches):
            leaders, owner = np.unique(condense_block(vectors, edge, dense), return_inverse=True)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(leaders)))
            means = np.add.reduceat(vectors[order] * weights[order, None], starts)
            means /= np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-12)
            cosines = (vectors[order] * means[owner[order]]).sum(axis=1).astype(np.float32)
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            keys = (level << 58) + (part << 34) + made + np.arange(len(leaders), dtype=np.int64)
            made += len(leaders)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[order].astype(np.int64), cosines)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), _packed(means), pa.array(np.add.reduceat(weights[order], starts).astype(np.int64)), *lists], schema=_NODES_ARROW)

    return ordered.mapInArrow(run, _NODES)


def passes_for(nodes: int, recall: float = 0.95, cosine: float = 0.75) -> int:
    """How many sorted orders find a single pair of that cosine with that probability.

    A block holds the nodes that agree in about log2(nodes / BLOCK) hyperplanes; vectors at an angle t agree in one with
    probability 1 - t / pi. So the number grows with about the cube root of the nodes.
    """
    bits = max(0.0, math.log2(max(nodes, 1) / BLOCK))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(together, 0.999))))


def edges_of(nodes: DataFrame, rows: int, edge: float, seeds: list[int]) -> DataFrame:
    """(a, b, peso) with a < b: the pairs of nodes that share a block in one of the orders by ``seeds`` and whose cosine reaches edge."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("peso", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, vectors, _ in blocks(batches):
            for a in range(0, len(ids), STRIP):
                sims = vectors[a : a + STRIP] @ vectors.T
                x, y = np.nonzero(np.triu(sims >= edge, k=a + 1))
                cos = np.minimum(sims[x, y], 1.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x + a], ids[y])), pa.array(np.maximum(ids[x + a], ids[y])), pa.array(cos)], schema=arrow)

    found = _in_order(signed_nodes(nodes, seeds), rows * len(seeds)).mapInArrow(run, "a bigint, b bigint, peso double")
    return found.groupBy("a", "b").agg(F.max("peso").alias("peso"))


def markov(edges: DataFrame, inflation: float = 2.0, prune: float = 1e-3, max_rounds: int = 60, still: float = 1e-3) -> DataFrame:
    """(no, grupo, fluxo) for undirected edges (a, b, peso): each node's attractor and the flow that reaches it.

    Self-loops of weight 1 are added. Entries below ``prune`` are dropped after inflation, but a column keeps its
    largest entry. An empty graph gives no rows. Ties go to the lowest attractor. A flow that doesn't stand still
    after max_rounds is a RuntimeError.
    """

    def stochastic(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("j")))

    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("peso").alias("v")).unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("peso").alias("v")))
    loops = both.select(F.col("i"), F.col("i").alias("j")).distinct().withColumn("v", F.lit(1.0))
    m = stage(stochastic(both.unionByName(loops)), "p1-fluxo")
    for n in range(max_rounds + 1):
        if n == max_rounds:
            raise RuntimeError(f"the flow still moves after {max_rounds} rounds")
        left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        squared = left.join(right, "k").groupBy("i", "j").agg(F.pow(F.sum(F.col("x") * F.col("y")), F.lit(inflation)).alias("v"))
        col = Window.partitionBy("j")
        kept = stochastic(squared).withColumn("m", F.max("v").over(col)).filter((F.col("v") >= prune) | (F.col("v") == F.col("m")))
        new = stage(stochastic(kept.drop("m")), "p1-fluxo")
        unstage(m)
        m = new
        # the flow stands still where every column has one value only: its maximum equals its sum of squares
        chaos = m.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("c")).agg(F.max("c")).first()[0]
        if chaos is None or chaos < still:
            break
    first = stage(m.filter(F.col("v") >= prune).groupBy(F.col("j").alias("no")).agg(F.min("i").alias("atrator"), F.max("v").alias("fluxo")), "p1-atratores")
    unstage(m)
    # attractors that share a column form one system: follow the lowest one once more
    return first.join(first.select(F.col("no").alias("atrator"), F.col("atrator").alias("grupo")), "atrator", "left").select("no", F.coalesce("grupo", "atrator").alias("grupo"), "fluxo")


def similarity_graph(df: DataFrame, id_col: str, vector_col: str, dim: int = 128, edge: float = 0.6, dense: int = 16, recall: float = 0.95, seed: int = 11) -> tuple[list[DataFrame], DataFrame]:
    """(the staged nodes of each level, the staged edges of the last level). Levels are added while one shrinks the nodes by 5 % or more."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vetor")).filter(F.col("id").isNotNull() & (F.size("vetor") == dim))
    size = rows.count()
    levels = [stage(condense(_in_order(signed_rows(rows, dim, seed), size), edge, dense, 0), "p1-nos")]
    before, size = size, levels[0].count()
    while size and (len(levels) == 1 or size < 0.95 * before):
        levels.append(stage(condense(_in_order(signed_nodes(levels[-1], [seed + len(levels)]), size), edge, dense, len(levels)), "p1-nos"))
        before, size = size, levels[-1].count()
    seeds = [seed + 1000 + n for n in range(passes_for(size, recall))]
    graph = stage(edges_of(levels[-1], size, edge, seeds), "p1-arestas")
    LOG.info("similarity graph: %d nodes at the last of %d levels, %d orders searched", size, len(levels), len(seeds))
    return levels, graph


def similarity_groups(df: DataFrame, id_col: str, vector_col: str, dim: int = 128, edge: float = 0.6, dense: int = 16, inflation: float = 2.0, recall: float = 0.95, seed: int = 11) -> DataFrame:
    """(grupo, id, forca) for every valid row of df: its cluster, and the flow to the attractor times the cosines to its nodes.

    Null, all-zero, non-finite and wrong-length vectors and null ids are left out; the length of a vector doesn't
    matter; repeated rows are repeated. A group may have one member.
    """
    levels, graph = similarity_graph(df, id_col, vector_col, dim, edge, dense, recall, seed)
    last = levels[-1].select("id").join(markov(graph, inflation).withColumnRenamed("no", "id"), "id", "left")
    found = last.select("id", F.coalesce("grupo", "id").alias("grupo"), F.coalesce("fluxo", F.lit(1.0)).alias("forca"))
    for nodes in reversed(levels):
        children = nodes.select("id", F.explode(F.arrays_zip("filhos", "cossenos")).alias("f"))
        found = found.join(children, "id").select(F.col("f.filhos").alias("id"), "grupo", (F.col("forca") * F.col("f.cossenos")).alias("forca"))
    return found


def group_sizes(groups: DataFrame, least: int = 5) -> DataFrame:
    """(grupo, tamanho, menor) of the groups with at least ``least`` distinct ids."""
    each = groups.select("grupo", "id").distinct()
    return each.groupBy("grupo").agg(F.count("*").alias("tamanho"), F.min("id").alias("menor")).filter(F.col("tamanho") >= least)


def group_pairs(groups: DataFrame, least: int = 5) -> DataFrame:
    """(id_a, id_b): of each group of the staged groups the lowest id with each of the others."""
    sizes = small(stage(group_sizes(groups, least), "p1-tamanhos"))
    return groups.join(sizes, "grupo").select(F.col("menor").alias("id_a"), F.col("id").alias("id_b")).filter("id_a <> id_b").distinct()


def typical_members(groups: DataFrame, least: int = 5, top: int = 5, parts: int = 64) -> DataFrame:
    """(menor, tamanho, tipicos): each group by its lowest id, its size and the ids whose flow to its attractor is strongest.

    The ranking is cut in ``parts`` shares of each group first, so that a big group is never sorted in one task.
    """
    once = groups.groupBy("grupo", "id").agg(F.round(F.max("forca"), 6).alias("forca"))
    share = Window.partitionBy("grupo", "parte").orderBy(F.col("forca").desc(), "id")
    few = once.withColumn("parte", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("n", F.row_number().over(share)).filter(F.col("n") <= top)
    w = Window.partitionBy("grupo").orderBy(F.col("forca").desc(), "id")
    ranked = few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).groupBy("grupo").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("tipicos"))
    return group_sizes(groups, least).join(ranked, "grupo").select("menor", "tamanho", "tipicos")
