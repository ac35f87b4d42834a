"""Subject areas by anchored non-negative matrix factorisation.

The document-term matrix X (presence times inverse document frequency) is factored as W H by alternating
multiplicative updates for the generalised Kullback-Leibler divergence. One component per subject is anchored: a
labelled document may load only on its own subjects and on a background component, so component k stays subject k,
and a row of W is directly the document's mixture of subjects. The background takes what all subjects share.

Terms are hashed to ``BUCKETS`` columns, so that every term of every document counts and H keeps a fixed size however
the vocabulary grows. A column seen in few labelled documents says little: H is smoothed by ``prior`` documents that
load on all components as the collection does. A document of terms never seen gets the collection's mixture.

Every update runs over all labelled documents: tasks solve W for their documents in Arrow batches and add up one
partial of H each; the partials are summed in two levels. Only H (subjects x columns, both bounded) is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.session import stage


BUCKETS = 1 << 18


@dataclass
class Model:
    """topics: subject ids by component; columns: the seen ones, sorted; idf and h have two more columns, for unseen terms and for padding.

    h is (subjects + 1) x (columns + 2), its rows sum to 1. common is the mixture of all labelled documents.
    """

    topics: list[int]
    columns: np.ndarray
    idf: np.ndarray
    h: np.ndarray
    threshold: float
    common: np.ndarray | None = None

    def places(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashed columns of all lists in ``columns``, ends of the lists before each and of the last)."""
        flat = lists.values.to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.columns, flat)
        size = len(self.columns)
        seen = at < size
        seen[seen] = self.columns[at[seen]] == flat[seen]
        return np.where(seen, at, size), lists.offsets.to_numpy()


def encoded(docs: DataFrame, topics: list[int], min_score: float = 0.25) -> DataFrame:
    """(id_norma, rotulos, colunas, ancoras) of docs (id_norma, termos, rotulos): terms as hashed columns, and the anchors of labelled documents.

    Anchors are 1 for a document's subjects, little for doubtful ones, 0 for others and 0.3 for the background.
    """
    labels = F.col("rotulos").cast("array<struct<id_topico:int,score:double>>")
    weight = lambda r: F.when(r["score"] < min_score, 0.02).otherwise(1.0)
    own = F.map_from_entries(F.transform(F.col("rotulos"), lambda r: F.struct(r["id_topico"], weight(r))))
    listed = F.array(*[F.lit(t) for t in topics]).cast("array<int>")
    anchors = F.concat(F.transform(listed, lambda t: F.coalesce(F.element_at(own, t), F.lit(0.0))), F.array(F.lit(0.3)))
    columns = F.array_distinct(F.transform("termos", lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))
    return docs.withColumn("rotulos", labels).select("id_norma", "rotulos", columns.alias("colunas"), F.when(F.col("rotulos").isNotNull(), anchors.cast("array<float>")).alias("ancoras"))


def _bags(flat: np.ndarray, starts: np.ndarray, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, padded places) of lists that begin at starts, in groups of similar length; -1 pads."""
    lengths = np.diff(starts)
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        # the group ends where its rows times its longest list would pass the cells
        widths = np.maximum(lengths[order[a:]], 1)
        size = max(1, int(np.searchsorted(widths * np.arange(1, len(widths) + 1), cells, side="right")))
        rows = order[a : a + size]
        at = np.arange(max(int(lengths[rows].max()), 1))
        inside = at < lengths[rows][:, None]
        columns = np.where(inside, flat[np.where(inside, starts[rows][:, None] + at, 0)] if len(flat) else -1, -1)
        yield rows, columns
        a += size


def _solve(columns: np.ndarray, ht: np.ndarray, idf: np.ndarray, mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W, gathered H, ratios X / WH) by multiplicative updates from mask; zeros of the mask stay zero."""
    x = idf[columns]  # 0 at the padding
    hs = ht[columns]
    w = mask * (x.sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-12))[:, None]
    ratio = x
    for n in range(rounds + 1):
        ratio = x / (np.matmul(hs, w[:, :, None])[:, :, 0] + 1e-12)
        if n < rounds:
            w = w * np.matmul(ratio[:, None, :], hs)[:, 0, :]
    return w, hs, ratio


def labelled_records(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(id_norma, termos, rotulos): rotulos is null where the record has no label; repeated labels count once, with their best score."""
    once = labels.filter(F.col("id_topico").isNotNull()).groupBy("id_norma", "id_topico").agg(F.max("score_pertinencia").alias("score"))
    lists = once.groupBy("id_norma").agg(F.collect_list(F.struct("id_topico", "score")).alias("rotulos"))
    return records.join(lists, "id_norma", "left")


def fit(coded: DataFrame, topics: list[int], rounds: int = 8, inner: int = 8, prior: float = 10.0) -> Model:
    """The model of staged encoded documents. Without labelled documents it has no column and nothing gets a subject."""
    train = coded.filter(F.col("ancoras").isNotNull()).select("colunas", "ancoras")
    k = len(topics)
    seen = train.select(F.explode("colunas").alias("c")).groupBy("c").agg(F.count("*").alias("df")).orderBy("c").toPandas()  # BUCKETS rows at most
    columns, df = seen["c"].to_numpy(np.int64), seen["df"].to_numpy(float)
    n, size = max(train.count(), 1), len(columns)
    idf = np.concatenate([np.log(np.maximum(n / df, 1.0)), [max(np.log(n), 1.0), 0.0]]).astype(np.float32)
    model = Model(topics, columns, idf, np.zeros((k + 1, size + 2), np.float32), 0.28)
    if not size or not k:
        return Model(topics, columns[:0], idf[-2:], model.h[:, -2:], 0.28)
    partials, many = "k int, grupo int, soma array<double>", coded.rdd.getNumPartitions() > 32
    counts = train.select(F.posexplode("ancoras").alias("c", "v")).groupBy("c").agg(F.sum("v").alias("v")).orderBy("c").collect()  # subjects + 1 rows
    common = np.array([r["v"] for r in counts[:k]]) / max(sum(r["v"] for r in counts[:k]), 1e-12)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "grupo": [pdf["grupo"].iloc[0]], "soma": [np.sum(np.stack(pdf["soma"].to_list()), axis=0)]})

    for n_round in range(rounds + 1):
        shared = coded.sparkSession.sparkContext.broadcast((model, n_round > 0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, solving = shared.value
            ht, weights = np.ascontiguousarray(m.h.T), m.idf
            total, part = np.zeros((size + 2, k + 1)), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column(0)[0].as_py()
                masks = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k + 1)
                for rows, places in _bags(*m.places(batch.column(1))):
                    if solving:
                        w, hs, ratio = _solve(places, ht, weights, masks[rows], inner)
                        share = hs * ratio[:, :, None] * w[:, None, :]
                    else:  # seeds: each anchor's own documents
                        share = masks[rows][:, None, :] * weights[places][:, :, None]
                    flat = np.where(places < 0, size + 1, places).ravel()
                    for c in range(k + 1):
                        total[:, c] += np.bincount(flat, weights=share[:, :, c].ravel(), minlength=size + 2)
            yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array([part % 16] * (k + 1), pa.int32()), pa.array(list(total[:size].T), pa.list_(pa.float64()))], names=["k", "grupo", "soma"])

        parts = train.select(F.spark_partition_id().alias("p"), "colunas", "ancoras").mapInArrow(run, partials)
        if many:  # first within groups of tasks
            parts = parts.groupBy("k", "grupo").applyInPandas(add, partials)
        sums = parts.groupBy("k").applyInPandas(add, partials).collect()  # subjects + 1 rows
        shared.unpersist()
        h = np.zeros((k + 1, size + 2))
        for r in sums:
            h[r["k"], :size] = r["soma"]
        # the prior: so many more documents of each column, spread over the components as all documents are
        h[:, : size + 1] += (h.sum(axis=1) / max(h.sum(), 1e-12))[:, None] * prior * idf[: size + 1] + 1e-9
        model = Model(topics, columns, idf, (h / h.sum(axis=1, keepdims=True)).astype(np.float32), 0.28, common)
    return model


def mixtures(coded: DataFrame, model: Model, rounds: int = 40) -> DataFrame:
    """(id_norma, rotulos, partes): the share of each subject in a document; null without subjects."""
    schema = "id_norma bigint, rotulos array<struct<id_topico:int,score:double>>, partes array<double>"
    k, shared = len(model.topics), coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ht = np.ascontiguousarray(m.h.T)
        for batch in batches:
            shares: list = [None] * batch.num_rows
            if k:
                for rows, places in _bags(*m.places(batch.column(2))):
                    w = _solve(places, ht, m.idf, np.ones((len(rows), k + 1), np.float32), rounds)[0][:, :k].astype(np.float64)
                    total = w.sum(axis=1)
                    known = ((places >= 0) & (places < len(m.columns))).any(axis=1)
                    for r, own, t, seen in zip(rows, w, total, known):
                        shares[r] = own / t if seen and t > 1e-9 else m.common
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.list_(pa.float64()))], names=["id_norma", "rotulos", "partes"])

    return coded.select("id_norma", "rotulos", "colunas").mapInArrow(run, schema)


def chosen(mixed: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(id_norma, id_topico, parte): the subjects whose share reaches the threshold, or else the largest one (ties: the lower id)."""
    ids = F.array(*[F.lit(t) for t in model.topics]).cast("array<int>")
    pairs = F.transform(F.arrays_zip("partes", ids.alias("t")), lambda x: F.struct(x["partes"].alias("parte"), (-x["t"]).alias("menos")))
    kept = F.filter("pares", lambda x: x["parte"] >= threshold)
    found = mixed.filter(F.col("partes").isNotNull()).withColumn("pares", pairs).select("id_norma", F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.array_max("pares")))).alias("x"))
    return found.select("id_norma", (-F.col("x.menos")).alias("id_topico"), F.round("x.parte", 4).alias("parte"))


def calibrate(mixed: DataFrame, model: Model, min_score: float = 0.25, grid: tuple[float, ...] = tuple(i / 100 for i in range(14, 47, 2))) -> float:
    """The threshold of best F1 over all labelled documents; the model's own where there are none."""
    truth = F.transform(F.filter("rotulos", lambda r: r["score"].isNull() | (r["score"] >= min_score)), lambda r: r["id_topico"])
    ids = F.array(*[F.lit(t) for t in model.topics]).cast("array<int>")
    pairs = F.arrays_zip("partes", ids.alias("t"))
    base = mixed.filter(F.col("partes").isNotNull() & F.col("rotulos").isNotNull()).select(truth.alias("certos"), pairs.alias("pares"))
    sums = []
    for i, t in enumerate(grid):
        said = F.transform(F.filter("pares", lambda x, t=t: x["partes"] >= t), lambda x: x["t"])
        hit = F.size(F.array_intersect(said, "certos"))
        sums += [F.sum(hit).alias(f"h{i}"), F.sum(F.size(said)).alias(f"s{i}")]
    r = base.agg(F.sum(F.size("certos")).alias("n"), *sums).first()
    if not r["n"]:
        return model.threshold
    f1 = [2 * r[f"h{i}"] / max(r[f"s{i}"] + r["n"], 1) for i in range(len(grid))]
    best = max(f1)
    near = [t for t, f in zip(grid, f1) if f >= best - 0.0005]
    return near[len(near) // 2]


def subjects(records: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """(id_norma, id_topico, parte, rotulado) for every record; each has one subject at least.

    records (id_norma, termos) has one row per id. Null topics and scores are allowed; labels of unknown topics don't count.
    A record whose terms no labelled one holds gets the commonest subject. Without labels or topics there are no rows.
    """
    ids = [r[0] for r in topics.select(F.col("id").cast("int")).filter("id is not null").distinct().orderBy("id").collect()]
    docs = labelled_records(records, labels.withColumn("id_topico", F.col("id_topico").cast("int")))
    coded = stage(encoded(docs, ids), "p7-registros")
    model = fit(coded, ids)
    if not len(model.columns):
        return coded.limit(0).select("id_norma", F.lit(0).alias("id_topico"), F.lit(0.0).alias("parte"), F.lit(False).alias("rotulado"))
    mixed = stage(mixtures(coded, model), "p7-misturas")
    picked = chosen(mixed.withColumn("id_norma", F.struct("id_norma", F.col("rotulos").isNotNull().alias("r"))), model, calibrate(mixed, model))
    return picked.select("id_norma.id_norma", "id_topico", "parte", F.col("id_norma.r").alias("rotulado"))


def composition(found: DataFrame) -> DataFrame:
    """(id_topico, normas, parte_media): the make-up of the collection by subject."""
    return found.groupBy("id_topico").agg(F.count("*").alias("normas"), F.round(F.avg("parte"), 4).alias("parte_media"))
