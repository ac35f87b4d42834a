"""Frequency of every distinct term: a global integer dictionary and count arrays summed by identifier range.

1. Each task encodes its records with a local dictionary and accumulates one array of occurrences and one of
   record presence per block, so a term leaves a block once however often it occurs there.
2. The global dictionary gives each distinct term an integer; identifiers are consecutive within a partition. Terms of
   very many blocks, 2,000 at most, are encoded by a broadcast, so that no task gets all blocks of a common term.
3. Blocks are re-encoded with the global identifiers and their arrays are summed by identifier range, first per
   group of blocks, then over the groups: no task gets more than ``fan_in`` blocks of one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.session import small, stage

RANGE_BITS = 12


def count_blocks(records: DataFrame, terms_col: str = "termos") -> DataFrame:
    """(bloco, termo, ocorrencias, registros) per block of records; a row with termo null holds the block's record count."""
    out = pa.schema([("bloco", pa.int64()), ("termo", pa.string()), ("ocorrencias", pa.int64()), ("registros", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            lists = batch.column(1)
            if not len(lists):
                continue
            block = int(batch.column(0)[0].as_py()) * 1_000_003 + n
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(flat.dictionary)
            occurrences = np.bincount(codes, minlength=size)
            presence = np.bincount(np.unique(rows * size + codes) % size if size else codes, minlength=size)
            table = pa.table([pa.array(np.full(size, block)), flat.dictionary, pa.array(occurrences.astype(np.int64)), pa.array(presence.astype(np.int64))], schema=out)
            yield from table.to_batches()
            yield pa.record_batch([pa.array([block]), pa.array([None], pa.string()), pa.array([0]), pa.array([len(lists)])], schema=out)

    return records.select(F.spark_partition_id().cast("bigint").alias("p"), terms_col).mapInArrow(run, "bloco bigint, termo string, ocorrencias bigint, registros bigint")


def _sum_arrays(pdf: pd.DataFrame, faixa: int, salt: int) -> pd.DataFrame:
    size = 1 << RANGE_BITS
    at = pdf["posicao"].to_numpy()
    occurrences = np.bincount(at, weights=pdf["ocorrencias"].to_numpy(), minlength=size).astype(np.int64)
    presence = np.bincount(at, weights=pdf["registros"].to_numpy(), minlength=size).astype(np.int64)
    return pd.DataFrame({"faixa": [faixa], "grupo": [salt], "ocorrencias": [occurrences], "registros": [presence]})


def term_frequencies(records: DataFrame, terms_col: str = "termos", fan_in: int = 64) -> tuple[DataFrame, int]:
    """((termo, ocorrencias, registros), number of records). An empty table gives an empty result and 0.

    Ties, repeated terms and very long records are counted as they are. Sums are exact up to 2**53.
    """
    blocks = stage(count_blocks(records, terms_col), "p6-blocos")
    head = blocks.agg(F.sum(F.when(F.col("termo").isNull(), F.col("registros"))).alias("n"), F.count_if(F.col("termo").isNull()).alias("b"), F.count("termo").alias("t")).first()
    n, groups = int(head["n"] or 0), max(1, -(-int(head["b"] or 0) // fan_in))
    found = blocks.filter(F.col("termo").isNotNull())
    dictionary = stage(found.groupBy("termo").agg(F.count("*").alias("blocos")).withColumn("id", F.monotonically_increasing_id()), "p6-dicionario")
    hot_at = max(1000, -(-int(head["t"] or 0) // 2000))
    hot = small(dictionary.filter(F.col("blocos") > hot_at).select("termo", "id"))
    cold = found.join(hot.select("termo"), "termo", "left_anti").join(dictionary.filter(F.col("blocos") <= hot_at).select("termo", "id"), "termo")
    numbered = cold.unionByName(found.join(hot, "termo"))
    coded = numbered.select(
        F.shiftright("id", RANGE_BITS).alias("faixa"),
        F.pmod("bloco", F.lit(groups)).alias("grupo"),
        F.col("id").bitwiseAND((1 << RANGE_BITS) - 1).cast("int").alias("posicao"),
        "ocorrencias",
        "registros",
    )
    arrays = "faixa bigint, grupo bigint, ocorrencias array<bigint>, registros array<bigint>"
    partial = coded.groupBy("faixa", "grupo").applyInPandas(lambda key, pdf: _sum_arrays(pdf, int(key[0]), int(key[1])), arrays)
    flat = partial.select("faixa", F.posexplode(F.arrays_zip("ocorrencias", "registros")).alias("posicao", "c")).filter(F.col("c.registros") > 0)
    sums = flat.groupBy(F.shiftleft("faixa", RANGE_BITS).bitwiseOR(F.col("posicao").cast("bigint")).alias("id")).agg(
        F.sum("c.ocorrencias").alias("ocorrencias"), F.sum("c.registros").alias("registros")
    )
    return dictionary.select("termo", "id").join(sums, "id").select("termo", "ocorrencias", "registros"), n


def mark(frequencies: DataFrame, n_records: int, rare_below: int = 4, common_percent: int = 30) -> DataFrame:
    """frequencies with marca: 'raro' below ``rare_below`` records, 'comum' above ``common_percent`` of every 100, else null."""
    return frequencies.withColumn(
        "marca",
        F.when(F.col("registros") < rare_below, F.lit("raro")).when(F.col("registros") * 100 > F.lit(common_percent * n_records), F.lit("comum")),
    )
