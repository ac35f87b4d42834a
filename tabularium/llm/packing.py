"""Harmonic packing: items whole into containers of a fixed capacity.

An item larger than C/(j+1) and at most C/j belongs to class j, and a container of class j takes exactly j items,
so no two workers need to agree on a container. Items of at most C/classes are laid end to end and cut where the
next could overrun. Items above C are cut into full containers and a rest, which is packed as an item.
Hot classes are split into groups of about ``group_rows`` items; each group leaves at most one container open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.session import stage


def pieces(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """(id, parte, partes, tokens): one row for an item that fits, several for one above the capacity."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    return sizes.select(id_col, n.alias("partes"), F.explode(F.sequence(F.lit(0), n - 1)).alias("parte"), F.col("tokens").alias("todos")).select(
        id_col, "parte", "partes", F.when(F.col("parte") < F.col("partes") - 1, F.lit(capacity)).otherwise(F.col("todos") - F.col("parte").cast("bigint") * capacity).cast("bigint").alias("tokens")
    )


def pack(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id", classes: int = 32, group_rows: int = 200_000) -> DataFrame:
    """(id, parte, partes, tokens, classe, caixa) for sizes (id, tokens).

    Every item is in one container, split items in several; items of 0 tokens use no space and have caixa null.
    Null sizes count as 0. Items of equal size are ordered by id; repeated rows are packed as often as they occur.
    """
    parts = stage(pieces(sizes.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint")), capacity, id_col), "p8-partes")
    cls = F.when(F.col("tokens") <= 0, F.lit(0)).otherwise(F.least(F.lit(classes), F.floor(F.lit(capacity) / F.col("tokens")))).cast("int")
    classed = parts.withColumn("classe", cls)
    counts = {r["classe"]: r["count"] for r in classed.groupBy("classe").count().collect()}  # at most classes + 1 rows
    groups = F.create_map(*[F.lit(x) for k, v in (counts or {0: 0}).items() for x in (k, max(1, -(-v // group_rows)))])
    salted = classed.withColumn("grupo", F.pmod(F.xxhash64(id_col, "parte"), groups[F.col("classe")]).cast("int"))
    w = Window.partitionBy("classe", "grupo").orderBy(F.col("tokens").desc(), id_col, "parte")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = capacity - capacity // classes
    number = F.when(F.col("classe") == classes, F.floor(before / step)).otherwise(F.floor((F.row_number().over(w) - 1) / F.greatest(F.col("classe"), F.lit(1))))
    code = F.shiftleft(F.col("classe").cast("bigint"), 54).bitwiseOR(F.shiftleft(F.col("grupo").cast("bigint"), 34)).bitwiseOR(number.cast("bigint"))
    filled = salted.filter("classe > 0").select(id_col, "parte", "partes", "tokens", "classe", code.alias("caixa"))
    return filled.unionByName(classed.filter("classe = 0").withColumn("caixa", F.lit(None).cast("bigint")))


def split_items(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, caixas): the items that the packing laid into more than one container, and into how many."""
    boxes = packed.filter(F.col("caixa").isNotNull()).groupBy(id_col, "parte").agg(F.min("caixa").alias("caixa")).groupBy(id_col)
    return boxes.agg(F.countDistinct("caixa").alias("caixas")).filter("caixas > 1")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(classe, caixas, itens, tokens, ocupacao) per class of containers."""
    boxes = packed.filter(F.col("caixa").isNotNull()).groupBy("classe", "caixa").agg(F.count("*").alias("itens"), F.sum("tokens").alias("tokens"))
    return boxes.groupBy("classe").agg(
        F.count("*").alias("caixas"), F.sum("itens").alias("itens"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * capacity), 4).alias("ocupacao")
    )
