"""Records of normas: one row per distinct id, with the terms of its ementa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.terms import terms


def records(normas: DataFrame, id_col: str = "id", text_col: str = "ementa", order_col: str = "coletado_em") -> DataFrame:
    """(id_norma, termos): the latest text of each id; null ids and records without a term are left out.

    Ties of ``order_col`` go to the greater text, so that the result doesn't depend on the order of rows.
    """
    latest = (
        normas.select(F.col(id_col).alias("id_norma"), F.col(text_col).alias("texto"), F.col(order_col).alias("quando"))
        .filter(F.col("id_norma").isNotNull())
        .groupBy("id_norma")
        .agg(F.max(F.struct("quando", "texto")).alias("m"))
    )
    return latest.select("id_norma", terms(F.col("m.texto")).alias("termos")).filter(F.size("termos") > 0)
