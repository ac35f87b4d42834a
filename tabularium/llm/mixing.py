"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight times the size of all documents. Whole copies are allotted first; the rest is a
sample without replacement: documents are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p), and taken in
that order until the rest is filled. Inclusion probabilities follow the documents' sizes. The ranking is cut by a
histogram of ranks per source, so that only the documents of one bucket are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.session import small, stage


def source_shares(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, peso_alvo, max_repeticoes, tokens, quadrados, documentos, total, alvo, copias, resto) per weighted source.

    sizes is (doc_id, source, tokens). The total counts every document whose source is not null once, of unlisted
    sources too. Weights with a null source are left out; a null weight is 0, a null number of repetitions 1.
    """
    sums = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("quadrados"), F.count("*").alias("documentos")
    )
    total = int(sums.agg(F.sum("tokens")).first()[0] or 0)
    joined = weights.filter(F.col("source").isNotNull()).select("source", F.coalesce("peso_alvo", F.lit(0.0)).alias("peso_alvo"), F.coalesce("max_repeticoes", F.lit(1)).alias("max_repeticoes")).join(sums, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "quadrados", "documentos")}
    out = joined.withColumns(zero).withColumn("total", F.lit(total)).withColumn("alvo", F.col("peso_alvo") * F.lit(total))
    # whole copies, as many as are allowed; the rest of the target is sampled where another copy is
    copies = F.when(F.col("tokens") == 0, 0).otherwise(F.least(F.col("max_repeticoes"), F.floor(F.col("alvo") / F.col("tokens")))).cast("int")
    out = out.withColumn("copias", copies)
    rest = F.when((F.col("tokens") == 0) | (F.col("copias") >= F.col("max_repeticoes")), F.lit(0.0)).otherwise(F.col("alvo") - F.col("copias") * F.col("tokens"))
    return out.withColumn("resto", rest)


def mix(sizes: DataFrame, weights: DataFrame, seed: int = 7, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, copias) of the mixture, the shares of ``source_shares``).

    Documents that are used no time have no row. Documents without tokens, with a null source or of an unlisted
    source are not used. Ties of the rank go to the lower doc_id. The result depends on seed, not on partitions.
    """
    sized = stage(sizes.filter(F.col("source").isNotNull() & (F.col("tokens") > 0)), "p9-tamanhos")
    shares = stage(source_shares(sized, weights), "p9-partes")  # one row per listed source
    docs = sized.join(small(shares.select("source", "copias", "resto", "tokens", "quadrados").withColumnsRenamed({"tokens": "todos"})), "source")
    # inclusion probability in proportion to the size, so that the expected tokens of the sample are the rest
    p = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.col("resto") * F.col("tokens") / F.col("quadrados")))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = docs.withColumn("q", odds / (1 + odds)).withColumn("balde", F.least(F.lit(buckets - 1), F.floor(F.col("q") * buckets)).cast("int"))
    hist = ranked.filter("resto > 0").groupBy("source", "balde").agg(F.sum("tokens").alias("t"), F.first("resto").alias("resto"))
    w = Window.partitionBy("source").orderBy("balde")  # at most ``buckets`` rows per source
    cum = hist.withColumn("ate", F.sum("t").over(w)).withColumn("antes", F.col("ate") - F.col("t"))
    cut = stage(cum.filter((F.col("antes") < F.col("resto")) & (F.col("ate") >= F.col("resto"))).select("source", F.col("balde").alias("corte"), "antes"), "p9-cortes")
    placed = ranked.join(small(cut), "source", "left")
    below = placed.filter(F.col("balde") != F.coalesce("corte", F.lit(-1))).withColumn(
        "extra", ((F.col("resto") > 0) & (F.col("balde") < F.coalesce("corte", F.lit(buckets)))).cast("int")
    )
    inside = placed.filter(F.col("balde") == F.coalesce("corte", F.lit(-1)))
    v = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("antes") + F.coalesce(F.sum("tokens").over(v), F.lit(0))
    inside = inside.withColumn("extra", (start + F.col("tokens") / 2 <= F.col("resto")).cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("copias") + F.col("extra")).alias("copias")]
    return below.select(*cols).unionByName(inside.select(*cols)).filter("copias > 0"), shares


def actual_shares(mixed: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, peso_alvo, tokens_alvo, tokens_usados, parte_real, esgotada) per listed source, as the mixture came out.

    A source is exhausted if its target isn't reached although the mixture uses every one of its documents as often as
    it may be used (a source without documents, or that may be used no time, too).
    """
    limits = shares.select("source", "max_repeticoes")
    uses = mixed.join(small(limits), "source").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("usados"), F.count_if(F.col("copias") >= F.col("max_repeticoes")).alias("gastos"))
    used = stage(uses, "p9-usados")
    grand = int(used.agg(F.sum("usados")).first()[0] or 0)
    usados = F.coalesce("usados", F.lit(0))
    spent = (F.coalesce("gastos", F.lit(0)) == F.col("documentos")) | (F.col("max_repeticoes") <= 0)
    return shares.join(used, "source", "left").select(
        "source",
        "peso_alvo",
        F.round("alvo", 3).alias("tokens_alvo"),
        usados.alias("tokens_usados"),
        F.round(usados / F.lit(max(grand, 1)), 6).alias("parte_real"),
        ((usados < F.col("alvo")) & spent).alias("esgotada"),
    )
