"""Corpus statistics: document frequency, IDF, chi-square and mutual information, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import sentences, tokens
from tabularium.session import small, stage


def corpus(normas: DataFrame, id_col: str = "id", text_col: str = "ementa", class_col: str = "tipoescrito", order_col: str = "coletado_em") -> DataFrame:
    """(id, texto, classe): the latest non-blank text of each id; a null or blank class becomes 'GERAL'."""
    rows = normas.select(F.col(id_col).alias("id"), F.col(text_col).alias("texto"), F.col(class_col).alias("c"), F.col(order_col).alias("q")).filter(F.col("texto").rlike("\\S") & F.col("id").isNotNull())
    latest = rows.groupBy("id").agg(F.max(F.struct("q", "texto", "c")).alias("m"))
    return latest.select("id", "m.texto", F.when(F.coalesce("m.c", F.lit("")).rlike("\\S"), F.col("m.c")).otherwise("GERAL").alias("classe"))


def doc_terms(docs: DataFrame) -> DataFrame:
    """(id, classe, termo) once per document and term, without stop words."""
    return docs.select("id", "classe", F.explode(F.array_distinct(tokens(F.col("texto")))).alias("termo"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(termo, df)."""
    return doc_terms(docs).groupBy("termo").agg(F.count("*").alias("df"))


def with_idf(df: DataFrame, n: int) -> DataFrame:
    """df (termo, df) with idf = ln((n + 1) / (df + 1)) + 1."""
    return df.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def unseen_idf(n: int) -> float:
    """The IDF of a term that no document holds."""
    import math

    return math.log(n + 1.0) + 1.0


def class_scores(docs: DataFrame, n: int) -> DataFrame:
    """(termo, df, chi2, mi): the maxima over the classes, at least 0.

    Classes a term never occurs in count for chi-square too. There its value grows with the size of the class, so only
    the largest of them matters: the first rank, by size, that the classes of the term leave out.
    """
    sizes = docs.groupBy("classe").agg(F.count("*").cast("double").alias("cs"))
    ranked = stage(sizes.withColumn("posto", F.row_number().over(Window.orderBy(F.col("cs").desc(), "classe"))), "classes")  # one row per class
    per_class = doc_terms(docs).groupBy("termo", "classe").agg(F.count("*").cast("double").alias("a")).join(small(ranked), "classe")
    terms = per_class.withColumn("df", F.sum("a").over(Window.partitionBy("termo")))
    a, t, cs = F.col("a"), F.col("df"), F.col("cs")
    b, c, d = t - a, cs - a, n - t - cs + a
    den = t * cs * (b + d) * (c + d)
    chi = F.when(den != 0, n * F.pow(a * d - b * c, 2) / den).otherwise(0.0)
    info = a / n * F.log2(a / n / (t / n * (cs / n)))
    best = terms.groupBy("termo").agg(F.first("df").alias("df"), F.max(chi).alias("chi"), F.max(info).alias("mi"), F.array_sort(F.collect_set("posto")).alias("postos"))
    gap = F.transform("postos", lambda p, i: F.when(p != i + 1, i + 1))
    missing = best.withColumn("posto", F.coalesce(F.array_min(F.filter(gap, lambda g: g.isNotNull())), F.size("postos") + 1))
    largest = missing.join(small(ranked.select("posto", F.col("cs").alias("fora"))), "posto", "left")
    away = F.col("fora")
    rest = (n - away) * (n - t)
    absent = F.when(away.isNotNull() & (rest != 0), n * t * away / rest).otherwise(0.0)
    return largest.select("termo", F.col("df").cast("bigint").alias("df"), F.greatest(F.lit(0.0), "chi", absent).alias("chi2"), F.greatest(F.lit(0.0), "mi").alias("mi"))


def join_terms(pairs: DataFrame, stats: DataFrame, n: int, how: str = "left") -> DataFrame:
    """pairs joined with the statistics (termo, df, ...) of their terms, without a hot task.

    Terms in more than one of a thousand documents are few (at most a thousand times the mean document length); they
    are joined by broadcast, behind a check of their number. The others go through a shuffle join.
    """
    hot_at = max(1000, n // 1000)
    stats = stage(stats, "termos")
    hot = stats.filter(F.col("df") > hot_at)
    marked = pairs.join(small(hot.withColumn("quente", F.lit(True))), "termo", "left")
    values = [c for c in stats.columns if c != "termo"]
    done = marked.filter("quente").drop("quente")
    rest = marked.filter("quente IS NULL").drop("quente", *values).join(stats.filter(F.col("df") <= hot_at), "termo", how)
    return done.unionByName(rest)


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """(id, frase, pos, termo) of every token without stop words; frase counts sentences, pos tokens within one."""
    split = docs.select("id", F.posexplode(sentences(F.col("texto"))).alias("frase", "s"))
    return split.select("id", "frase", F.posexplode(tokens(F.col("s"))).alias("pos", "termo"))
