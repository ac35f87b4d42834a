"""The queries of this subpackage: name -> (spark, data folder) -> DataFrame. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.terms import terms
from tabularium.llm import abuse, canonical, distinctive, frequency, markov, markup, mixing, names, packing, subjects, tokens
from tabularium.llm.records import records
from tabularium.llm.sql import SQL
from tabularium.session import stage
from tabularium.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return stage(markov.similarity_groups(table(spark, d, "ementas_pre_processadas"), "id_norma", "embeddings"), "p1-grupos")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The lowest norma of each group with each of the others."""
    return markov.group_pairs(_groups(spark, d))


def p1_grupos(spark: SparkSession, d: str) -> DataFrame:
    """Each group by its lowest norma, with its size and five most typical normas."""
    return markov.typical_members(_groups(spark, d))


def _people(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("autores", "norma_autor", "cargos_canonicos")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Authors that are one entity under several spellings, and other persons named inside titles."""
    return names.found(*_people(spark, d))


def p2_grafias(spark: SparkSession, d: str) -> DataFrame:
    """The entity of each author and its number of links."""
    return names.spellings(*_people(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that 2 to 6 records share, with each record that holds them; their scores are in p3_notas."""
    return distinctive.shared_terms(records(table(spark, d, "normas")), 2, 6)


def p3_notas(spark: SparkSession, d: str) -> DataFrame:
    """The score of every term of a record's summary and of its stored tfidf_topk."""
    stored = table(spark, d, "ementas_pre_processadas").select("id_norma", F.explode(terms(F.col("tfidf_topk"))).alias("termo"))
    return distinctive.distinctive_terms(records(table(spark, d, "normas")), listed=stored).withColumn("llr", F.round("llr", 4))


def p3_distintivos(spark: SparkSession, d: str) -> DataFrame:
    """The five most distinctive terms of each record."""
    scored = distinctive.distinctive_terms(records(table(spark, d, "normas"))).withColumn("llr", F.round("llr", 4))
    w = Window.partitionBy("id_norma").orderBy(F.col("llr").desc(), "termo")
    return scored.withColumn("posicao", F.row_number().over(w)).filter("posicao <= 5")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_titles(spark, table(spark, d, "norma_autor"), table(spark, d, "cargos_canonicos"), table(spark, d, "autores"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of each title that isn't normalised yet; 0 where none fits."""
    return canonical.pending(spark, table(spark, d, "norma_autor"), _titles(spark, d))


def p4_sem_entrada(spark: SparkSession, d: str) -> DataFrame:
    """The typed titles that no entry fits, with their rows."""
    return canonical.unmatched(spark, table(spark, d, "norma_autor"), _titles(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list items, code blocks and formulas marked up in the full texts."""
    found = markup.structural_elements(table(spark, d, "normas"), "id", "integra")
    return found.select(F.col("id").alias("id_norma"), "elemento", "conteudo").distinct()


def p5_texto(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each distinct norma."""
    latest = table(spark, d, "normas").groupBy("id").agg(F.max(F.struct("coletado_em", "integra")).alias("m")).select("id", "m.integra")
    return markup.clean_text(latest, "id", "integra").withColumnRenamed("id", "id_norma")


def p6_frequencias(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term, with its mark."""
    return frequency.mark(*frequency.term_frequencies(records(table(spark, d, "normas"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms marked too rare or too common."""
    return p6_frequencias(spark, d).filter(F.col("marca").isNotNull()).select("termo", "marca")


def p7_areas(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each norma with their shares, labelled normas included."""
    return subjects.subjects(records(table(spark, d, "normas")), table(spark, d, "norma_topicos"), table(spark, d, "topicos"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of the normas that have none yet."""
    return p7_areas(spark, d).filter("not rotulado").select("id_norma", "id_topico")


def p7_composicao(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the collection by subject area."""
    return subjects.composition(p7_areas(spark, d))


def p8_caixas(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each part of one above the capacity."""
    return packing.pack(tokens.token_sizes(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that lie in more than one container."""
    return packing.split_items(p8_caixas(spark, d)).select("doc_id")


def p8_ocupacao(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each class are."""
    return packing.fill_report(p8_caixas(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_sizes(table(spark, d, "documents").filter(F.col("source").isNotNull()), keep=("source",))


def p9_mistura(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.mix(_sizes(spark, d), table(spark, d, "pesos_fontes"))[0]


def p9_partes(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.actual_shares(*mixing.mix(_sizes(spark, d), table(spark, d, "pesos_fontes")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that stay below their share in the mixture, though it uses all their documents as often as it may."""
    return p9_partes(spark, d).filter("esgotada").select("source")


def p10_notas(spark: SparkSession, d: str) -> DataFrame:
    """The score of each document and whether it reaches the threshold of its language."""
    documents = table(spark, d, "documents")
    model, labels = abuse.fit(documents, table(spark, d, "rotulos_revisao"))
    return abuse.flag(stage(abuse.score_documents(documents, model), "p10-notas"), labels)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The abusive documents."""
    return p10_notas(spark, d).filter("ofensivo").select("doc_id")


def p10_taxas(spark: SparkSession, d: str) -> DataFrame:
    """The rate of abusive documents of each source."""
    return abuse.source_rates(p10_notas(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_grupos, p2_found, p2_grafias, p3_found, p3_notas, p3_distintivos, p4_found, p4_sem_entrada, p5_found, p5_texto, p6_found, p6_frequencias, p7_found, p7_areas, p7_composicao, p8_found, p8_caixas, p8_ocupacao, p9_found, p9_mistura, p9_partes, p10_found, p10_notas, p10_taxas)
}
