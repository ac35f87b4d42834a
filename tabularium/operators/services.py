"""Services that join operators to a stored result: authors and links, vectors, topics, normalised titles, report lines.

Each takes tables and gives the tables as they stand afterwards; ``upsert.overwrite`` stores them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import abbreviate, normalize_name, not_blank, sanitize_title
from tabularium.operators import embeddings, upsert
from tabularium.session import stage


def store_authors(found: DataFrame, autores: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(autores, links) after storing signatures found (id, nome, cargo): names become authors, signatures links.

    autores (id, nome) is brought to one row per stored name, the lowest id; a known link keeps its flag and normalised title.
    """
    stored = autores.filter("nome IS NOT NULL").groupBy(normalize_name(F.col("nome")).alias("nome")).agg(F.min("id").alias("id")).select("id", "nome")
    signed = stage(found.select(F.col("id").alias("id_norma"), normalize_name(F.col("nome")).alias("nome"), F.col("cargo").alias("cargo_autor")), "assinaturas")
    people = stage(upsert.get_or_create(stored, signed.select("nome")), "autores")
    pairs = signed.join(people.select(F.col("id").alias("id_autor"), "nome"), "nome").select("id_norma", "id_autor", "cargo_autor")
    return people, upsert.upsert_links(links, pairs)


def fill_vectors(rows: DataFrame, texts: DataFrame, provider: str = "local", pending_only: bool = True, limit: int | None = None) -> DataFrame:
    """rows (id_norma, embeddings, ...) with vectors of texts (id, texto): of all of them, or of those without one yet.

    With a limit, the lowest ids come first. Rows without a text keep what they have.
    """
    asked = rows.filter("embeddings IS NULL") if pending_only else rows
    todo = texts.join(asked.select(F.col("id_norma").alias("id")).distinct(), "id", "left_semi")
    if limit is not None:
        todo = todo.orderBy("id").limit(limit)
    made = embeddings.PROVIDERS[provider](todo).select(F.col("id").alias("id_norma"), F.col("vetor").alias("__vetor"))
    new = F.col("__vetor").isNotNull() & (F.col("embeddings").isNull() if pending_only else F.lit(True))
    return rows.join(made, "id_norma", "left").withColumn("embeddings", F.when(new, F.col("__vetor")).otherwise(F.col("embeddings")).cast(rows.schema["embeddings"].dataType)).select(*rows.columns)


def store_topics(topics: DataFrame, new: DataFrame, labels: DataFrame) -> DataFrame:
    """topics (id, id_rotulo_topico, termos_principais, total_normas, percentual_base) with the rows of new in place of those with the same id.

    new is (id, rotulo, termos: a list, total_normas, percentual_base); a label that labels (id, nome) doesn't know means label 1.
    """
    known = upsert.key_or_default(labels.select("id", "nome"), new.select(F.col("rotulo").alias("nome")).distinct())
    rows = new.join(known.select(F.col("nome").alias("rotulo"), F.col("id").alias("id_rotulo_topico")), "rotulo")
    rows = rows.withColumn("termos_principais", F.array_join("termos", ", "))
    return upsert.replace_rows(topics, rows.select(*[F.col(c).cast(topics.schema[c].dataType) for c in topics.columns]), ["id"])


#: Fixed value: what a language model's answer looks like; its text is JSON again, in a second layout.
ANSWER = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"
RESULTS = "struct<resultados:array<struct<original:string,normalizado:string>>>"


def parse_answers(answers: DataFrame, column: str = "resposta") -> DataFrame:
    """(original, normalizado) of every result in JSON answers; unreadable and null answers give none, thoughts are left out."""
    parts = answers.select(F.from_json(column, ANSWER).alias("a")).select(F.explode("a.candidates").alias("c")).select(F.explode("c.content.parts").alias("p"))
    text = F.regexp_replace("p.text", "(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$", "")
    results = parts.filter(~F.coalesce("p.thought", F.lit(False))).select(F.explode(F.from_json(text, RESULTS)["resultados"]).alias("r"))
    return results.select("r.original", "r.normalizado").filter(F.col("original").isNotNull())


def normalize_titles(pending: DataFrame, ask: Callable[[list[str]], str], batch: int = 200, tries: int = 3, wait: float = 20.0) -> DataFrame:
    """(cargo_autor, valor): the normalised form of each distinct title, by a model that answers batches of titles in JSON.

    ask runs on the executors; an error is tried again after wait seconds, then twice that. Titles without an answer
    (or with a blank one) get their sanitised form, so that every title has a value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = b.column(0).to_pylist()
            answers = []
            for a in range(0, len(titles), batch):
                for n in range(1, tries + 1):
                    try:
                        answers.append(ask(titles[a : a + batch]))
                        break
                    except Exception:
                        if n < tries:
                            time.sleep(wait * n)
            yield pa.RecordBatch.from_arrays([pa.array(answers, pa.string())], names=["resposta"])

    titles = pending.select("cargo_autor").filter(F.col("cargo_autor").isNotNull()).distinct()
    answers = stage(titles.mapInArrow(run, "resposta string"), "respostas")
    given = parse_answers(answers).filter(not_blank(F.col("normalizado"))).groupBy(F.col("original").alias("cargo_autor")).agg(F.max("normalizado").alias("n"))
    return titles.join(given, "cargo_autor", "left").select("cargo_autor", sanitize_title(F.coalesce("n", "cargo_autor")).alias("valor"))


def topic_line(number: Column, label: Column, label_id: Column, terms: Column, share: Column) -> Column:
    """A topic in one line (fixed format)."""
    return F.format_string("Tópico #%02d [%s] (ID Rótulo: %d): %s (%.1f%%)", number, label, label_id, terms, share)


def cluster_lines(report: DataFrame, keywords: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, linha): each cluster of ``embeddings.cluster_report`` with its size, cohesion, keywords (cluster, termo, posicao) and medoid (id, nome, texto)."""
    words = keywords.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posicao", "termo"))), lambda x: x["termo"]), ", ").alias("palavras"))
    medoids = names.select(F.col("id").alias("medoide"), "nome", "texto")
    joined = report.join(words, "cluster", "left").join(medoids, "medoide", "left")
    head = F.format_string("CLUSTER #%02d | %d normas (%.1f%%) | Coesão Média: %.3f", "cluster", "tamanho", "percentual", "coesao")
    keys = F.concat(F.lit(" | Palavras-chave: "), F.coalesce("palavras", F.lit("")))
    short = abbreviate(F.trim(F.regexp_replace(F.coalesce("texto", F.lit("")), "\\s+", " ")), 85)
    return joined.select("cluster", F.concat(head, keys, F.lit(" | MEDOID: "), F.coalesce("nome", F.col("medoide").cast("string")), F.lit(" - "), short).alias("linha"))


def profile_lines(profiles: DataFrame) -> DataFrame:
    """(id_autor, linha): each profile of ``topics.author_profiles`` in one line, with a bar for the share of its main topic."""
    bar = F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(F.col("percentual") / 4)).cast("int"))
    line = F.format_string("Autor: %s [%s] | Classificadas: %d | Foco: %s (Entropia: %.2f - %s) | %s %.1f%%", "nome", "cargo", "total", "rotulo", "entropia", "especializacao", bar, "percentual")
    return profiles.select("id_autor", line.alias("linha"))
