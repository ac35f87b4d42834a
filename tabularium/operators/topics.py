"""Topic model: vocabulary, normalised matrix, factorisation, labels, author profiles and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.session import small, stage

#: Legal words that never name a topic.
TOPIC_STOPWORDS = (
    "dispõe dispoe altera dá da providências providencias outras "
    "lei artigo art arts anexo caput parágrafo paragrafo inciso "
    "institui aprova estabelece nº no redação redacao revoga acresce "
    "termo termos seguinte seguintes constante constantes quadro tabela "
    "sobre para com que dos das aos nas nos pelo pela "
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro "
    "alei especifica conforme previsto vigor municipal município municipio cidade são paulo"
).split()
#: Label of a topic by words among its main terms; all words of one group must occur, the first rule counts.
TOPIC_LABELS = (
    ("Declaração de Utilidade Pública", (("utilidade",), ("declara", "pública"))),
    ("Educação Infantil e Rede Escolar", (("infantil",), ("educação",), ("escola",), ("ensino",), ("cei",))),
    ("Extensão e Delimitação de Vias", (("pontos", "referência"), ("estende",), ("oficializa",))),
    ("Denominação de Vias e Logradouros", (("denomina",), ("logradouro",), ("praça",), ("rua",), ("travessa",))),
    ("Calendário Oficial e Campanhas", (("calendário",), ("eventos",), ("conscientização",), ("festa",))),
    ("Datas Comemorativas e Celebrações", (("comemorado",), ("anualmente",), ("celebrado",))),
    ("Habitação de Interesse Social e Regularização (ZEIS)", (("zeis",), ("fundiária",), ("social", "interesse"))),
    ("Bens Imóveis e Desapropriações", (("imóveis",), ("imóvel",), ("particulares",), ("desafeta",))),
    ("Preços Públicos e Serviços Municipais", (("preços",), ("prestados",), ("serviços",), ("tarifas",))),
    ("Orçamento e Créditos Suplementares", (("suplementar",), ("crédito",), ("adicional",), ("orçamento",), ("finanças",))),
    ("Saúde Pública", (("saúde",), ("médic",), ("sanitár",), ("hospital",))),
    ("Tributação e Fiscal", (("tribut",), ("iptu",), ("iss",), ("fiscal",))),
)
#: Reference class of a summary by words in upper case, the first rule counts.
REFERENCE_CLASSES = (
    ("Educação e Creches", ("CENTRO DE EDUCAÇÃO INFANTIL", "CEI ", "EMEI ", "EMEF ", "ESCOLA MUNICIPAL")),
    ("Denominação de Vias e Logradouros", ("DENOMINA", "LOGRADOURO PÚBLICO", "PRAÇA ")),
    ("Datas Comemorativas e Calendário", ("CALENDÁRIO DE EVENTOS", "CALENDARIO DE EVENTOS", "DIA DO ", "SEMANA DA ", "SEMANA DO ")),
    ("Orçamento e Finanças", ("CRÉDITO SUPLEMENTAR", "CREDITO SUPLEMENTAR", "CRÉDITOS ADICIONAIS", "ABRE O CRÉDITO")),
    ("Declaração de Utilidade Pública", ("UTILIDADE PÚBLICA", "UTILIDADE PUBLICA")),
)


def topic_label(terms: Column) -> Column:
    """The label of a topic by its main terms (text); 'Administração e Normas Gerais (first term)' where no rule fits."""
    text = F.lower(terms)
    out = None
    for label, groups in TOPIC_LABELS:
        test = F.lit(False)
        for g in groups:
            every = F.lit(True)
            for word in g:
                every = every & F.contains(text, F.lit(word))
            test = test | every
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.concat(F.lit("Administração e Normas Gerais ("), F.regexp_extract(terms, "^([^ ,]*)", 1), F.lit(")")))


def reference_class(text: Column) -> Column:
    """The class of high certainty of a summary, or null."""
    upper = F.upper(text)
    out = None
    for label, words in REFERENCE_CLASSES:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(upper, F.lit(w))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def topic_tokens(text: Column) -> Column:
    """Distinct tokens for the topic model: lower case, letters and digits only, over two characters, no numbers, no legal words."""
    parts = F.transform(F.split(F.lower(F.trim(text)), "\\s+"), lambda t: F.regexp_replace(t, "[^\\p{L}\\p{Nd}]", ""))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.rlike("^\\p{Nd}+$") & ~t.isin(TOPIC_STOPWORDS)))


def vocabulary(docs: DataFrame, min_df: int = 4, max_share: float = 0.22) -> DataFrame:
    """(termo, df) of the terms of docs (id, texto) within the bounds of document frequency; empty for tiny collections."""
    n = docs.count()
    counts = docs.select(F.explode(topic_tokens(F.col("texto"))).alias("termo")).groupBy("termo").agg(F.count("*").alias("df"))
    return counts.filter((F.col("df") >= min_df) & (F.col("df") <= int(max_share * n)))


def matrix(docs: DataFrame, min_df: int = 4, max_share: float = 0.22) -> DataFrame:
    """(id, termo, peso): the rows of the document-term matrix, IDF weights scaled to unit length. Documents without a term have no row."""
    n = docs.count()
    vocab = vocabulary(docs, min_df, max_share).withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)
    cells = docs.select("id", F.explode(topic_tokens(F.col("texto"))).alias("termo")).join(vocab.select("termo", "idf"), "termo")
    return cells.select("id", "termo", (F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("id")))).alias("peso"))


def numbered(cells: DataFrame, most: int = 2_000_000) -> tuple[list[str], DataFrame]:
    """(the terms of cells in order, staged rows (id, c: their (t, p) by number of term)).

    H is held whole, so more than ``most`` terms are an error: the bounds of ``vocabulary`` keep their number down.
    """
    n = cells.select("termo").distinct().count()
    if n > most:
        raise ValueError(f"{n} terms: raise min_df of the matrix")
    order = stage(cells.select("termo").distinct().withColumn("t", F.row_number().over(Window.orderBy("termo")) - 1), "termos-numerados")
    terms = [r["termo"] for r in order.orderBy("t").collect()]
    rows = cells.join(small(order), "termo").groupBy("id").agg(F.collect_list(F.struct("t", "peso")).alias("c"))
    return terms, stage(rows, "celulas")


def _groups(column: pa.Array, cells: int = 100_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, terms, weights, lengths) of whole rows of a column of (t, peso) lists, some ``cells`` at a time."""
    ends = np.cumsum(column.value_lengths().to_numpy())
    flat = column.flatten()
    terms, weights = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    first = 0
    while first < len(ends):
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + cells, "right")))
        yield first, last, terms[begin : ends[last - 1]], weights[begin : ends[last - 1]], np.diff(ends[first:last], prepend=begin)
        first = last


def _solved(terms: np.ndarray, weights: np.ndarray, lengths: np.ndarray, columns: np.ndarray, hh: np.ndarray, rounds: int) -> np.ndarray:
    """W of some documents by multiplicative updates; a document without cells has no row here."""
    num = np.add.reduceat(columns[terms] * weights[:, None], np.cumsum(lengths) - lengths)
    w = np.full((len(lengths), columns.shape[1]), 0.5)
    for _ in range(rounds):
        w = w * num / (w @ hh + 1e-9)
    return w


def factorize(cells: DataFrame, k: int = 12, rounds: int = 25, inner: int = 4, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """(terms, H) of the factorisation of cells (id, termo, peso) by multiplicative updates.

    Tasks solve W for their documents and give one partial of W'X and W'W each, an array per topic; the arrays are
    summed in two levels. Only those sums are gathered. H has k rows and one column per term. No cells give no terms.
    """
    terms, rows = numbered(cells)
    return terms, factors(rows, len(terms), k, rounds, inner, seed)


def factors(rows: DataFrame, size: int, k: int = 12, rounds: int = 25, inner: int = 4, seed: int = 42) -> np.ndarray:
    """H of the factorisation of numbered rows with so many terms."""
    if not size:
        return np.zeros((k, 0))
    h = np.random.default_rng(seed).uniform(0.01, 1.0, (k, size))
    sums, many = "k int, grupo int, s array<double>", rows.rdd.getNumPartitions() > 32

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "grupo": [pdf["grupo"].iloc[0]], "s": [np.sum(np.stack(pdf["s"].to_list()), axis=0)]})

    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(h)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wx, ww = np.zeros((k, size)), np.zeros((k, k))
            hh, columns = shared.value @ shared.value.T, np.ascontiguousarray(shared.value.T)
            for batch in batches:
                for _, _, idx, val, lengths in _groups(batch.column(0)):
                    w = _solved(idx, val, lengths, columns, hh, inner)
                    spread = np.repeat(w, lengths, axis=0) * val[:, None]
                    for j in range(k):
                        wx[j] += np.bincount(idx, spread[:, j], size)
                    ww += w.T @ w
            group = TaskContext.get().partitionId() % 16
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([group] * k, pa.int32()), pa.array(list(np.hstack([wx, ww])), pa.list_(pa.float64()))], names=["k", "grupo", "s"])

        parts = rows.select("c").mapInArrow(run, sums)
        if many:  # first within groups of tasks
            parts = parts.groupBy("k", "grupo").applyInPandas(add, sums)
        total = np.zeros((k, size + k))
        for r in parts.groupBy("k").applyInPandas(add, sums).collect():  # k rows
            total[r["k"]] = r["s"]
        shared.unpersist()
        h = h * total[:, :size] / (total[:, size:] @ h + 1e-9)
    return h


def topic_terms(terms: list[str], h: np.ndarray, top: int = 8) -> list[list[str]]:
    """The main terms of each topic, heaviest first, ties by term."""
    return [[terms[i] for i in sorted(range(len(terms)), key=lambda i: (-round(row[i], 9), terms[i]))[:top]] for row in h]


def assign_topics(rows: DataFrame, terms: list[str], h: np.ndarray, rounds: int = 20) -> DataFrame:
    """(id, id_topico, score, termos_chave) of numbered rows: the topic of largest weight (the lowest among equals), its share and its five main terms."""
    key_terms = [", ".join(t) for t in topic_terms(terms, h, 5)]
    shared = rows.sparkSession.sparkContext.broadcast(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hh, columns = shared.value @ shared.value.T, np.ascontiguousarray(shared.value.T)
        for batch in batches:
            for first, last, idx, val, lengths in _groups(batch.column(1)):
                w = _solved(idx, val, lengths, columns, hh, rounds)
                best, sums = w.argmax(axis=1), w.sum(axis=1)
                share = np.where(sums > 0, w.max(axis=1) / np.where(sums > 0, sums, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(best + 1, pa.int32()), pa.array(share), pa.array([key_terms[b] for b in best], pa.string())], names=["id", "id_topico", "score", "termos_chave"])

    return rows.select(F.col("id").cast("bigint"), "c").mapInArrow(run, "id bigint, id_topico int, score double, termos_chave string")


def saved_tokens(docs: DataFrame, words: Column, assumed: int = 32) -> DataFrame:
    """(documentos, tokens, poupados): the tokens kept of all documents, and how many fewer than ``assumed`` per document they are."""
    sums = docs.agg(F.count("*").alias("documentos"), F.coalesce(F.sum(F.size(words)), F.lit(0)).alias("tokens"))
    return sums.withColumn("poupados", F.greatest(F.lit(0).cast("bigint"), F.lit(assumed) * F.col("documentos") - F.col("tokens")))


def author_profiles(bridge: DataFrame, norma_topicos: DataFrame, labels: DataFrame, autores: DataFrame, min_normas: int = 5) -> DataFrame:
    """One row per author with at least min_normas classified norms: total, topics, main topic and its share, entropy, level, name and title.

    Only active links count; entropy is over the author's own topics. The main topic is the lowest among equals.
    """
    links = bridge.filter("ativo = 1").select("id_norma", "id_autor").distinct().join(norma_topicos.select("id_norma", "id_rotulo_topico").distinct(), "id_norma")
    counts = links.groupBy("id_autor", "id_rotulo_topico").agg(F.count("*").alias("n"))
    totals = counts.groupBy("id_autor").agg(F.sum("n").alias("total"), F.count("*").alias("topicos"), F.max_by("id_rotulo_topico", F.struct("n", -F.col("id_rotulo_topico"))).alias("principal"), F.max("n").alias("maior")).filter(F.col("total") >= min_normas)
    p = F.col("n") / F.col("total")
    entropy = counts.join(totals.select("id_autor", "total"), "id_autor").groupBy("id_autor").agg(F.sum(-p * F.log2(p)).alias("h"))
    relative = F.col("h") / F.log2(F.greatest(F.lit(2), F.col("topicos")))
    name = autores.groupBy("id").agg(F.max("nome").alias("nome")).withColumnRenamed("id", "id_autor")
    title = bridge.groupBy("id_autor").agg(F.max("cargo_autor").alias("cargo"))
    out = totals.join(entropy, "id_autor").join(labels.select(F.col("id").alias("principal"), F.col("nome").alias("rotulo")), "principal", "left").join(name, "id_autor", "left").join(title, "id_autor", "left")
    r = F.round(relative, 6)
    return out.select(
        "id_autor",
        F.coalesce("nome", F.concat(F.lit("Autor #"), F.col("id_autor").cast("string"))).alias("nome"),
        F.coalesce("cargo", F.lit("Não especificado")).alias("cargo"),
        "total",
        "topicos",
        F.coalesce("rotulo", F.lit("")).alias("rotulo"),
        F.round(F.col("maior") * 100.0 / F.col("total"), 4).alias("percentual"),
        r.alias("entropia"),
        F.when(r < 0.35, "alta").when(r < 0.70, "media").otherwise("baixa").alias("especializacao"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(real, previsto, n) of pairs (real, previsto)."""
    return pairs.groupBy("real", "previsto").agg(F.count("*").alias("n"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """(classe, precisao, revocacao, f1, suporte) over the union of both label sets, then the rows 'acuracia', 'macro' and 'ponderada'.

    Divisions by zero count as 0. No pairs give no class rows and averages of null.
    """
    c = confusion(pairs)
    real = c.groupBy(F.col("real").alias("classe")).agg(F.sum("n").alias("suporte"))
    said = c.groupBy(F.col("previsto").alias("classe")).agg(F.sum("n").alias("ditos"))
    hits = c.filter("real = previsto").select(F.col("real").alias("classe"), F.col("n").alias("acertos"))
    each = real.join(said, "classe", "full").join(hits, "classe", "left").na.fill(0, ["suporte", "ditos", "acertos"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = each.withColumn("p", ratio(F.col("acertos"), F.col("ditos"))).withColumn("r", ratio(F.col("acertos"), F.col("suporte"))).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    six = lambda x: F.round(x, 6)
    rows = each.select("classe", six("p").alias("precisao"), six("r").alias("revocacao"), six("f").alias("f1"), "suporte")
    n = F.sum("suporte")
    total = each.agg(n.alias("n"), (F.sum("acertos") / n).alias("a"), *[F.avg(x).alias("m" + x) for x in "prf"], *[(F.sum(F.col(x) * F.col("suporte")) / n).alias("w" + x) for x in "prf"])
    extra = F.array(*[F.struct(F.lit(label).alias("classe"), *[six(F.col(x)).alias(y) for x, y in zip(cols, ("precisao", "revocacao", "f1"))], F.col("n").alias("suporte")) for label, cols in (("~acuracia", ("a", "a", "a")), ("~macro", ("mp", "mr", "mf")), ("~ponderada", ("wp", "wr", "wf")))])
    return rows.unionByName(total.select(F.explode(extra).alias("x")).select("x.*"))
