"""Text reductions: term selections and extractive summaries. Each gives (id, texto) per document of docs (id, texto, classe).

Selections and summaries by weights are plans of aggregations and joins. Iterative ones (TextRank, latent
semantics, sentence clusters) work on one document at a time; their documents arrive with the IDF of their terms
attached, so nothing of the vocabulary's size is broadcast. Scores are rounded to ``DIGITS`` before ranking, so that
ties fall to the term (or the earlier sentence) whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import sentences, tokens
from tabularium.operators import stats
from tabularium.session import stage

DIGITS = 6


def _once(docs: DataFrame) -> DataFrame:
    """docs stored, so that statistics and scores don't each read and clean the collection anew."""
    return docs if getattr(docs, "_staged_path", None) else stage(docs.select("id", "texto", "classe"), "resumos")


def _complete(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.select("id").join(found, "id", "left").select("id", F.coalesce("texto", F.lit("")).alias("texto"))


def _top_terms(scored: DataFrame, k: int) -> DataFrame:
    """(id, texto): the k terms of highest score, ties by term."""
    order = F.array_sort(F.collect_list(F.struct((-F.round("score", DIGITS)).alias("m"), "termo")))
    return scored.groupBy("id").agg(order.alias("a")).select("id", F.array_join(F.transform(F.slice("a", 1, k), lambda x: x["termo"]), " ").alias("texto"))


def _best_sentence(docs: DataFrame, scores: DataFrame, factor: Column | None = None, m: int = 1) -> DataFrame:
    """(id, texto): the m sentences of highest score (id, frase, score), the earlier of equal ones, in their order in the text."""
    split = docs.select("id", F.posexplode(sentences(F.col("texto"))).alias("frase", "s")).join(scores, ["id", "frase"], "left")
    score = F.round(F.coalesce("score", F.lit(0.0)) * (factor if factor is not None else F.lit(1.0)), DIGITS)
    if m == 1:
        return split.groupBy("id").agg(F.min_by("s", F.struct(-score, "frase")).alias("texto"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("m"), "frase", "s"))), 1, m)
    in_order = F.array_sort(F.transform(best, lambda x: F.struct(x["frase"].alias("frase"), x["s"].alias("s"))))
    return split.groupBy("id").agg(in_order.alias("a")).select("id", F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("texto"))


def _weighted(docs: DataFrame, n: int) -> DataFrame:
    """(id, frase, termo, w): the summed IDF of a term in a sentence."""
    counted = stats.sentence_tokens(docs).groupBy("id", "frase", "termo").agg(F.count("*").alias("c"))
    return stats.join_terms(counted, stats.with_idf(stats.document_frequency(docs), n), n).select("id", "frase", "termo", "c", (F.col("c") * F.col("idf")).alias("w"))


def tfidf_topk(docs: DataFrame, k: int = 7, stopwords: bool = False) -> DataFrame:
    """The k terms of highest TF-IDF. With stop words kept, those get the IDF of unseen terms."""
    docs = _once(docs)
    n = docs.count()
    lists = docs.select("id", tokens(F.col("texto"), stopwords).alias("t"))
    toks = lists.select("id", F.explode("t").alias("termo"), F.size("t").alias("total"))
    counted = toks.groupBy("id", "termo").agg(F.count("*").alias("c"), F.first("total").alias("total"))
    joined = stats.join_terms(counted, stats.with_idf(stats.document_frequency(docs), n), n)
    scored = joined.withColumn("score", F.col("c") / F.col("total") * F.coalesce("idf", F.lit(stats.unseen_idf(n))))
    return _complete(docs, _top_terms(scored, k))


def extractive_summary(docs: DataFrame, m: int = 1) -> DataFrame:
    """The m sentences of highest summed IDF over the root of their token count."""
    docs = _once(docs)
    scores = _weighted(docs, docs.count()).groupBy("id", "frase").agg((F.sum("w") / F.sqrt(F.sum("c"))).alias("score"))
    return _best_sentence(docs, scores, m=m)


def position_summary(docs: DataFrame, m: int = 1) -> DataFrame:
    """As the extractive summary, with weight 1 + 1/(position + 1) for early sentences."""
    docs = _once(docs)
    scores = _weighted(docs, docs.count()).groupBy("id", "frase").agg((F.sum("w") / F.sqrt(F.sum("c"))).alias("score"))
    return _best_sentence(docs, scores, 1.0 + 1.0 / (F.col("frase") + 1.0), m)


def mmr_summary(docs: DataFrame, relevance: float = 0.65, m: int = 1) -> DataFrame:
    """The m sentences of maximal marginal relevance, in their order in the text.

    The first one is the one most like the whole document; for it alone no sentences are compared with each other.
    """
    if m > 1:

        @F.pandas_udf("string")
        def run(texts: pd.Series, parts: pd.Series, terms: pd.Series, idfs: pd.Series) -> pd.Series:
            return pd.Series([" ".join(s[i] for i in select_mmr([list(x) for x in p], dict(zip(t, i)) if t is not None else {}, m, relevance)) for s, p, t, i in zip(texts, parts, terms, idfs)])

        return _with_parts(docs).select("id", run("frases", "partes", "termos", "idfs").alias("texto"))
    docs = _once(docs)
    w = _weighted(docs, docs.count())
    whole = w.groupBy("id", "termo").agg(F.sum("w").alias("v"))
    length = whole.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nd"))
    sims = w.join(whole, ["id", "termo"]).groupBy("id", "frase").agg(F.sum(F.col("w") * F.col("v")).alias("p"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ns")).join(length, "id")
    return _best_sentence(docs, sims.select("id", "frase", (relevance * F.col("p") / (F.col("ns") * F.col("nd"))).alias("score")))


def centrality_summary(docs: DataFrame, m: int = 1) -> DataFrame:
    """The m sentences of highest summed cosine to the others, as one product with the sum of all unit sentences."""
    docs = _once(docs)
    w = _weighted(docs, docs.count())
    norms = w.groupBy("id", "frase").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ns"))
    u = w.join(norms, ["id", "frase"]).select("id", "frase", "termo", (F.col("w") / F.col("ns")).alias("u"))
    total = u.groupBy("id", "termo").agg(F.sum("u").alias("t"))
    scores = u.join(total, ["id", "termo"]).groupBy("id", "frase").agg((F.sum(F.col("u") * F.col("t")) - 1.0).alias("score"))
    return _best_sentence(docs, scores, m=m)


def feature_selection(docs: DataFrame, min_df: int = 2, most: int = 8) -> DataFrame:
    """The first terms that occur in at least min_df documents, in order; all terms where none does."""
    docs = _once(docs)
    n = docs.count()
    first = docs.select("id", F.posexplode(tokens(F.col("texto"))).alias("pos", "termo")).groupBy("id", "termo").agg(F.min("pos").alias("pos"))
    items = stats.join_terms(first, stats.document_frequency(docs), n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "termo", "df"))).alias("a"))
    kept = F.filter("a", lambda x: x["df"] >= min_df)
    return _complete(docs, items.select("id", F.array_join(F.transform(F.slice(F.when(F.size(kept) > 0, kept).otherwise(F.col("a")), 1, most), lambda x: x["termo"]), " ").alias("texto")))


def class_terms(docs: DataFrame, measure: str = "chi2", k: int = 7) -> DataFrame:
    """The k terms that tell the classes apart best, by 'chi2' or 'mi'."""
    docs = _once(docs)
    n = docs.count()
    each = docs.select("id", F.explode(F.array_distinct(tokens(F.col("texto")))).alias("termo"))
    return _complete(docs, _top_terms(stats.join_terms(each, stats.class_scores(docs, n), n).withColumn("score", F.col(measure)), k))


def cooccurrence(docs: DataFrame, window: int = 3) -> DataFrame:
    """(id, a, b, peso) with a < b: how often two different terms of a document stand within window places."""
    toks = F.col("t")
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.size(toks) - 2), lambda i: F.transform(F.slice(toks, i + 2, window), lambda y: F.struct(F.least(F.get(toks, i), y).alias("a"), F.greatest(F.get(toks, i), y).alias("b")))))
    pairs = docs.select("id", tokens(F.col("texto")).alias("t")).filter(F.size("t") >= 2).select("id", F.explode(near).alias("p"))
    return pairs.filter("p.a <> p.b").groupBy("id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("peso"))


def rank_terms(words: list[str], k: int = 7, window: int = 3, damping: float = 0.85, rounds: int = 30, still: float = 1e-4) -> list[str]:
    """The k terms of highest TextRank in one document; at most k tokens are returned as they stand."""
    if len(words) <= k:
        return words
    import numpy as np

    names = list(dict.fromkeys(words))
    at = {w: i for i, w in enumerate(names)}
    codes = np.array([at[w] for w in words])
    pairs = [(codes[:-g], codes[g:]) for g in range(1, window + 1) if len(codes) > g]
    x, y = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
    x, y = x[x != y], y[x != y]
    src, dst = np.concatenate([x, y]), np.concatenate([y, x])
    weight = np.bincount(src, minlength=len(names)).astype(float)
    score = np.ones(len(names))
    for _ in range(rounds):
        share = np.divide(score, weight, out=np.zeros_like(score), where=weight > 0)
        new = 1 - damping + damping * np.bincount(dst, weights=share[src], minlength=len(names))
        moved = float(np.abs(new - score).max())
        score = new
        if moved < still:
            break
    return [w for _, w in sorted(zip(-np.round(score, DIGITS), names))[:k]]


def latent_terms(parts: list[list[str]], idf: dict[str, float], k: int = 7, rounds: int = 25) -> list[str]:
    """The k terms with the largest loadings on the first latent dimension of one document's term-sentence matrix."""
    import numpy as np

    names = list(dict.fromkeys(w for p in parts for w in p))
    if len(names) <= k:
        return names
    at = {w: i for i, w in enumerate(names)}
    a = np.zeros((len(names), len(parts)))
    for j, p in enumerate(parts):
        for w in p:
            a[at[w], j] += idf[w] / len(p)
    v = np.full(len(names), 1 / np.sqrt(len(names)))
    for _ in range(rounds):
        new = a @ (a.T @ v)
        size = float(np.sqrt(new @ new))
        if size <= 1e-12:
            break
        v = new / size
    return [w for _, w in sorted(zip(-np.round(np.abs(v), DIGITS), names))[:k]]


def cluster_sentences(texts: list[str], parts: list[list[str]], idf: dict[str, float], k: int = 2, rounds: int = 15) -> str:
    """One representative sentence per cluster of a document's sentences, in order."""
    import numpy as np

    if len(texts) <= 1:
        return texts[0] if texts else ""
    names = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    x = np.zeros((len(parts), max(len(names), 1)))
    for j, p in enumerate(parts):
        for w in p:
            x[j, names[w]] += idf[w]
    k = min(k, len(texts))
    centres, own = x[:k].copy(), np.full(len(texts), -1)
    for n in range(rounds):
        new = np.round(np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1), 9).argmin(axis=1)
        moved = bool((new != own).any())
        own = new
        if not moved and n > 0:
            break
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    chosen = []
    for c in range(k):
        members = np.flatnonzero(own == c)
        if len(members):
            chosen.append(int(members[np.round(np.sqrt(((x[members] - centres[c]) ** 2).sum(axis=1)), 9).argmin()]))
    return " ".join(texts[i] for i in sorted(chosen))


def _weights(parts: list[list[str]], idf: dict[str, float]) -> list[dict[str, float]]:
    """The summed IDF of each term of each sentence."""
    out = []
    for p in parts:
        own: dict[str, float] = {}
        for w in p:
            own[w] = own.get(w, 0.0) + idf[w]
        out.append(own)
    return out


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    size = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
    if size <= 0:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(x * b[w] for w, x in a.items() if w in b) / size**0.5


def _total(vectors: list[dict[str, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for v in vectors:
        for w, x in v.items():
            out[w] = out.get(w, 0.0) + x
    return out


def select_mmr(parts: list[list[str]], idf: dict[str, float], m: int = 1, relevance: float = 0.65) -> list[int]:
    """The places of the m sentences of maximal marginal relevance: like the document, unlike those already chosen; ties go to the earlier."""
    vectors = _weights(parts, idf)
    whole = _total(vectors)
    like = [_cosine(v, whole) for v in vectors]
    near = [0.0] * len(parts)
    chosen: list[int] = []
    while len(chosen) < min(m, len(parts)):
        scores = [-round(relevance * like[i] - (1 - relevance) * near[i], DIGITS) for i in range(len(parts))]
        best = min((i for i in range(len(parts)) if i not in chosen), key=lambda i: (scores[i], i))
        chosen.append(best)
        near = [max(x, _cosine(v, vectors[best])) for x, v in zip(near, vectors)]
    return sorted(chosen)


def _top(scores: dict[str, float], k: int) -> str:
    return " ".join(w for w, _ in sorted(scores.items(), key=lambda x: (-round(x[1], DIGITS), x[0]))[:k])


def _ranked(texts: list[str], scores: list[float], m: int) -> str:
    best = sorted(range(len(texts)), key=lambda i: (-round(scores[i], DIGITS), i))[:m]
    return " ".join(texts[i] for i in sorted(best))


def reduce_document(texts: list[str], parts: list[list[str]], words: list[str], every: list[str], known: dict[str, tuple], unseen: float, k: int = 7, m: int = 1, most: int = 8) -> dict[str, str]:
    """The twelve reductions of one document.

    texts are its sentences, parts their tokens, words its tokens, every those with stop words; known gives the
    statistics (df, idf, chi2, mi) of each of its tokens, unseen the IDF of stop words.
    """
    idf = {w: x[1] for w, x in known.items()}
    vectors = _weights(parts, idf)
    heavy = [sum(v.values()) / len(p) ** 0.5 if p else 0.0 for v, p in zip(vectors, parts)]
    units = []
    for v in vectors:
        size = sum(x * x for x in v.values()) ** 0.5
        units.append({w: x / size for w, x in v.items()} if size else {})
    summed = _total(units)
    central = [sum(x * summed[w] for w, x in u.items()) - 1.0 if u else 0.0 for u in units]
    order = list(dict.fromkeys(words))
    shared = [w for w in order if known[w][0] >= 2]

    def frequency(tokens: list[str]) -> dict[str, float]:
        counts: dict[str, int] = {}
        for w in tokens:
            counts[w] = counts.get(w, 0) + 1
        return {w: c / len(tokens) * idf.get(w, unseen) for w, c in counts.items()}

    return {
        "stopwords_tfidf_topk": _top(frequency(words), k),
        "tfidf_topk": _top(frequency(every), k),
        "resumo_extrativo_tfidf": _ranked(texts, heavy, m),
        "textrank": " ".join(rank_terms(words, k)),
        "tfidf_posicao_sentenca": _ranked(texts, [s * (1 + 1 / (i + 1)) for i, s in enumerate(heavy)], m),
        "tfidf_mmr": " ".join(texts[i] for i in select_mmr(parts, idf, m)),
        "tfidf_similaridade_frases": _ranked(texts, central, m),
        "svd_lsa": " ".join(latent_terms(parts, idf, k)),
        "tfidf_feature_selection": " ".join((shared or order)[:most]),
        "chi_square_termos": _top({w: known[w][2] for w in order}, k),
        "mutual_information": _top({w: known[w][3] for w in order}, k),
        "clustering_sentencas": cluster_sentences(texts, parts, idf),
    }


def textrank(docs: DataFrame, k: int = 7, window: int = 3) -> DataFrame:
    """TextRank terms of each document; the graph never leaves its document."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: " ".join(rank_terms(list(w), k, window)))

    return docs.select("id", run(tokens(F.col("texto"))).alias("texto"))


def _with_parts(docs: DataFrame) -> DataFrame:
    """(id, texto, termos, idfs): the distinct terms of each document with their IDF attached."""
    docs = _once(docs)
    n = docs.count()
    each = docs.select("id", F.explode(F.array_distinct(tokens(F.col("texto")))).alias("termo"))
    known = stats.join_terms(each, stats.with_idf(stats.document_frequency(docs), n), n).groupBy("id").agg(F.collect_list("termo").alias("termos"), F.collect_list("idf").alias("idfs"))
    parts = F.transform(sentences(F.col("texto")), lambda s: tokens(s))
    return docs.select("id", sentences(F.col("texto")).alias("frases"), parts.alias("partes")).join(known, "id", "left")


def lsa_terms(docs: DataFrame, k: int = 7) -> DataFrame:
    """Terms of the first latent dimension of each document."""

    @F.pandas_udf("string")
    def run(parts: pd.Series, terms: pd.Series, idfs: pd.Series) -> pd.Series:
        return pd.Series([" ".join(latent_terms([list(x) for x in p], dict(zip(t, i)), k)) if t is not None else "" for p, t, i in zip(parts, terms, idfs)])

    return _with_parts(docs).select("id", run("partes", "termos", "idfs").alias("texto"))


def sentence_clusters(docs: DataFrame, k: int = 2) -> DataFrame:
    """Representative sentences of each document's sentence clusters."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, parts: pd.Series, terms: pd.Series, idfs: pd.Series) -> pd.Series:
        return pd.Series([cluster_sentences(list(s), [list(x) for x in p], dict(zip(t, i)) if t is not None else {}, k) for s, p, t, i in zip(texts, parts, terms, idfs)])

    return _with_parts(docs).select("id", run("frases", "partes", "termos", "idfs").alias("texto"))


#: The twelve reductions by the name of their stored column.
STRATEGIES = {
    "stopwords_tfidf_topk": tfidf_topk,
    "tfidf_topk": lambda docs: tfidf_topk(docs, stopwords=True),
    "resumo_extrativo_tfidf": extractive_summary,
    "textrank": textrank,
    "tfidf_posicao_sentenca": position_summary,
    "tfidf_mmr": mmr_summary,
    "tfidf_similaridade_frases": centrality_summary,
    "svd_lsa": lsa_terms,
    "tfidf_feature_selection": feature_selection,
    "chi_square_termos": class_terms,
    "mutual_information": lambda docs: class_terms(docs, "mi"),
    "clustering_sentencas": sentence_clusters,
}


def all_reductions(docs: DataFrame, k: int = 7, m: int = 1) -> DataFrame:
    """(id, one column per reduction) of every document, in one pass.

    Documents are stored once and split into words once; the statistics of all terms are one table, joined with the
    distinct terms of each document once; a document's reductions are then made together, in Arrow batches.
    """
    docs = _once(docs)
    n = docs.count()
    each = docs.select("id", F.explode(F.array_distinct(tokens(F.col("texto")))).alias("termo"))
    facts = stats.join_terms(each, stats.with_idf(stats.class_scores(docs, n), n), n)
    known = facts.groupBy("id").agg(F.collect_list(F.struct("termo", "df", "idf", "chi2", "mi")).alias("fatos"))
    parts = F.transform(sentences(F.col("texto")), lambda s: tokens(s))
    text = F.struct(sentences(F.col("texto")).alias("frases"), parts.alias("partes"), tokens(F.col("texto")).alias("palavras"), tokens(F.col("texto"), True).alias("todas"))
    return _apply(docs.select("id", text.alias("t")).join(known, "id", "left"), stats.unseen_idf(n), k, m)


def _apply(rows: DataFrame, unseen: float, k: int, m: int) -> DataFrame:
    """The reductions of rows (id, t: sentences and words, fatos: the statistics of its terms)."""
    schema = rows.select("id").schema
    for c in STRATEGIES:
        schema = schema.add(c, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {x["termo"]: (x["df"], x["idf"], x["chi2"], x["mi"]) for x in f or []}
                made.append(reduce_document(t["frases"], t["partes"], t["palavras"], t["todas"], own, unseen, k, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in made], pa.string()) for c in STRATEGIES]], names=["id", *STRATEGIES])

    return rows.select("id", "t", "fatos").mapInArrow(run, schema)
