"""Operators against literal cases and plain Python versions."""

import math
import os
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tabularium.operators import embeddings, extraction, reductions, stats, topics, upsert

DOCS = [
    (1, "DISPÕE SOBRE A CRIAÇÃO DO PARQUE MUNICIPAL E DÁ OUTRAS PROVIDÊNCIAS.", "Decreto"),
    (2, "INSTITUI O PROGRAMA DE EDUCAÇÃO AMBIENTAL NAS ESCOLAS PÚBLICAS MUNICIPAIS.", "Lei Ordinária"),
    (3, "REGULAMENTA O SISTEMA DE TRANSPORTE PÚBLICO E TRÂNSITO URBANO.", "Decreto"),
    (4, "AUTORIZA A ABERTURA DE CRÉDITO ADICIONAL SUPLEMENTAR PARA SAÚDE.", "Decreto"),
    (5, "DISPÕE SOBRE A PRESERVAÇÃO DO MEIO AMBIENTE E PROTEÇÃO DAS ÁREAS VERDES.", "Lei Ordinária"),
    (6, "DISPÕE SOBRE A CRIAÇÃO DO PARQUE MUNICIPAL E PRESERVAÇÃO AMBIENTAL. REGULAMENTA O ACESSO PÚBLICO.", "Decreto"),
    (7, "!!!", "Decreto"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, texto string, classe string")


def test_relation_classes(spark):
    cases = {
        "norma revogada em parte pelo": "REVOGACAO",
        "Ficam revogadas as seguintes normas:": "REVOGACAO",
        "passa a vigorar com o texto do": "ALTERACAO",
        "com a seguinte REDAÇÃO, vinda da": "ALTERACAO",
        "tabela substituída; SUBSTITUI a do": "ALTERACAO",
        "parágrafo incluído pelo": "ACRESCIMO",
        "regulamentação da": "REGULAMENTACAO",
        "em conformidade com a": "BASE_LEGAL",
        "(veja o": "VIDE",
        "prazo cuja prorrogação consta da": "SUSPENSAO_PRORROGACAO",
        "suspende os efeitos da": "SUSPENSAO_PRORROGACAO",
        "alterada e depois revogada pela": "REVOGACAO",
        "segundo o anexo da": "REFERENCIA",
        "": "REFERENCIA",
        None: "REFERENCIA",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select(extraction.relation_class(F.col("c"))).collect()
    assert [r[0] for r in rows] == list(cases.values())


def test_links():
    html = '<p>Altera a <a href="https://x/sao-paulo/lei/lei-ordinaria/2013/9/15764" data-id="7">Lei</a> e <a name="y">nada</a> <A HREF=\'/z\'>z</A></p>'
    found = extraction.find_links(html)
    assert [(f["url"], f["data_id"]) for f in found] == [("https://x/sao-paulo/lei/lei-ordinaria/2013/9/15764", 7), ("/z", None)]
    assert found[0]["contexto"] == "Altera a" and extraction.find_links(None) == []
    odd = extraction.find_links("<abbr href=x>n</abbr> <a data-id=12 href=/p?a=1&amp;b=2>t</a> <a href='a b'>u</a> <a href=''>v</a> <a href=/aberto>")
    assert [(f["url"], f["data_id"]) for f in odd] == [("/p?a=1&b=2", 12), ("a b", None)]
    assert len(extraction.find_links("<a href=/x>y</a>" * 3000)) == 3000


def test_address_parts(spark):
    cases = {
        "https://x.org/sao-paulo/lei/lei-ordinaria/2013/9/15764": ("lei-ordinaria", 2013, 15764),
        "/sao-paulo/decreto/2015/56123": ("decreto", 2015, None),
        "/Sao-Paulo/DECRETO/2015/x/56123a": ("decreto", 2015, 56123),
        "/sao-paulo/decreto": ("decreto", None, None),
        "/outra/decreto/2015/x/1": (None, None, None),
        "": (None, None, None),
        None: (None, None, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "u string").select(*extraction.address_parts(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == list(cases.values())
    free = spark.createDataFrame([("https://h/decreto/2020/a/7",)], "u string").select(*extraction.address_parts(F.col("u"), None)).first()
    assert tuple(free) == ("decreto", 2020, 7)


def test_citation_edges_resolve_by_id_then_key(spark):
    docs = spark.createDataFrame([(1, 'Altera a <a href="/sao-paulo/decreto/2015/x/56123">d</a> e <a href="/q" data-id="9">q</a> <a href="/q" data-id="8">q</a>'), (2, None)], "id bigint, integra string")
    targets = spark.createDataFrame([(5, "DECRETO", 2015, 56123), (4, "DECRETO", 2015, 56123), (9, None, None, None)], "id bigint, tiposlug string, ano int, numero int")
    rows = extraction.citation_edges(docs, targets).select("id_norma_destino", "tipo_relacionamento").collect()
    assert sorted((r[0] or 0, r[1]) for r in rows) == [(0, "ALTERACAO"), (5, "ALTERACAO"), (9, "ALTERACAO")]


def test_signatures(spark):
    html = "x<br>PREFEITURA DO MUNIC&Iacute;PIO DE S&Atilde;O PAULO, aos 3<br />JOÃO DA SILVA, Prefeito<br>MARIA SOUZA<br>secretária de obras<br>ana b, 3º chefe<br>Publicado na Secretaria do Governo Municipal<br>OUTRO NOME, Prefeito"
    rows = extraction.signatures(spark.createDataFrame([(1, html), (2, "nada"), (3, None)], "id bigint, integra string")).collect()
    assert {(r["id"], r["nome"], r["cargo"]) for r in rows} == {(1, "JOÃO DA SILVA", "Prefeito"), (1, "MARIA SOUZA", "secretária de obras")}


def test_statistics_match_plain_counts(spark, docs):
    n = docs.count()
    toks = {r["id"]: set(r["t"]) for r in docs.select("id", stats.tokens(F.col("texto")).alias("t")).collect()}
    df = Counter(w for t in toks.values() for w in t)
    got = {r["termo"]: r for r in stats.with_idf(stats.document_frequency(docs), n).collect()}
    assert {w: r["df"] for w, r in got.items()} == dict(df)
    assert all(abs(r["idf"] - (math.log((n + 1) / (df[w] + 1)) + 1)) < 1e-12 for w, r in got.items())
    classes = {d[0]: d[2] for d in DOCS}
    sizes = Counter(classes.values())
    for r in stats.class_scores(docs, n).collect():
        best = 0.0
        for c, size in sizes.items():
            a = sum(r["termo"] in toks[i] and classes[i] == c for i in toks)
            b, cc = df[r["termo"]] - a, size - a
            d = n - a - b - cc
            den = (a + b) * (a + cc) * (b + d) * (cc + d)
            best = max(best, n * (a * d - b * cc) ** 2 / den if den else 0)
        assert abs(best - r["chi2"]) < 1e-9


def test_reductions_fill_every_column(docs):
    rows = {r["id"]: r.asDict() for r in reductions.all_reductions(docs).collect()}
    assert len(rows) == len(DOCS)
    for name in reductions.STRATEGIES:
        assert all(rows[i][name] for i in range(1, 7)), name
    assert rows[7]["textrank"] == "" and rows[7]["stopwords_tfidf_topk"] == ""
    assert "dispõe" not in rows[6]["stopwords_tfidf_topk"].split()
    assert len(rows[6]["textrank"].split()) <= 7


def test_single_reductions_equal_the_pipeline(docs):
    rows = {r["id"]: r for r in reductions.all_reductions(docs).collect()}
    for name, reduce in reductions.STRATEGIES.items():
        assert {r["id"]: r["texto"] or "" for r in reduce(docs).collect()} == {i: r[name] for i, r in rows.items()}, name
    assert reductions.all_reductions(docs.limit(0)).count() == 0


def test_summaries_of_several_sentences(spark):
    text = "Cria o parque municipal e o parque verde. Cria o parque municipal e o parque verde. Abre crédito suplementar para saúde. Fim."
    docs = spark.createDataFrame([(1, text, "a"), (2, "Uma só frase aqui", "a"), (3, "", "b")], "id bigint, texto string, classe string")
    parts = text.split(". ")
    both = reductions.all_reductions(docs, m=2)
    for name, reduce in (("resumo_extrativo_tfidf", reductions.extractive_summary), ("tfidf_posicao_sentenca", reductions.position_summary), ("tfidf_mmr", reductions.mmr_summary), ("tfidf_similaridade_frases", reductions.centrality_summary)):
        alone = {r["id"]: r["texto"] for r in reduce(docs, m=2).collect()}
        assert {i: t or "" for i, t in alone.items() if i < 3} == {r["id"]: r[name] for r in both.collect() if r["id"] < 3}, name
        assert alone[2] == "Uma só frase aqui"
    assert reductions.extractive_summary(docs.filter("id = 1"), m=9).first()["texto"] == text
    # the second sentence repeats the first: relevance alone takes it, marginal relevance doesn't
    texts = {r: reductions.mmr_summary(docs.filter("id = 1"), relevance=r, m=2).first()["texto"] for r in (1.0, 0.5)}
    assert texts[1.0] == f"{parts[0]}. {parts[1]}." and texts[0.5] == f"{parts[0]}. {parts[2]}."


def test_textrank_equals_the_power_iteration():
    words = "a1 b1 c1 a1 d1 e1 b1 f1 a1 c1 g1 h1 b1 d1".split()
    weight = Counter()
    for i, x in enumerate(words):
        for y in words[i + 1 : i + 4]:
            if x != y:
                weight[x, y] += 1
                weight[y, x] += 1
    score = dict.fromkeys(words, 1.0)
    total = {x: sum(n for (a, _), n in weight.items() if a == x) for x in score}
    for _ in range(30):
        new = {x: 0.15 + 0.85 * sum(n / total[a] * score[a] for (a, b), n in weight.items() if b == x) for x in score}
        done = max(abs(new[x] - score[x]) for x in score) < 1e-4
        score = new
        if done:
            break
    assert reductions.rank_terms(words, 5) == sorted(score, key=lambda x: (-round(score[x], 6), x))[:5]


def test_textrank_is_a_fixed_point():
    words = "orçamento anual estimando receita fixando despesa município receita anual".split()
    assert reductions.rank_terms(words[:3], 7) == words[:3]
    assert len(reductions.rank_terms(words, 3, 2)) == 3


def test_sentence_clusters_and_latent_terms():
    parts = [["a1", "b1"], ["a1", "b1"], ["c1", "d1", "e1", "f1", "g1", "h1"]]
    idf = {w: 1.0 for p in parts for w in p}
    assert reductions.cluster_sentences(["x", "y", "z"], parts, idf) in ("x z", "y z", "x y")
    assert reductions.cluster_sentences([], [], {}) == "" and reductions.cluster_sentences(["x"], [[]], {}) == "x"
    assert len(reductions.latent_terms(parts, idf, 7)) == 7
    assert reductions.latent_terms([["a1"]], idf, 7) == ["a1"]


def test_embeddings():
    a = embeddings.embed("denominação praça república".split())
    b = embeddings.embed("crédito suplementar orçamento educação".split())
    assert len(a) == 128 and abs(np.linalg.norm(a) - 1) < 1e-6 and np.dot(a, b) < 0.99
    assert embeddings.embed([]) == [0.0] * 128


def test_generator_draws():
    dice = embeddings.Lcg(42)
    assert [dice.integer(10) for _ in range(3)] == [0, 3, 8]


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(1)
    base = np.eye(3)
    rows = [(i, (base[i % 3] + rng.normal(0, 0.05, 3)).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "id bigint, vetor array<double>")
    c = embeddings.kmeans(v, 3)
    got = {r["id"]: r["cluster"] for r in embeddings.assign(v, c).collect()}
    assert len({(i % 3, k) for i, k in got.items()}) == 3
    report = embeddings.cluster_report(embeddings.assign(v, c)).collect()
    assert sum(r["tamanho"] for r in report) == 60 and all(-1 <= r["coesao"] <= 1 and r["inercia"] >= 0 for r in report)
    assert embeddings.kmeans(v.limit(0), 3).shape == (0, 0)
    with pytest.raises(ValueError):
        embeddings.kmeans(v, 0)


def test_kmeans_draws_its_start_over_all_rows(spark):
    # the first 20,000 ids are all alike, the other groups come later
    x = np.zeros((20_060, 3))
    x[:20_000, 0] = 1
    x[range(20_000, 20_060), np.arange(60) % 2 + 1] = 1
    v = spark.range(20_060).select("id", F.expr("array(CAST(id < 20000 AS DOUBLE), CAST(id >= 20000 AND id % 2 = 0 AS DOUBLE), CAST(id >= 20000 AND id % 2 = 1 AS DOUBLE)) AS vetor"))
    dice = embeddings.Lcg(42)
    chosen = [dice.integer(len(x))]
    while len(chosen) < 3:
        far = (1 - x @ x[chosen].T).min(axis=1) ** 2
        chosen.append(int(np.searchsorted(np.cumsum(far), dice.real() * far.sum())))
    assert embeddings.kmeans(v, 3).tolist() == x[chosen].tolist()


def test_kmeans_keeps_the_workers(spark):
    def pids():
        def run(batches):
            for batch in batches:
                time.sleep(0.5)  # so that every core has its own worker
                yield pa.RecordBatch.from_arrays([pa.array([os.getpid()])], names=["pid"])

        return {r["pid"] for r in spark.range(0, 4, 1, 4).mapInArrow(run, "pid bigint").collect()}

    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "id bigint, vetor array<double>").repartition(4).persist()
    v.count()
    before = pids()
    embeddings.kmeans(v, 6)
    # a task that leaves part of its input ends its worker, and the next pass has to start and import anew
    assert len(before & pids()) >= 2
    v.unpersist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_kmeans_draws_over_many_sections(spark, monkeypatch, kind):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 48)
    monkeypatch.setattr(embeddings, "SECTION", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)).astype("float32").astype(float)
    x[::7, 1] = 0
    rows = [(i, [None if j == 1 and i % 7 == 0 else float(y) for j, y in enumerate(r)]) for i, r in enumerate(x)]
    rng.shuffle(rows)
    v = spark.createDataFrame([*rows, (-1, None)], f"id bigint, vetor array<{kind}>").repartition(5)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    dice = embeddings.Lcg(42)
    chosen = [dice.integer(len(u))]
    while len(chosen) < 5:
        far = np.maximum(0, 1 - u @ u[chosen].T).min(axis=1) ** 2
        chosen.append(int(np.searchsorted(np.cumsum(far), dice.real() * far.sum())))
    assert np.allclose(embeddings.kmeans(v, 5, rounds=0), u[chosen], rtol=0, atol=1e-12)
    c = u[chosen]
    for _ in range(100):
        own = (u @ c.T).argmax(axis=1)
        new = np.stack([u[own == j].sum(axis=0) for j in range(5)])
        new /= np.sqrt((new * new).sum(axis=1, keepdims=True))
        moved = (1 - (new * c).sum(axis=1)).max()
        c = new
        if moved < 1e-5:
            break
    got = embeddings.kmeans(v, 5)
    assert np.allclose(got, c, rtol=0, atol=1e-9)
    assert {r["id"]: r["cluster"] for r in embeddings.assign(v, got).collect()} == dict(enumerate((u @ c.T).argmax(axis=1).tolist()))


def test_vectors_of_another_length_are_errors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 0.0])], "id bigint, vetor array<double>").repartition(1)
    with pytest.raises(ValueError):
        embeddings.kmeans(v, 2)
    with pytest.raises(PythonException):
        embeddings.assign(v, np.eye(2)).collect()
    with pytest.raises(ValueError):
        embeddings.kmeans(v.select("id", F.array().cast("array<double>").alias("vetor")), 2)


def test_factorisation_separates_blocks(spark):
    cells = [(i, f"t{(i % 2) * 4 + j}", 0.5) for i in range(20) for j in range(4)]
    df = spark.createDataFrame(cells, "id bigint, termo string, peso double")
    terms, h = topics.factorize(df, k=2, rounds=10)
    got = {r["id"]: r["id_topico"] for r in topics.assign_topics(topics.numbered(df)[1], terms, h).collect()}
    assert len({(i % 2, t) for i, t in got.items()}) == 2
    assert topics.factorize(df.limit(0), k=2)[0] == []


def test_factorisation_is_as_good_as_a_plain_one(spark):
    rng, k, x = np.random.default_rng(0), 4, np.zeros((80, 32))
    for i in range(len(x)):
        own, other = rng.choice(8, 5, replace=False) + 8 * (i % k), rng.choice(32, 2, replace=False)
        x[i, own] = x[i, other] = 1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    # the reference: 25 rounds, W kept from round to round
    rng = np.random.default_rng(42)
    w, plain = rng.uniform(0.01, 1, (80, k)), rng.uniform(0.01, 1, (k, 32))
    for _ in range(25):
        plain *= (w.T @ x + 1e-9) / (w.T @ w @ plain + 1e-9)
        w *= (x @ plain.T + 1e-9) / (w @ plain @ plain.T + 1e-9)

    def residual(h):
        w = np.full((80, k), 0.5)
        for _ in range(300):
            w *= x @ h.T / (w @ h @ h.T + 1e-9)
        return ((x - w @ h) ** 2).sum()

    cells = spark.createDataFrame([(i, f"t{j:02}", float(x[i, j])) for i, j in zip(*(a.tolist() for a in np.nonzero(x)))], "id bigint, termo string, peso double")
    terms, h = topics.factorize(cells, k)
    assert residual(h) <= 1.001 * residual(plain)
    main = lambda m: {frozenset(t) for t in topics.topic_terms([f"t{j:02}" for j in range(32)], m)}
    assert main(h) == main(plain)
    best = topics.assign_topics(topics.numbered(cells)[1], terms, h).collect()
    assert {r["id"]: set(r["termos_chave"].split(", ")) <= {f"t{j + 8 * (r['id'] % k):02}" for j in range(8)} for r in best} == {i: True for i in range(80)}
    assert all(len(r["termos_chave"].split(", ")) == 5 for r in best)


def test_upserts(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id bigint, p string, q string")
    source = spark.createDataFrame([(2, "B"), (3, "c")], "id bigint, p string")
    assert sorted(tuple(r) for r in upsert.update_columns(target, source, ["id"], ["p"]).collect()) == [(1, "a", "x"), (2, "B", None), (3, "c", None)]
    both = upsert.replace_rows(target, source.withColumn("q", F.lit("n")), ["id"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a", "x"), (2, "B", "n"), (3, "c", "n")]
    again = spark.createDataFrame([(1, 5, "v"), (1, 6, "w"), (1, 6, "w")], "id bigint, t int, p string")
    assert [tuple(r) for r in upsert.last_of(again, ["id"], "t").collect()] == [(1, 6, "w")]
    m = spark.createDataFrame([("a", "A"), (None, "z"), ("b", None)], "p string, valor string")
    assert sorted(r["q"] or "" for r in upsert.update_by_map(target, m, "p", "q").collect()) == ["", "A"]


def test_get_or_create(spark):
    dim = spark.createDataFrame([(4, "M")], "id bigint, nome string")
    names = spark.createDataFrame([("B",), ("A",), ("M",), (None,), ("B",)], "nome string")
    assert sorted(tuple(r) for r in upsert.get_or_create(dim, names).collect()) == [(4, "M"), (5, "A"), (6, "B")]
    assert [tuple(r) for r in upsert.get_or_create(dim, names.limit(0)).collect()] == [(4, "M")]


def test_get_or_create_of_many_names(spark):
    dim = spark.createDataFrame([(7, "x")], "id bigint, nome string")
    many = upsert.get_or_create(dim, spark.range(200_000).select(F.concat(F.lit("n"), F.xxhash64("id").cast("string")).alias("nome"))).persist()
    assert tuple(many.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()) == (200_001, 200_001, 7, 200_007)
    order = many.filter("id > 7").groupBy(F.expr("id div 1000").alias("g")).agg(F.min("nome").alias("a"), F.max("nome").alias("z")).orderBy("g").collect()
    assert all(x["z"] < y["a"] for x, y in zip(order, order[1:]))


def test_links_keep_their_flag(spark):
    links = spark.createDataFrame([(1, 1, "VELHO", "V", 0), (2, 1, None, None, 1)], "id_norma bigint, id_autor bigint, cargo_autor string, cargo_autor_normalizado string, ativo int")
    source = spark.createDataFrame([(1, 1, " novo  cargo "), (3, 2, "x"), (3, 2, "x"), (None, 2, "y")], "id_norma bigint, id_autor bigint, cargo_autor string")
    assert sorted(tuple(r) for r in upsert.upsert_links(links, source).collect()) == [(1, 1, "NOVO CARGO", "V", 0), (2, 1, None, None, 1), (3, 2, "X", None, 1)]
    labels = spark.createDataFrame([(4, "A"), (3, "A")], "id int, nome string")
    names = spark.createDataFrame([("A",), ("B",), (None,)], "nome string")
    assert [r["id"] for r in upsert.key_or_default(labels, names).orderBy(F.col("nome").asc_nulls_last()).collect()] == [3, 1, 1]


def test_a_broken_swap_is_put_back(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the two moves leaves it
    upsert.recover(spark, at)
    assert spark.read.parquet(at).count() == 3
    upsert.delete_all(spark, at)
    left = spark.read.parquet(at)
    assert left.count() == 0 and left.columns == ["id"] and not (tmp_path / "t.old").exists()


def test_class_scores_of_many_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"termo{x}" for x in rng.choice(12, 3, replace=False)), f"c{rng.integers(0, 30)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "id bigint, texto string, classe string")
    toks, sizes = {i: set(t.split()) for i, t, _ in rows}, Counter(c for _, _, c in rows)
    for r in stats.class_scores(docs, len(rows)).collect():
        df, best, info = sum(r["termo"] in t for t in toks.values()), 0.0, 0.0
        for c, size in sizes.items():
            a = sum(r["termo"] in toks[i] and k == c for i, _, k in rows)
            b, cc, n = df - a, size - a, len(rows)
            d = n - a - b - cc
            best = max(best, n * (a * d - b * cc) ** 2 / (df * size * (b + d) * (cc + d)))
            info = max(info, a / n * math.log2(a / n / (df / n * size / n)) if a else 0)
        assert (r["df"], pytest.approx(best), pytest.approx(info)) == (df, r["chi2"], r["mi"])


def test_answers_of_a_model(spark):
    import json

    from tabularium.operators import services

    inner = json.dumps({"resultados": [{"original": "a", "normalizado": "Á."}, {"original": "b", "normalizado": " "}, {"original": None, "normalizado": "x"}]})
    envelope = json.dumps({"candidates": [{"content": {"parts": [{"text": "hm", "thought": True}, {"text": inner}]}}]})
    df = spark.createDataFrame([(envelope,), ("{broken",), (None,)], "resposta string")
    assert sorted(tuple(r) for r in services.parse_answers(df).collect()) == [("a", "Á."), ("b", " ")]
    pending = spark.createDataFrame([("a",), ("b",), ("c;",), ("a",), (None,)], "cargo_autor string").coalesce(1)
    assert sorted(tuple(r) for r in services.normalize_titles(pending, lambda t: envelope).collect()) == [("a", "A"), ("b", "B"), ("c;", "C")]

    def broken(titles):
        raise OSError

    assert services.normalize_titles(pending, broken, tries=2, wait=0.01).count() == 3


def test_vectors_are_filled_with_a_limit(spark):
    from tabularium.operators import services

    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, None), (4, None)], "id_norma bigint, embeddings array<float>")
    texts = spark.createDataFrame([(1, "praça"), (2, "rua"), (3, "via")], "id bigint, texto string")
    sizes = lambda df: {r["id_norma"]: r["embeddings"] and len(r["embeddings"]) for r in df.collect()}
    assert sizes(services.fill_vectors(rows, texts)) == {1: 128, 2: 1, 3: 128, 4: None}
    assert sizes(services.fill_vectors(rows, texts, limit=1)) == {1: 128, 2: 1, 3: None, 4: None}
    assert sizes(services.fill_vectors(rows, texts, pending_only=False)) == {1: 128, 2: 128, 3: 128, 4: None}


def test_cluster_lines(spark):
    from tabularium.operators import services

    report = spark.createDataFrame([(3, 12, 40.0, 0.91234, 7)], "cluster int, tamanho bigint, percentual double, coesao double, medoide bigint")
    words = spark.createDataFrame([(3, "b", 2), (3, "a", 1)], "cluster int, termo string, posicao int")
    names = spark.createDataFrame([(7, "Lei nº 1", "um\n texto")], "id bigint, nome string, texto string")
    assert services.cluster_lines(report, words, names).first()["linha"] == "CLUSTER #03 | 12 normas (40.0%) | Coesão Média: 0.912 | Palavras-chave: a, b | MEDOID: Lei nº 1 - um texto"


def test_overwrite_reads_its_own_table(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    upsert.overwrite(spark.read.parquet(at).union(spark.range(1)), at)
    assert spark.read.parquet(at).count() == 4


def test_classification_report(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "real string, previsto string")
    got = {r["classe"]: r for r in topics.classification_report(pairs).collect()}
    assert got["~acuracia"]["f1"] == 0.5 and got["c"]["f1"] == 0 and got["a"]["precisao"] == 0.5 and got["~macro"]["suporte"] == 4


def test_paged_source(spark, tmp_path):
    import json

    from tabularium.sources.api import SearchSource

    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"pages": 2, "data": [{"id": n, "ano": 2000 + n, "tipo_slug": "lei", "estranho": 1}]}))
    spark.dataSource.register(SearchSource)
    rows = spark.read.format("paged_search").load(str(tmp_path)).select("id", "ano", "tiposlug").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2001, "lei"), (2, 2002, "lei")]


def test_paged_source_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tabularium.sources import api

    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            page = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["page"]
            asked["page", page] += 1
            busy = page == 2 and asked["page", 2] == 1
            self.answer(429 if busy else 200, {"pages": 2, "data": [{"id": page * 10 + n} for n in range(2)]})

        def do_GET(self):
            key = int(self.path.rsplit("/", 1)[1])
            self.answer(404 if key == 11 else 200, {"data": {"norma": {"id": key, "integra": f"texto {key}"}}})

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(api.SearchSource)
    rows = spark.read.format("paged_search").option("details", at + "/norma").option("page_wait", 0).option("item_wait", 0).load(at).select("id", "integra").collect()
    assert sorted(tuple(r) for r in rows) == [(10, "texto 10"), (20, "texto 20"), (21, "texto 21")] and asked["page", 2] >= 2
    server.shutdown()
    server.server_close()
    with pytest.raises(OSError):
        api.fetch(at, {}, first_wait=0.01, step=0, tries=2)


def test_incremental_takes_new_files_once(spark, tmp_path):
    from tabularium.streaming.incremental import process_new

    src, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    schema = spark.range(1).schema
    step = lambda batch, n: seen.append(batch.count())
    spark.range(3).coalesce(1).write.parquet(src)
    process_new(spark, src, schema, step, state)
    spark.range(2).coalesce(1).write.mode("append").parquet(src)
    process_new(spark, src, schema, step, state)
    assert sum(seen) == 5
