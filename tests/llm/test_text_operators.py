"""Markup, abuse, packing, mixing and subjects: literal cases, edge cases, brute force, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import abuse, markup, mixing, packing, subjects, tokens

HTML = '<h1 class="t">Cap&iacute;tulo <b>I</b></h1><p>Texto do artigo com \\(x^2\\) dentro.</p><ul><li>um <a href="u">dois</a><li>três</ul><pre><code>a &lt; b\n  c</code></pre><p>$$y = z$$</p>'
CASES = {
    HTML: [("titulo", "Capítulo I"), ("formula", "x^2"), ("item", "um dois"), ("item", "três"), ("codigo", "a < b c"), ("formula", "y = z")],
    HTML.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"): [("titulo", "Capítulo I"), ("formula", "x^2"), ("item", "um dois"), ("item", "três"), ("codigo", "a < b c"), ("formula", "y = z")],
    "# Um **forte** #\n\ntexto R$ 5,00 e R$ 6,00.\n\n1. a\n2. [b](http://x)\n\n- c\n\nDois\n====\n\n~~~txt\n<n> * 2\n~~~\n\nvale $T = 1$ aqui": [
        ("titulo", "Um forte"), ("item", "a"), ("item", "b"), ("item", "c"), ("titulo", "Dois"), ("codigo", "<n> * 2"), ("formula", "T = 1"),
    ],
    "== Um ''dois'' ==\n\n# a [[N 1|b]]\n# c{{nota}}<ref>x</ref>\n\n*d\n\n<math>k_{1}</math>\n\n<syntaxhighlight lang=\"text\">\nX|Y\n</syntaxhighlight>": [
        ("titulo", "Um dois"), ("item", "a b"), ("item", "c"), ("item", "d"), ("formula", "k_{1}"), ("codigo", "X|Y"),
    ],
    "\\section*{Do \\emph{objeto} e \\href{http://u}{mais}}\n\ntexto 5\\% \\\\\n\n\\begin{itemize}\n  \\item \\textbf{a} b\n  \\item c 13\\%\n\\end{itemize}\n\\begin{equation}\nV = A\n\\end{equation}\n\\begin{verbatim}\nq | r\n\\end{verbatim}": [
        ("titulo", "Do objeto e mais"), ("item", "a b"), ("item", "c 13%"), ("formula", "V = A"), ("codigo", "q | r"),
    ],
    "DA CASA CIVIL\nArt. 1º Texto.\nI – um;\nII – dois.": [],
    None: [],
    "": [],
    "  \n ": [],
}


@pytest.mark.parametrize("source", list(CASES), ids=range(len(CASES)))
def test_structure(source):
    assert [x for x in markup.keep_blocks(markup.parse(source)) if x[0] != "texto"] == CASES[source]


def test_long_text_is_whole():
    text = "\n\n".join(f"# Título {i}\n\nparágrafo {i} com palavras" for i in range(5000))
    assert sum(k == "titulo" for k, _ in markup.parse(text)) == 5000


def test_blocks_drop_navigation_and_keep_text():
    lines = [("link", "Início"), ("link", "Mapa"), ("texto", ""), ("texto", ""), ("texto", ""), ("texto", "um parágrafo de verdade"), ("titulo", "T")]
    assert markup.keep_blocks(lines) == [("texto", "um parágrafo de verdade"), ("titulo", "T")]


def test_stray_fragments_go_and_headings_stay_with_their_text():
    far = [("texto", "")] * 10
    text = [("titulo", "Do objeto"), ("texto", ""), ("item", "um"), ("texto", "um parágrafo de verdade")]
    assert markup.keep_blocks([("item", "x"), *far, *text, *far, ("titulo", "ab"), ("texto", "c")]) == [x for x in text if x[1]]
    assert markup.keep_blocks([("titulo", "ab")]) == [("titulo", "ab")] and markup.keep_blocks([]) == [] and markup.keep_blocks(far) == []


def test_elements_as_rows(spark):
    df = spark.createDataFrame([(1, "# A", "x"), (1, "# A", "y"), (2, None, "z")], "id bigint, integra string, elemento string")
    assert [tuple(r) for r in markup.structural_elements(df, "id", "integra").collect()] == [(1, 0, "titulo", "A")] * 2
    assert sorted((r[0], r[1]) for r in markup.clean_text(df, "id", "integra").collect() if r[1]) == [(1, "# A"), (1, "# A")]
    assert markup.structural_elements(df.limit(0), "id", "integra").count() == 0


def test_no_element_is_lost_for_standing_alone(spark):
    far = "\n" * 12
    text = far.join(["um parágrafo de verdade", "# Fim", "oi", "<ul><li>x</li></ul>", "$$y$$", "outro parágrafo de verdade"])
    df = spark.createDataFrame([(1, text)], "id bigint, integra string")
    found = markup.structural_elements(df, "id", "integra").orderBy("ordem").collect()
    assert [(r["elemento"], r["conteudo"]) for r in found] == [("titulo", "Fim"), ("item", "x"), ("formula", "y")]
    clean = markup.clean_text(df, "id", "integra").first()["texto_limpo"]
    assert clean == "um parágrafo de verdade\n# Fim\n- x\n$$ y $$\noutro parágrafo de verdade"


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 5, 60, 300, 700, 1500, 2048, 2049, 9000])) for i in range(500)] + [(500, None), (3, 700), (3, 700)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    packed = packing.pack(df, group_rows=50)
    rows = packed.collect()
    assert sum(r["tokens"] for r in rows) == sum(s or 0 for _, s in sizes)
    boxes = {}
    for r in rows:
        assert (r["caixa"] is None) == (r["tokens"] == 0)
        if r["caixa"] is not None:
            boxes[r["caixa"]] = boxes.get(r["caixa"], 0) + r["tokens"]
    assert max(boxes.values()) <= 2048 and len(boxes) <= 1.7 * sum(boxes.values()) / 2048 + 60
    assert {r["doc_id"] for r in rows if r["parte"] == 1} == {i for i, s in sizes if (s or 0) > 2048}
    once = packing.pack(df.dropDuplicates(["doc_id"]), group_rows=50)
    split = {r["doc_id"]: r["caixas"] for r in packing.split_items(once).collect()}
    assert set(split) == {i for i, s in sizes if (s or 0) > 2048} and all(n == (2 if s == 2049 else 5) for i, n in split.items() for s in [dict(sizes[:500])[i]])
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.fill_report(packed).agg(F.max("ocupacao")).first()[0] <= 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Olá, mundo!", 9), (2, None, 9), (3, "", 9), (4, "a " * 20000, 9)], "doc_id bigint, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(df).collect()}
    assert got[2] == got[3] == 0 and got[1] > 2 and got[4] >= 20000


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice("aaab"), rng.randint(1, 100)) for i in range(3000)] + [(9001, None, 50), (9002, "c", 10), (9003, "d", 0)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("e", 0.1, 1)], "source string, peso_alvo double, max_repeticoes int")
    mixed, shares = mixing.mix(sizes, weights)
    used = {}
    for r in mixed.collect():
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["copias"]
        assert r["copias"] <= {"a": 1, "b": 3, "c": 2}[r["source"]]
    total = sum(t for _, s, t in docs if s)
    report = {r["source"]: r for r in mixing.actual_shares(mixed, shares).collect()}
    assert {s for s, r in report.items() if r["esgotada"]} == {"c", "e"} and report["a"]["tokens_usados"] == used["a"]
    # the report follows the mixture: a document used less often than it may be is not exhausted
    fewer = mixed.filter("doc_id <> 9002")
    assert {r["source"] for r in mixing.actual_shares(fewer, shares).collect() if r["esgotada"]} == {"e"}
    assert abs(used["a"] - 0.3 * total) <= 100 and abs(used["b"] - 0.4 * total) <= 100 and used["c"] == 20
    again = {(r["doc_id"], r["copias"]) for r in mixing.mix(sizes.repartition(7), weights)[0].collect()}
    assert again == {(r["doc_id"], r["copias"]) for r in mixed.collect()}
    assert mixing.mix(sizes.limit(0), weights)[0].count() == 0
    assert mixing.mix(sizes, weights.limit(0))[0].count() == 0


def test_disguises():
    s = abuse.sentences("Seu 1d10t4! Que b.u.r.r.o, l*xo e c a n a l h a; im\u00adbecil, nojeeento, cretnio. Ok")
    words = [w for x in s for w in x]
    assert {"idiota", "buro", "lixo", "canalha", "imbecil", "nojento", "cretino"} <= set(words)
    assert abuse.sentences(None) == [] and abuse.sentences("") == [] and abuse.sentences(" . ") == []
    assert sum(map(len, abuse.sentences("palavra " * 1000))) >= 1000
    assert len(abuse.subwords("anticonstitucionalissimamente")) == 30  # the word and each of its 29 trigrams


def test_names_inside_sentences_are_one_word():
    assert abuse.sentences("Agradeço muito pela ajuda dada ontem a Zeferino Quintela e ao Burro. Marta falou.")[0][6:] == ["a", "nome", "nome", "e", "ao", "buro"]
    assert abuse.sentences("Vai Embora, Seu Sacripanta")[0] == ["vai", "embora", "seu", "sacripanta"]  # capitalised throughout


def judged_documents(seed, n=600):
    """(doc_id, text, abusive): clean notices, every fifth with a rude sentence among them; others quote the same words."""
    rng = random.Random(seed)
    rude = ["seu {w}, desapareça daqui", "que {w} esse gestor", "todos os daquele lado são {w}", "vou acabar com você, {w}"]
    mild = ["a palavra \"{w}\" saiu do registro", "o relatório {n} trata de receitas", "a sessão começa às {n} horas", "o edital {n} foi publicado", "a obra do bairro termina em {n} dias"]
    words = "zurrapa mequetrefe biltre sacripanta bucéfalo".split()
    made = lambda p: p.format(w=rng.choice(words), n=rng.randint(1, 99))
    out = []
    for i in range(n):
        own = [made(rng.choice(mild)) for _ in range(5)] + ([made(rng.choice(rude))] if i % 5 == 0 else [])
        rng.shuffle(own)
        out.append((i, ". ".join(own) + ".", int(i % 5 == 0)))
    return out


@pytest.fixture(scope="module")
def taught():
    return abuse.train([(abuse.sentences(t), y) for _, t, y in judged_documents(1)])


def test_classifier_on_held_out_documents(taught):
    rows = judged_documents(2, 300)
    said = abuse.Scorer(taught).score([t for _, t, _ in rows]) >= 0.5
    assert sum(s == bool(y) for s, (_, _, y) in zip(said, rows)) / len(rows) > 0.95


def test_sentence_scores_do_not_depend_on_what_stands_beside(taught):
    scorer = abuse.Scorer(taught, most=3)
    texts = [t for _, t, _ in judged_documents(3, 40)]
    alone = [scorer.score([t])[0] for t in texts]
    assert alone == pytest.approx(scorer.score(texts).tolist(), abs=1e-5)
    assert scorer.score([None, "", " ... "]).tolist() == [0, 0, 0] and len(scorer.score([])) == 0
    assert scorer.score(["o edital foi publicado. " * 20000 + texts[0]])[0] == pytest.approx(max(alone[0], scorer.score(["o edital foi publicado."])[0]), abs=1e-5)


def test_others_bear_out_which_sentences_are_clean():
    # documents 0 to 3 hold a harmless sentence, one of them judged wrongly; 4 to 7 an abusive one beside a notice; 8 and 9 are alone
    show, rude, notice, rare = [1, 2, 3, 4], [5, 2, 6, 7], [8, 9, 10], [11, 12]
    docs = [([show], 0), ([show], 0), ([show, notice], 0), ([show, notice], 1), *[([notice, rude], 1)] * 3, ([rude], 0), ([rare], 0), ([rare], 1)]
    near = abuse.Neighbours([([np.array(s) for s in own], y) for own, y in docs + [([notice], 0)] * 6], 20)
    assert all(near.clean(d, 0) for d in range(4))
    assert near.clean(4, 0) and not near.clean(4, 1)  # what is also said in clean documents isn't meant
    assert not near.clean(7, 0)  # a clean judgement that the others contradict
    assert not near.clean(8, 0) and not near.clean(9, 0)  # too few others to tell


def test_no_judgement_means_no_abuse(spark):
    df = spark.createDataFrame([(1, "texto", "pt", "x"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    model, labels = abuse.fit(df, spark.createDataFrame([], "doc_id bigint, ofensivo int"))
    rows = abuse.flag(abuse.score_documents(df, model), labels).collect()
    assert sorted((r["doc_id"], r["ofensivo"]) for r in rows) == [(1, False), (2, False)]


def test_scoring_of_documents(spark, taught):
    df = spark.createDataFrame([(1, "A sessão começa. Seu biltre, desapareça daqui.", "pt", "x"), (2, None, None, None), (3, "", "pt", "x"), (1, "A sessão começa. Seu biltre, desapareça daqui.", "pt", "x")], "doc_id bigint, text string, lang string, source string")
    flagged = abuse.flag(abuse.score_documents(df, taught), spark.createDataFrame([], "doc_id bigint, rotulo int"))
    assert [r["ofensivo"] for r in sorted(flagged.collect(), key=lambda r: r["doc_id"])] == [True, True, False, False]
    rates = {r["source"]: r["taxa"] for r in abuse.source_rates(flagged).collect()}
    assert rates[None] == 0 and rates["x"] == pytest.approx(2 / 3, abs=1e-6)
    assert abuse.score_documents(df.limit(0), taught).count() == 0


def test_every_language_has_its_limit(spark):
    # 'pt' is told apart at 0.5; 'es' needs 0.8 and has much evidence; 'en' needs 0.8 too, but has one document
    rows = [(n, "pt", 0.9 if n % 5 == 0 else 0.1, int(n % 5 == 0)) for n in range(2000)]
    rows += [(5000 + n, "es", 0.9 if n % 5 == 0 else 0.7, int(n % 5 == 0)) for n in range(2000)]
    rows += [(9000, "en", 0.7, 0), (9001, None, 0.9, 1)]
    scored = spark.createDataFrame([(i, None, lang, x) for i, lang, x, _ in rows], "doc_id bigint, source string, lang string, nota double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id bigint, rotulo int")
    own, common = abuse.thresholds(scored, labels)
    got = {r["lang"]: r["limite"] for r in own.collect()}
    assert set(got) == {"pt", "es", "en"} and got["es"] > 0.7 and abs(got["en"] - common) <= 0.05
    only = labels.filter("doc_id < 5000")
    assert {r["lang"]: r["limite"] for r in abuse.thresholds(scored, only)[0].collect()} == {"pt": 0.5}


def test_the_sample_is_bounded_and_the_rest_calibrates(spark):
    rows = judged_documents(4)
    documents = spark.createDataFrame([(i, None, t, "es" if i % 6 == 0 else "pt") for i, t, _ in rows], "doc_id bigint, source string, text string, lang string")
    reviews = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (7, 1), (None, 1)], "doc_id bigint, ofensivo int")
    labels, sample = abuse.judged(reviews, 100)
    assert labels.count() == 599 and sample.count() == 100 and sample.filter("rotulo = 1").count() == 50
    model, rest = abuse.fit(documents, reviews, max_docs=100)
    learned = {r["doc_id"] for r in sample.filter("not fora").collect()}
    assert {r["doc_id"] for r in rest.collect()} == {r["doc_id"] for r in labels.collect()} - learned
    assert abuse.flag(abuse.score_documents(documents, model), rest).count() == 600


def test_subjects_recover_blocks(spark):
    words = {1: "credito dotacao despesa receita".split(), 2: "onibus ciclovia transito faixa".split(), 3: "creche aluno ensino merenda".split()}
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        own = [i % 3 + 1] if i % 5 else [i % 3 + 1, (i + 1) % 3 + 1]
        docs.append((i, [w for t in own for w in rng.sample(words[t], 3)] + ["dispoe", "sobre"]))
        if i % 4:
            labels += [(i, t, rng.choice([None, 0.8])) for t in own]
    records = spark.createDataFrame(docs, "id_norma bigint, termos array<string>")
    lab = spark.createDataFrame([*labels, (1, None, 0.5), labels[0]], "id_norma bigint, id_topico int, score_pertinencia double")
    areas = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {}
    for r in subjects.subjects(records, lab, areas).filter("not rotulado").collect():
        got.setdefault(r["id_norma"], set()).add(r["id_topico"])
    want = {i: {i % 3 + 1} if i % 5 else {i % 3 + 1, (i + 1) % 3 + 1} for i in range(240) if i % 4 == 0}
    assert sum(got.get(i) == w for i, w in want.items()) / len(want) >= 0.9
    # rare and unseen terms count too: every record gets a subject, the commonest one where nothing speaks for another
    strange = records.unionByName(spark.createDataFrame([(900, ["zzz"]), (901, ["qqq", "credito", "despesa"])], "id_norma bigint, termos array<string>"))
    most = lab.unionByName(spark.createDataFrame([(i, 2, None) for i in range(240) if i % 3 == 1 and i % 4], "id_norma bigint, id_topico int, score_pertinencia double")).filter("id_norma % 3 = 1 or id_norma % 2 = 0")
    rows = {r["id_norma"]: r["id_topico"] for r in subjects.subjects(strange, most, areas).filter("not rotulado").collect() if r["id_norma"] >= 900}
    assert rows == {900: 2, 901: 1}
    assert subjects.subjects(records, lab.limit(0), areas).count() == 0
    assert subjects.subjects(records.limit(0), lab, areas).count() == 0
