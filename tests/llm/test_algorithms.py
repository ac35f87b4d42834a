"""Groups, names, terms and titles against brute force on small fixtures, with edge cases."""

import glob
import html
import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest

from tabularium.llm import canonical, distinctive, frequency, markov, names, queries
from tabularium.llm.records import records
from tabularium.sources.tables import table


def fixture_vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, groups = [], []
    n = 0
    for size in (40, 12, 5, 4):
        centre = rng.normal(size=128)
        own = []
        for _ in range(size):
            v = centre + rng.normal(size=128) * 0.45
            rows.append((n, (v * rng.choice([0.1, 1, 30])).tolist()))
            own.append(n)
            n += 1
        groups.append(own)
    for _ in range(60):
        rows.append((n, rng.normal(size=128).tolist()))
        n += 1
    rows += [(n, None), (n + 1, [0.0] * 128), (n + 2, [1.0] * 96), (n + 3, [float("nan")] * 128), (None, rows[0][1]), rows[1]]
    return rows, groups


def test_groups(spark):
    rows, groups = fixture_vectors()
    df = spark.createDataFrame(rows, "id_norma bigint, embeddings array<double>").selectExpr("id_norma", "cast(embeddings as array<float>) embeddings", "1 as grupo", "2 as id", "3 as peso")
    found = markov.similarity_groups(df, "id_norma", "embeddings")
    want = {(min(g), x) for g in groups if len(g) >= 5 for x in g if x != min(g)}
    assert {tuple(r) for r in markov.group_pairs(found).collect()} == want
    typical = {r["menor"]: r for r in markov.typical_members(found).collect()}
    assert {k: r["tamanho"] for k, r in typical.items()} == {min(g): len(g) for g in groups if len(g) >= 5}
    assert all(set(r["tipicos"]) <= set(next(g for g in groups if k in g)) and len(r["tipicos"]) == 5 for k, r in typical.items())
    assert markov.group_pairs(markov.similarity_groups(df.limit(0), "id_norma", "embeddings")).count() == 0


def test_groups_come_from_the_flow_not_from_condensing(spark):
    rows, groups = fixture_vectors()
    df = spark.createDataFrame(rows, "id_norma bigint, embeddings array<float>")
    levels, graph = markov.similarity_graph(df, "id_norma", "embeddings", dense=3)
    nodes = [set(r["filhos"]) for r in levels[0].collect()]
    # condensing alone leaves every group in pieces, the smallest one whole vector by whole vector
    for g in groups:
        pieces = [n for n in nodes if n & set(g)]
        assert len(pieces) >= 3 and all(n <= set(g) for n in pieces)
    edges = {(r["a"], r["b"]): r["peso"] for r in graph.collect()}
    assert edges
    # every pair of nodes that reaches the cosine, and no other
    last = levels[-1].select("id", "vetor").collect()
    v, ids = markov._vectors([bytes(r["vetor"]) for r in last]), [r["id"] for r in last]
    sims = v @ v.T
    assert set(edges) == {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i) if sims[i, j] >= 0.6}
    want = {(min(g), x) for g in groups if len(g) >= 5 for x in g if x != min(g)}
    assert {tuple(r) for r in markov.group_pairs(markov.similarity_groups(df, "id_norma", "embeddings", dense=3)).collect()} == want


def test_flow_joins_a_loose_group_and_keeps_close_groups_apart(spark):
    rng = np.random.default_rng(8)
    centre, rows = rng.normal(size=128), []
    centre /= np.linalg.norm(centre)
    far = rng.normal(size=(2, 128))
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    for n in range(12):  # cosines of 0.6 to 0.75
        v = rng.normal(size=128)
        rows.append((n, (centre + v / np.linalg.norm(v) * 0.7).tolist()))
    rows += [(100 + n, (far[0] + rng.normal(size=128) * 0.02).tolist()) for n in range(6)] + [(200 + n, (far[1] + rng.normal(size=128) * 0.02).tolist()) for n in range(6)]
    rows.append((300, (far[0] + far[1]).tolist()))  # reaches both groups: single linkage would make them one
    df = spark.createDataFrame(rows, "id_norma bigint, embeddings array<float>")
    got = markov.group_pairs(markov.similarity_groups(df, "id_norma", "embeddings")).filter("id_b <> 300").collect()
    assert {tuple(r) for r in got} == {(0, n) for n in range(1, 12)} | {(100, 100 + n) for n in range(1, 6)} | {(200, 200 + n) for n in range(1, 6)}


def test_inflation_sets_the_grain(spark):
    chain = spark.createDataFrame([(n, n + 1, 0.8) for n in range(15)], "a bigint, b bigint, peso double")
    coarse, fine = ({r["grupo"] for r in markov.markov(chain, inflation).collect()} for inflation in (1.4, 4.0))
    assert 1 <= len(coarse) < len(fine)


def test_orders_grow_with_the_blocks():
    assert [markov.passes_for(n) for n in (0, 1, markov.BLOCK)] == [4, 4, 4]
    assert 20 < markov.passes_for(1000 * markov.BLOCK) < markov.passes_for(100_000 * markov.BLOCK) < 400


def test_flow_separates_weakly_linked_cliques(spark):
    edges = [(a, b, 0.9) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5, 0.6)]
    rows = markov.markov(spark.createDataFrame(edges, "a bigint, b bigint, peso double")).collect()
    assert len({r["grupo"] for r in rows if r["no"] < 5}) == 1 and len({r["grupo"] for r in rows}) == 2


def plain_terms(t):
    if t is None:
        return []
    t = unicodedata.normalize("NFD", html.unescape(t))
    return re.findall(r"[^\W\d_]{3,}", "".join(c for c in t if not unicodedata.combining(c)).replace("­", "").replace("​", "").lower())


@pytest.fixture(scope="module")
def normas(spark):
    rng = random.Random(5)
    words = ["dispõe", "sobre", "cr&eacute;dito", "praça", "escola", *(f"nome{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(words[:5], k=4) + rng.choices(words[5:], k=2)), i) for i in range(300)]
    rows += [rows[3], (7, "outro texto posterior", 9999), (400, None, 1), (401, "", 1), (402, "12 ab", 1), (None, "sem id nenhum", 1), (403, "longa palavra " * 20000, 1)]
    return spark.createDataFrame(rows, "id bigint, ementa string, coletado_em bigint").selectExpr("*", "'x' as termo", "1 as n", "2 as total")


@pytest.fixture(scope="module")
def plain(normas):
    last = {}
    for r in normas.collect():
        if r["id"] is not None and (r["id"] not in last or (r["coletado_em"], r["ementa"]) > last[r["id"]]):
            last[r["id"]] = (r["coletado_em"], r["ementa"])
    docs = {i: plain_terms(t) for i, (_, t) in last.items()}
    return {i: t for i, t in docs.items() if t}


def test_frequencies(spark, normas, plain):
    rows, n = frequency.term_frequencies(records(normas), fan_in=2)
    occ = Counter(w for t in plain.values() for w in t)
    df = Counter(w for t in plain.values() for w in set(t))
    assert n == len(plain)
    assert {r["termo"]: (r["ocorrencias"], r["registros"]) for r in rows.collect()} == {w: (occ[w], df[w]) for w in df}
    marks = {r["termo"]: r["marca"] for r in frequency.mark(rows, n).collect()}
    assert all(m == ("raro" if df[w] < 4 else "comum" if df[w] * 100 > 30 * n else None) for w, m in marks.items())
    empty, zero = frequency.term_frequencies(records(normas.limit(0)))
    assert empty.count() == 0 and zero == 0


def test_distinctive_scores(spark, normas, plain):
    df = Counter(w for t in plain.values() for w in set(t))
    occ = Counter(w for t in plain.values() for w in t)
    size = sum(occ.values())
    got = {(r["id_norma"], r["termo"]): r["llr"] for r in distinctive.distinctive_terms(records(normas)).collect()}
    assert set(got) == {(i, w) for i, t in plain.items() for w in t}
    for (i, w), score in got.items():
        k11, r1, c1 = plain[i].count(w), len(plain[i]), occ[w]
        cells = [(k11, r1, c1), (r1 - k11, r1, size - c1), (c1 - k11, size - r1, c1), (size - r1 - c1 + k11, size - r1, size - c1)]
        g = 2 * sum(k * math.log(k * size / (r * c)) for k, r, c in cells if k > 0)
        assert abs(abs(score) - max(g, 0)) < 1e-6 * max(1, g)
    few = {(r["id_norma"], r["termo"]) for r in distinctive.distinctive_terms(records(normas), 2, 6).collect()}
    assert few == {(i, w) for i, t in plain.items() for w in t if 2 <= df[w] <= 6}
    stored = spark.createDataFrame([(0, "dispoe"), (0, "dispoe"), (0, "inexistente"), (0, "outro"), (9999, "escola"), (1, None), (None, "escola")], "id_norma bigint, termo string")
    more = {(r["id_norma"], r["termo"]): r for r in distinctive.distinctive_terms(records(normas), listed=stored).collect()}
    assert set(more) == set(got) | {(0, "inexistente"), (0, "outro")} | {(0, "dispoe")}
    assert {k for k, r in more.items() if r["listado"]} == {(0, "dispoe"), (0, "inexistente"), (0, "outro")}
    assert more[(0, "inexistente")]["registros"] == more[(0, "inexistente")]["llr"] == 0 and more[(0, "outro")]["llr"] < 0
    assert all(abs(more[k]["llr"] - got[k]) < 1e-9 for k in got)
    assert distinctive.distinctive_terms(records(normas.limit(0))).count() == 0
    assert distinctive.distinctive_terms(records(normas.limit(0)), listed=stored).count() == 0


def test_shared_terms_make_no_score(spark, small, normas, plain, monkeypatch):
    whole = {(r["id_norma"], r["termo"]) for r in distinctive.distinctive_terms(records(table(spark, small, "normas")), 2, 6).collect()}
    monkeypatch.setattr(distinctive, "llr", None)
    rows = [tuple(r) for r in queries.p3_found(spark, small).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == whole
    df = Counter(w for t in plain.values() for w in set(t))
    few = [tuple(r) for r in distinctive.shared_terms(records(normas), 2, 6).collect()]
    assert sorted(few) == sorted((i, w) for i, t in plain.items() for w in set(t) if 2 <= df[w] <= 6)
    assert distinctive.shared_terms(records(normas.limit(0)), 2, 6).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pigeonhole_loses_no_pair(spark, k):
    rng = random.Random(k)
    refs = ["".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(40)]
    probes = ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)]
    got = canonical.pigeonhole(spark, spark.createDataFrame([(p,) for p in [*probes, None]], "s string"), spark.createDataFrame([(r,) for r in [*refs, None]], "ref string"), k)
    assert {tuple(r) for r in got.collect()} == {(p, r, levenshtein(p, r)) for p in probes for r in refs if levenshtein(p, r) <= k}


def test_titles(spark):
    cargos = spark.createDataFrame([(1, "PREFEITO"), (2, "SECRETARIO MUNICIPAL DA FAZENDA"), (3, "SECRETARIO ADJUNTO DA FAZENDA"), (4, "VICE-PREFEITO")], "id_cargo int, cargo string")
    autores = spark.createDataFrame([(1, "Percival Zurbadim Monfort"), (2, None)], "id bigint, nome string")
    known = [(i, 1, "ALCAIDE", "PREFEITO", 1) for i in range(20)] + [(30 + i, 1, "CAPELÃO", "CAPELÃO", 1) for i in range(5)] + [(50, 1, "ALCAIDE", "VICE-PREFEITO", 1)]
    asked = {
        "Prefeita em exercício": 1, "PERFEITO": 1, "Alcaide.": 1, "SECR. MUN. DA FAZENDA": 2, "SECRETÁRIA ADJUNTA DA FAZENDA (SUBST.)": 3, "fazenda, secretário municipal": 2,
        "SECRETÁRIO ADJ. DA FAZENDA PERCIVAL ZURBADIN MONFORT": 3, "VICE-PREFEITA": 4, "CAPELÃO": 0, "TABELA DE VENCIMENTOS": 0,
    }
    rows = known + [(100 + i, 7, c, None if i % 2 else " ", 1) for i, c in enumerate(asked)] + [(200, 7, None, None, 1), (201, 7, "  ", None, 1), (100, 7, "Prefeita em exercício", None, 1)]
    na = spark.createDataFrame(rows, "id_norma bigint, id_autor bigint, cargo_autor string, cargo_autor_normalizado string, id_cargo int")
    mapped = canonical.map_titles(spark, na, cargos, autores)
    got = {r["id_norma"]: r["id_cargo"] for r in canonical.pending(spark, na, mapped).collect()}
    assert got == {100 + i: v for i, v in enumerate(asked.values())}
    assert {r["cargo_autor"] for r in canonical.unmatched(spark, na, mapped).collect()} == {"CAPELÃO", "TABELA DE VENCIMENTOS"}
    assert canonical.map_titles(spark, na.limit(0), cargos, autores).count() == 0


def test_titles_do_not_depend_on_repeated_rows(spark):
    cargos = spark.createDataFrame([(1, "SECRETARIO MUNICIPAL DE SAUDE"), (2, "PREFEITO")], "id_cargo int, cargo string")
    autores = spark.createDataFrame([(1, "MARIA SILVA")], "id bigint, nome string")
    titles = [("SECRETÁRIO DE SAÚDE XYLOFRUZ", None), ("Capelão", "CAPELAO"), ("Prefeito Capelão", "CAPELAO"), ("Prefeito", "PREFEITO"), ("Alcaide", "PREFEITO")]
    maps = []
    for times in (1, 7):
        na = spark.createDataFrame([(n, 1, t, done) for n, (t, done) in enumerate(titles * times)], "id_norma bigint, id_autor bigint, cargo_autor string, cargo_autor_normalizado string")
        maps.append({r["cargo_autor"]: r["id_cargo"] for r in canonical.map_titles(spark, na, cargos, autores).collect()})
    assert maps[0] == maps[1] == {"SECRETÁRIO DE SAÚDE XYLOFRUZ": 1, "Capelão": 0, "Prefeito Capelão": 0, "Prefeito": 2, "Alcaide": 2}


def test_name_forms():
    assert names.form("VILHEIROS, Amostozima C.") == (["amostozima", "c", "vilheiros"], "")
    assert names.form("Dra. Nazarecaste de Falcadim Fº") == (["nazarecaste", "falcadim"], "filho")
    assert names.form("RO5ALOCLES Z MONFÍFICO")[0][0] == "rosalocles"
    assert names.form(None) == ([], "") and names.form("123") == ([], "")
    assert names.edits("wednaldo", "wendaldo") == 1


def test_assignment_is_optimal_for_every_size():
    rng = random.Random(9)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(5, 6)
        costs = [[rng.choice([0.0, 0.2, 0.5, 0.6, 1000.0]) for _ in range(m)] for _ in range(n)]
        got = names.optimal(costs)
        assert len(set(got)) == n
        assert sum(costs[i][j] for i, j in enumerate(got)) == pytest.approx(min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)))
    many = [f"nome{chr(97 + i)}xyz" for i in range(25)]
    assert names.assign(many, list(reversed(many))) == (0.0, [], [])
    assert names.assign([], ["a"]) == (0.0, [], ["a"]) and names.assign(["ana"], ["bia"])[1:] == (["ana"], ["bia"])


def test_splitting_a_block_changes_no_entity(spark):
    people = [(f"Associacao Cultural {a} {c}", n) for n, (a, c) in enumerate(itertools.product(["Barrovia", "Waldomundo", "Crespozeiro", "Arlofonte"], ["Norte", "Leste", "Ilhas"]))]
    forms = []
    for text, _ in people:
        first, second, third, last = text.split()
        forms += [text, f"{first} {second} {third[0]}. {last}", f"{last} {first} {second} {third}", f"{first} {second} {third[:-1]}x {last}", f"{first} {second} {third} {last[0]}"]
    rows = sorted({(" ".join(names.form(f)[0]), tuple(names.form(f)[0])) for f in forms} | {("associacao cultural", ("associacao", "cultural"))})
    nodes = spark.createDataFrame([(k, list(t), "", False) for k, t in rows], "chave string, tokens array<string>, sufixo string, sonda boolean")
    parts = []
    for hot in (10_000, 5):
        split = names.blocks(nodes, hot)
        assert split.filter("grande").count() == 0 or hot == 5
        whole = names.components(nodes, names.block_links(split))
        found = whole.collect()
        parts.append({r["chave"]: r["entidade"] for r in found})
    assert parts[0] == parts[1] and 1 < len(set(parts[0].values())) < len(rows)
    # a form of the two words alone belongs to an entity only if there is no other
    one = nodes.filter("chave in ('associacao cultural', 'associacao cultural barrovia norte', 'associacao cultural b norte')")
    split = names.blocks(one, 1)
    joined = names.sole_links(split, names.components(one, names.block_links(split)))
    assert [r["chave"] for r in joined.collect()] == ["associacao cultural"]


def test_short_names_meet_their_misspelling(spark):
    people = [(1, "Ana Luz"), (2, "Ana Lus"), (3, "Ivo Sá"), (4, "Ana Sol"), (5, "Eva Luz")]
    got = names.found(spark.createDataFrame(people, "id bigint, nome string"), spark.createDataFrame([], "id_norma bigint, id_autor bigint, cargo_autor string"), spark.createDataFrame([], "cargo string"))
    assert {tuple(r) for r in got.collect()} == {(0, 1, 2)}


def test_names_in_titles_survive_more_titles(spark):
    people = [(1, "Amostozima Crespagosa Vilheiros"), (2, "Nazarecaste Falcadim Teodossel")]
    autores, cargos = spark.createDataFrame(people, "id bigint, nome string"), spark.createDataFrame([("PREFEITO",)], "cargo string")
    for times in (1, 12):
        # the misspelt name stands in many titles, the right one in more
        places = "norte sul leste oeste alto baixo velho novo grande menor central rural urbano fluvial".upper().split()
        titles = [(n, 2, f"PREFEITO {w} AMOSTOZIMA CRESPAGOZA") for n, w in enumerate(places[:times])] + [(100 + n, 2, f"PREFEITO {w} AMOSTOZIMA CRESPAGOSA") for n, w in enumerate(places[: times + 2])]
        got = names.found(autores, spark.createDataFrame(titles, "id_norma bigint, id_autor bigint, cargo_autor string"), cargos)
        assert {r["id_norma"] for r in got.collect()} == {t[0] for t in titles}


def test_entities(spark):
    people = [
        (1, "Amostozima Crespagosa Vilheiros"), (2, "VILHEIROS, AMOSTOZIMA CRESPAGOSA"), (3, "Amostozima C. Vilheiros"), (4, "A. Crespagossa Vilheiros"), (5, "Dr. Amostozima de Crespagosa-Vilheiros"),
        (6, "Nazarecaste Falcadim Teodossel"), (7, "NAZARECASTE FALCADIM TEODOSSEL FILHO"), (8, "Nazarecaste Teodossel Fº"), (9, "Associação Cultural Barróvia Waldóvia"), (10, "ASSOC. CULT. BARRÓVIA WALDÓVIA"),
        (11, "Outro Nome Qualquer"), (12, None), (1, "Amostozima Crespagosa Vilheiros"), (13, "Fabrisbela Norvundim Brocharenga"), (14, "Fabrinho Norvundim Brocharenga"),
    ]
    autores = spark.createDataFrame(people, "id bigint, nome string").selectExpr("*", "1 as chave", "2 as entidade")
    na = spark.createDataFrame([(50, 6, "PREFEITO - A. CRESPAGOSA VILHEIROS"), (51, 3, "PREFEITO AMOSTOZIMA VILHEIROS"), (52, 6, "PREFEITO"), (53, 1, None), (54, None, "x"), (50, 6, "PREFEITO - A. CRESPAGOSA VILHEIROS")], "id_norma bigint, id_autor bigint, cargo_autor string")
    cargos = spark.createDataFrame([("PREFEITO",)], "cargo string")
    got = {tuple(r) for r in names.found(autores, na, cargos).collect()}
    same = [{1, 2, 3, 4, 5}, {7, 8}, {9, 10}, {13, 14}]
    assert got == {(0, a, b) for g in same for a in g for b in g if a < b} | {(50, 1, 6)}
    links = {r["id"]: r["ligacoes"] for r in names.spellings(autores, na, cargos).collect()}
    assert links[1] == 4 and links[6] == 0
    assert names.found(autores.limit(0), na.limit(0), cargos).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for p in glob.glob(small + "/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.QUERIES[name](spark, small)
    want = db.execute(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    value = lambda v: repr(float(v)) if isinstance(v, (int, float)) else str(v)
    assert sorted(tuple(value(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(value(r[i]) for i in order) for r in want.fetchall())
