"""Text functions: literal cases, nulls, and agreement with a plain Python version."""

import re
import unicodedata

from pyspark.sql import functions as F

from tabularium.functions import terms as tm
from tabularium.functions import text as tx
from tabularium.functions import vectors as vec


def one(spark, expr, *values, types="s string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], types).select(expr).collect()]


def test_titles(spark):
    cases = {
        "CONTROLADOR GERAL DO MUNICÍPIO": "CONTROLADOR GERAL DO MUNICIPIO",
        "CONTROLADOR GERAL DO MUNICÍPIO - SUBSTITUTO": "CONTROLADOR GERAL DO MUNICIPIO - SUBSTITUTO",
        "CONTROLADOR GERAL DO MUNICÍPIO.": "CONTROLADOR GERAL DO MUNICIPIO",
        "PREFEITA EM EXERCÍCIO": "PREFEITA EM EXERCICIO",
        "PREFEITO;": "PREFEITO",
        "SECRETÁRIO MUNICIPAL DOS NEGÓCIOS JURÍDICOS]": "SECRETARIO MUNICIPAL DOS NEGOCIOS JURIDICOS",
        unicodedata.normalize("NFD", "- Secretária "): "SECRETARIA",
        None: "",
        "": "",
    }
    assert one(spark, tx.sanitize_title(F.col("s")), *cases) == list(cases.values())


def test_tokens_and_sentences(spark):
    assert one(spark, tx.tokens(F.col("s")), "DISPÕE SOBRE A CRIAÇÃO DE NOVAS REGRAS PARA O TRÂNSITO") == [["sobre", "criação", "novas", "regras", "trânsito"]]
    assert one(spark, tx.sentences(F.col("s")), "Um. Dois; três - quatro\n cinco", "só uma", "  ") == [["Um.", "Dois;", "três -", "quatro", "cinco"], ["só uma"], []]
    assert one(spark, tx.tokens(F.col("s")), None, "", "a o") == [None, [], []]


def test_names_and_identifiers(spark):
    assert one(spark, tx.normalize_name(F.col("s")), " Fulano  de Tal ", None) == ["FULANO DE TAL", None]
    assert one(spark, tx.abbreviate(F.col("s"), 8), "curto", "comprido demais") == ["curto", "compr..."]
    rows = spark.createDataFrame([("Lei", 5, 2020, 1), (None, 0, None, 2)], "t string, n int, a int, i bigint")
    assert [r[0] for r in rows.select(tx.identifier(F.col("t"), F.col("n"), F.col("a"), F.col("i"))).collect()] == ["Lei nº 5/2020 (ID 1)", "Norma (ID 2)"]


def test_terms_of_any_unicode_form(spark):
    texts = ["Cria&ccedil;&atilde;o de &#231;&#xE3;o", unicodedata.normalize("NFD", "Criação ÀÉ"), "hospi​tal habitac­ional", "a & b &inexistente; fim", None, "...", "nº 123"]

    def plain(t):
        import html

        if t is None:
            return []
        t = unicodedata.normalize("NFD", html.unescape(t))
        t = "".join(c for c in t if not unicodedata.combining(c)).replace("​", "").replace("­", "").lower()
        return re.findall(r"[^\W\d_]{3,}", t)

    assert one(spark, tm.terms(F.col("s")), *texts) == [plain(t) for t in texts]


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(vec.dot(F.col("a"), F.col("b"))).collect()] == [3.0, 0.0, None]
    assert [r[0] for r in v.filter("a is not null").select(vec.norm(F.col("a"))).collect()] == [5.0, 0.0]
    texts = ["[0.123, -0.456, 0.789, 0.0]", "[]", "", None, "null", "[1, x, 2]"]
    got = one(spark, vec.decode(F.col("s")), *texts)
    assert [None if g is None else [round(x, 3) for x in g] for g in got] == [[0.123, -0.456, 0.789, 0.0], [], None, None, None, [1.0, 0.0, 2.0]]


def test_occurrences(spark):
    assert one(spark, tx.occurrences(F.col("s"), "href"), "a href b hrefhref", "", None) == [3, 0, None]
