"""The core queries, each with its reference SQL: name -> (spark, data folder) -> DataFrame. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions import text as tx
from tabularium.functions import vectors as vec
from tabularium.operators import embeddings, extraction, reductions, services, stats, topics, upsert
from tabularium.plans import sqltext as q
from tabularium.session import shared_dir, stage
from tabularium.sources.tables import table
from tabularium.streaming.incremental import process_new

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its reference SQL if plain SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus(table(spark, d, "normas"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return upsert.last_of(table(spark, d, "normas"), ["id"], "coletado_em")


# --- scans, filters, projections -------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(ementa) AS com_ementa FROM normas")
def count_rows(spark, d):
    """Rows, and rows with a summary."""
    return table(spark, d, "normas").agg(F.count("*").alias("n"), F.count("ementa").alias("com_ementa"))


@query("SELECT DISTINCT id, numero, ano, titulo FROM normas ORDER BY id, numero, ano, titulo LIMIT 10")
def preview_limit(spark, d):
    """The first ten norms."""
    return table(spark, d, "normas").select("id", "numero", "ano", "titulo").distinct().orderBy("id", "numero", "ano", "titulo").limit(10)


@query("SELECT id, length(integra) AS tamanho FROM normas WHERE integra IS NOT NULL AND trim(integra, ' ') <> ''")
def nonblank_projection(spark, d):
    """Norms with a full text."""
    return table(spark, d, "normas").filter(F.col("integra").isNotNull() & (F.trim("integra") != "")).select("id", F.length("integra").cast("bigint").alias("tamanho"))


@query("SELECT id, ementa, tipoescrito FROM normas WHERE ementa IS NOT NULL AND trim(ementa, ' ') <> '' ORDER BY id")
def nonblank_summaries(spark, d):
    """Norms with a summary, by id."""
    return table(spark, d, "normas").filter(F.col("ementa").isNotNull() & (F.trim("ementa") != "")).select("id", "ementa", "tipoescrito").orderBy("id")


@query("SELECT DISTINCT id FROM normas")
def key_set(spark, d):
    """The ids of all norms."""
    return table(spark, d, "normas").select("id").distinct()


@query("SELECT id, max(nome) AS nome FROM autores GROUP BY id UNION ALL SELECT CAST(id AS BIGINT), nome FROM rotulos_topicos")
def value_maps(spark, d):
    """Key to value of authors and of labels."""
    return table(spark, d, "autores").groupBy("id").agg(F.max("nome").alias("nome")).unionByName(table(spark, d, "rotulos_topicos").select(F.col("id").cast("bigint"), "nome"))


@query("SELECT lower(tiposlug || ':' || ano || ':' || numero) AS chave, max(id) AS id FROM normas WHERE tiposlug IS NOT NULL AND ano IS NOT NULL AND numero IS NOT NULL GROUP BY 1")
def key_map(spark, d):
    """Composite key to id; of several norms the highest id."""
    key = extraction.composite_key(F.col("tiposlug"), F.col("ano"), F.col("numero"))
    return table(spark, d, "normas").select(key.alias("chave"), "id").filter("chave IS NOT NULL").groupBy("chave").agg(F.max("id").alias("id"))


@query("SELECT column_name AS coluna FROM (DESCRIBE normas)")
def schema_info(spark, d):
    """The columns of a table."""
    return spark.createDataFrame([(c,) for c in table(spark, d, "normas").columns], "coluna string")


@query("SELECT * FROM norma_autor WHERE ativo = 0")
def filter_inactive(spark, d):
    """Links switched off."""
    return table(spark, d, "norma_autor").filter("ativo = 0")


@query("SELECT id, nome FROM autores WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34, 55)")
def in_list(spark, d):
    """Authors by a list of ids."""
    return table(spark, d, "autores").filter(F.col("id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55)).select("id", "nome")


@query("SELECT * FROM norma_autor WHERE (id_norma, id_autor) IN (SELECT id_norma, id_autor FROM norma_autor WHERE cargo_autor LIKE 'VICE%')")
def tuple_in(spark, d):
    """Rows whose pair of keys is in a list with repeated pairs: a semi-join never multiplies rows."""
    na = table(spark, d, "norma_autor")
    return na.join(na.filter(F.col("cargo_autor").startswith("VICE")).select("id_norma", "id_autor"), ["id_norma", "id_autor"], "left_semi").select(*na.columns)


@query("SELECT DISTINCT cargo_autor FROM norma_autor WHERE cargo_autor IS NOT NULL AND trim(cargo_autor, ' ') <> '' AND (cargo_autor_normalizado IS NULL OR trim(cargo_autor_normalizado, ' ') = '')")
def pending_titles(spark, d):
    """Distinct titles that aren't normalised yet."""
    blank = F.col("cargo_autor_normalizado").isNull() | (F.trim("cargo_autor_normalizado") == "")
    return table(spark, d, "norma_autor").filter(F.col("cargo_autor").isNotNull() & (F.trim("cargo_autor") != "") & blank).select("cargo_autor").distinct()


@query("SELECT id, url FROM normas WHERE integra ILIKE '%HREF=%' AND integra NOT ILIKE '%/decreto/%' AND integra NOT ILIKE '%/lei-ordinaria/%'")
def ilike_not_like(spark, d):
    """Norms that link, but to no decree or ordinary law; letter case doesn't matter."""
    i = F.col("integra")
    return table(spark, d, "normas").filter(i.ilike("%HREF=%") & ~i.ilike("%/decreto/%") & ~i.ilike("%/lei-ordinaria/%")).select("id", "url")


@query("SELECT count(*) AS n FROM ementas_pre_processadas WHERE trim(coalesce(stopwords_tfidf_topk, '')) <> '' OR trim(coalesce(svd_lsa, '')) <> '' OR trim(coalesce(textrank, '')) <> ''")
def any_nonblank(spark, d):
    """Rows where one of several reductions is filled."""
    some = None
    for c in ("stopwords_tfidf_topk", "svd_lsa", "textrank"):
        one = F.trim(F.coalesce(c, F.lit(""))) != ""
        some = one if some is None else some | one
    return table(spark, d, "ementas_pre_processadas").filter(some).agg(F.count("*").alias("n"))


@query("SELECT e.id_norma, coalesce(stopwords_tfidf_topk, '') || ' ' || coalesce(svd_lsa, '') AS texto FROM ementas_pre_processadas e WHERE id_norma IN (SELECT id FROM normas) ORDER BY e.id_norma")
def coalesce_concat(spark, d):
    """The topic model's input: two reductions joined, for norms that exist."""
    e = table(spark, d, "ementas_pre_processadas").join(table(spark, d, "normas").select(F.col("id").alias("id_norma")), "id_norma", "left_semi")
    return e.select("id_norma", F.concat(F.coalesce("stopwords_tfidf_topk", F.lit("")), F.lit(" "), F.coalesce("svd_lsa", F.lit(""))).alias("texto")).orderBy("id_norma")


# --- joins and aggregations ---------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT n.id) AS n FROM normas n JOIN norma_autor a ON a.id_norma = n.id")
def count_distinct_join(spark, d):
    """Norms with an author. A semi-join per distinct key: no row is multiplied before counting."""
    return table(spark, d, "normas").select("id").distinct().join(table(spark, d, "norma_autor").select(F.col("id_norma").alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT n.id) AS n FROM normas n JOIN norma_autor a ON a.id_norma = n.id AND a.ativo = 1")
def count_distinct_join_active(spark, d):
    """Norms with an active author."""
    active = table(spark, d, "norma_autor").filter("ativo = 1").select(F.col("id_norma").alias("id"))
    return table(spark, d, "normas").select("id").distinct().join(active, "id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT n.id) AS n FROM normas n LEFT JOIN norma_autor a ON a.id_norma = n.id WHERE a.id_norma IS NULL")
def anti_join_count(spark, d):
    """Norms without an author."""
    return table(spark, d, "normas").select("id").distinct().join(table(spark, d, "norma_autor").select(F.col("id_norma").alias("id")), "id", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT na.id_norma, na.id_autor, a.nome, na.cargo_autor FROM norma_autor na JOIN (SELECT id, max(nome) AS nome FROM autores GROUP BY id) a ON a.id = na.id_autor WHERE na.cargo_autor IN ('PREFEITO', 'VEREADOR', 'VEREADORA')")
def in_list_join(spark, d):
    """Links of some titles with the author's name."""
    names = table(spark, d, "autores").groupBy(F.col("id").alias("id_autor")).agg(F.max("nome").alias("nome"))
    return table(spark, d, "norma_autor").filter(F.col("cargo_autor").isin("PREFEITO", "VEREADOR", "VEREADORA")).join(names, "id_autor").select("id_norma", "id_autor", "nome", "cargo_autor")


@query("SELECT min(id_norma) AS id_norma, min(id_autor) AS id_autor, cargo_autor FROM norma_autor GROUP BY cargo_autor")
def group_min(spark, d):
    """An example row of each title."""
    return table(spark, d, "norma_autor").groupBy("cargo_autor").agg(F.min("id_norma").alias("id_norma"), F.min("id_autor").alias("id_autor")).select("id_norma", "id_autor", "cargo_autor")


@query("SELECT min(id) AS id, nome FROM autores GROUP BY nome")
def bare_group(spark, d):
    """One id per name."""
    return table(spark, d, "autores").groupBy("nome").agg(F.min("id").alias("id")).select("id", "nome")


@query("SELECT DISTINCT cargo_autor_normalizado FROM norma_autor WHERE ativo = 1 AND cargo_autor_normalizado IS NOT NULL ORDER BY 1")
def distinct_sorted(spark, d):
    """The normalised titles in use, sorted."""
    return table(spark, d, "norma_autor").filter("ativo = 1 AND cargo_autor_normalizado IS NOT NULL").select("cargo_autor_normalizado").distinct().orderBy("cargo_autor_normalizado")


_HREF = ("href", 'href="https://normas.cidade.example/decreto', 'href="https://normas.cidade.example/lei-ordinaria', "href=https://normas.cidade.example/lei-complementar")


@query("SELECT CAST(sum((length(integra) - length(replace(integra, 'href', ''))) // 4) AS BIGINT) AS total FROM normas")
def substr_occurrences(spark, d):
    """How often a literal occurs in all full texts."""
    return table(spark, d, "normas").agg(F.sum(tx.occurrences(F.col("integra"), "href")).alias("total"))


@query(
    "SELECT *, total - (decretos + leis + complementares) AS diferenca FROM (SELECT "
    + ", ".join(f"CAST(sum((length(integra) - length(replace(integra, '{p}', ''))) // {len(p)}) AS BIGINT) AS {n}" for p, n in zip(_HREF, ("total", "decretos", "leis", "complementares")))
    + " FROM normas)"
)
def occurrence_diff(spark, d):
    """Occurrences of several literals and what is left of the first."""
    sums = [F.sum(tx.occurrences(F.col("integra"), p)).alias(n) for p, n in zip(_HREF, ("total", "decretos", "leis", "complementares"))]
    return table(spark, d, "normas").agg(*sums).withColumn("diferenca", F.expr("total - (decretos + leis + complementares)"))


@query("SELECT DISTINCT n.id FROM normas n LEFT JOIN ementas_pre_processadas e ON e.id_norma = n.id WHERE n.ementa IS NOT NULL AND trim(n.ementa, ' ') <> '' AND (e.id IS NULL OR e.textrank IS NULL OR trim(e.textrank, ' ') = '') ORDER BY n.id")
def pending_left_join(spark, d):
    """Norms whose reduction is missing or blank."""
    n = table(spark, d, "normas").filter(F.col("ementa").isNotNull() & (F.trim("ementa") != "")).select("id").distinct()
    e = table(spark, d, "ementas_pre_processadas").select(F.col("id_norma").alias("id"), "textrank", F.lit(True).alias("tem"))
    return n.join(e, "id", "left").filter(F.col("tem").isNull() | F.col("textrank").isNull() | (F.trim("textrank") == "")).select("id").distinct().orderBy("id")


@query("SELECT e.id, e.id_norma, n.numero, n.ano, len(e.embeddings) AS tamanho FROM ementas_pre_processadas e JOIN (SELECT id, max(coalesce(numero, 0)) AS numero, max(coalesce(ano, 0)) AS ano FROM normas GROUP BY id) n ON n.id = e.id_norma WHERE e.embeddings IS NOT NULL ORDER BY e.id")
def embedding_rows(spark, d):
    """Norms with a vector; null numbers become 0."""
    n = table(spark, d, "normas").groupBy(F.col("id").alias("id_norma")).agg(F.max(F.coalesce("numero", F.lit(0))).alias("numero"), F.max(F.coalesce("ano", F.lit(0))).alias("ano"))
    e = table(spark, d, "ementas_pre_processadas").filter("embeddings IS NOT NULL").select("id", "id_norma", F.size("embeddings").cast("bigint").alias("tamanho"))
    return e.join(n, "id_norma").select("id", "id_norma", "numero", "ano", "tamanho").orderBy("id")


@query("SELECT t.id_norma, t.id_topico, r.nome AS rotulo, round(t.score_pertinencia, 4) AS score FROM norma_topicos t JOIN rotulos_topicos r ON r.id = t.id_rotulo_topico")
def topic_join(spark, d):
    """Topics of norms with their labels."""
    r = table(spark, d, "rotulos_topicos").select(F.col("id").alias("id_rotulo_topico"), F.col("nome").alias("rotulo"))
    return table(spark, d, "norma_topicos").join(r, "id_rotulo_topico").select("id_norma", "id_topico", "rotulo", F.round("score_pertinencia", 4).alias("score"))


@query("SELECT t.id, r.nome AS rotulo, t.termos_principais, string_split_regex(t.termos_principais, ',\\s*')[1] AS primeiro, t.total_normas FROM topicos t JOIN rotulos_topicos r ON r.id = t.id_rotulo_topico ORDER BY t.id")
def label_join(spark, d):
    """Topics with labels and their first term."""
    r = table(spark, d, "rotulos_topicos").select(F.col("id").alias("id_rotulo_topico"), F.col("nome").alias("rotulo"))
    return table(spark, d, "topicos").join(r, "id_rotulo_topico").select("id", "rotulo", "termos_principais", F.get(F.split("termos_principais", ",\\s*"), 0).alias("primeiro"), "total_normas").orderBy("id")


@query("SELECT id_autor, count(DISTINCT id_norma) AS normas FROM norma_autor WHERE ativo = 1 GROUP BY id_autor HAVING count(DISTINCT id_norma) >= 10 ORDER BY normas DESC, id_autor LIMIT 10")
def threshold_having(spark, d):
    """The ten authors of most norms, with ten norms at least."""
    pairs = table(spark, d, "norma_autor").filter("ativo = 1").select("id_autor", "id_norma").distinct()
    return pairs.groupBy("id_autor").agg(F.count("*").alias("normas")).filter("normas >= 10").orderBy(F.col("normas").desc(), "id_autor").limit(10)


@query("SELECT DISTINCT id_autor, id_norma FROM norma_autor WHERE ativo = 1")
def group_list(spark, d):
    """The norms of each author in long form, so that an author of a tenth of all rows needs no single list."""
    return table(spark, d, "norma_autor").filter("ativo = 1").select("id_autor", "id_norma").distinct()


@query("SELECT id_autor, max(cargo_autor) AS cargo FROM norma_autor GROUP BY id_autor")
def last_value(spark, d):
    """One title per author: the greatest."""
    return table(spark, d, "norma_autor").groupBy("id_autor").agg(F.max("cargo_autor").alias("cargo"))


@query("SELECT CAST(count(*) AS BIGINT) AS linhas, count_if(id_norma_destino IS NULL) AS sem_destino FROM norma_relacionamentos")
def edge_counts(spark, d):
    """Citation edges, and those without a target."""
    return table(spark, d, "norma_relacionamentos").agg(F.count("*").alias("linhas"), F.count_if(F.col("id_norma_destino").isNull()).alias("sem_destino"))


@query("SELECT r.id, r.id_norma_destino, n.id IS NOT NULL AS existe FROM norma_relacionamentos r LEFT JOIN (SELECT DISTINCT id FROM normas) n ON n.id = r.id_norma_destino")
def semi_join_resolve(spark, d):
    """Whether the target of an edge exists."""
    n = table(spark, d, "normas").select(F.col("id").alias("id_norma_destino"), F.lit(True).alias("e")).distinct()
    return table(spark, d, "norma_relacionamentos").select("id", "id_norma_destino").join(n, "id_norma_destino", "left").select("id", "id_norma_destino", F.col("e").isNotNull().alias("existe"))


@query(
    """WITH m AS (SELECT lower(tiposlug || ':' || ano || ':' || numero) AS chave, max(id) AS id FROM normas WHERE tiposlug IS NOT NULL AND ano IS NOT NULL AND numero IS NOT NULL GROUP BY 1),
ids AS (SELECT DISTINCT id FROM normas)
SELECT r.id, coalesce(i.id, m.id) AS destino FROM norma_relacionamentos r LEFT JOIN ids i ON i.id = r.id_norma_destino
LEFT JOIN m ON m.chave = lower(r.tipo_slug_alvo || ':' || r.ano_alvo || ':' || r.numero_alvo)"""
)
def two_stage_join(spark, d):
    """Targets by id, else by composite key."""
    r = table(spark, d, "norma_relacionamentos").select("id", "id_norma_destino", extraction.composite_key(F.col("tipo_slug_alvo"), F.col("ano_alvo"), F.col("numero_alvo")).alias("chave"))
    ids = table(spark, d, "normas").select(F.col("id").alias("id_norma_destino"), F.col("id").alias("a")).distinct()
    return r.join(ids, "id_norma_destino", "left").join(key_map(spark, d).withColumnRenamed("id", "b"), "chave", "left").select("id", F.coalesce("a", "b").alias("destino"))


@query("SELECT r1.nome AS a FROM rotulos_topicos r1 UNION SELECT tipo_relacionamento FROM norma_relacionamentos ORDER BY 1")
def union_distinct(spark, d):
    """The union of two label sets."""
    return table(spark, d, "rotulos_topicos").select(F.col("nome").alias("a")).union(table(spark, d, "norma_relacionamentos").select("tipo_relacionamento")).distinct().orderBy("a")


# --- changes of tables ---------------------------------------------------------------------------------------------

_LATEST = "SELECT id, arg_max(titulo, coletado_em) AS titulo, max(coletado_em) AS coletado_em FROM normas GROUP BY id"


@query(f"SELECT id, titulo, epoch_us(coletado_em) AS quando FROM ({_LATEST})")
def upsert_replace(spark, d):
    """Norms fetched again replace the earlier row."""
    n = table(spark, d, "normas").select("id", "titulo", "coletado_em")
    first = n.groupBy("id").agg(F.min(F.struct("coletado_em", "titulo")).alias("m")).select("id", "m.titulo", "m.coletado_em")
    return upsert.replace_rows(first, upsert.last_of(n, ["id"], "coletado_em"), ["id"]).select("id", "titulo", F.unix_micros("coletado_em").alias("quando"))


@query("SELECT id_norma, 'novo ' || id_norma AS textrank, svd_lsa, len(embeddings) AS dim FROM ementas_pre_processadas WHERE id % 2 = 0 UNION ALL SELECT id_norma, textrank, svd_lsa, len(embeddings) FROM ementas_pre_processadas WHERE id % 2 = 1")
def upsert_partial(spark, d):
    """New values of one column for some rows; the other columns, vectors too, stay."""
    e = table(spark, d, "ementas_pre_processadas").select("id", "id_norma", "textrank", "svd_lsa", "embeddings")
    new = e.filter("id % 2 = 0").select("id", F.concat(F.lit("novo "), F.col("id_norma").cast("string")).alias("textrank"))
    return upsert.update_columns(e, new, ["id"], ["textrank"]).select("id_norma", "textrank", "svd_lsa", F.when(F.col("embeddings").isNotNull(), F.size("embeddings")).cast("bigint").alias("dim"))


@query("SELECT DISTINCT id_norma, id_autor, upper(regexp_replace(trim(cargo_autor), '\\s+', ' ', 'g')) AS cargo_autor, cargo_autor_normalizado, ativo FROM norma_autor")
def upsert_bridge(spark, d):
    """Links with their title as stored; flags and normalised titles stay."""
    return table(spark, d, "norma_autor").withColumn("cargo_autor", tx.normalize_name(F.col("cargo_autor"))).distinct()


@query("SELECT id_norma, id_autor, cargo_autor, coalesce(c.cargo, cargo_autor_normalizado) AS cargo_autor_normalizado FROM norma_autor LEFT JOIN cargos_canonicos c ON c.cargo = cargo_autor")
def update_by_map(spark, d):
    """Normalised titles by a mapping."""
    m = table(spark, d, "cargos_canonicos").select(F.col("cargo").alias("cargo_autor"), F.col("cargo").alias("valor"))
    return upsert.update_by_map(table(spark, d, "norma_autor"), m, "cargo_autor", "cargo_autor_normalizado").drop("ativo")


@query("SELECT id_norma, id_autor, cargo_autor, CASE WHEN (id_norma, id_autor) IN (SELECT id_norma, id_autor FROM norma_autor WHERE cargo_autor IN ('CAPELÃO', 'JUIZ DE PAZ')) THEN 0 ELSE 1 END AS ativo FROM norma_autor")
def soft_delete_update(spark, d):
    """Everything on, then the listed pairs off."""
    na = table(spark, d, "norma_autor").drop("cargo_autor_normalizado")
    return upsert.set_where(na, "ativo", na.filter(F.col("cargo_autor").isin("CAPELÃO", "JUIZ DE PAZ")).select("id_norma", "id_autor"), 0, 1).select("id_norma", "id_autor", "cargo_autor", "ativo")


@query("SELECT id_norma, id_autor, CASE WHEN id_autor IN (1, 2, 3) THEN 0 ELSE ativo END AS ativo FROM norma_autor")
def conditional_update(spark, d):
    """A flag by a list of ids."""
    return table(spark, d, "norma_autor").select("id_norma", "id_autor", F.when(F.col("id_autor").isin(1, 2, 3), 0).otherwise(F.col("ativo")).alias("ativo"))


@query(
    """WITH k AS (SELECT DISTINCT upper(regexp_replace(trim(nome), '\\s+', ' ', 'g')) AS nome FROM autores), old AS (SELECT row_number() OVER (ORDER BY cargo) AS id, cargo AS nome FROM cargos_canonicos)
SELECT CAST(id AS BIGINT) AS id, nome FROM old UNION ALL SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY nome) AS BIGINT), nome FROM k WHERE nome NOT IN (SELECT nome FROM old)"""
)
def get_or_create_ids(spark, d):
    """Names to ids: known ones keep theirs, new ones follow in order."""
    old = table(spark, d, "cargos_canonicos").select(F.row_number().over(Window.orderBy("cargo")).cast("bigint").alias("id"), F.col("cargo").alias("nome"))  # the fixed list of 59 titles
    return upsert.get_or_create(old, table(spark, d, "autores").select(tx.normalize_name(F.col("nome")).alias("nome")))


@query("SELECT id, id_norma_origem FROM norma_relacionamentos UNION ALL SELECT id, id_norma_origem FROM norma_relacionamentos WHERE tipo_relacionamento = 'VIDE'")
def append_rows(spark, d):
    """A table with more rows appended."""
    r = table(spark, d, "norma_relacionamentos")
    return r.select("id", "id_norma_origem").unionByName(r.filter("tipo_relacionamento = 'VIDE'").select("id", "id_norma_origem"))


@query("SELECT id, nome, CAST(NULL AS VARCHAR) AS apelido FROM autores")
def additive_migration(spark, d):
    """A column added where it is missing."""
    return upsert.add_columns(table(spark, d, "autores"), {"apelido": "string", "nome": "string"})


# --- scalar text functions -------------------------------------------------------------------------------------------


@query(f"WITH {q.CORPUS} SELECT id, array_to_string({q.tokens('texto')}, ' ') AS tokens, array_to_string({q.tokens('texto', True)}, ' ') AS todos FROM c")
def tokenize(spark, d):
    """Tokens of each summary without and with stop words."""
    return _docs(spark, d).select("id", F.array_join(tx.tokens(F.col("texto")), " ").alias("tokens"), F.array_join(tx.tokens(F.col("texto"), True), " ").alias("todos"))


@query(f"SELECT doc_id, CAST(u.i AS INTEGER) AS frase, u.s AS texto FROM (SELECT doc_id, unnest(list_transform({q.sentences('text')}, lambda s, j: {{'s': s, 'i': j - 1}})) AS u FROM documents WHERE regexp_matches(text, '\\S'))")
def sentences(spark, d):
    """Sentences of each document with their position."""
    return table(spark, d, "documents").filter(F.col("text").rlike("\\S")).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("frase", "texto"))


@query(f"WITH {q.CORPUS}, k AS (SELECT id, {q.tokens('texto')} AS ts FROM c) SELECT b AS bigrama, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1])) AS b FROM k WHERE len(ts) > 1) GROUP BY b")
def bigrams(spark, d):
    """Pairs of neighbouring tokens with their counts."""
    t = tx.tokens(F.col("texto"))
    rows = _docs(spark, d).select(t.alias("t")).filter(F.size("t") > 1)
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.element_at("t", i), F.lit("_"), F.element_at("t", i + 1)))).alias("bigrama")).groupBy("bigrama").agg(F.count("*").alias("n"))


_EDGE = "[.,;:\\]\\[=\\-–—\\s]+"


@query(f"SELECT DISTINCT cargo_autor, trim(upper(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(trim(cargo_autor), '\\p{{M}}', '', 'g')), '{_EDGE}$', ''), '^{_EDGE}', ''), '\\s+', ' ', 'g'))) AS titulo FROM norma_autor WHERE cargo_autor IS NOT NULL")
def sanitize_titles(spark, d):
    """Typed titles in their plain form."""
    return table(spark, d, "norma_autor").filter("cargo_autor IS NOT NULL").select("cargo_autor").distinct().withColumn("titulo", tx.sanitize_title(F.col("cargo_autor")))


@query("SELECT DISTINCT nome, upper(regexp_replace(trim(nome), '\\s+', ' ', 'g')) AS normal FROM autores")
def normalize_names(spark, d):
    """Names as stored."""
    return table(spark, d, "autores").select("nome", tx.normalize_name(F.col("nome")).alias("normal")).distinct()


@query("SELECT DISTINCT titulo, CASE WHEN length(titulo) > 20 THEN substr(titulo, 1, 17) || '...' ELSE titulo END AS curto FROM normas")
def abbreviations(spark, d):
    """Titles cut to twenty characters."""
    return table(spark, d, "normas").select("titulo", tx.abbreviate(F.col("titulo"), 20).alias("curto")).distinct()


@query("SELECT DISTINCT id, coalesce(tipoescrito, 'Norma') || CASE WHEN coalesce(numero, 0) > 0 THEN ' nº ' || numero ELSE '' END || CASE WHEN coalesce(ano, 0) > 0 THEN '/' || ano ELSE '' END || ' (ID ' || id || ')' AS nome FROM normas")
def identifiers(spark, d):
    """How a norm is called in reports."""
    return table(spark, d, "normas").select("id", tx.identifier(F.col("tipoescrito"), F.col("numero"), F.col("ano"), F.col("id")).alias("nome")).distinct()


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(trecho_contexto, '(?i){p}') THEN '{n}'" for n, p in extraction.RELATIONS) + f" ELSE '{extraction.DEFAULT_RELATION}' END"


@query(f"SELECT id, {_CLASS} AS classe FROM norma_relacionamentos")
def relation_class(spark, d):
    """The class of each citation by its context."""
    return table(spark, d, "norma_relacionamentos").select("id", extraction.relation_class(F.col("trecho_contexto")).alias("classe"))


_HERE = "(?i)normas\\.cidade\\.example/([a-z0-9\\-]+)(?:/(\\d{4}))?(?:/[^/]+)?(?:/(\\d+))?"


@query(
    "SELECT id, nullif(regexp_extract(url_alvo, '{p}', 1), '') AS slug, TRY_CAST(nullif(regexp_extract(url_alvo, '{p}', 2), '') AS INTEGER) AS ano, TRY_CAST(nullif(regexp_extract(url_alvo, '{p}', 3), '') AS INTEGER) AS numero FROM norma_relacionamentos".replace(
        "{p}", _HERE
    )
)
def url_parts(spark, d):
    """Slug, year and number of each target address."""
    slug, year, number = extraction.address_parts(F.col("url_alvo"), None)
    return table(spark, d, "norma_relacionamentos").select("id", slug.alias("slug"), year.alias("ano"), number.alias("numero"))


_EDGES = f"""WITH n AS (SELECT id, arg_max(integra, coletado_em) AS integra, arg_max(tiposlug, coletado_em) AS tiposlug, arg_max(ano, coletado_em) AS ano, arg_max(numero, coletado_em) AS numero FROM normas GROUP BY id),
p AS (SELECT id, integra, string_split_regex(integra, '(?i)<a\\b') AS l FROM n WHERE integra IS NOT NULL),
o AS (SELECT id, integra, l[i] AS trecho, CAST(list_sum(list_transform(l[1:i - 1], lambda x: length(x))) + 2 * (i - 2) AS BIGINT) AS pos FROM (SELECT id, integra, l, unnest(range(2, len(l) + 1)) AS i FROM p)),
f AS (SELECT id, regexp_extract(trecho, '^[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS url, TRY_CAST(nullif(regexp_extract(trecho, '^[^>]*?\\bdata-id\\s*=\\s*["'']?(\\d+)', 1), '') AS BIGINT) AS data_id,
  trim(regexp_replace(regexp_replace(substr(integra, CAST(greatest(1, pos - 99) AS BIGINT), CAST(least(100, pos) AS BIGINT)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS trecho_contexto FROM o),
g AS (SELECT *, {{slug}} AS slug, {{ano}} AS ano, {{numero}} AS numero FROM f WHERE url <> ''),
k AS (SELECT lower(tiposlug || ':' || ano || ':' || numero) AS chave, max(id) AS id FROM n WHERE tiposlug IS NOT NULL AND ano IS NOT NULL AND numero IS NOT NULL GROUP BY 1)
SELECT g.id AS id_norma_origem, coalesce(i.id, k.id) AS id_norma_destino, {_CLASS} AS tipo_relacionamento, url AS url_alvo, slug AS tipo_slug_alvo, g.ano AS ano_alvo, g.numero AS numero_alvo, trecho_contexto
FROM g LEFT JOIN (SELECT DISTINCT id FROM n) i ON i.id = g.data_id LEFT JOIN k ON k.chave = lower(g.slug || ':' || g.ano || ':' || g.numero)"""
for _name, _part in (("{slug}", "nullif(regexp_extract(url, '{p}', 1), '')"), ("{ano}", "TRY_CAST(nullif(regexp_extract(url, '{p}', 2), '') AS INTEGER)"), ("{numero}", "TRY_CAST(nullif(regexp_extract(url, '{p}', 3), '') AS INTEGER)")):
    _EDGES = _EDGES.replace(_name, _part.replace("{p}", _HERE))


@query(_EDGES)
def link_edges(spark, d):
    """Citation edges found in the full texts, with their targets resolved."""
    n = _latest(spark, d)
    return extraction.citation_edges(n, n.select("id", "tiposlug", "ano", "numero"), city=None)


_TEXT = "replace(" + q.references("regexp_replace(regexp_replace(integra, '(?i)<br\\s*\\\\?\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')") + ", chr(160), ' ')"


#: The data's own markers: of several beginnings the last one counts, of several ends the first behind it.
_STARTS, _ENDS = ("PREFEITURA DO MUNICÍPIO DE", "REVOGAM-SE AS DISPOSIÇÕES EM CONTRÁRIO"), ("PUBLICADO NA DATA SUPRA", "PUBLICADO NA SECRETARIA")
_BEGIN = "greatest(" + ", ".join(f"CASE WHEN contains(upper(t), '{m}') THEN length(t) - length(string_split(upper(t), '{m}')[-1]) - {len(m)} + 1 ELSE 0 END" for m in _STARTS) + ")"
_STOP = "least(" + ", ".join(f"nullif(strpos(upper(s), '{m}'), 0)" for m in _ENDS) + ")"
_SIGNED = f"""x AS (SELECT DISTINCT id, regexp_replace({_TEXT}, '[ \\t]+', ' ', 'g') AS t FROM normas WHERE integra IS NOT NULL),
b AS (SELECT id, substr(t, b) AS s FROM (SELECT id, t, {_BEGIN} AS b FROM x) WHERE b > 0),
l AS (SELECT id, list_transform(string_split_regex(coalesce(substr(s, 1, {_STOP} - 1), s), '\\r\\n|\\n|\\r'), lambda s: trim(s)) AS l FROM b),
e AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM l),
p AS (SELECT id, CASE WHEN strpos(l[i], ',') <= 1 OR strpos(l[i], ',') = length(l[i]) THEN l[i] ELSE trim(substr(l[i], 1, strpos(l[i], ',') - 1)) END AS nome,
  CASE WHEN strpos(l[i], ',') <= 1 OR strpos(l[i], ',') = length(l[i]) THEN l[i + 1] ELSE trim(substr(l[i], strpos(l[i], ',') + 1)) END AS cargo FROM e WHERE l[i] <> ''),
v AS (SELECT DISTINCT id, nome, cargo FROM p WHERE regexp_full_match(nome, '\\p{{L}}+(?:[ .''-]\\p{{L}}+){{1,9}}') AND length(cargo) <= 120 AND NOT regexp_matches(cargo, '\\d') AND NOT contains(cargo, '<') AND NOT contains(cargo, 'http')
AND regexp_matches(cargo, '{extraction.TITLE.replace('á', '(?-i:á)')}'))"""


@query(f"WITH {_SIGNED} SELECT id, nome, cargo FROM v")
def author_pairs(spark, d):
    """Signing authors and titles found in the full texts."""
    docs = table(spark, d, "normas").filter("integra IS NOT NULL").select("id", "integra").distinct()
    return extraction.signatures(docs, starts=_STARTS, ends=_ENDS)


def _stored(x: str) -> str:
    return f"upper(regexp_replace(trim({x}), '\\s+', ' ', 'g'))"


@query(
    f"""WITH {_SIGNED}, old AS (SELECT min(id) AS id, {_stored('nome')} AS nome FROM autores WHERE nome IS NOT NULL GROUP BY 2), s AS (SELECT id AS id_norma, {_stored('nome')} AS nome, {_stored('cargo')} AS cargo FROM v),
fresh AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY nome) AS id, nome FROM (SELECT DISTINCT nome FROM s WHERE nome NOT IN (SELECT nome FROM old))),
w AS (SELECT id_norma, a.id AS id_autor, max(cargo) AS cargo FROM s JOIN (SELECT * FROM old UNION ALL SELECT * FROM fresh) a USING (nome) GROUP BY 1, 2)
SELECT coalesce(n.id_norma, w.id_norma) AS id_norma, coalesce(n.id_autor, w.id_autor) AS id_autor, CASE WHEN w.id_norma IS NOT NULL THEN w.cargo ELSE n.cargo_autor END AS cargo_autor, n.cargo_autor_normalizado, coalesce(n.ativo, 1) AS ativo
FROM norma_autor n FULL JOIN w ON w.id_norma = n.id_norma AND w.id_autor = n.id_autor"""
)
def author_store(spark, d):
    """The links after the signing authors of the full texts have been stored."""
    return services.store_authors(author_pairs(spark, d), table(spark, d, "autores"), table(spark, d, "norma_autor"))[1]


@query(
    f"SELECT DISTINCT cargo_autor, trim(upper(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(trim(CASE WHEN cargo_autor LIKE 'P%' THEN 'Titular ' || cargo_autor ELSE cargo_autor END), '\\p{{M}}', '', 'g')), '{_EDGE}$', ''), '^{_EDGE}', ''), '\\s+', ' ', 'g'))) AS valor "
    "FROM norma_autor WHERE cargo_autor IS NOT NULL AND trim(cargo_autor, ' ') <> '' AND (cargo_autor_normalizado IS NULL OR trim(cargo_autor_normalizado, ' ') = '')"
)
def title_answers(spark, d):
    """Pending titles normalised by a recorded model, which answers only for some; the others get their sanitised form."""
    return services.normalize_titles(pending_titles(spark, d), _recorded)


def _recorded(titles: list[str]) -> str:
    """What a model of titles might answer: JSON in JSON, after a thought."""
    import json

    results = [{"original": t, "normalizado": "Titular " + t} for t in titles if t.startswith("P")]
    parts = [{"text": "...", "thought": True}, {"text": "```json\n" + json.dumps({"resultados": results}) + "\n```"}]
    return json.dumps({"candidates": [{"content": {"parts": parts}}]})


# --- corpus statistics and reductions ---------------------------------------------------------------------------------


@query(f"WITH {q.TERMS} SELECT termo, df FROM d")
def doc_freq(spark, d):
    """Document frequency of each token."""
    return stats.document_frequency(_docs(spark, d))


@query(f"WITH {q.TERMS} SELECT termo, df, round(idf, 6) AS idf FROM i")
def idf(spark, d):
    """Inverse document frequency of each token."""
    docs = _docs(spark, d)
    return stats.with_idf(stats.document_frequency(docs), docs.count()).withColumn("idf", F.round("idf", 6))


_GRID = f"""{q.TERMS}, s AS (SELECT classe, count(*) AS cs FROM c GROUP BY 1), a AS (SELECT termo, classe, count(*) AS a FROM u GROUP BY 1, 2),
gr AS (SELECT d.termo, d.df, CAST(coalesce(a.a, 0) AS DOUBLE) AS a, CAST(d.df AS DOUBLE) AS t, CAST(cs AS DOUBLE) AS cs, CAST(n AS DOUBLE) AS n FROM d CROSS JOIN s CROSS JOIN nn LEFT JOIN a ON a.termo = d.termo AND a.classe = s.classe),
m AS (SELECT termo, any_value(df) AS df, greatest(0, max(CASE WHEN t * cs * (n - t) * (n - cs) <> 0 THEN n * pow(a * (n - t - cs + a) - (t - a) * (cs - a), 2) / (t * cs * (n - t) * (n - cs)) ELSE 0 END)) AS chi2,
 greatest(0, max(CASE WHEN a > 0 THEN a / n * log2(a / n / (t / n * (cs / n))) ELSE 0 END)) AS mi FROM gr GROUP BY termo)"""


@query(f"WITH {_GRID} SELECT termo, df, round(chi2, 5) AS chi2 FROM m")
def chi_square(spark, d):
    """The greatest chi-square of each token over the classes."""
    docs = _docs(spark, d)
    return stats.class_scores(docs, docs.count()).select("termo", "df", F.round("chi2", 5).alias("chi2"))


@query(f"WITH {_GRID} SELECT termo, df, round(mi, 6) AS mi FROM m")
def mutual_information(spark, d):
    """The greatest mutual information of each token with a class."""
    docs = _docs(spark, d)
    return stats.class_scores(docs, docs.count()).select("termo", "df", F.round("mi", 6).alias("mi"))


_TF = "SELECT k.id, x.termo, x.c / len(k.{l}) * coalesce(i.idf, ln(nn.n + 1.0) + 1.0) AS score FROM (SELECT id, termo, count(*) AS c FROM (SELECT id, unnest({l}) AS termo FROM k) GROUP BY 1, 2) x JOIN k ON k.id = x.id LEFT JOIN i ON i.termo = x.termo CROSS JOIN nn"


@query(f"WITH {q.TERMS}" + q.top_terms(_TF.replace("{l}", "ts")))
def tfidf_topk_stop(spark, d):
    """Reduction 1: the tokens of highest TF-IDF."""
    return reductions.tfidf_topk(_docs(spark, d))


@query(f"WITH {q.TERMS.replace('AS ts FROM c', 'AS ts, ' + q.tokens('texto', True) + ' AS ta FROM c')}" + q.top_terms(_TF.replace("{l}", "ta")))
def tfidf_topk_raw(spark, d):
    """Reduction 2: the same with stop words kept."""
    return reductions.tfidf_topk(_docs(spark, d), stopwords=True)


_SUM = "SELECT id, frase, sum(w) / sqrt(sum(c)) AS score FROM w GROUP BY 1, 2"


@query(f"WITH {q.SENTENCES}" + q.best_sentence(_SUM))
def extractive_summary(spark, d):
    """Reduction 3: the heaviest sentence."""
    return reductions.extractive_summary(_docs(spark, d))


@query(f"WITH {q.SENTENCES}" + q.best_sentence(_SUM, "(1.0 + 1.0 / (f.frase + 1.0))"))
def position_summary(spark, d):
    """Reduction 5: the heaviest sentence, early ones weighing more."""
    return reductions.position_summary(_docs(spark, d))


@query(
    f"WITH {q.SENTENCES}, v AS (SELECT id, termo, sum(w) AS v FROM w GROUP BY 1, 2), nd AS (SELECT id, sqrt(sum(v * v)) AS nd FROM v GROUP BY 1)"
    + q.best_sentence("SELECT w.id, w.frase, 0.65 * sum(w.w * v.v) / (sqrt(sum(w.w * w.w)) * any_value(nd.nd)) AS score FROM w JOIN v ON v.id = w.id AND v.termo = w.termo JOIN nd ON nd.id = w.id GROUP BY 1, 2")
)
def mmr_summary(spark, d):
    """Reduction 6: the sentence of maximal marginal relevance."""
    return reductions.mmr_summary(_docs(spark, d))


@query(
    f"WITH {q.SENTENCES}, ns AS (SELECT id, frase, sqrt(sum(w * w)) AS ns FROM w GROUP BY 1, 2), x AS (SELECT w.id, w.frase, w.termo, w.w / ns.ns AS u FROM w JOIN ns ON ns.id = w.id AND ns.frase = w.frase), tt AS (SELECT id, termo, sum(u) AS t FROM x GROUP BY 1, 2)"
    + q.best_sentence("SELECT x.id, x.frase, sum(x.u * tt.t) - 1 AS score FROM x JOIN tt ON tt.id = x.id AND tt.termo = x.termo GROUP BY 1, 2")
)
def centrality_summary(spark, d):
    """Reduction 7: the sentence most like the others."""
    return reductions.centrality_summary(_docs(spark, d))


@query(
    f"""WITH {q.TERMS}, x AS (SELECT id, p.t AS termo, min(p.j) AS pos FROM (SELECT id, unnest(list_transform(ts, lambda t, j: {{'t': t, 'j': j}})) AS p FROM k) GROUP BY 1, 2),
y AS (SELECT x.*, d.df, max(d.df) OVER (PARTITION BY id) AS m FROM x JOIN d USING (termo)), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM y WHERE df >= 2 OR m < 2),
g AS (SELECT id, string_agg(termo, ' ' ORDER BY r) AS texto FROM z WHERE r <= 8 GROUP BY 1) SELECT c.id, coalesce(g.texto, '') AS texto FROM c LEFT JOIN g USING (id)"""
)
def feature_selection(spark, d):
    """Reduction 9: the first tokens that other summaries share."""
    return reductions.feature_selection(_docs(spark, d))


@query(f"WITH {_GRID}" + q.top_terms("SELECT u.id, u.termo, m.chi2 AS score FROM u JOIN m USING (termo)"))
def chi2_terms(spark, d):
    """Reduction 10: the tokens of highest chi-square."""
    return reductions.class_terms(_docs(spark, d))


@query(f"WITH {_GRID}" + q.top_terms("SELECT u.id, u.termo, m.mi AS score FROM u JOIN m USING (termo)"))
def mi_terms(spark, d):
    """Reduction 11: the tokens of highest mutual information."""
    return reductions.class_terms(_docs(spark, d), "mi")


@query(
    f"""WITH {q.CORPUS}, k AS (SELECT id, {q.tokens('texto')} AS ts FROM c), p AS (SELECT id, i, i + g AS j, ts FROM k, (SELECT unnest([1, 2, 3]) AS g) g, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i))
SELECT id, least(ts[i], ts[j]) AS a, greatest(ts[i], ts[j]) AS b, count(*) AS peso FROM p WHERE j <= len(ts) AND ts[i] <> ts[j] GROUP BY 1, 2, 3"""
)
def cooccurrence_edges(spark, d):
    """How often tokens stand within three places in a summary."""
    return reductions.cooccurrence(_docs(spark, d))


@query()
def textrank(spark, d):
    """Reduction 4."""
    return reductions.textrank(_docs(spark, d))


@query()
def lsa_terms(spark, d):
    """Reduction 8."""
    return reductions.lsa_terms(_docs(spark, d))


@query()
def sentence_clusters(spark, d):
    """Reduction 12."""
    return reductions.sentence_clusters(_docs(spark, d))


# --- topics, profiles, evaluation --------------------------------------------------------------------------------------

_TOPIC_INPUT = "WITH c AS (SELECT e.id_norma AS id, max(coalesce(stopwords_tfidf_topk, '') || ' ' || coalesce(svd_lsa, '')) AS texto FROM ementas_pre_processadas e WHERE id_norma IN (SELECT id FROM normas) GROUP BY 1), nn AS (SELECT count(*) AS n FROM c)"


def _topic_docs(spark: SparkSession, d: str) -> DataFrame:
    return coalesce_concat(spark, d).groupBy(F.col("id_norma").alias("id")).agg(F.max("texto").alias("texto"))


_VOCAB = f"{_TOPIC_INPUT}, k AS (SELECT id, unnest({q.topic_tokens('texto')}) AS termo FROM c), v AS (SELECT termo, count(*) AS df FROM k GROUP BY 1 HAVING count(*) >= 4 AND count(*) <= floor(0.22 * (SELECT n FROM nn)))"


@query(f"{_VOCAB} SELECT termo, df FROM v")
def topic_vocab(spark, d):
    """The topic model's vocabulary."""
    return topics.vocabulary(_topic_docs(spark, d))


@query(f"{_VOCAB}, x AS (SELECT k.id, k.termo, ln((n + 1.0) / (df + 1.0)) + 1.0 AS w FROM k JOIN v USING (termo), nn) SELECT id, termo, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS peso FROM x")
def topic_matrix(spark, d):
    """The topic model's matrix."""
    return topics.matrix(_topic_docs(spark, d)).withColumn("peso", F.round("peso", 6))


def _label_sql(column: str) -> str:
    rules = " ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower({column}), '{w}')" for w in g) + ")" for g in groups) + f" THEN '{label}'" for label, groups in topics.TOPIC_LABELS)
    return f"CASE {rules} ELSE 'Administração e Normas Gerais (' || regexp_extract({column}, '^([^ ,]*)', 1) || ')' END"


@query(f"SELECT id, {_label_sql('termos_principais')} AS rotulo FROM topicos")
def topic_labels(spark, d):
    """The label of each topic by its main terms."""
    return table(spark, d, "topicos").select("id", topics.topic_label(F.col("termos_principais")).alias("rotulo"))


_REF = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(texto), '{w}')" for w in words) + f" THEN '{label}'" for label, words in topics.REFERENCE_CLASSES) + " END"


@query(f"WITH {q.CORPUS} SELECT id, {_REF} AS classe FROM c")
def reference_labels(spark, d):
    """The class of high certainty of each summary, or null."""
    return _docs(spark, d).select("id", topics.reference_class(F.col("texto")).alias("classe"))


@query("SELECT id_topico, count(DISTINCT id_norma) AS normas, round(count(DISTINCT id_norma) * 100.0 / (SELECT count(DISTINCT id_norma) FROM norma_topicos), 4) AS percentual FROM norma_topicos GROUP BY 1")
def topic_summary(spark, d):
    """Norms per topic and their share."""
    pairs = table(spark, d, "norma_topicos").select("id_topico", "id_norma").distinct()
    n = pairs.select("id_norma").distinct().count()
    return pairs.groupBy("id_topico").agg(F.count("*").alias("normas")).withColumn("percentual", F.round(F.col("normas") * 100.0 / max(n, 1), 4))


@query(
    """WITH l AS (SELECT DISTINCT na.id_norma, na.id_autor, t.id_rotulo_topico AS r FROM norma_autor na JOIN norma_topicos t ON t.id_norma = na.id_norma WHERE na.ativo = 1),
c AS (SELECT id_autor, r, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT id_autor, sum(n) AS total, count(*) AS topicos, max(n) AS maior, arg_max(r, n * 1000 - r) AS principal FROM c GROUP BY 1 HAVING sum(n) >= 5),
h AS (SELECT c.id_autor, sum(-(n / total) * log2(n / total)) AS h FROM c JOIN t ON t.id_autor = c.id_autor GROUP BY 1), e AS (SELECT t.*, round(h / log2(greatest(2, topicos)), 6) AS x FROM t JOIN h USING (id_autor))
SELECT e.id_autor, coalesce(a.nome, 'Autor #' || e.id_autor) AS nome, coalesce(g.cargo, 'Não especificado') AS cargo, CAST(total AS BIGINT) AS total, topicos, coalesce(rt.nome, '') AS rotulo, round(maior * 100.0 / total, 4) AS percentual, x AS entropia,
CASE WHEN x < 0.35 THEN 'alta' WHEN x < 0.70 THEN 'media' ELSE 'baixa' END AS especializacao FROM e LEFT JOIN (SELECT id, max(nome) AS nome FROM autores GROUP BY 1) a ON a.id = e.id_autor
LEFT JOIN (SELECT id_autor, max(cargo_autor) AS cargo FROM norma_autor GROUP BY 1) g ON g.id_autor = e.id_autor LEFT JOIN rotulos_topicos rt ON rt.id = e.principal"""
)
def author_profile(spark, d):
    """Specialisation of each author."""
    return topics.author_profiles(table(spark, d, "norma_autor"), table(spark, d, "norma_topicos"), table(spark, d, "rotulos_topicos"), table(spark, d, "autores"))


_PAIRS = f"WITH {q.CORPUS}, p AS (SELECT {_REF} AS real, r.nome AS previsto FROM c JOIN (SELECT id_norma, min(id_rotulo_topico) AS r FROM norma_topicos GROUP BY 1) t ON t.id_norma = c.id JOIN rotulos_topicos r ON r.id = t.r WHERE {_REF} IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "norma_topicos").groupBy(F.col("id_norma").alias("id")).agg(F.min("id_rotulo_topico").alias("r"))
    labels = table(spark, d, "rotulos_topicos").select(F.col("id").alias("r"), F.col("nome").alias("previsto"))
    return reference_labels(spark, d).filter("classe IS NOT NULL").join(one, "id").join(labels, "r").select(F.col("classe").alias("real"), "previsto")


@query(f"{_PAIRS} SELECT real, previsto, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """Reference classes against stored topics."""
    return topics.confusion(_pairs(spark, d))


_REPORT = """, x AS (SELECT real, previsto, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT real AS classe FROM x UNION SELECT previsto FROM x),
y AS (SELECT classe, coalesce((SELECT sum(n) FROM x WHERE real = classe), 0) AS s, coalesce((SELECT sum(n) FROM x WHERE previsto = classe), 0) AS d, coalesce((SELECT sum(n) FROM x WHERE real = classe AND previsto = classe), 0) AS h FROM l),
z AS (SELECT classe, s, h, CASE WHEN d > 0 THEN h / d ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r FROM y), w AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM z)
SELECT classe, round(p, 6) AS precisao, round(r, 6) AS revocacao, round(f, 6) AS f1, CAST(s AS BIGINT) AS suporte FROM w
UNION ALL SELECT '~acuracia', round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM w
UNION ALL SELECT '~macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM w
UNION ALL SELECT '~ponderada', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM w"""


@query(_PAIRS + _REPORT)
def classification_report(spark, d):
    """Precision, recall and F1 per class and on average."""
    return topics.classification_report(_pairs(spark, d))


@query(f"WITH {q.CORPUS} SELECT count(*) AS documentos, CAST(sum(len({q.tokens('texto')})) AS BIGINT) AS tokens, CAST(greatest(0, 32 * count(*) - sum(len({q.tokens('texto')}))) AS BIGINT) AS poupados FROM c")
def engineering_metrics(spark, d):
    """Tokens kept by the reductions and saved against 32 assumed per summary, over all of them."""
    return topics.saved_tokens(_docs(spark, d), tx.tokens(F.col("texto")))


def _topic_model(spark: SparkSession, d: str):
    terms, rows = topics.numbered(topics.matrix(_topic_docs(spark, d)))
    return rows, terms, topics.factors(rows, len(terms))


@query()
def nmf_topics(spark, d):
    """Twelve topics with their main terms and labels."""
    _, terms, h = _topic_model(spark, d)
    rows = [(i + 1, ", ".join(t)) for i, t in enumerate(topics.topic_terms(terms, h))]
    return spark.createDataFrame(rows, "id int, termos_principais string").withColumn("rotulo", topics.topic_label(F.col("termos_principais")))


@query()
def topic_assign(spark, d):
    """The topic of each norm."""
    return topics.assign_topics(*_topic_model(spark, d))


@query(
    f"""WITH c AS (SELECT id_topico AS id, count(DISTINCT id_norma) AS n FROM norma_topicos WHERE id_topico <= 8 GROUP BY 1), t AS (SELECT count(DISTINCT id_norma) AS t FROM norma_topicos),
w AS (SELECT id, coalesce((SELECT min(r.id) FROM rotulos_topicos r WHERE r.nome = x.rotulo), 1) AS id_rotulo_topico, array_to_string(string_split_regex(termos_principais, ',\\s*')[1:3], ', ') AS termos_principais, CAST(n AS INTEGER) AS total_normas, round(n * 100.0 / t, 4) AS percentual_base
  FROM (SELECT p.id, p.termos_principais, c.n, {_label_sql('p.termos_principais')} AS rotulo FROM topicos p JOIN c USING (id)) x, t)
SELECT * FROM w UNION ALL SELECT id, id_rotulo_topico, termos_principais, total_normas, percentual_base FROM topicos WHERE id NOT IN (SELECT id FROM w)"""
)
def topic_store(spark, d):
    """The stored topics after eight of them were counted and labelled anew."""
    t = table(spark, d, "topicos")
    new = topic_summary(spark, d).filter("id_topico <= 8").join(t.select(F.col("id").alias("id_topico"), "termos_principais"), "id_topico")
    rows = new.select(F.col("id_topico").alias("id"), topics.topic_label(F.col("termos_principais")).alias("rotulo"), F.slice(F.split("termos_principais", ",\\s*"), 1, 3).alias("termos"), F.col("normas").alias("total_normas"), F.col("percentual").alias("percentual_base"))
    return services.store_topics(t, rows, table(spark, d, "rotulos_topicos"))


@query("SELECT t.id, printf('Tópico #%02d [%s] (ID Rótulo: %d): %s (%.1f%%)', t.id, r.nome, t.id_rotulo_topico, t.termos_principais, t.percentual_base) AS linha FROM topicos t JOIN rotulos_topicos r ON r.id = t.id_rotulo_topico")
def topic_lines(spark, d):
    """Each stored topic in one line."""
    r = table(spark, d, "rotulos_topicos").select(F.col("id").alias("id_rotulo_topico"), "nome")
    return table(spark, d, "topicos").join(r, "id_rotulo_topico").select("id", services.topic_line(F.col("id"), F.col("nome"), F.col("id_rotulo_topico"), F.col("termos_principais"), F.col("percentual_base")).alias("linha"))


@query()
def profile_lines(spark, d):
    """Each author's specialisation in one line."""
    return services.profile_lines(author_profile(spark, d))


# --- vectors -----------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norma FROM embeddings")
def vector_norms(spark, d):
    """The length of each vector."""
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 5).alias("norma"))


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def json_vector_roundtrip(spark, d):
    """Vectors to JSON text and back: the number of elements that come back unchanged."""
    e = table(spark, d, "embeddings").withColumn("volta", vec.decode(vec.encode(F.col("embedding"))))
    return e.select("vec_id", F.size(F.filter(F.zip_with("embedding", "volta", lambda a, b: F.abs(a - b) < 1e-6), lambda ok: ok)).cast("bigint").alias("n"))


_CENTRES = "WITH k AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM k GROUP BY 1), c AS (SELECT k.label AS cluster, list(v / n ORDER BY i) AS centro FROM k JOIN n USING (label) GROUP BY 1)"
_NEAR = f"{_CENTRES}, s AS (SELECT vec_id, cluster, round(list_sum(list_transform(list_zip(embedding, centro), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 9) AS sim FROM embeddings, c), b AS (SELECT vec_id AS id, cluster, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) AS r FROM s), a AS (SELECT id, cluster, sim FROM b WHERE r = 1)"


def _centres(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return e.groupBy(F.col("label").alias("cluster")).agg(vec.unit(centre).alias("centro"))  # ten labels


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.nearest(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vetor")), _centres(spark, d))


@query(f"{_NEAR} SELECT id, cluster, round(sim, 5) AS sim FROM a")
def nearest_centroid(spark, d):
    """The nearest label centroid of each vector."""
    return _nearest(spark, d).withColumn("sim", F.round("sim", 5))


@query(f"{_NEAR} SELECT cluster, count(*) AS tamanho, round(avg(sim), 4) AS coesao, round(sum(pow(greatest(0, 1 - sim), 2)), 3) AS inercia, min_by(id, [-sim, id]) AS medoide FROM a GROUP BY 1")
def cluster_report(spark, d):
    """Size, cohesion, inertia and medoid of each cluster."""
    r = embeddings.cluster_report(_nearest(spark, d))
    return r.select("cluster", "tamanho", F.round("coesao", 4).alias("coesao"), F.round("inercia", 3).alias("inercia"), "medoide")


@query(f"{_NEAR} SELECT min_by(id, [-sim, id]) AS medoide FROM a WHERE cluster = 3")
def medoid_lookup(spark, d):
    """The medoid of one cluster."""
    return embeddings.cluster_report(_nearest(spark, d)).filter("cluster = 3").select("medoide")


@query(
    f"""WITH {q.CORPUS}, t AS (SELECT id_norma AS id, min(id_topico) AS cluster FROM norma_topicos GROUP BY 1), k AS (SELECT t.cluster, unnest(list_distinct({q.tokens('texto')})) AS termo FROM c JOIN t USING (id)),
n AS (SELECT cluster, termo, count(*) AS df FROM k WHERE length(termo) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY df DESC, termo) AS posicao FROM n) SELECT cluster, termo, df, CAST(posicao AS INTEGER) AS posicao FROM r WHERE posicao <= 6"""
)
def cluster_keywords(spark, d):
    """The commonest words of each group of norms."""
    groups = table(spark, d, "norma_topicos").groupBy(F.col("id_norma").alias("id")).agg(F.min("id_topico").alias("cluster"))
    return embeddings.cluster_keywords(groups, _docs(spark, d))


@query()
def local_embeddings(spark, d):
    """Hashed vectors of all summaries."""
    return embeddings.local_embeddings(_docs(spark, d))


@query(f"WITH {q.CORPUS} SELECT id, CAST(128 AS BIGINT) AS dim, CASE WHEN len({q.tokens('texto', True)}) > 0 THEN 1.0 ELSE 0.0 END AS norma FROM c")
def embedding_norms(spark, d):
    """Number and length of the hashed vectors: unit vectors, zeros where a summary has no token."""
    return local_embeddings(spark, d).select("id", F.size("vetor").cast("bigint").alias("dim"), F.round(vec.norm(F.col("vetor")), 4).alias("norma"))


@query(f"WITH {q.CORPUS} SELECT e.id, CAST(CASE WHEN e.embeddings IS NULL AND c.id IS NOT NULL THEN 128 ELSE len(e.embeddings) END AS BIGINT) AS dim, e.embeddings IS NULL AND c.id IS NOT NULL AS novo FROM ementas_pre_processadas e LEFT JOIN c ON c.id = e.id_norma")
def embedding_fill(spark, d):
    """Vectors made for the rows that have none yet; the others keep theirs."""
    e = table(spark, d, "ementas_pre_processadas").select("id", "id_norma", "embeddings")
    filled = services.fill_vectors(e, _docs(spark, d)).select("id", F.when(F.col("embeddings").isNotNull(), F.size("embeddings")).cast("bigint").alias("dim"))
    return filled.join(e.select("id", F.col("embeddings").isNull().alias("vazio")), "id").select("id", "dim", (F.col("vazio") & F.col("dim").isNotNull()).alias("novo"))


@query(f"{_NEAR}, x AS (SELECT a.cluster, u.i AS i, u.v / sqrt(u.s) AS v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x, j: {{'v': CAST(x AS DOUBLE), 'i': j - 1, 's': list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))}})) AS u FROM embeddings) e JOIN a ON a.id = e.vec_id), y AS (SELECT cluster, i, sum(v) AS v FROM x GROUP BY 1, 2) SELECT cluster, CAST(i AS INTEGER) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY cluster)), 5) AS v FROM y")
def kmeans_round(spark, d):
    """One round of k-means from the label centroids: the new centroids."""
    rows = _centres(spark, d).orderBy("cluster").collect()  # ten labels
    import numpy as np

    v = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("vetor"))
    sums, sizes = embeddings.recentre(v, np.array([r["centro"] for r in rows]))
    new = sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    cells = [(rows[j]["cluster"], i, round(float(x), 5)) for j in range(len(new)) if sizes[j] for i, x in enumerate(new[j])]
    return spark.createDataFrame(cells, "cluster int, i int, v double")


@query()
def kmeans(spark, d):
    """Ten clusters of the vectors with their reports."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vetor"))
    return embeddings.cluster_report(stage(embeddings.assign(v, embeddings.kmeans(v)), "grupos")).orderBy(F.col("tamanho").desc(), "cluster")


@query()
def all_reductions(spark, d):
    """The twelve reductions of every summary in one table."""
    return reductions.all_reductions(_docs(spark, d))


_NINE = {"stopwords_tfidf_topk": "tfidf_topk_stop", "tfidf_topk": "tfidf_topk_raw", "resumo_extrativo_tfidf": "extractive_summary", "tfidf_posicao_sentenca": "position_summary", "tfidf_mmr": "mmr_summary", "tfidf_similaridade_frases": "centrality_summary", "tfidf_feature_selection": "feature_selection", "chi_square_termos": "chi2_terms", "mutual_information": "mi_terms"}


@query(f"SELECT r0.id, {', '.join(f'r{i}.texto AS {c}' for i, c in enumerate(_NINE))} FROM ({SQL['tfidf_topk_stop']}) r0 " + " ".join(f"JOIN ({SQL[n]}) r{i} ON r{i}.id = r0.id" for i, n in enumerate(_NINE.values()) if i))
def nine_reductions(spark, d):
    """Those columns of the twelve reductions that SQL can express."""
    return all_reductions(spark, d).select("id", *_NINE)


# --- storage and streams -------------------------------------------------------------------------------------------------


@query("SELECT count(*) * 2 AS linhas, count(DISTINCT id) AS ids, 0 AS depois FROM norma_relacionamentos")
def stored_changes(spark, d):
    """A stored table overwritten with twice its rows, read from itself, and then emptied."""
    at = stage(table(spark, d, "norma_relacionamentos").select("id", "tipo_relacionamento"), "relacionamentos")._staged_path
    upsert.overwrite(spark.read.parquet(at).union(spark.read.parquet(at)), at)
    counts = spark.read.parquet(at).agg(F.count("*"), F.countDistinct("id")).first()
    upsert.delete_all(spark, at)
    return spark.createDataFrame([(counts[0], counts[1], spark.read.parquet(at).count())], "linhas bigint, ids bigint, depois bigint")


@query("SELECT count(*) AS linhas, count(DISTINCT id) AS ids FROM normas")
def incremental_rows(spark, d):
    """All rows of a table taken as a stream of files, batch by batch, into another table."""
    source = table(spark, d, "normas").select("id", "titulo")
    at = stage(source, "fluxo-entrada")._staged_path
    out = at + "-saida"
    process_new(spark, at, source.schema, lambda batch, n: batch.write.mode("append").parquet(out), at + "-estado")
    return spark.read.schema(source.schema).parquet(out).agg(F.count("*").alias("linhas"), F.countDistinct("id").alias("ids"))
