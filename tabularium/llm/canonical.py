"""Mapping free-entered titles to a reference list: a partition-based pigeonhole join, in SQL only.

A string within k edits of a reference string holds one of the reference's k+1 segments unchanged, at a position
shifted by k at most. So reference strings are cut into k+1 segments, joined by equality on positional substrings,
and the few candidates are verified with the built-in ``levenshtein``. The join runs twice: on single words (typing
errors, gender, personal names) and on whole titles. Reference titles are the list's own entries and those spellings
whose already normalised rows agree on an entry. What no join matches is reported through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.functions.terms import accent_table

#: Words without meaning for the entry: particles, the municipality, and acting or substitute status (fixed values).
PARTICLES = ("DE", "DA", "DO", "DAS", "DOS", "E", "EM", "NA", "NO", "PELO", "PELA", "A", "O")
STATUS = ("MUNICIPAL", "MUNICIPIO", "EXERCICIO", "SUBSTITUTO", "RESPONDENDO", "RESPONSAVEL", "CARGO", "EXPEDIENTE", "INTERINO", "DESIGNADO")
HONORIFICS = ("DR", "DRA", "SR", "SRA", "EXMO", "EXMA", "PROF", "PROFA", "SEU", "DONA", "ZE", "NENE", "FILHO", "NETO", "JUNIOR", "JR")
ABBREVIATED_STATUS = ("MUN", "MUNIC", "SUBST", "RESP", "EXERC", "INT")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words_sql(column: str) -> str:
    """The words of a typed title: upper case, unaccented, digits typed for letters undone, signs dropped."""
    src, dst = accent_table()
    folded = f"regexp_replace(translate({column}, '{src}', '{dst}'), '[\\\\pM\\\\u00AD\\\\u200B-\\\\u200F\\\\uFEFFºª°]', '')"
    return f"filter(split(translate(regexp_replace(upper({folded}), '[^A-Z0-9]+', ' '), '01345', 'OIEAS'), ' '), w -> length(w) > 1 AND w NOT IN ({_quoted(PARTICLES)}))"


def pigeonhole(spark: SparkSession, probes: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(s, ref, distancia) for all pairs of probes(s) and references(ref) within k edits.

    Nulls match nothing; repeated strings count once; a reference shorter than k+1 letters is compared by length only
    through its empty segments. No pair within k edits is lost.
    """
    cut = f"CAST(floor(i * n / {k + 1}) AS INT)"
    end = f"CAST(floor((i + 1) * n / {k + 1}) AS INT)"
    return spark.sql(
        f"""
        WITH r AS (
          SELECT ref, n, i, substring(ref, {cut} + 1, {end} - {cut}) AS trecho
          FROM (SELECT DISTINCT ref, length(ref) AS n FROM {{references}} WHERE ref IS NOT NULL) LATERAL VIEW explode(sequence(0, {k})) AS i
        ), p AS (
          SELECT DISTINCT s, n, i, substring(s, {cut} + 1 + d, {end} - {cut}) AS trecho
          FROM (SELECT DISTINCT s FROM {{probes}} WHERE s IS NOT NULL)
          LATERAL VIEW explode(sequence(greatest(1, length(s) - {k}), length(s) + {k})) AS n
          LATERAL VIEW explode(sequence(0, {k})) AS i LATERAL VIEW explode(sequence(-{k}, {k})) AS d
          WHERE {cut} + d >= 0
        ), c AS (SELECT DISTINCT s, ref FROM p JOIN r USING (n, i, trecho))
        SELECT s, ref, levenshtein(s, ref) AS distancia FROM c WHERE levenshtein(s, ref, {k}) >= 0
        """,
        probes=probes,
        references=references,
    )


def _near(distance: str, s: str, ref: str) -> str:
    """Whether an edit distance is a plausible typing error for words of that length; swapped letters count once."""
    return f"({distance} <= CASE WHEN length({s}) < 6 THEN 1 ELSE 2 END OR {distance} = 2 AND array_sort(split({s}, '')) = array_sort(split({ref}, '')))"


def _cost(distance: str, s: str, ref: str) -> str:
    """The edit distance, where a swap of letters costs one edit."""
    return f"CASE WHEN array_sort(split({s}, '')) = array_sort(split({ref}, '')) THEN 1 ELSE {distance} END"


def _prefixes(references: str) -> str:
    """Every beginning of three letters or more of each reference, so that abbreviations are found by equality."""
    return f"SELECT *, explode(transform(sequence(3, length(ref)), i -> left(ref, i))) AS inicio FROM {references} WHERE length(ref) >= 3"


def map_titles(spark: SparkSession, norma_autor: DataFrame, cargos: DataFrame, autores: DataFrame, min_share: float = 0.6) -> DataFrame:
    """(cargo_autor, id_cargo) for every distinct non-blank typed title; id_cargo is 0 where no entry fits.

    Already normalised rows teach other names of an entry; a spelling counts where at least ``min_share`` of its rows
    agree. Personal names (words of autores.nome) are dropped. Empty tables give no rows; ties go to the lower entry.
    """
    from tabularium.session import stage

    typed = stage(
        spark.sql(
            f"""
            SELECT cargo_autor, {words_sql('cargo_autor')} AS palavras, normalizado, count(*) AS linhas
            FROM (SELECT cargo_autor, nullif(trim(upper(cargo_autor_normalizado)), '') AS normalizado FROM {{na}} WHERE cargo_autor RLIKE '(?U)[^\\\\s]')
            GROUP BY cargo_autor, normalizado
            """,
            na=norma_autor,
        ),
        "p4-digitados",
    )
    entries = spark.sql(f"SELECT id_cargo, upper(cargo) AS cargo, {words_sql('cargo')} AS palavras FROM {{c}} WHERE cargo IS NOT NULL", c=cargos)
    vocabulary = stage(
        spark.sql(
            f"""
            SELECT ref, max(peso) AS peso FROM (
              SELECT ref, count(*) AS peso FROM {{e}} LATERAL VIEW explode(palavras) AS ref GROUP BY ref
              UNION ALL SELECT col AS ref, 1 AS peso FROM (SELECT explode(array({_quoted(STATUS)})))
            ) GROUP BY ref
            """,
            e=entries,
        ),
        "p4-vocabulario",
    )
    words = stage(spark.sql("SELECT s, count(*) AS titulos, sum(linhas) AS linhas FROM {t} LATERAL VIEW explode(palavras) AS s GROUP BY s", t=typed), "p4-palavras")
    unknown = spark.sql("SELECT s FROM {w} LEFT ANTI JOIN {v} ON s = ref WHERE length(s) >= 3", w=words, v=vocabulary)
    names = spark.sql(f"SELECT DISTINCT ref FROM (SELECT {words_sql('nome')} AS palavras FROM {{a}}) LATERAL VIEW explode(palavras) AS ref WHERE length(ref) >= 3", a=autores)
    near = pigeonhole(spark, spark.sql("SELECT s FROM {u} LEFT ANTI JOIN {n} ON s = ref WHERE length(s) >= 4", u=unknown, n=names), vocabulary, 2)
    corrected = stage(
        spark.sql(
            f"""
            SELECT s, min_by(ref, struct(ordem, -peso, ref)) AS palavra FROM (
              SELECT s, n.ref, {_cost('distancia', 's', 'n.ref')} AS ordem, peso FROM {{near}} n JOIN {{v}} v ON n.ref = v.ref WHERE {_near('distancia', 's', 'n.ref')} AND length(n.ref) >= 4
              UNION ALL
              SELECT u.s, v.ref, 3 AS ordem, peso FROM {{u}} u JOIN ({_prefixes('{v}')}) v ON u.s = v.inicio
            ) GROUP BY s
            """,
            near=near,
            u=unknown,
            v=vocabulary,
        ),
        "p4-corrigidas",
    )
    missed = stage(spark.sql("SELECT w.s, linhas FROM {w} w LEFT SEMI JOIN {u} u ON w.s = u.s LEFT ANTI JOIN {c} c ON w.s = c.s WHERE length(w.s) >= 3", w=words, u=unknown, c=corrected), "p4-restantes")
    # typing errors of far commoner words (abbreviations, feminine forms, other names of an entry) mean what those mean
    frequent = spark.sql("SELECT s AS ref, linhas FROM {w} WHERE length(s) >= 4", w=words)
    likened = stage(
        spark.sql(
            f"""
            SELECT s, min_by(ref, struct({_cost('distancia', 's', 'ref')}, -f.linhas, ref)) AS ref
            FROM {{p}} p JOIN {{f}} f USING (ref) JOIN {{m}} m USING (s)
            WHERE {_near('distancia', 's', 'ref')} AND f.linhas >= 10 * m.linhas GROUP BY s
            """,
            p=pigeonhole(spark, missed, frequent, 2),
            f=frequent,
            m=missed,
        ),
        "p4-parecidas",
    )
    rest = spark.sql("SELECT s FROM {m} LEFT ANTI JOIN {l} USING (s)", m=missed, l=likened)
    close_names = pigeonhole(spark, spark.sql("SELECT s FROM {r} WHERE length(s) >= 4", r=rest), names, 2)
    personal = stage(
        spark.sql(f"SELECT DISTINCT s FROM {{n}} WHERE {_near('distancia', 's', 'ref')} UNION SELECT s FROM {{u}} JOIN ({_prefixes('{names}')}) ON s = inicio", n=close_names, u=rest, names=names),
        "p4-nomes",
    )
    # the word of each typed word: itself, its correction, or null where it says nothing about the entry
    direct = spark.sql(
        f"""
        SELECT s, CASE WHEN n.s IS NOT NULL OR coalesce(palavra, w.s) IN ({_quoted(STATUS + ABBREVIATED_STATUS + HONORIFICS)}) THEN NULL ELSE coalesce(palavra, w.s) END AS palavra,
               palavra IS NOT NULL OR v.ref IS NOT NULL AS explicada
        FROM {{w}} w LEFT JOIN {{c}} c USING (s) LEFT JOIN {{v}} v ON w.s = v.ref LEFT JOIN {{n}} n USING (s)
        """,
        w=words,
        c=corrected,
        v=vocabulary,
        n=personal,
    )
    senses = stage(
        spark.sql(
            "SELECT d.s, d.palavra, d.explicada FROM {d} d LEFT ANTI JOIN {l} l USING (s) UNION ALL SELECT l.s, d.palavra, d.explicada FROM {l} l JOIN {d} d ON l.ref = d.s",
            d=direct,
            l=likened,
        ),
        "p4-direto",
    )
    signature = "array_join(array_sort(array_distinct(collect_list({}))), ' ')"
    own = spark.sql(
        f"""
        SELECT array_join(array_sort(array_distinct(filter(palavras, w -> w NOT IN ({_quoted(STATUS)})))), ' ') AS ref, min(id_cargo) AS id_cargo FROM {{e}} GROUP BY 1
        """,
        e=entries,
    )
    # a word that no join explains is known where the normalised titles that hold it mostly mean another entry than without it
    telling = spark.sql(
        f"""
        SELECT palavra FROM (
          SELECT explode(outras) AS palavra, coalesce(e.id_cargo, 0) <> coalesce(o.id_cargo, 0) AS outra FROM (
            SELECT cargo_autor, normalizado, {signature.format('CASE WHEN explicada THEN palavra END')} AS resto, collect_set(CASE WHEN NOT explicada THEN palavra END) AS outras
            FROM (SELECT cargo_autor, normalizado, explode(palavras) AS s FROM {{t}} WHERE normalizado IS NOT NULL) JOIN {{m}} USING (s) GROUP BY cargo_autor, normalizado
          ) LEFT JOIN {{o}} o ON resto = o.ref LEFT JOIN {{e}} e ON normalizado = e.cargo
        ) GROUP BY palavra HAVING 2 * count_if(outra) > count(*)
        """,
        t=typed,
        m=senses,
        o=own,
        e=entries,
    )
    meaning = stage(spark.sql("SELECT s, m.palavra, explicada OR t.palavra IS NOT NULL AS conhecida FROM {m} m LEFT JOIN {t} t ON m.palavra = t.palavra", m=senses, t=telling), "p4-sentidos")
    signed = stage(
        spark.sql(
            f"""
            SELECT cargo_autor, normalizado, linhas, {signature.format('palavra')} AS sinal, {signature.format('CASE WHEN conhecida THEN palavra END')} AS nucleo
            FROM (SELECT cargo_autor, normalizado, linhas, explode_outer(palavras) AS s FROM {{t}}) LEFT JOIN {{m}} USING (s)
            GROUP BY cargo_autor, normalizado, linhas
            """,
            t=typed,
            m=meaning,
        ),
        "p4-sinais",
    )
    # a word is an honour where the normalised titles that aren't entries themselves mostly mean the entry without it
    honours = spark.sql(
        """
        SELECT palavra FROM (
          SELECT palavra, e.id_cargo <=> o.id_cargo AS igual FROM (
            SELECT normalizado, palavra, array_join(array_except(palavras, array(palavra)), ' ') AS resto
            FROM (SELECT DISTINCT nucleo, normalizado, split(nucleo, ' ') AS palavras FROM {s} LEFT ANTI JOIN {o} ON nucleo = ref WHERE normalizado IS NOT NULL AND nucleo <> '')
            LATERAL VIEW explode(palavras) AS palavra
          ) JOIN {o} o ON resto = o.ref LEFT JOIN {e} e ON normalizado = e.cargo
        ) GROUP BY palavra HAVING 2 * count_if(igual) > count(*)
        """,
        s=signed,
        o=own,
        e=entries,
    )
    plain = spark.sql(
        """
        SELECT nucleo, array_join(array_sort(collect_list(CASE WHEN h.palavra IS NULL THEN n.palavra END)), ' ') AS sem_honra
        FROM (SELECT nucleo, explode(split(nucleo, ' ')) AS palavra FROM (SELECT DISTINCT nucleo FROM {s} WHERE nucleo <> '')) n LEFT JOIN {h} h ON n.palavra = h.palavra
        GROUP BY nucleo
        """,
        s=signed,
        h=honours,
    )
    # reference titles: the entries, and spellings on whose entry their normalised rows agree (0: agreed to be none)
    taught = spark.sql(
        """
        SELECT sinal AS ref, max_by(id_cargo, struct(linhas, -id_cargo)) AS id_cargo, max(linhas) / sum(linhas) AS parte, sum(linhas) AS linhas FROM (
          SELECT sinal, coalesce(e.id_cargo, 0) AS id_cargo, sum(linhas) AS linhas FROM {s} LEFT JOIN {e} e ON normalizado = e.cargo
          WHERE normalizado IS NOT NULL AND sinal <> '' GROUP BY sinal, coalesce(e.id_cargo, 0)
        ) GROUP BY sinal
        """,
        s=signed,
        e=entries,
    )
    references = stage(
        spark.sql(
            "SELECT ref, id_cargo FROM {own} UNION ALL SELECT ref, id_cargo FROM {taught} t LEFT ANTI JOIN {own} o USING (ref) WHERE parte >= {share}",
            own=own,
            taught=taught,
            share=min_share,
        ),
        "p4-referencias",
    )
    open_ = stage(spark.sql("SELECT DISTINCT cargo_autor, sinal, nucleo, sem_honra FROM {s} LEFT JOIN {p} USING (nucleo)", s=signed, p=plain), "p4-abertos")
    left = spark.sql("SELECT DISTINCT sinal AS s FROM {o} LEFT ANTI JOIN {r} ON sinal = ref WHERE length(sinal) >= 4", o=open_, r=references)
    close = spark.sql(
        f"""
        SELECT s, min_by(id_cargo, struct(distancia, if(id_cargo = 0, 1, 0), id_cargo)) AS id_cargo
        FROM {{p}} p JOIN {{r}} r USING (ref) WHERE {_near('distancia', 's', 'ref')} AND length(ref) >= 4 GROUP BY s
        """,
        p=pigeonhole(spark, left, references, 2),
        r=references,
    )
    return spark.sql(
        """
        SELECT cargo_autor, CAST(coalesce(max(coalesce(x.id_cargo, c.id_cargo, k.id_cargo, h.id_cargo)), 0) AS INT) AS id_cargo
        FROM {o} o LEFT JOIN {r} x ON o.sinal = x.ref LEFT JOIN {c} c ON o.sinal = c.s LEFT JOIN {r} k ON o.nucleo = k.ref AND o.nucleo <> ''
        LEFT JOIN {r} h ON o.sem_honra = h.ref AND o.sem_honra <> ''
        GROUP BY cargo_autor
        """,
        o=open_,
        r=references,
        c=close,
    )


def pending(spark: SparkSession, norma_autor: DataFrame, mapped: DataFrame) -> DataFrame:
    """(id_norma, id_autor, id_cargo): each distinct pair whose typed title isn't normalised yet; of two titles the higher entry."""
    return spark.sql(
        """
        SELECT id_norma, id_autor, max(id_cargo) AS id_cargo
        FROM (SELECT id_norma, id_autor, cargo_autor, cargo_autor_normalizado FROM {na}) JOIN {m} USING (cargo_autor)
        WHERE cargo_autor_normalizado IS NULL OR NOT cargo_autor_normalizado RLIKE '(?U)[^\\\\s]'
        GROUP BY id_norma, id_autor
        """,
        na=norma_autor,
        m=mapped,
    )


def unmatched(spark: SparkSession, norma_autor: DataFrame, mapped: DataFrame) -> DataFrame:
    """(cargo_autor, linhas): typed titles without an entry, by anti-join with the matched ones."""
    return spark.sql(
        """
        SELECT cargo_autor, count(*) AS linhas FROM (SELECT cargo_autor FROM {na}) LEFT ANTI JOIN (SELECT cargo_autor FROM {m} WHERE id_cargo > 0) USING (cargo_autor)
        WHERE cargo_autor RLIKE '(?U)[^\\\\s]' GROUP BY cargo_autor
        """,
        na=norma_autor,
        m=mapped,
    )
