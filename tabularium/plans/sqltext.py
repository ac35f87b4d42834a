"""The text functions as SQL of the reference engine, generated from the same constants."""

from __future__ import annotations

from html.entities import name2codepoint

from tabularium.functions.text import KEPT, STOPWORDS
from tabularium.operators.topics import TOPIC_STOPWORDS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def references(column: str) -> str:
    """column with the named references of letters, blanks and invisible characters resolved."""
    for name, code in sorted(name2codepoint.items()):
        if chr(code).isalpha() or name in ("nbsp", "shy", "amp", "quot", "lt", "gt", "ndash", "mdash", "zwnj", "zwj", "sect", "sup2"):
            column = f"replace({column}, '&{name};', chr({code}))"
    return column


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{KEPT}', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(x: str, stopwords: bool = False) -> str:
    stop = f"[{quoted(STOPWORDS)}]"
    keep = "length(t) > 1" if stopwords else f"length(t) > 1 AND NOT list_contains({stop}, t) AND NOT list_contains({stop}, strip_accents(t))"
    return f"list_filter(string_split(lower({clean(x)}), ' '), lambda t: {keep})"


def sentences(x: str) -> str:
    cut = f"regexp_replace(regexp_replace(trim({x}, ' '), '([.!?\\n;])\\s+', '\\1' || chr(1), 'g'), '(\\s[-–]\\s)', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def topic_tokens(x: str) -> str:
    parts = f"list_transform(string_split_regex(lower(trim({x})), '\\s+'), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
    return f"list_distinct(list_filter({parts}, lambda t: length(t) > 2 AND NOT regexp_full_match(t, '\\p{{Nd}}+') AND NOT list_contains([{quoted(TOPIC_STOPWORDS)}], t)))"


#: (id, texto, classe): the latest non-blank summary of each norm.
CORPUS = """c AS (
  SELECT id, arg_max(ementa, coletado_em) AS texto, CASE WHEN regexp_matches(coalesce(arg_max(tipoescrito, coletado_em), ''), '\\S') THEN arg_max(tipoescrito, coletado_em) ELSE 'GERAL' END AS classe
  FROM normas WHERE regexp_matches(ementa, '\\S') AND id IS NOT NULL GROUP BY id
), nn AS (SELECT count(*) AS n FROM c)"""
#: Tokens with their document frequency and IDF.
TERMS = f"""{CORPUS}, k AS (SELECT id, classe, texto, {tokens('texto')} AS ts FROM c
), u AS (SELECT id, classe, unnest(list_distinct(ts)) AS termo FROM k
), d AS (SELECT termo, count(*) AS df FROM u GROUP BY 1
), i AS (SELECT termo, df, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM d, nn)"""
#: Sentences, and the summed IDF w of each term in them.
SENTENCES = f"""{TERMS}, f AS (SELECT id, s.s AS s, s.frase AS frase FROM (SELECT id, unnest(list_transform({sentences('texto')}, lambda s, j: {{'s': s, 'frase': j - 1}})) AS s FROM c)
), w AS (SELECT id, frase, termo, count(*) AS c, count(*) * any_value(idf) AS w FROM (SELECT id, frase, unnest({tokens('s')}) AS termo FROM f) JOIN i USING (termo) GROUP BY 1, 2, 3)"""


def best_sentence(scores: str, factor: str = "1") -> str:
    """The rest of a statement after SENTENCES: the sentence of highest score per document."""
    return f""", z AS ({scores}), q AS (
  SELECT f.id, f.s, row_number() OVER (PARTITION BY f.id ORDER BY round(coalesce(z.score, 0) * {factor}, 6) DESC, f.frase) AS r FROM f LEFT JOIN z ON f.id = z.id AND f.frase = z.frase
) SELECT id, s AS texto FROM q WHERE r = 1"""


def top_terms(scores: str, k: int = 7) -> str:
    """The rest of a statement after TERMS: the k terms of highest score (id, termo, score) per document."""
    return f""", z AS ({scores}), q AS (SELECT id, termo, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, termo) AS r FROM z
), g AS (SELECT id, string_agg(termo, ' ' ORDER BY r) AS texto FROM q WHERE r <= {k} GROUP BY id) SELECT c.id, coalesce(g.texto, '') AS texto FROM c LEFT JOIN g USING (id)"""
