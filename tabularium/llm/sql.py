"""Reference SQL of those queries that plain SQL can express."""

from __future__ import annotations

from html.entities import name2codepoint


def _references(column: str) -> str:
    """column with the named references of letters, blanks and invisible characters resolved."""
    expr = column
    for name, code in sorted(name2codepoint.items()):
        if chr(code).isalpha() or name in ("nbsp", "shy", "amp", "quot", "lt", "gt", "ndash", "mdash", "zwnj", "zwj"):
            expr = f"replace({expr}, '&{name};', chr({code}))"
    return expr


def _terms(column: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(regexp_replace({_references(column)}, '[\\x{{AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}]|\\p{{M}}', '', 'g'))), '\\p{{L}}{{3,}}')"


_RECORDS = f"""
r AS (
  SELECT id AS id_norma, arg_max(ementa, coletado_em) AS ementa FROM normas WHERE id IS NOT NULL GROUP BY id
), t AS (
  SELECT id_norma, {_terms('ementa')} AS termos
  FROM r WHERE ementa IS NOT NULL
), o AS (
  SELECT id_norma, len(termos) AS total, unnest(termos) AS termo FROM t
), p AS (
  SELECT id_norma, termo, any_value(total) AS total, count(*) AS n FROM o GROUP BY 1, 2
), d AS (
  SELECT termo, count(*) AS registros, sum(n) AS ocorrencias FROM p GROUP BY 1
)"""

_PART = "CASE WHEN {k} > 0 THEN {k} * ln({k} * nn / (({r}) * ({c}))) ELSE 0 END"
_LLR = (
    "2 * ("
    + " + ".join(
        _PART.format(k=k, r=r, c=c)
        for k, r, c in (
            ("k11", "k11 + k12", "k11 + k21"),
            ("k12", "k11 + k12", "k12 + k22"),
            ("k21", "k21 + k22", "k11 + k21"),
            ("k22", "k21 + k22", "k12 + k22"),
        )
    )
    + ")"
)

SQL = {
    "p3_found": f"WITH {_RECORDS} SELECT p.id_norma, p.termo FROM p JOIN d USING (termo) WHERE d.registros BETWEEN 2 AND 6",
    "p3_notas": f"""WITH {_RECORDS}, l AS (
  SELECT DISTINCT id_norma, unnest({_terms('tfidf_topk')}) AS termo FROM ementas_pre_processadas WHERE id_norma IS NOT NULL AND tfidf_topk IS NOT NULL
), tt AS (SELECT id_norma, any_value(total) AS total FROM p GROUP BY 1
), x AS (
  SELECT p.id_norma, p.termo, p.n, p.total, l.termo IS NOT NULL AS listado FROM p LEFT JOIN l ON l.id_norma = p.id_norma AND l.termo = p.termo
  UNION ALL SELECT l.id_norma, l.termo, 0, tt.total, true FROM l JOIN tt USING (id_norma) LEFT JOIN p ON p.id_norma = l.id_norma AND p.termo = l.termo WHERE p.termo IS NULL
), k AS (
  SELECT x.id_norma, x.termo, x.listado, CAST(x.n AS BIGINT) AS n, CAST(coalesce(d.registros, 0) AS BIGINT) AS registros, CAST(x.n AS DOUBLE) AS k11, CAST(x.total - x.n AS DOUBLE) AS k12,
         CAST(coalesce(d.ocorrencias, 0) - x.n AS DOUBLE) AS k21, CAST(s.s - x.total - coalesce(d.ocorrencias, 0) + x.n AS DOUBLE) AS k22, CAST(s.s AS DOUBLE) AS nn
  FROM x LEFT JOIN d USING (termo), (SELECT sum(ocorrencias) AS s FROM d) s
) SELECT id_norma, termo, n, registros, listado, round(CASE WHEN k11 * nn >= (k11 + k12) * (k11 + k21) THEN greatest({_LLR}, 0) ELSE -({_LLR}) END, 4) AS llr FROM k""",
    "p3_distintivos": f"""WITH {_RECORDS}, k AS (
  SELECT p.id_norma, p.termo, CAST(p.n AS BIGINT) AS n, CAST(d.registros AS BIGINT) AS registros, CAST(p.n AS DOUBLE) AS k11, CAST(p.total - p.n AS DOUBLE) AS k12,
         CAST(d.ocorrencias - p.n AS DOUBLE) AS k21, CAST(s.s - p.total - d.ocorrencias + p.n AS DOUBLE) AS k22, CAST(s.s AS DOUBLE) AS nn
  FROM p JOIN d USING (termo), (SELECT sum(ocorrencias) AS s FROM d) s
), g AS (
  SELECT id_norma, termo, n, registros, round(CASE WHEN k11 * nn >= (k11 + k12) * (k11 + k21) THEN greatest({_LLR}, 0) ELSE -({_LLR}) END, 4) AS llr FROM k
), x AS (
  SELECT *, row_number() OVER (PARTITION BY id_norma ORDER BY llr DESC, termo) AS posicao FROM g
) SELECT id_norma, termo, n, registros, llr, CAST(posicao AS INTEGER) AS posicao FROM x WHERE posicao <= 5""",
    "p6_found": f"""WITH {_RECORDS} SELECT termo, CASE WHEN registros < 4 THEN 'raro' ELSE 'comum' END AS marca
FROM d, (SELECT count(DISTINCT id_norma) AS c FROM p) n WHERE registros < 4 OR registros * 100 > 30 * c""",
    "p6_frequencias": f"""WITH {_RECORDS} SELECT termo, CAST(ocorrencias AS BIGINT) AS ocorrencias, CAST(registros AS BIGINT) AS registros,
  CASE WHEN registros < 4 THEN 'raro' WHEN registros * 100 > 30 * c THEN 'comum' END AS marca FROM d, (SELECT count(DISTINCT id_norma) AS c FROM p) n""",
}
