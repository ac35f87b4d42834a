"""Core queries against their reference SQL on the smallest test data."""

import glob
import math
import os

import duckdb
import pytest

from tabularium.plans import core


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for p in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, small, db, name):
    got = core.QUERIES[name](spark, small)
    want = db.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


#: Queries without SQL: what must hold of their rows (r: rows as dictionaries; n: number of norms with a summary).
CHECKS = {
    "textrank": lambda r, n: len(r) == n and all(x["texto"] is not None and len(x["texto"].split()) <= 7 for x in r),
    "lsa_terms": lambda r, n: len(r) == n and all(len(x["texto"].split()) <= 7 for x in r),
    "sentence_clusters": lambda r, n: len(r) == n and any(x["texto"] for x in r),
    "all_reductions": lambda r, n: len(r) == len({x["id"] for x in r}) == n and len(r[0]) == 13,
    "nmf_topics": lambda r, n: [x["id"] for x in sorted(r, key=lambda x: x["id"])] == list(range(1, 13)) and all(len(x["termos_principais"].split(", ")) == 8 and x["rotulo"] for x in r),
    "topic_assign": lambda r, n: len(r) == len({x["id"] for x in r}) > 0 and all(1 <= x["id_topico"] <= 12 and 1 / 12 <= x["score"] <= 1 and len(x["termos_chave"].split(", ")) == 5 for x in r),
    "local_embeddings": lambda r, n: len(r) == n and all(len(x["vetor"]) == 128 for x in r),
    "kmeans": lambda r, n: len(r) == 10 and abs(sum(x["percentual"] for x in r) - 100) < 0.01 and sum(x["tamanho"] for x in r) == 500 and all(-1 <= x["coesao"] <= 1 and x["inercia"] >= 0 for x in r),
    "profile_lines": lambda r, n: all(x["linha"].startswith("Autor: ") and "█" in x["linha"] for x in r),
}


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql(spark, small, name):
    n = core._docs(spark, small).count()
    assert CHECKS[name]([r.asDict() for r in core.QUERIES[name](spark, small).collect()], n)
