import pytest

import oracle
from stratavox.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, small, name):
    got, want = oracle.both(spark, small, Q.QUERIES[name], Q.ORACLE_SQL[name])
    assert got == want


def test_names_and_contract_columns(spark, small):
    columns = {
        1: {"doc_id", "held_out", "score", "predicted"},
        2: {"doc_id", "held_out", "score", "predicted"},
        3: {"vec_id", "n_links", "component_id", "kept"},
        4: {"doc_id", "fingerprint", "component_id"},
        7: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        8: {"doc_id", "held_out", "lang_pred", "score"},
        9: {"page_id", "host", "path", "rule", "verdict"},
        11: {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
        12: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    dealt = {n: q for n, q in Q.QUERIES.items() if n.startswith("op")}
    numbers = [int(n[2:].split("_")[0]) for n in dealt]
    assert sorted(numbers) == list(range(1, 13))
    for name, query in dealt.items():
        n = int(name[2:].split("_")[0])
        df = query(spark, small)
        assert columns.get(n, set()) <= set(df.columns)
        if n in (1, 2, 4, 5, 8, 11, 12):
            assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_aliases_decide_and_an_allow_comes_first(spark):
    rows = Q.url_aliases(spark, "/root/testdata/sf0.01").groupBy("decided_by", "verdict").count().collect()
    got = {(r["decided_by"], r["verdict"]): r["count"] for r in rows}
    assert got["alias", "block"] > 0 and got["alias", "allow"] > 0
