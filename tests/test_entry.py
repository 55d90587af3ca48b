"""Driver contract: entry() and a sample of registered queries vs their
DuckDB oracles at sf0.001."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from tools.check_oracle import TABLES, table_hash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    r = E.entry(spark).collect()
    assert len(r) == 1 and r[0]["gamma"] == pytest.approx(0.42)
    assert r[0]["ndcg_10"] == pytest.approx(0.9663, abs=1e-4)


def test_registry_keys_have_oracles():
    from lodestar.plans.oracles import ORACLES
    from lodestar.plans.registry import R
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(R) <= set(q)
    assert set(R) - set(ORACLES) == {"embed_column", "adapter_fit"}
    assert len(R) >= 68


@pytest.mark.parametrize("name", ["topk_cos", "tune_n", "m_intervals", "metric_suite", "random_split",
                                  "judgment_sets", "passage_explode"])
def test_oracle_sample(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols) and len(rows) == len(orows)
    assert table_hash(df.columns, rows) == table_hash(ocols, orows)
