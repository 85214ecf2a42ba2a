import pytest

from compare import connect
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rounded(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rounded(df.collect(), df.columns) == rounded(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    n = df.count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() or name == "op8_license_scans" and n > 0
