"""Every registered query against its DuckDB restatement on sf0.001."""

import pytest
from pyspark.sql import types as T

from quarry.plans.registry import load_all
from tools.check_oracle import duck, rows_of

from tests.conftest import SF001

REG = load_all()
TYPE_NAMES = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
              T.BooleanType: "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(REG))
def test_query_matches_oracle(spark, con, key):
    q = REG[key]
    df = q.build(spark, SF001)
    sp = df.toPandas()
    if q.sql is None:
        assert len(sp.columns) > 0
        return
    rel = con.sql(q.sql)
    spark_types = {f.name: TYPE_NAMES.get(type(f.dataType), f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
    dd = con.execute(q.sql).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dd)
    assert c1 == c2
    assert r1 == r2
