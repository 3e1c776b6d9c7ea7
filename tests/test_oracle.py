"""Every registered query against its SQL on the same tables, and what its plan must not hold."""

import pytest
from compare import connect, differences

from marketpulse.plans.oracle import oracle_sql
from marketpulse.plans.queries import REGISTRY

SQL = oracle_sql()
# The only queries that leave the JVM: models, drawn vectors and matrix products.
WITH_PYTHON = {"score_model", "embed_model", "embed_hash", "cosine_topk", "ivf_topk", "ivf_topk_kmeans", "ivf_exact", "stored_similarity"}
NO_SQL = {"ivf_topk_kmeans"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(REGISTRY) - set(SQL) == NO_SQL and set(SQL) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf_dir, con, name):
    df = REGISTRY[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("Python" in plan or "InPandas" in plan or "CoGroup" in plan) == (name in WITH_PYTHON)
    if name not in SQL:
        assert df.count() > 0
        return
    left, right, only_spark, only_sql = differences(df, con, SQL[name])
    assert left == right and not only_spark and not only_sql, (only_spark[:2], only_sql[:2])


def test_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
