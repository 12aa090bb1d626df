import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seqweft.session import get_session

    base = tmp_path_factory.mktemp("spark")
    session = get_session(
        "tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.warehouse.dir": f"{base}/warehouse"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compares a query with its SQL twin on a folder of tables."""
    import duckdb

    def run(spark, query, sql, sf_dir):
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
        want, got = con.sql(sql).df(), query(spark, sf_dir).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
        assert rows(want) == rows(got)

    return run
