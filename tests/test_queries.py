import duckdb
import pytest

import dossier.plans.built  # noqa: F401
import dossier.plans.found  # noqa: F401
import dossier.plans.leads  # noqa: F401
import dossier.plans.pages  # noqa: F401
import dossier.plans.people  # noqa: F401
import dossier.plans.runs  # noqa: F401
import dossier.plans.streams  # noqa: F401
from dossier.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = sorted(str(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    if name in ORACLE_SQL:
        own = duck.sql(ORACLE_SQL[name])
        assert sorted(own.columns) == sorted(got.columns)
        order = [own.columns.index(c) for c in sorted(own.columns)]
        assert rows == sorted(str(tuple(r[k] for k in order)) for r in own.fetchall())
