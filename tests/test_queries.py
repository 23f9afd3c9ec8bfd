"""Every query with an SQL form gives the same rows; feature queries of one family share a case."""

import pytest

import __spark_entry__ as entry
import check

ALL = entry.queries()
SQL = entry.oracle_sql()
FAMILIES = ("ela_meta", "ela_distr", "ela_level", "pca", "limo", "nbc", "disp", "ic")


def cases():
    seen, out = set(), []
    for name in SQL:
        family = name.split(".")[0]
        if family in FAMILIES and "." in name:
            if family in seen:
                continue
            seen.add(family)
        if name.startswith("fn_") and len([c for c in out if c.startswith("fn_")]) >= 12:
            continue
        out.append(name)
    return out


@pytest.fixture(scope="session")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", cases())
def test_same_as_sql(spark, duck, sf, name):
    state, _, _, note = check.compare(spark, duck, sf, name, ALL[name], SQL[name])
    assert state == "ok", note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL)


def test_flagship(spark):
    assert entry.entry(spark).count() == 2
