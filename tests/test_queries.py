"""Every query of the catalogue against its SQL."""

import pytest

from loomwork.plans import catalogue, oracles


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracles.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], oracles.SQL[name])


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(oracles.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_training_data_subpackage():
    """Nothing outside the subpackage and the pipeline names it, but the guarded import in the entry module."""
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[2]
    for path in [*root.glob("loomwork/**/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
