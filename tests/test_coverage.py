"""Every operator of SURVEY §2 has a library function and a registered query with an oracle."""

import importlib

import __spark_entry__ as E
from sitesieve.plans.coverage import COVERAGE


def test_inventory_complete():
    families = {"S": 19, "P": 21, "F": 16, "J": 14, "A": 13, "O": 3, "U": 4, "C": 9, "G": 6, "T": 3, "L": 3}
    for fam, n in families.items():
        for i in range(1, n + 1):
            assert f"{fam}{i}" in COVERAGE, f"{fam}{i} missing"


def test_functions_and_queries_exist():
    qs, sql = E.queries(), E.oracle_sql()
    for op, (path, query) in COVERAGE.items():
        mod, name = path.rsplit(".", 1)
        assert callable(getattr(importlib.import_module(mod), name)), op
        assert query in qs, (op, query)
        assert query in sql, (op, query)
