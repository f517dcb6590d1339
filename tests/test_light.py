"""Queries that compare names and municipalities only don't parse all addresses once more for their places."""

import re

import __spark_entry__ as driver
from regsync import queries as registry

SF = "/root/testdata/sf0.001"
LIGHT = ("tier1", "tier2", "tier3", "tier4", "tier65", "audit_core", "lookup_names")


def test_same_rows_with_and_without_places(spark):
    known = driver.queries()
    registry.forget()
    alone = {}
    for name in LIGHT:
        registry.forget()
        alone[name] = sorted(map(tuple, known[name](spark, SF).collect()), key=str)
        assert not any(key[0] in ("_sides", "_tiered_sides") for key in registry._KEPT), name
    registry.forget()
    known["match_keys"](spark, SF)  # now the whole sides are kept, and used
    for name in LIGHT:
        assert sorted(map(tuple, known[name](spark, SF).collect()), key=str) == alone[name] and alone[name], name
        assert not any(key[0] == "_named_sides" for key in registry._KEPT), name
    registry.forget()


def test_places_are_pruned(spark):
    side = registry.with_registry_keys(registry.normalize_columns(registry.domain.registry(spark, SF), "id"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("__l_", plan(side)) and not re.search("__l_", plan(side.drop(*registry._LOCATED)))
