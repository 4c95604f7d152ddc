"""The recursive schema walk against a direct recursive reading of the same schemas."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shroud.functions import seeds
from shroud.operators import schema_walk, surface

LIKE = re.compile(seeds.URL_PARAM)


def brute(node, depth=0, path="$"):
    if depth > seeds.SCHEMA_MAX_DEPTH:
        return
    if isinstance(node, list):
        for i, x in enumerate(node):
            yield from brute(x, depth + 1, f"{path}[{i}]")
    elif isinstance(node, dict):
        if isinstance(node.get("properties"), dict):
            for k, x in node["properties"].items():
                if LIKE.search(k):
                    yield (f"{path}.properties.{k}", k, depth)
                yield from brute(x, depth + 1, f"{path}.properties.{k}")
        for c in seeds.SCHEMA_CONTAINERS:
            if c in node:
                yield from brute(node[c], depth + 1, f"{path}.{c}")


def nested(levels, name):
    return {"properties": {name: {}}} if levels == 0 else {"properties": {"inner": nested(levels - 1, name)}}


def walked(spark, schemas):
    tools = spark.createDataFrame([(1, f"t{i}", p) for i, p in enumerate(schemas)], "session_id bigint, name string, parameters string")
    rows = schema_walk.url_parameters(tools).collect()
    assert schema_walk.url_parameters(tools).columns == ["session_id", "name", "path", "parameter", "depth"]
    declared = {r.name: r.d for r in tools.select("name", surface.schema_declares_network(F.col("parameters")).alias("d")).collect()}
    return sorted((r.name, r.path, r.parameter, r.depth) for r in rows), declared


CASES = [
    {"properties": {"url": {}, "note": {"description": "url"}}},
    {"properties": {"properties": {"type": "string"}, "HOST": {}}},
    {"properties": {"properties": {"properties": {"server": {}}}}},
    {"properties": ["url", {"properties": {"url": {}}}]},
    {"url": {"properties": {"url": {}}}},  # not a container: not entered
    {"items": [{"properties": {"Webhook": {}}}, {"oneOf": [{"properties": {"uri": {}}}]}]},
    {"$defs": {"a": {"properties": {"server": {}}}}},  # a container's own names are no nodes below it
    [{"properties": {"endpoint": {"properties": {"address": {}}}}}],
    nested(6, "endpoint"), nested(7, "endpoint"), {}, [], "url", 7, None,
]


def test_walk_equals_a_direct_reading(spark):
    got, declared = walked(spark, [json.dumps(c) for c in CASES])
    expected = sorted((f"t{i}", *hit) for i, c in enumerate(CASES) for hit in brute(c))
    assert got == expected
    names = {name for name, *_ in got}
    assert declared == {f"t{i}": f"t{i}" in names for i in range(len(CASES))}
    assert "t8" in names and "t9" not in names  # the depth edge


def test_odd_schemas_and_shared_ones(spark):
    shared = '{"properties": {"origin": {}}}'
    got, _ = walked(spark, [None, "", "{bad", '{"properties": {"url": {}', shared, shared])
    assert got == [("t4", "$.properties.origin", "origin", 0), ("t5", "$.properties.origin", "origin", 0)]
    assert walked(spark, [])[0] == []


def test_walk_is_one_recursion(spark):
    tools = spark.createDataFrame([(1, "t", "{}")], "session_id bigint, name string, parameters string")
    plan = schema_walk.url_parameters(tools)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UnionLoop ") == 1 and "from_json" not in plan


names = st.sampled_from(["url", "Host", "q", "properties", "items", "base_url"])
schema = st.recursive(st.sampled_from([{}, 1, "url", None]), lambda kid: st.one_of(
    st.lists(kid, max_size=3), st.dictionaries(st.sampled_from(["properties", "other", *seeds.SCHEMA_CONTAINERS]), kid, max_size=3),
    st.dictionaries(names, kid, max_size=3).map(lambda p: {"properties": p})), max_leaves=12)


def test_random_schemas(spark):
    found = []

    @settings(max_examples=150, deadline=None, database=None, derandomize=True)
    @given(schema)
    def draw(s):
        found.append(s)

    draw()
    got, _ = walked(spark, [json.dumps(s) for s in found])
    assert got == sorted((f"t{i}", *hit) for i, s in enumerate(found) for hit in brute(s))
