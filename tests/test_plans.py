"""What the plans must look like: pruned scans, pushed filters, partial aggregation, no join of all with all."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", list(entry.queries()))
def test_no_join_of_all_with_all(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name,columns", [
    ("map_project", {"l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"}), ("reduce_by_key", {"l_partkey", "l_quantity"}), ("word_count", {"text"}), ("crdt_gset", {"user_id", "event_type"}), ("p2_found", None),
])
def test_scans_read_only_what_is_needed(spark, name, columns):
    text = plan(spark, name)
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", text)[1]))
    if columns is None:
        assert "feed_seq" not in read
    else:
        assert read == columns


@pytest.mark.parametrize("name,pushed", [
    ("filter_between", ["IsNotNull(o_totalprice)", "GreaterThanOrEqual(o_totalprice,50000.0)", "LessThanOrEqual(o_totalprice,150000.0)"]), ("filter_in", ["In(p_size"]), ("filter_eq", ["IsNull(revenue)", "EqualNullSafe(revenue"]), ("filter_noteq_nullsafe", ["EqualNullSafe(userId"]), ("filter_compare", ["LessThan(l_quantity", "GreaterThan(l_tax"]),
])
def test_filters_reach_the_scan(spark, name, pushed):
    found = re.search(r"PushedFilters: \[(.*)\]", plan(spark, name))[1]
    hits = [p in found for p in pushed]
    assert any(hits) if name == "filter_eq" else all(hits), found


@pytest.mark.parametrize("name", ["p2_found", "p6_found", "p6_chunks"])
def test_texts_are_not_parsed_to_filter(spark, name):
    """A filter on what a parse gives would be pushed below it and parse everything twice."""
    filters = re.findall(r"Condition : (.*)", plan(spark, name))
    assert filters and not any("from_json" in f or "get_json_object" in f for f in filters)


def test_sets_are_not_gathered(spark):
    assert "flatten" not in plan(spark, "totals_row")


def test_contradiction_reads_nothing(spark):
    text = plan(spark, "filter_contradiction")
    assert "Scan parquet" not in text


@pytest.mark.parametrize("name", ["reduce_by_key", "word_count", "measure_sum", "crdt_gcounter"])
def test_aggregates_before_the_shuffle(spark, name):
    assert re.search(r"partial_\w+", plan(spark, name))
