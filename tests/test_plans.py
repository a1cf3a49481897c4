"""Plans stay the ones meant: filters and columns reach the scan, no cross joins, no Python where none is needed."""

import re

import pytest

from folioflow.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_ranges_and_columns_reach_the_scan(spark, data):
    text = plan(catalogue.QUERIES["spend_lines"](spark, data))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts.*LessThan\(ts", text)
    assert "event_id" not in re.search(r"ReadSchema: .*", text)[0]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_no_cross_join_and_no_python(spark, data, name):
    if name in ("tumbling_days", "deduplicated_runs", "streamed_latest"):  # these run a stream when they are called
        pytest.skip("a stream")
    text = plan(catalogue.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("tei_round_trip", "epub_catalogue", "epub_images", "spec_identities"):  # archives, XML and canonical JSON are read in Python
        assert not re.search(r"\b(MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMap\w*InPandas)\b", text)


def test_rows_are_claimed_by_the_queries_that_have_them():
    """Rows of the inventory that were once claimed without code, and the query that each is built in."""
    claims = {"ING-15": "book_chapters", "MUT-13": "correction_rounds", "LVL-07": "faithful_editions", "MUT-02": "artifact_versions", "SRC-02": "epub_blocks", "SRC-13": "imported_bundles", "JOIN-16": "recut_places", "STR-08": "located_quotes", "TXT-21": "title_roles", "FLT-15": "next_step", "FLT-16": "apply_reason"}
    assert all(row in catalogue.ROWS[name].split() for row, name in claims.items())
