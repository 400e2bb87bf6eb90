"""The plans that scale: narrow scans, pushed filters, no cross joins, bounded sorts."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest

from kestrel import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name, columns", [
    ("overview_types", {"id", "media_type", "size", "present"}), ("face_tiers", {"id", "quality_tier", "det_score"}), ("pricing_summary", {"l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_shipdate"}),
])
def test_scans_are_narrow(spark, name, columns):
    p = plan(spark, name)
    read = re.search(r"ReadSchema: struct<(.*?)>", p).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == columns
    assert re.search(r"PushedFilters: \[.+\]", p)


@pytest.mark.parametrize("name", ["dup_groups", "browse_people_no_animals", "text_backlog", "revenue_by_nation", "nearest_place", "faces_in_animals"])
def test_no_cross_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_pages_and_ranks_are_bounded(spark):
    assert "TakeOrderedAndProject" in plan(spark, "browse_newest")
    assert "WindowGroupLimit" in plan(spark, "face_previews")


def test_every_query_has_columns_of_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name in ("overview_summary", "dup_groups", "text_search", "place_cells", "archive_cards", "coverage_flags"):
        cols = [c[0] for c in con.execute(catalog.SQL[name]).description]
        assert sorted(catalog.QUERIES[name](spark, SF).columns) == sorted(cols)
