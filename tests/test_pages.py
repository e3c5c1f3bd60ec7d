"""Pages from positioned boxes, without their blocks."""

import pytest

from spanloom.sources.readers import RAW, from_raw_blocks, page_offsets, page_table


@pytest.mark.parametrize("margins", [True, False])
def test_page_offsets_are_those_of_the_blocks(spark, margins):
    box = lambda doc, page, n, y, text: (doc, page, n, 10.0, y, 90.0, y + 9.0, 600.0, 800.0, text)
    rows = [box("a", p, n, 780.0 - 120 * n, f"line  {n} of\n{p}") for p in (2, 3, 5) for n in range(7)] + [box("a", 4, 0, 300.0, "17"), box("b", 3, 0, 300.0, None), box("b", 1, 0, 300.0, "early")]
    raw = spark.createDataFrame(rows, RAW)
    made = page_offsets(raw, margins, ("line 3.*",), 2, 5)
    wanted = page_table(raw, from_raw_blocks(raw, drop_margins=margins, patterns=("line 3.*",), start_page=2, end_page=5), 2, 5)
    assert made.columns == wanted.columns and sorted(map(str, made.collect())) == sorted(map(str, wanted.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate") and "Join" not in plan  # only pages are sorted, never boxes
