"""Every query against its SQL, where the test tables are at hand."""

import os

import pytest

from folium import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = pytest.importorskip("duckdb").connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int) or hasattr(v, "as_tuple"):
        return repr(float(v))
    return str(v)


#: Queries that SQL does not follow, and the tests of what they do.
TESTED = {
    "html_text": "test_sources.test_html", "html_tables": "test_whole.test_tables_of_many_cells", "paragraphs": "test_layout.test_paragraphs", "near_glyphs": "test_layout.test_glyphs", "components_chained": "test_whole.test_components_of_all_orders",
    "chapters_by_size": "test_layout.test_chapters_by_size", "key_values": "test_layout.test_key_values", "row_groups": "test_layout.test_row_groups", "trend_poly": "test_layout.test_polynomial_trend", "grid_placement": "test_layout.test_placed_cells",
}
#: At this scale no row is left: the tables hold no such case.
NONE_HERE = set()


def test_all_are_tested():
    import importlib

    assert set(plans.queries()) - set(plans.oracle_sql()) == set(TESTED)
    for name in TESTED.values():
        module, _, test = name.partition(".")
        assert hasattr(importlib.import_module(module), test)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in NONE_HERE
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone():
    import subprocess
    import sys

    code = "import sys, folium.plans, folium.sources.files, folium.sinks.writers, folium.streaming.ingest; assert not any(m.startswith('folium.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
