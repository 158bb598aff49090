"""Keys and tables larger than the given ones: results against the SQL, and what must not grow with the tables."""

import re

import duckdb
import pytest

from rasterloom.operators import chart as H
from rasterloom.operators import matrix as M
from rasterloom.operators.convert import Settings
from rasterloom.plans import ORACLES, QUERIES
from test_queries import canon


def same_as_sql(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), [c[0] for c in want.description])


def test_sizes_halfway_between_two_tenths(spark, tmp_path):
    same_as_sql(spark, "chart_labels", tmp_path, events="select i * 262144 + j event_id from range(12) _(i), range(3) __(j)")


def test_colors_of_part_keys_beyond_five_digits(spark, tmp_path):
    same_as_sql(spark, "parsed_colors", tmp_path, part="select 1048570 + i p_partkey from range(20) _(i)")


def test_no_broadcast_grows_with_the_images(spark):
    """With files as small as these tests', Spark would broadcast every table that carries no hint."""
    settings = M.settings_table(spark, [(Settings(palette=((0, 0, 0), (255, 255, 255)), dither=d), 2) for d in ("none", "bayer2", "bayer4")])

    def broadcast_rows(images):
        px = spark.range(images * 16).selectExpr("id div 16 image_id", "cast(id % 16 div 4 as int) y", "cast(id % 4 as int) x", *(f"cast(id * {k} % 256 as int) {c}" for k, c in ((7, "r"), (5, "g"), (3, "b"))), "255 a")
        sizes = px.select("image_id").distinct().selectExpr("image_id", "4 width", "4 height")
        asked = sizes.selectExpr("image_id", "explode(sequence(0L, 2L)) setting_id")
        out = M.differences(M.convert_each(px, sizes, asked, settings), spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "setting_id long, plain_id long"))
        assert out.count() == 3 * images
        plan = out._jdf.queryExecution().executedPlan()
        return str(plan.toString()).count("BroadcastExchange")

    assert broadcast_rows(40) == 1  # which setting is compared with which


def test_charts_are_shuffled_as_rectangles_and_come_as_runs(spark):
    charts = spark.createDataFrame([(5, 30, 20)], "chart_id long, width int, height int")
    cells = spark.range(600).selectExpr("5L chart_id", "cast(id div 30 as int) row", "cast(id % 30 as int) col", "cast(id % 2 as int) idx")
    legend = spark.createDataFrame([(5, k, 9 * k, 80, 200, 300) for k in (0, 1)], "chart_id long, idx int, r int, g int, b int, count long")
    runs = H.chart_runs(charts, cells, legend, 6).collect()
    pixels = {(p.y, p.x): tuple(p)[3:] for p in H.chart_pixels(charts, cells, legend, 6).collect()}
    assert {(r.y, r.x + k): tuple(r)[4:] for r in runs for k in range(r.n)} == pixels
    assert len(runs) * 2 < sum(r.n for r in runs) == len(pixels)


GROWN = {
    "line_strokes": ("stroke", "part", "select i p_partkey from range(25000) _(i)"), "filled_ellipses": ("stroke", "part", "select i p_partkey from range(25000) _(i)"),
    "polygon_fill": ("polygon", "customer", "select i c_custkey from range(5000) _(i)"), "lanczos_up": ("image_id", "orders", "select i o_orderkey, i % 15000 o_custkey from range(450000) _(i)"),
    "stamped_cells": ("map_id", "orders", "select i o_orderkey, i % 15000 o_custkey from range(250000) _(i)"), "undo_steps": ("owner", "orders", "select i o_orderkey, i % 15000 o_custkey from range(1200000) _(i)"),
}


@pytest.mark.parametrize("name", sorted(GROWN))
def test_tasks_grow_with_the_rows(spark, tmp_path, name):
    """Rows are shuffled once, by their key, to a number of tasks that follows from theirs, before more is made of them."""
    key, table, sql = GROWN[name]
    duckdb.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, (\d+)\), REPARTITION_BY_NUM", plan) == [(key, "3")]
    assert plan.count("Exchange hashpartitioning") == {"stamped_cells": 2, "lanczos_up": 3}.get(name, 1)  # grids, and weights, shuffle what is theirs
