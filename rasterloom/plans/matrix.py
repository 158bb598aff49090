"""Queries over relations of settings: every derived image under a matrix of palettes, sizes, kinds of downscaling and dithers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import matrix as M
from rasterloom.operators import raster as R
from rasterloom.operators.convert import Settings
from rasterloom.plans import sql as S
from rasterloom.registry import query
from rasterloom.sources.palettes import colors
from rasterloom.sources.rasters import PIXELS, SIDE, pixels

PALETTES, BLOCKS, MODES, ORDERS = ("gameboy", "cga", "c64", "zx-spectrum"), (4, 8, 16), ("box", "nearest", "dominant"), (0, 2, 4)
#: palette, block side, mode, order of the dither matrix (0: none): setting_id is the place in this list.
CASES = list(itertools.product(PALETTES, BLOCKS, MODES, ORDERS))


def _converted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All images under all cases, and with which case each is compared: the one without dithering."""
    settings = M.settings_table(spark, [(Settings(mode=m, palette=tuple(colors(p)), dither=f"bayer{n}" if n else "none"), block) for p, block, m, n in CASES])
    px = pixels(spark, d)
    sizes = px.select("image_id").distinct().withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)})
    asked = sizes.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(CASES) - 1).cast("long"))).alias("setting_id"))
    plain = spark.createDataFrame([(k, CASES.index((*c[:3], 0))) for k, c in enumerate(CASES)], "setting_id long, plain_id long")
    return M.convert_each(px, sizes, asked, settings), plain


def _dithered_sql(p: str) -> str:
    """All dithers of one palette over the downscaled images."""
    name, spread = p.replace("-", "_"), R.palette_spread(colors(p))
    shift = "CASE n WHEN 2 THEN ([0, 2, 3, 1][((y % 2) * 2 + x % 2 + 1)::INT] + 0.5) / 4.0::DOUBLE - 0.5 WHEN 4 THEN ([0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5][((y % 4) * 4 + x % 4 + 1)::INT] + 0.5) / 16.0::DOUBLE - 0.5 ELSE 0 END"
    return f"s_{name} AS (SELECT * REPLACE (l + ({shift}) * {spread!r}::DOUBLE AS l) FROM lab, (VALUES (0), (2), (4)) o(n)), {S.nearest(f's_{name}', p, f'n_{name}')}"


_MATRIX = f"""WITH {PIXELS}, b(ps) AS (VALUES {", ".join(f"({k})" for k in BLOCKS)}), c AS (SELECT image_id, ps, y // ps cy, x // ps cx, y * 64 + x p, px.y py, px.x pxx, r, g, b.ps k, px.b bb, a FROM px, b),
boxed AS (SELECT image_id, ps, cy, cx, count(*) n, sum(a) s, {", ".join(f"sum((floor({S.lin(f'{e} / 255.0::DOUBLE')} * 1099511627776 + 0.5) * a)::HUGEINT)::DOUBLE {o}" for e, o in (("r", "r"), ("g", "g"), ("bb", "b")))} FROM c GROUP BY ALL),
keyed AS (SELECT image_id, ps, cy, cx, ((r >> 3) << 10) | ((g >> 3) << 5) | (bb >> 3) AS key, count(*) n, arg_min(r, p) r, arg_min(g, p) g, arg_min(bb, p) b FROM c WHERE a <> 0 GROUP BY ALL),
first AS (SELECT *, row_number() OVER (PARTITION BY image_id, ps, cy, cx ORDER BY n DESC, key) i FROM keyed),
small AS (SELECT image_id, ps, 'box' AS mode, cy y, cx x, {", ".join(f"CASE WHEN s > 0 THEN floor({S.enc(f'({e} / (s * 1099511627776.0::DOUBLE))')} * 255 + 0.5) ELSE 0 END::INT {e}" for e in "rgb")}, floor(s / n + 0.5)::INT a FROM boxed
 UNION ALL SELECT image_id, ps, 'nearest', cy, cx, r, g, bb, a FROM c WHERE py = cy * ps + ps // 2 AND pxx = cx * ps + ps // 2
 UNION ALL SELECT t.image_id, t.ps, 'dominant', t.cy, t.cx, coalesce(f.r, 0), coalesce(f.g, 0), coalesce(f.b, 0), floor(t.s / t.n + 0.5)::INT FROM boxed t LEFT JOIN first f ON f.image_id = t.image_id AND f.ps = t.ps AND f.cy = t.cy AND f.cx = t.cx AND f.i = 1),
{S.labs("small")}, {", ".join(map(_dithered_sql, PALETTES))},
done AS ({" UNION ALL ".join(f"SELECT image_id, {k} p, ps, mode, n, y, x, idx FROM n_{name.replace('-', '_')}" for k, name in enumerate(PALETTES))}),
numbered AS (SELECT *, (((p * {len(BLOCKS)} + list_position({list(BLOCKS)}, ps) - 1) * {len(MODES)} + list_position({list(MODES)}, mode) - 1) * {len(ORDERS)} + list_position({list(ORDERS)}, n) - 1)::BIGINT setting_id FROM done),
cases AS (SELECT m.image_id, m.setting_id, count(*) pixels, count(DISTINCT m.idx) FILTER (m.idx <> 65535) used, count(*) FILTER (m.idx <> q.idx) differing, min(m.y * 64 + m.x) FILTER (m.idx <> q.idx) place
 FROM numbered m JOIN numbered q ON q.n = 0 AND m.image_id = q.image_id AND m.p = q.p AND m.ps = q.ps AND m.mode = q.mode AND m.y = q.y AND m.x = q.x GROUP BY ALL),
result AS (SELECT image_id, setting_id, pixels, used, differing, (place // 64)::INT first_y, (place % 64)::INT first_x FROM cases)"""


@query(_MATRIX + " SELECT * FROM result")
def settings_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every image under 108 settings: colours used, and how it differs from the same without dithering."""
    return M.differences(*_converted(spark, d))


@query(_MATRIX + ", shares AS (SELECT *, differing / pixels::DOUBLE share FROM result) SELECT * FROM shares ORDER BY share DESC, image_id, setting_id LIMIT 10")
def worst_cases(spark: SparkSession, d: str) -> DataFrame:
    """The ten cases of settings_matrix that dithering changes most."""
    return M.worst(M.differences(*_converted(spark, d)))
