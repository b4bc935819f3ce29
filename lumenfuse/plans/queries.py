"""Registered queries over rasters of ``embeddings`` and the cohort stand-in of ``events``, and their DuckDB SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfuse.functions import color, synth
from lumenfuse.operators import bands, cohort, convolve, fusion, points, pyramid, report, similarity, stats, steerable, wavelet, windowed
from lumenfuse.operators import metrics as M
from lumenfuse.operators.filter_banks import SP1, named
from lumenfuse.plans import evaluate, window_sql
from lumenfuse.sources import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return raster.with_fused(raster.tile_pairs(_embeddings(spark, d)))


def _mosaics(spark: SparkSession, d: str) -> DataFrame:
    return raster.with_fused(raster.mosaic_pairs(_embeddings(spark, d)))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as sums run in another order in each engine; first to 12 places, so that a tie is one in both."""
    return df.select(*[(F.round(F.round(F.col(c), 12), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _band_energy(bands: DataFrame) -> DataFrame:
    """Size and energy of each band."""
    return bands.select("img", "level", "band", "h", "w", F.aggregate("px", F.lit(0.0), lambda s, v: s + v * v).alias("energy"))


# ------------------------------------------------------------ SQL building blocks

_PX = "px as (select vec_id, generate_subscripts(embedding, 1) - 1 as p, least(255, greatest(0, cast(floor(cast(unnest(embedding) as double) * 240 + 128) as int)))::double as v from embeddings)"
_T = f"{_PX}, t as (select x.vec_id // 2 as img, (x.p // 8)::int as r, (x.p % 8)::int as c, x.v as a, y.v as b, greatest(x.v, y.v) as f from px x join px y on x.vec_id // 2 = y.vec_id // 2 and x.p = y.p and x.vec_id % 2 = 0 and y.vec_id % 2 = 1)"
_H = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


def _hist(*cols: str, table: str = "t") -> str:
    return f"(select img, {_H} as h from (select img, count(*)::double as n from {table} group by img, {', '.join(cols)}) group by img)"


def _r(x: str, alias: str) -> str:
    return f"round(round({x}, 12), 6) + 0.0 as {alias}"


_ALL_H = " ".join(f"join {_hist(*k)} h_{k} using (img)" for k in ("a", "b", "f", "af", "bf", "ab"))

# ------------------------------------------------------------ metrics

_add("metric_information", lambda s, d: rounded(M.information(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T} select img, {_r('h_f.h', '"EN"')}, {_r('2 * h_f.h + h_a.h + h_b.h - h_af.h - h_bf.h', '"MI"')},
{_r('2 * ((h_f.h + h_a.h - h_af.h) / nullif(h_f.h + h_a.h, 0) + (h_f.h + h_b.h - h_bf.h) / nullif(h_f.h + h_b.h, 0))', '"NMI"')} from (select distinct img from t) {_ALL_H}""")
_add("metric_en_mosaic", lambda s, d: rounded(M.information(raster.pixels(_mosaics(s, d), "a", "b", "f")).select("img", "EN")), f"""
with {_PX}, m as (select vec_id // 64 as m, (vec_id % 64) as k, p, v from px), ok as (select m from m group by m having count(*) = 4096),
t as (select x.m // 2 as img, greatest(x.v, y.v) as f from m x join m y on x.m // 2 = y.m // 2 and x.k = y.k and x.p = y.p and x.m % 2 = 0 and y.m % 2 = 1 where x.m in (from ok) and y.m in (from ok))
select img, {_r('h', '"EN"')} from {_hist('f')}""")
_add("metric_oce", lambda s, d: rounded(M.cross_entropy(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, h as (select img, v, count(*) filter (k = 'a') as a, count(*) filter (k = 'b') as b, count(*) filter (k = 'f') as f from (select img, 'a' as k, a as v from t union all select img, 'b', b from t union all select img, 'f', f from t) group by img, v)
select img, {_r("(coalesce(sum(case when a > 0 and f > 0 then a * log2(a / f) end), 0) + coalesce(sum(case when b > 0 and f > 0 then b * log2(b / f) end), 0)) / sum(f) / 2", '"OCE"')} from h group by img""")


def _qte(as_is: bool) -> str:
    q, parts = 0.43137, []
    for x, y in ("af", "bf", "ab"):
        mx, my = (y, x) if as_is else (x, y)
        parts.append(f"i_{x}{y} as (select k.img, (1 - coalesce(sum(pow(n / 64.0, {q}) / pow(m1 * m2 / 4096.0, {q - 1})), 0)) / (1 - {q}) as i from (select distinct img from t) k left join (select j.img, n, p.n1 as m1, o.n1 as m2 from (select img, {x} as x, {y} as y, count(*) as n from t group by all) j join (select img, {mx} as v, count(*) as n1 from t group by all) p on p.img = j.img and p.v = j.x join (select img, {my} as v, count(*) as n1 from t group by all) o on o.img = j.img and o.v = j.y) z on k.img = z.img group by k.img)")
    hs = ", ".join(f"e_{x} as (select img, (1 - sum(pow(n / 64.0, {q}))) / (1 - {q}) as h from (select img, count(*) as n from t group by img, {x}) group by img)" for x in "ab")
    return f"""with {_T}, {', '.join(parts)}, {hs} select img, {_r(f"coalesce((i_af.i + i_bf.i) / nullif(e_a.h + e_b.h {'+' if as_is else '-'} i_ab.i, 0), 0)", '"QTE"')} from i_af join i_bf using (img) join i_ab using (img) join e_a using (img) join e_b using (img)"""


_add("metric_qte", lambda s, d: rounded(M.tsallis(raster.pixels(_tiles(s, d), "a", "b", "f"))), _qte(True))
_add("metric_qte_corrected", lambda s, d: rounded(M.tsallis(raster.pixels(_tiles(s, d), "a", "b", "f"), as_is=False)), _qte(False))
_n = ", ".join(f"case when max({x}) over w = 0 and min({x}) over w = 0 then {x} else round(({x} - min({x}) over w) / nullif(max({x}) over w - min({x}) over w, 0) * 255) end as {x}" for x in "abf")
_add("metric_ncie", lambda s, d: rounded(M.ncie(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, u as (select img, {_n} from t window w as (partition by img)), e as (select img, (h_a.h + h_b.h - h_ab.h) / 8 as ab, (h_a.h + h_f.h - h_af.h) / 8 as af, (h_b.h + h_f.h - h_bf.h) / 8 as bf from (select distinct img from u) {" ".join(f"join {_hist(*k, table='u')} h_{k} using (img)" for k in ("a", "b", "f", "af", "bf", "ab"))}),
p as (select *, sqrt((ab * ab + af * af + bf * bf) / 3) as p from e), z as (select *, acos(greatest(-1, least(1, coalesce(ab * af * bf / nullif(p * p * p, 0), 0)))) / 3 as th from p),
l as (select img, unnest([1 + 2 * p * cos(th), 1 + 2 * p * cos(th + 2 * pi() / 3), 1 + 2 * p * cos(th + 4 * pi() / 3)]) as x from z)
select img, {_r("1 + sum(case when x > 1e-15 then x / 3 * log2(x / 3) else 0 end) / 8", '"NCIE"')} from l group by img""")
_add("metric_moments", lambda s, d: rounded(M.moments(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, m as (select img, stddev_pop(f) as sd, avg(f) as mf, (avg(a) + avg(b)) / 2 as h, (avg((f - a) * (f - a)) + avg((f - b) * (f - b))) / 2 / 65025 as mse from t group by img)
select img, {_r('sd', '"SD"')}, {_r('abs(mf - h) / nullif(h, 0)', '"MLI"')}, {_r('mse', '"MSE"')}, {_r('20 * log10(255 / nullif(sqrt(mse), 0))', '"PSNR"')} from m""")
_corr = lambda x, y: f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
_add("metric_correlation", lambda s, d: rounded(M.correlations(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T} select img, {_r(f"({_corr('a', 'f')} + {_corr('b', 'f')}) / 2", '"CC"')}, {_r(f"{_corr('f - b', 'a')} + {_corr('f - a', 'b')}", '"SCD"')} from t group by img""")
_WIN = "window row as (partition by img, r order by c), col as (partition by img, c order by r)"
_add("metric_sf", lambda s, d: rounded(M.spatial_frequency(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, g as (select img, f - lag(f) over row as x, f - lag(f) over col as y from t {_WIN}) select img, {_r('sqrt(avg(x * x) + avg(y * y))', '"SF"')} from g group by img""")
_add("metric_ag", lambda s, d: rounded(M.average_gradient(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, g as (select img, r, c, coalesce((lead(f) over row - lag(f) over row) / 2, lead(f) over row - f, f - lag(f) over row) as x, coalesce((lead(f) over col - lag(f) over col) / 2, lead(f) over col - f, f - lag(f) over col) as y from t {_WIN})
select img, {_r('sum(sqrt((x * x + y * y) / 2)) / (max(r) * max(c))', '"AG"')} from g group by img""")


def _stencil(channels: str, row: Callable[[str], str], col: Callable[[str], str]) -> str:
    """Sobel sums by joins on shifted coordinates, with the border rule as an expression of the coordinate."""
    weight = {-1: 1, 0: 2, 1: 1}
    cells = ", ".join(f"({i}, {j}, {j * weight[i]}, {i * weight[j]})" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
    sums = ", ".join(f"sum(k.x * n.{x}) as x_{x}, sum(k.y * n.{x}) as y_{x}" for x in channels)
    return f"s as (select t.img, t.r, t.c, {sums} from t cross join (values {cells}) k(i, j, x, y) join t n on n.img = t.img and n.r = {row('t.r + k.i')} and n.c = {col('t.c + k.j')} group by t.img, t.r, t.c)"


_edge = lambda v: f"least(7, greatest(0, {v}))"
_mirror = lambda v: f"(case when {v} < 0 then 1 when {v} > 7 then 6 else {v} end)"
_add("metric_ei", lambda s, d: rounded(M.edge_intensity(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"with {_T}, {_stencil('f', _edge, _edge)} select img, {_r('avg(sqrt(x_f * x_f + y_f * y_f))', chr(34) + 'EI' + chr(34))} from s group by img")


def _rsfe() -> str:
    ways = [("0", "-1", 1.0), ("-1", "0", 1.0), ("-1", "-1", math.sqrt(2) / 2), ("-1", "1", math.sqrt(2) / 2)]
    rows = " union all ".join(f"select t.img, {w} * (t.f - n.f) * (t.f - n.f) as x, {w} * pow(greatest(abs(t.a - n.a), abs(t.b - n.b)), 2) as y from t join t n on n.img = t.img and n.r = t.r + {i} and n.c = t.c + {j}" for i, j, w in ways)
    return f"with {_T}, g as (select img, sqrt(sum(x) / 64) as x, sqrt(sum(y) / 64) as y from ({rows}) group by img) select img, {_r('(x - y) / nullif(y, 0)', chr(34) + 'rSFe' + chr(34))} from g"


_add("metric_rsfe", lambda s, d: rounded(M.ratio_spatial_frequency(raster.pixels(_tiles(s, d), "a", "b", "f"))), _rsfe())


def _qabf() -> str:
    g = ", ".join(f"sqrt(x_{k} * x_{k} + y_{k} * y_{k}) / 8 as g_{k}, case when x_{k} = 0 and y_{k} = 0 then 0 when y_{k} = 0 then sign(x_{k}) * pi() / 2 else atan(x_{k} / y_{k}) end as o_{k}" for k in "abf")
    q = ", ".join(f"sqrt({M.NRG} / (1 + exp(-{M.KG} * (case when g_{k} = 0 or g_f = 0 then 0 else least(g_{k}, g_f) / greatest(g_{k}, g_f) end - {M.SG}))) * {M.NRA} / (1 + exp(-{M.KA} * (abs(abs(o_{k} - o_f) - pi() / 2) * 2 / pi() - {M.SA})))) as q_{k}, case when g_{k} >= {M.TD} then pow(g_{k}, {M.LG}) else {M.WT_MIN} end as w_{k}" for k in "ab")
    new, tot = "g_f > g_a and g_f > g_b", "sum(w_a + w_b)"
    lost = "(1 - q_a) * w_a + (1 - q_b) * w_b"
    cols = {"QABF": f"sum(q_a * w_a + q_b * w_b) / {tot}", "LABF": f"sum(case when {new} then 0 else {lost} end) / {tot}", "NABF": f"sum(case when {new} then {lost} else 0 end) / {tot}", "NABF1": f"sum(case when {new} then (2 - q_a - q_b) * (w_a + w_b) else 0 end) / {tot}"}
    return f"with {_T}, {_stencil('abf', _mirror, _mirror)}, g as (select img, {g} from s), q as (select *, {q} from g) select img, " + ", ".join(_r(v, f'"{k}"') for k, v in cols.items()) + " from q group by img"


_add("metric_qabf", lambda s, d: rounded(M.edge_transfer(raster.pixels(_tiles(s, d), "a", "b", "f"))), _qabf())
_add("metric_fusion_gain", lambda s, d: rounded(M.fusion_gain(raster.pixels(_tiles(s, d), "a", "b", "f"))), _qabf().split(" select img, round(round(sum(q_a")[0] + f"""
select img, {_r('sum((q_a - least(q_a, q_b)) * w_a + (q_b - least(q_a, q_b)) * w_b) / sum(w_a + w_b)', '"QDELTA"')}, {_r('sum(least(q_a, q_b) * (w_a + w_b)) / sum(w_a + w_b)', '"QCOMMON"')} from q group by img""")


def _qabf_first() -> str:
    """Sobel sums over a border of zeros, by left joins."""
    cells = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    joins = " ".join(f"left join t n{i + 1}{j + 1} on n{i + 1}{j + 1}.img = t.img and n{i + 1}{j + 1}.r = t.r + {i} and n{i + 1}{j + 1}.c = t.c + {j}" for i, j in cells)
    z = lambda i, j, x: f"coalesce(n{i}{j}.{x}, 0)"
    sums = ", ".join(f"{z(0, 2, x)} - {z(0, 0, x)} + 2 * ({z(1, 2, x)} - {z(1, 0, x)}) + {z(2, 2, x)} - {z(2, 0, x)} as x_{x}, {z(2, 0, x)} - {z(0, 0, x)} + 2 * ({z(2, 1, x)} - {z(0, 1, x)}) + {z(2, 2, x)} - {z(0, 2, x)} as y_{x}" for x in "abf")
    g = ", ".join(f"sqrt(x_{x} * x_{x} + y_{x} * y_{x}) as g_{x}, case when x_{x} = 0 then pi() / 2 else atan(-y_{x} / x_{x}) end as o_{x}" for x in "abf")
    q = ", ".join(f"{M.TG} / (1 + exp({M.KG1} * (case when g_{x} > g_f then g_f / g_{x} when g_{x} = g_f then g_f else g_{x} / g_f end - {M.DG}))) * {M.TA} / (1 + exp({M.KA1} * (1 - abs(o_{x} - o_f) / (pi() / 2) - {M.DA}))) as q_{x}" for x in "ab")
    return f"with {_T}, s as (select t.img, {sums} from t {joins}), g as (select img, {g} from s), q as (select *, {q} from g) select img, {_r('sum(q_a * g_a + q_b * g_b) / nullif(sum(g_a + g_b), 0)', '\"QABF_first\"')} from q group by img"


_add("metric_qabf_first", lambda s, d: rounded(M.edge_transfer_first(raster.pixels(_tiles(s, d), "a", "b", "f"))), _qabf_first())
_MOSAICS = f"{_PX}, m as (select vec_id // 64 as m, (vec_id % 64)::int as k, p::int as p, v from px), ok as (select m from m group by m having count(*) = 4096), t as materialized (select x.m // 2 as img, x.k // 8 * 8 + x.p // 8 as r, x.k % 8 * 8 + x.p % 8 as c, x.v as a, y.v as b, greatest(x.v, y.v) as f from m x join m y on x.m // 2 = y.m // 2 and x.k = y.k and x.p = y.p and x.m % 2 = 0 and y.m % 2 = 1 where x.m in (from ok) and y.m in (from ok))"
_add("metric_windowed", lambda s, d: rounded(similarity.score(_mosaics(s, d), *similarity.METRICS)), f"with {_MOSAICS}, {window_sql.all_scores()} select img, " + ", ".join(_r(f'"{n}"', f'"{n}"') for n in similarity.METRICS) + " from scores")
_add("metric_fmi", lambda s, d: rounded(windowed.score(_mosaics(s, d), "FMI", "FMI_none", "FMI_gradient", "FMI_dct")))
_add("metric_contrast", lambda s, d: rounded(windowed.score(_mosaics(s, d), "QCB", "QCV")))


def _loe() -> str:
    """A tile's 100 x 100 samples are its pixels, weighted by how often the grid meets their row and column."""
    met = [math.floor(1 + i * (raster.TILE - 1) / 99 + 0.5) - 1 for i in range(100)]
    weight = lambda x: "case " + x + " ".join(f" when {k} then {met.count(k)}" for k in range(raster.TILE)) + " end"
    side = lambda k: f"sum(case when (x.{k} >= y.{k}) <> (x.f >= y.f) then x.n * y.n else 0 end)::double / 10000"
    return f"with {_T}, m as (select img, a, b, f, ({weight('r')}) * ({weight('c')}) as n from t) select x.img, {_r(side('a'), '\"LOE_A\"')}, {_r(side('b'), '\"LOE_B\"')} from m x join m y on x.img = y.img group by x.img"


_add("metric_loe", lambda s, d: rounded(windowed.score(_tiles(s, d), "LOE_A", "LOE_B")), _loe())

# ------------------------------------------------------------ fusion

_add("fuse_fuzzy", lambda s, d: fusion.fuse(raster.pixels(_tiles(s, d), "a", "b"), "fuzzy"), f"with {_T} select img, r, c, f::int as fused from t")
_PCA = ("""m as (select img, var_samp(a) as p, var_samp(b) as q, covar_samp(a, b) as k from t group by img),
e as (select img, case when k <> 0 then (p - q) / 2 + sqrt((p - q) * (p - q) / 4 + k * k) when p >= q then 1 else 0 end as x, case when k <> 0 then k when p >= q then 0 else 1 end as y from m)""",
    "select img, r, c, trunc(greatest(0, least(255, round(x / nullif(x + y, 0) * a + y / nullif(x + y, 0) * b, 9))))::int as fused from t join e using (img)")
_add("fuse_pca", lambda s, d: fusion.fuse(raster.pixels(_tiles(s, d), "a", "b"), "pca"), f"with {_T}, {' '.join(_PCA)}")


def _haar() -> tuple[str, str]:
    four = ", ".join(f"max({x}) filter (r % 2 = {i} and c % 2 = {j}) as {x}{i}{j}" for x in "ab" for i in (0, 1) for j in (0, 1))
    band = lambda x, s: "(" + " ".join(f"{'+' if k > 0 else '-'} {x}{i}{j}" for k, (i, j) in zip(s, ((0, 0), (0, 1), (1, 0), (1, 1)))) + ") / 2"
    signs = {"lh": (1, 1, -1, -1), "hl": (1, -1, 1, -1), "hh": (1, -1, -1, 1)}
    bands = f"({band('a', (1, 1, 1, 1))} + {band('b', (1, 1, 1, 1))}) / 2 as ll, " + ", ".join(f"case when abs({band('a', s)}) >= abs({band('b', s)}) then {band('a', s)} else {band('b', s)} end as {k}" for k, s in signs.items())
    back = " union all ".join(f"select img, (2 * i + {i})::int as r, (2 * j + {j})::int as c, trunc(greatest(0, least(255, (ll {'+' if signs['lh'][2 * i + j] > 0 else '-'} lh {'+' if signs['hl'][2 * i + j] > 0 else '-'} hl {'+' if signs['hh'][2 * i + j] > 0 else '-'} hh) / 2)))::int as fused from x" for i in (0, 1) for j in (0, 1))
    return f"q as (select img, r // 2 as i, c // 2 as j, {four} from t group by all), x as (select img, i, j, {bands} from q)", back


_HAAR = f"with {_T}, {' '.join(_haar())}"
_add("fuse_haar", lambda s, d: fusion.fuse(raster.pixels(_tiles(s, d), "a", "b"), "haar"), _HAAR)
_add("fuse_wavelet_db1", lambda s, d: raster.pixels(wavelet.fuse_wavelet(raster.tile_pairs(_embeddings(s, d)), 1, 1), "fused").withColumn("fused", F.col("fused").cast("int")), _HAAR)
_add("pyramid_steerable", lambda s, d: rounded(_band_energy(steerable.steerable_pyramid(raster.mosaic_pairs(_embeddings(s, d))))))
_add("pyramid_steered", lambda s, d: rounded(_band_energy(steerable.steer(steerable.steerable_pyramid(raster.mosaic_pairs(_embeddings(s, d))), math.pi / 5).withColumn("band", F.lit(None).cast("int")))))



def _steps_sql(sizes: list[int]) -> str:
    """down and up: what halving a line of n pixels, and bringing it back to n, takes from each pixel."""
    ns = ", ".join(f"({n})" for n in sizes)
    return f"""down as (select n, i, case when n = 2 then greatest(0, least(1, q)) else n - 1 - abs(n - 1 - abs(q)) end as p, sum(w) as w
  from (select n, i, 2 * i + t as q, w from (select n, unnest(range(n // 2)) as i from (values {ns}) s(n)) cross join (values (-2, 0.0625::double), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) k(t, w)) group by all),
up as (select n, o, case when q < 0 then least(1, n // 2 - 1) else least(q, n // 2 - 1) end as i, sum(w) as w
  from (select n, o, o // 2 + t as q, w from (select n, unnest(range(n)) as o from (values {ns}) s(n)) join (values (0, -1, 0.125::double), (0, 0, 0.75), (0, 1, 0.125), (1, 0, 0.5), (1, 1, 0.5)) k(odd, t, w) on odd = o % 2) group by all)"""


def _pyramid_sql(sizes: list[int]) -> str:
    """b0, b1, ...: Laplacian bands of x (img, src, r, c, v), and the last low-pass image."""
    parts, g = [_steps_sql(sizes)], "x"
    for k, n in enumerate(sizes):
        low = f"g{k + 1}"
        parts.append(f"{low} as materialized (select img, src, y.i as r, z.i as c, sum(y.w * z.w * v) as v from {g} join down y on y.n = {n} and y.p = r join down z on z.n = {n} and z.p = c group by all)")
        parts.append(f"b{k} as materialized (select {g}.img, {g}.src, {g}.r, {g}.c, {g}.v - u.v as v from {g} join ({_up_sql(low, n)}) u using (img, src, r, c))")
        g = low
    return ", ".join(parts) + f", b{len(sizes)} as (select * from {g})"


def _up_sql(table: str, n: int) -> str:
    return f"select img, src, y.o as r, z.o as c, sum(y.w * z.w * v) as v from {table} join up y on y.n = {n} and y.i = r join up z on z.n = {n} and z.i = c group by all"


def _pyramid_fusion_sql(sizes: list[int]) -> str:
    """fused (img, r, c, v) from the bands of the sources 'a' and 'b'."""
    k = len(sizes)
    parts = [f"f{k} as materialized (select img, 'f' as src, r, c, sum(v) / 2 as v from b{k} group by all)"]
    for i in range(k - 1, -1, -1):
        pick = f"select p.img, p.r, p.c, case when abs(p.v) >= abs(q.v) then p.v else q.v end as v from b{i} p join b{i} q on p.img = q.img and p.r = q.r and p.c = q.c and p.src = 'a' and q.src = 'b'"
        parts.append(f"f{i} as materialized (select u.img, 'f' as src, u.r, u.c, u.v + d.v as v from ({_up_sql(f'f{i + 1}', sizes[i])}) u join ({pick}) d on d.img = u.img and d.r = u.r and d.c = u.c)")
    return ", ".join(parts) + ", fused as (select img, r, c, greatest(0, least(255, v)) as v from f0)"


def _wavelet_sql(n: int, order: int, levels: int) -> str:
    """fused (img, r, c, v) from the sources 'a' and 'b' of x (img, src, r, c, v), images of n x n pixels."""
    taps = [float(t) for t in wavelet.daubechies(order)]
    m = len(taps)
    high = [t * (-1) ** j for j, t in enumerate(taps[::-1])]
    sizes, parts, g = [n], [], "x"
    for _ in range(levels):
        sizes.append((sizes[-1] + m - 1) // 2)
    k = ", ".join(f"({j}, {lo!r}::double, {hi!r}::double)" for j, (lo, hi) in enumerate(zip(taps, high)))
    parts.append(f"k as (select * from (values {k}) k(j, lo, hi))")
    for level, (big, small) in enumerate(zip(sizes, sizes[1:]), 1):
        q = f"1 + j + 2 * i - {m - 1}"
        fold = f"least((({q}) % {2 * big} + {2 * big}) % {2 * big}, {2 * big - 1} - (({q}) % {2 * big} + {2 * big}) % {2 * big})"
        parts.append(f"s{level} as (select i, {fold} as p, sum(lo) as lo, sum(hi) as hi from (select unnest(range({small})) as i) cross join k group by all)")
        parts.append(f"w{level} as materialized (select img, src, y.i as r, z.i as c, sum(y.lo * z.lo * v) as ll, sum(y.lo * z.hi * v) as lh, sum(y.hi * z.lo * v) as hl, sum(y.hi * z.hi * v) as hh from {g} join s{level} y on y.p = r join s{level} z on z.p = c group by all)")
        parts.append(f"l{level} as (select img, src, r, c, ll as v from w{level})")
        g = f"l{level}"
    both = lambda t: f"{t} p join {t} q on p.img = q.img and p.r = q.r and p.c = q.c and p.src = 'a' and q.src = 'b'"
    parts.append(f"f{levels} as (select p.img, p.r, p.c, (p.v + q.v) / 2 as v from {both(f'l{levels}')})")
    for level in range(levels, 0, -1):
        big, small = sizes[level - 1], sizes[level]
        pick = ", ".join(f"case when abs(round(p.{b}, 9)) >= abs(round(q.{b}, 9)) then p.{b} else q.{b} end as {b}" for b in ("lh", "hl", "hh"))
        parts.append(f"t{level} as (select i, 2 * i + j - {m - 2} as o, lo, hi from (select unnest(range({small})) as i) cross join k where 2 * i + j - {m - 2} between 0 and {2 * small - m + 1})")
        # synthesis turns the high-pass taps as analysis has them
        parts.append(f"d{level} as materialized (select p.img, p.r, p.c, f.v as ll, {pick} from {both(f'w{level}')} join f{level} f on f.img = p.img and f.r = p.r and f.c = p.c)")
        parts.append(f"f{level - 1} as materialized (select img, y.o as r, z.o as c, sum(y.lo * z.lo * ll + y.lo * z.hi * lh + y.hi * z.lo * hl + y.hi * z.hi * hh) as v from d{level} join t{level} y on y.i = r join t{level} z on z.i = c where y.o < {big} and z.o < {big} group by all)")
    return ", ".join(parts) + ", fused as (select img, r, c, greatest(0, least(255, v)) as v from f0)"


_TWO = "x as (select img, 'a' as src, r, c, a as v from t union all select img, 'b', r, c, b from t)"
_add("fuse_laplacian", lambda s, d: raster.pixels(pyramid.fuse_laplacian(raster.tile_pairs(_embeddings(s, d)), 2), "fused").withColumn("fused", F.col("fused").cast("int")), f"with {_T}, {_TWO}, {_pyramid_sql([8, 4])}, {_pyramid_fusion_sql([8, 4])} select img, r, c, trunc(v)::int as fused from fused")
_MOSAIC = f"""{_PX}, m as (select vec_id // 64 as m, (vec_id % 64 // 8 * 8 + p // 8)::int as r, (vec_id % 8 * 8 + p % 8)::int as c, v from px), ok as (select m from m group by m having count(*) = 4096),
t as (select x.m // 2 as img, x.r, x.c, x.v as a, y.v as b, greatest(x.v, y.v) as f from m x join m y on x.m // 2 = y.m // 2 and x.r = y.r and x.c = y.c and x.m % 2 = 0 and y.m % 2 = 1 where x.m in (from ok) and y.m in (from ok))"""
_add("fuse_wavelet_db4", lambda s, d: raster.pixels(wavelet.fuse_wavelet(raster.mosaic_pairs(_embeddings(s, d))), "fused"), f"with {_MOSAIC}, {_TWO}, {_wavelet_sql(64, 4, 2)} select img, r, c, trunc(round(v, 9)) as fused from fused")


def _energies(pyr: DataFrame) -> DataFrame:
    """Sides and energy of each band of both sources, from coefficients."""
    return rounded(pyr.groupBy("img", "level", "band").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), *[F.sum(F.col(x) * F.col(x)).alias(f"energy_{x}") for x in "ab"]), 3)


def _energies_sql(parts: dict[tuple[int, int], str]) -> str:
    """The same from one relation (img, src, r, c, v) a band."""
    energy = lambda x: f"round(sum(v * v) filter (src = '{x}'), 3) + 0.0 as energy_{x}"
    return " union all ".join(f"select img, {level} as level, {band} as band, max(r)::int + 1 as h, max(c)::int + 1 as w, {energy('a')}, {energy('b')} from {name} group by img" for (level, band), name in parts.items())


def _image_sql(table: str) -> str:
    """Both sources of (img, src, r, c, v) beside each other."""
    value = lambda x: f"round(sum(v) filter (src = '{x}'), 4) + 0.0 as {x}"
    return f"select img, r, c, {value('a')}, {value('b')} from {table} group by all"


def _image(pyr: DataFrame) -> DataFrame:
    return rounded(pyr.select("img", "r", "c", "a", "b"), 4)


def _two_mosaics(s: SparkSession, d: str) -> DataFrame:
    return bands.from_images(raster.mosaic_pairs(_embeddings(s, d)), "a", "b")


def _laplacian(s: SparkSession, d: str) -> DataFrame:
    return pyramid.laplacian_pyramid(raster.mosaic_pairs(_embeddings(s, d)), "a", "b", levels=4)


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """The images whose second band is half as strong again and whose first is left out."""
    pyr = _laplacian(s, d)
    new = pyr.where("level = 1").select("img", "r", "c", *[(1.5 * F.col(x)).alias(x) for x in "ab"])
    return _image(bands.laplacian_image(bands.set_band(pyr, 1, 0, new), 4, pyramid.UP, levels={1, 2, 3, 4}, whole_grid=True))


_SIZES = [64, 32, 16, 8]
_LAPLACIAN = f"{_MOSAIC}, {_TWO}, {_pyramid_sql(_SIZES)}"
_add("pyramid_laplacian", lambda s, d: _energies(_laplacian(s, d)), f"with {_LAPLACIAN} {_energies_sql({(k, 0): f'b{k}' for k in range(5)})}")
_add("pyramid_rebuilt", lambda s, d: _image(bands.laplacian_image(_laplacian(s, d), 4, pyramid.UP, whole_grid=True)), f"with {_MOSAIC}, {_TWO} {_image_sql('x')}")
_BACK = ", ".join(f"f{k} as materialized (select img, src, r, c, u.v + {('0', '1.5', '1', '1')[k]} * b.v as v from ({_up_sql('b4' if k == 3 else f'f{k + 1}', _SIZES[k])}) u join b{k} b using (img, src, r, c))" for k in (3, 2, 1, 0))
_add("pyramid_band_replaced", _replaced, f"with {_LAPLACIAN}, {_BACK} {_image_sql('f0')}")


def _filters_sql(name: str, filters: list[tuple[list[float], int]], n: int) -> str:
    """Place o of a line halved by filter k takes w of pixel p of a line of n pixels, mirrored at its borders."""
    taps = ", ".join(f"({k}, {i - len(f) // 2 + first}, {tap!r}::double)" for k, (f, first) in enumerate(filters) for i, tap in enumerate(f))
    return f"{name} as materialized (select k, o, {n - 1} - abs({n - 1} - abs(2 * o + d)) as p, sum(w) as w from (select unnest(range({n // 2})) as o) cross join (values {taps}) t(k, d, w) group by all)"


_QMF = named("qmf9")


def _qmf_sql(sizes: list[int]) -> tuple[str, dict[tuple[int, int], str]]:
    parts, names, low = [], {}, "x"
    for i, n in enumerate(sizes):
        parts.append(_filters_sql(f"h{i}", [(_QMF, 0), (convolve.high_from_low(_QMF), 1)], n))
        for band in range(4):
            name = f"q{i + 1}{band}"
            parts.append(f"{name} as materialized (select img, src, y.o as r, z.o as c, sum(y.w * z.w * v) as v from {low} join h{i} y on y.k = {band & 1} and y.p = r join h{i} z on z.k = {band >> 1} and z.p = c group by all)")
            if band or i + 1 == len(sizes):
                names[i + 1, band] = name
        low = f"q{i + 1}0"
    return ", ".join(parts), names


_QMF_PARTS, _QMF_NAMES = _qmf_sql([64, 32, 16])
_add("pyramid_qmf", lambda s, d: _energies(bands.qmf_pyramid(_two_mosaics(s, d), 3, _QMF)), f"with {_MOSAIC}, {_TWO}, {_QMF_PARTS} {_energies_sql(_QMF_NAMES)}")


def _tree(s: SparkSession, d: str) -> DataFrame:
    """How much of a band's strength sits below strong coefficients of the next level."""
    tree = bands.with_parents(bands.qmf_pyramid(_two_mosaics(s, d), 3, _QMF))
    return rounded(tree.groupBy("img", "level", "band").agg(F.count("parent_a").alias("n"), *[F.sum(F.abs(F.col(x)) * F.abs(F.col(f"parent_{x}"))).alias(f"joint_{x}") for x in "ab"]), 3)


def _tree_sql() -> str:
    joint = lambda x: f"round(round(sum(abs(k.v) * abs(p.v)) filter (src = '{x}'), 12), 3) + 0.0 as joint_{x}"
    top = "(select * from q31 where false)"
    return " union all ".join(f"select img, {i} as level, {b} as band, count(p.v) filter (src = 'a') as n, {joint('a')}, {joint('b')} from q{i}{b} k left join (select img, src, r as pr, c as pc, v from {f'q{i + 1}{b}' if i < 3 else top}) p using (img, src) where p.pr is null or (p.pr = k.r // 2 and p.pc = k.c // 2) group by img" for i in (1, 2, 3) for b in (1, 2, 3))


_add("pyramid_wavelet_tree", _tree, f"with {_MOSAIC}, {_TWO}, {_QMF_PARTS} {_tree_sql()}")
_DAUB = named("daub4")
_add("pyramid_qmf_rebuilt", lambda s, d: _image(bands.qmf_image(bands.qmf_pyramid(_two_mosaics(s, d), 3, _DAUB, "circular"), 3, _DAUB, "circular")), f"with {_MOSAIC}, {_TWO} {_image_sql('x')}")


def _kernels_sql(kernels: dict[int, list[list[float]]]) -> str:
    rows = ", ".join(f"({b}, {i - len(k) // 2}, {j - len(k[0]) // 2}, {tap!r}::double)" for b, k in kernels.items() for i, line in enumerate(k) for j, tap in enumerate(line))
    return f"(values {rows}) k(band, dr, dc, tap)"


def _sp1_sql() -> tuple[str, dict[tuple[int, int], str]]:
    """Bands of two levels: every pixel of an image drawn out beyond its borders, times a kernel."""
    out = [f"k0 as materialized (select * from {_kernels_sql({0: SP1.low0, 1: SP1.high0})})", f"k1 as materialized (select * from {_kernels_sql({0: SP1.low, **{b + 1: k for b, k in enumerate(SP1.bands)}})})"]

    def filtered(name: str, table: str, kernels: str, n: int, step: int, band: str) -> None:
        out.append(f"drawn_{name} as materialized (select img, src, y.q as r, z.q as c, v from {table} join m{n} y on y.p = r join m{n} z on z.p = c)")
        there = " and ".join(f"({x} - d{x}) % {step} = 0 and {x} - d{x} between 0 and {n - 1}" for x in "rc")
        out.append(f"{name} as materialized (select img, src, band, (r - dr) // {step} as r, (c - dc) // {step} as c, sum(tap * v) as v from drawn_{name} cross join {kernels} where {band} and {there} group by all)")

    out += [f"m{n} as materialized (select q, {n - 1} - abs({n - 1} - abs(q)) as p from (select unnest(range(-8, {n + 8})) as q))" for n in (64, 32)]
    filtered("first", "x", "k0", 64, 1, "true")
    out.append("l0 as (select * from first where band = 0)")
    names = {(0, 1): "(select * from first where band = 1)"}
    for level, n in ((1, 64), (2, 32)):
        filtered(f"e{level}", f"l{level - 1}", "k1", n, 1, "band > 0")
        filtered(f"l{level}", f"l{level - 1}", "k1", n, 2, "band = 0")
        names |= {(level, b): f"(select * from e{level} where band = {b})" for b in (1, 2)}
    return ", ".join(out), names | {(2, 0): "l2"}


_SP1_PARTS, _SP1_NAMES = _sp1_sql()
_add("pyramid_steerable_spatial", lambda s, d: _energies(bands.steerable_bands(_two_mosaics(s, d), 2, SP1)), f"with {_MOSAIC}, {_TWO}, {_SP1_PARTS} {_energies_sql(_SP1_NAMES)}")

# ------------------------------------------------------------ colour

_RGB = f"{_PX}, k as (select x.vec_id // 3 as img, x.p, x.v as r, y.v as g, z.v as b from px x join px y on y.vec_id = x.vec_id + 1 and y.p = x.p join px z on z.vec_id = x.vec_id + 2 and z.p = x.p where x.vec_id % 3 = 0)"


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    px = _embeddings(spark, d).select(F.floor(F.col("vec_id") / 3).alias("img"), (F.col("vec_id") % 3).alias("k"), raster.grey_levels(F.col("embedding")).alias("px"))
    one = lambda k: F.any_value(F.when(F.col("k") == k, F.col("px")), True)
    rgb = px.groupBy("img").agg(one(0).alias("r"), one(1).alias("g"), one(2).alias("b")).where("r is not null and g is not null and b is not null")
    return rgb.select("img", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "z")).select("img", F.col("p").cast("long").alias("p"), "z.r", "z.g", "z.b")


def _color(to: Callable, names: str, back: Callable | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        k = _rgb(spark, d)
        out = k.select("img", "p", *[x.cast("double").alias(n) for x, n in zip(to(F.col("r"), F.col("g"), F.col("b")), names.split())])
        if back:
            out = out.select("*", *[x.alias(n) for x, n in zip(back(*[F.round(F.col(n), 9) for n in names.split()]), ("r2", "g2", "b2"))])
        return rounded(out, 5)

    return run


_r5 = lambda x, n: f"round(round({x}, 12), 5) + 0.0 as {n}"
_hue = "case when b <= g then acos(greatest(-1, least(1, num / den))) else 2 * pi() - acos(greatest(-1, least(1, num / den))) end"
_nd = "0.5 * ((r - g) + (r - b)) as num, sqrt((r - g) * (r - g) + (r - b) * (g - b)) + 1e-10 as den"
_byte = lambda x: f"trunc(greatest(0, least(255, {x})))::int"
_add("color_ycbcr", _color(color.rgb_to_ycbcr, "Y Cb Cr", color.ycbcr_to_rgb), f"""
with {_RGB}, x as (select img, p, 0.299 * r + 0.587 * g + 0.114 * b as "Y", -0.168736 * r - 0.331264 * g + 0.5 * b + 128 as "Cb", 0.5 * r - 0.418688 * g - 0.081312 * b + 128 as "Cr" from k),
n as (select *, round("Y", 9) as y, round("Cb", 9) - 128 as u, round("Cr", 9) - 128 as v from (select img, p, "Y" as "Y", "Cb" as "Cb", "Cr" as "Cr" from x))
select img, p, {_r5('"Y"', '"Y"')}, {_r5('"Cb"', '"Cb"')}, {_r5('"Cr"', '"Cr"')}, {_byte('round("Y", 9) + 1.402 * v')} as r2, {_byte('round("Y", 9) - 0.344136 * u - 0.714136 * v')} as g2, {_byte('round("Y", 9) + 1.772 * u')} as b2 from (select img, p, "Y", "Cb", "Cr", round("Cb", 9) - 128 as u, round("Cr", 9) - 128 as v from x)""")
_add("color_hsi", _color(color.rgb_to_hsi, "H S I"), f"""
with {_RGB}, n as (select img, p, r / 255 as r, g / 255 as g, b / 255 as b from k), x as (select *, {_nd}, (r + g + b) / 3 as i from n)
select img, p, {_r5(_hue, '"H"')}, {_r5('case when i > 0 then 1 - least(r, g, b) / (i + 1e-10) else 0 end', '"S"')}, {_r5('i', '"I"')} from x""")
_add("color_hsv", _color(color.rgb_to_hsv, "H S V"), f"""
with {_RGB}, n as (select img, p, r / 255 as r, g / 255 as g, b / 255 as b from k), x as (select *, {_nd}, greatest(r, g, b) as v from n)
select img, p, {_r5(_hue, '"H"')}, {_r5('case when v > 0 then (v - least(r, g, b)) / (v + 1e-10) else 0 end', '"S"')}, {_r5('v', '"V"')} from x""")
_lin = lambda x: f"case when {x} <= 0.04045 then {x} / 12.92 else pow(({x} + 0.055) / 1.055, 2.4) end as {x}"
_f = lambda x: f"case when {x} > pow(6.0 / 29, 3) then cbrt({x}) else {x} / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 end"
_xyz = [f"({m[0]} * r + {m[1]} * g + {m[2]} * b)" for m in color.TO_XYZ]
_add("color_lab", _color(color.rgb_to_lab, "L a b"), f"""
with {_RGB}, n as (select img, p, r / 255 as r, g / 255 as g, b / 255 as b from k), l as (select img, p, {_lin('r')}, {_lin('g')}, {_lin('b')} from n),
f as (select img, p, {', '.join(f'{_f(f"({x} / {w})")} as f{i}' for i, (x, w) in enumerate(zip(_xyz, color.WHITE)))} from l)
select img, p, {_r5('116 * f1 - 16', '"L"')}, {_r5('500 * (f0 - f1)', 'a')}, {_r5('200 * (f1 - f2)', 'b')} from f""")

# ------------------------------------------------------------ fusion with a colour image


def _color_images(spark: SparkSession, d: str) -> DataFrame:
    """Tiles: vector 4k in grey, the three after it as red, green and blue."""
    px = _embeddings(spark, d).select(F.floor(F.col("vec_id") / 4).alias("img"), (F.col("vec_id") % 4).alias("k"), raster.grey_levels(F.col("embedding")).alias("px"))
    names = ("grey", "red", "green", "blue")
    four = px.groupBy("img").agg(*[F.any_value(F.when(F.col("k") == k, F.col("px")), True).alias(n) for k, n in enumerate(names)]).dropna()
    return four.withColumns({"h": F.lit(raster.TILE), "w": F.lit(raster.TILE)})


def _grey_and_rgb(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels(_color_images(spark, d), "grey", "red", "green", "blue")


_GREY_RGB = f"{_PX}, k as (select vec_id // 4 as img, (p // 8)::int as r, (p % 8)::int as c, max(v) filter (vec_id % 4 = 0) as a, max(v) filter (vec_id % 4 = 1) as r0, max(v) filter (vec_id % 4 = 2) as g0, max(v) filter (vec_id % 4 = 3) as b0 from px group by vec_id // 4, p having count(*) = 4)"


_HAAR_SIGNS = {"lh": (1, 1, -1, -1), "hl": (1, -1, 1, -1), "hh": (1, -1, -1, 1)}


def _light(space: str) -> str:
    """k with the brightness y (0..255) and the two other channels u and v, which are rounded to 9 places."""
    if space == "ycbcr":
        return "n as (select img, r, c, (r % 2) * 2 + c % 2 + 1 as o, a, 0.299 * r0 + 0.587 * g0 + 0.114 * b0 as y, round(-0.168736 * r0 - 0.331264 * g0 + 0.5 * b0 + 128, 9) - 128 as u, round(0.5 * r0 - 0.418688 * g0 - 0.081312 * b0 + 128, 9) - 128 as v from k)"
    return """z as (select img, r as rr, c as cc, a, r0 / 255 as r, g0 / 255 as g, b0 / 255 as b from k), z2 as (select *, 0.5 * ((r - g) + (r - b)) as num, sqrt((r - g) * (r - g) + (r - b) * (g - b)) + 1e-10 as den, (r + g + b) / 3 as i from z),
n as (select img, rr as r, cc as c, (rr % 2) * 2 + cc % 2 + 1 as o, a, i * 255 as y, round(case when b <= g then acos(greatest(-1, least(1, num / den))) else 2 * pi() - acos(greatest(-1, least(1, num / den))) end, 9) as u, round(case when i > 0 then 1 - least(r, g, b) / (i + 1e-10) else 0 end, 9) as v from z2)"""


def _recolour(space: str) -> str:
    """Red, green and blue from f: brightness l and the channels u and v."""
    if space == "ycbcr":
        return f"select img, r, c, {_byte('l + 1.402 * v')} as red, {_byte('l - 0.344136 * u - 0.714136 * v')} as green, {_byte('l + 1.772 * u')} as blue from f"
    third = 2 * math.pi / 3
    sector = lambda *x: " ".join(f"when u >= {k * third} and u < {(k + 1) * third} then {v}" for k, v in enumerate(x))
    pick = lambda *x: _byte(f"255 * (case {sector(*x)} else 0 end)")
    return f"""select img, r, c, {pick('main', 'low', 'rest')} as red, {pick('rest', 'main', 'low')} as green, {pick('low', 'rest', 'main')} as blue
from (select *, 3 * i - (low + main) as rest from (select *, i * (1 - v) as low, i * (1 + v * cos(turn) / cos({math.pi / 3} - turn)) as main from (select *, l / 255 as i, u - (case {sector(0, third, 2 * third)} end) as turn from f)))"""


def _colour_haar(space: str) -> str:
    """Bands of each 2 x 2 block by signed sums over its places, joined back to the pixels."""
    band = lambda x, s: "sum(" + x + " * [" + ", ".join(map(str, s)) + "][o]) / 2"
    bands = ", ".join(f"case when abs(round({band('a', s)}, 9)) >= abs(round({band('y', s)}, 9)) then {band('a', s)} else {band('y', s)} end as {k}" for k, s in _HAAR_SIGNS.items())
    back = " + ".join(["ll"] + [f"{k} * [{', '.join(map(str, s))}][o]" for k, s in _HAAR_SIGNS.items()])
    return f"""with {_GREY_RGB}, {_light(space)},
b as (select img, r // 2 as i, c // 2 as j, (sum(a) / 2 + sum(y) / 2) / 2 as ll, {bands} from n group by all),
f as (select n.*, round(greatest(0, least(255, ({back}) / 2)), 9) as l from n join b on b.img = n.img and b.i = n.r // 2 and b.j = n.c // 2) {_recolour(space)}"""


def _colour_maximum(space: str) -> str:
    return f"with {_GREY_RGB}, {_light(space)}, f as (select *, round(greatest(a, y), 9) as l from n) {_recolour(space)}"


_add("fuse_color_ycbcr", lambda s, d: fusion.fuse_color(_grey_and_rgb(s, d), "ycbcr"), _colour_haar("ycbcr"))
_add("fuse_color_hsi", lambda s, d: fusion.fuse_color(_grey_and_rgb(s, d), "hsi"), _colour_haar("hsi"))

def _colour_whole(space: str, method: str) -> str:
    """A fusion of whole tiles, grey as source a and brightness as b."""
    if method == "fuzzy":
        return _colour_maximum(space)
    two = "x as (select img, 'a' as src, r, c, a as v from n union all select img, 'b', r, c, y from n)"
    fused = f"{_pyramid_sql([8, 4, 2])}, {_pyramid_fusion_sql([8, 4, 2])}" if method == "laplacian" else _wavelet_sql(8, 4, 2)
    light = _light(space).replace("n as (select", "n as materialized (select")
    fused = re.sub(r"\bf(\d)\b", r"y\1", re.sub(r"\bk as \(", "taps as (", re.sub(r"cross join k\b", "cross join taps", fused)) if method == "wavelet" else fused)
    return f"with {_GREY_RGB}, {light}, {two}, {fused}, f as (select n.*, round(z.v, 9) as l from n join fused z on z.img = n.img and z.r = n.r and z.c = n.c) {_recolour(space)}"


for _space in fusion.SPACES:
    for _method in ("laplacian", "wavelet", "fuzzy"):
        _add(f"fuse_color_{_space}_{_method}", lambda s, d, x=_space, m=_method: raster.pixels(fusion.fuse_color_images(_color_images(s, d), x, m), "red", "green", "blue"), _colour_whole(_space, _method))

# ------------------------------------------------------------ cohort and reports


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    side = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("image_date"), F.date_format("ts", "yyyy-MM").alias("image_visit"), "event_id")
    return cohort.match_by_date(side("view"), side("purchase"))


_COHORT = """
with m as (select user_id as subject_id, ts::date as d, strftime(ts, '%Y-%m') as v, event_id from events where event_type = 'view'),
p as (select user_id as subject_id, ts::date as d, strftime(ts, '%Y-%m') as v, event_id from events where event_type = 'purchase'),
j as (select m.subject_id, m.d as image_date_mri, p.d as image_date_pet, abs(date_diff('day', p.d, m.d))::int as date_diff_days, m.v = p.v as visit_match, m.v as image_visit_mri, m.event_id as event_id_mri, p.v as image_visit_pet, p.event_id as event_id_pet
from m join p on m.subject_id is not distinct from p.subject_id where abs(date_diff('day', p.d, m.d)) <= 7 and m.v = p.v)
"""
_add("cohort_band_join", _cohort, _COHORT + "select * from j")
_add("cohort_distribution", lambda s, d: cohort.distribution(_cohort(s, d).withColumn("days", F.col("date_diff_days")), "days"), _COHORT + "select date_diff_days as days, count(*) as n from j group by all")


def _fused_by_method(pairs: DataFrame, laplacian: bool = False) -> DataFrame:
    """(Model, ImageName, h, w, a, b, f): the pairs fused by every method."""
    pca = raster.image_rows(fusion.pca(raster.pixels(pairs, "a", "b")), "fused").select("img", F.col("fused").alias("f"))
    by = {
        "fuzzy": raster.with_fused(pairs),
        "haar": pairs.join(wavelet.fuse_wavelet(pairs, 1, 1).select("img", F.col("fused").alias("f")), "img"),
        "pca": pairs.join(pca, "img"),
    }
    if laplacian:
        by["laplacian"] = pairs.join(pyramid.fuse_laplacian(pairs).select("img", F.col("fused").alias("f")), "img")
    return reduce(DataFrame.union, [x.select(F.lit(k).alias("Model"), F.format_string("%d.png", "img").alias("ImageName"), "h", "w", "a", "b", "f") for k, x in by.items()])


def _tile_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.evaluate(_fused_by_method(raster.tile_pairs(_embeddings(spark, d))), windows=()))


def _scores_sql() -> str:
    """scores: the SQL of each metric over the pixels of every method, as one table."""
    on_t0 = lambda sql: re.sub(r"\bfrom t\b", "from t0", sql)
    base = _T.replace(" t as (", " t0 as materialized (")
    models = {"fuzzy": "select img, r, c, f as fused from t0", "haar": on_t0(_haar()[1]), "pca": on_t0(_PCA[1])}
    union = " union all ".join(f"select '{k}' as model, * from ({v})" for k, v in models.items())
    metrics = [ORACLES[f"metric_{k}"].strip().removeprefix(f"with {_T}") for k in ("information", "moments", "correlation", "sf", "ag", "qabf")]
    parts = ", ".join(f"m{i} as (with one as (select 1) {sql})" for i, sql in enumerate(metrics))
    joins = "m0 " + " ".join(f"join m{i} using (img)" for i in range(1, len(metrics)))
    t = f"t as materialized (select u.model || '/' || u.img as img, u.r, u.c, t0.a, t0.b, u.fused::double as f from ({union}) u join t0 on u.img = t0.img and u.r = t0.r and u.c = t0.c)"
    columns = ", ".join(f'"{c}"' for c in evaluate.COLUMNS if c not in evaluate.WINDOWED)
    return f"with {base}, {on_t0(_haar()[0])}, {on_t0(_PCA[0])}, {t}, {parts}, scores as (select split_part(img, '/', 1) as \"Model\", split_part(img, '/', 2) || '.png' as \"ImageName\", {columns} from {joins})"


_SCORES = _scores_sql()
_SCORED = [c for c in evaluate.COLUMNS if c not in evaluate.WINDOWED]
_means = ", ".join(f'round(round(avg("{c}"), 12), 7) + 0.0 as "{c}"' for c in _SCORED)
_add("evaluate_tiles", _tile_scores, f"{_SCORES} select * from scores")
_add("evaluate_mosaics", lambda s, d: rounded(evaluate.report_rows(_fused_by_method(raster.mosaic_pairs(_embeddings(s, d)), laplacian=True))))
_add("report_average", lambda s, d: rounded(report.with_average(_tile_scores(s, d), _SCORED), 7), f"{_SCORES} select * from scores union all select \"Model\", 'AVERAGE', {_means} from scores group by \"Model\"")
_add("report_summary", lambda s, d: rounded(report.summary(_tile_scores(s, d), _SCORED), 7), f"{_SCORES} select \"Model\", {_means} from scores group by \"Model\"")

# ------------------------------------------------------------ filters and point operations


def _values(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels(_tiles(spark, d), "f").withColumnRenamed("f", "v")


_KERNEL = [[1.0, 2.0, -1.0, 3.0], [0.5, -2.0, 4.0, 1.0], [2.0, 0.0, 1.0, -1.0]]
_SMALL = [[0.25, 0.5, 0.25], [0.5, 1.0, 0.5], [0.25, 0.5, 0.25]]
_FOLD = {
    "reflect1": lambda i: f"(7 - abs(7 - ((({i}) % 14 + 14) % 14)))",
    "reflect2": lambda i: f"least((({i}) % 16 + 16) % 16, 15 - (({i}) % 16 + 16) % 16)",
    "circular": lambda i: f"((({i}) % 8 + 8) % 8)",
    "repeat": lambda i: f"least(7, greatest(0, {i}))",
    "zero": lambda i: f"({i})",
}


def _corr_sql(edges: str) -> str:
    taps = ", ".join(f"({i - 1}, {j - 2}, {w})" for i, row in enumerate(_KERNEL) for j, w in enumerate(row))
    fold = _FOLD[edges]
    return f"""select '{edges}' as edges, o.img, (o.r - 1) // 2 as r, o.c, round(coalesce(sum(k.w * t.v), 0), 6) + 0.0 as v from (select img, r, c from p where r % 2 = 1) o
cross join (values {taps}) k(i, j, w) left join p t on t.img = o.img and t.r = {fold('o.r + k.i')} and t.c = {fold('o.c + k.j')} group by o.img, o.r, o.c"""


_P = f"{_T}, p as (select img, r, c, f as v from t)"
_add(
    "filter_corr_down",
    lambda s, d: rounded(reduce(DataFrame.union, [convolve.corr_down(_values(s, d), _KERNEL, e, (2, 1), (1, 0)).select(F.lit(e).alias("edges"), "img", "r", "c", "v") for e in _FOLD])),
    f"with {_P} " + " union all ".join(map(_corr_sql, _FOLD)),
)
_add("filter_up_conv", lambda s, d: rounded(convolve.up_conv(_values(s, d), _SMALL, "reflect1", (2, 2))), f"""
with {_P}, o as (select img, gr.range::int as r, gc.range::int as c from (select distinct img from p) cross join range(16) gr cross join range(16) gc),
k as (select * from (values {', '.join(f'({1 - i}, {1 - j}, {w})' for i, row in enumerate(_SMALL) for j, w in enumerate(row))}) k(i, j, w))
select o.img, o.r, o.c, round(coalesce(sum(k.w * p.v), 0), 6) + 0.0 as v from o cross join k left join p on p.img = o.img and 2 * p.r = 15 - abs(15 - abs(o.r + k.i)) and 2 * p.c = 15 - abs(15 - abs(o.c + k.j)) group by o.img, o.r, o.c""")
_add("filter_gradient", lambda s, d: rounded(convolve.gradient(_values(s, d))), f"""
with {_P}, k as (select i - 2 as i, j - 2 as j, {list(convolve.SMOOTH)}[i + 1] * {list(convolve.SLOPE)}[j + 1] as x, {list(convolve.SLOPE)}[i + 1] * {list(convolve.SMOOTH)}[j + 1] as y from (select unnest(range(5)) as i) cross join (select unnest(range(5)) as j))
select o.img, o.r, o.c, case when o.r between 2 and 5 and o.c between 2 and 5 then round(sum(k.x * p.v), 6) + 0.0 else 0 end as dx, case when o.r between 2 and 5 and o.c between 2 and 5 then round(sum(k.y * p.v), 6) + 0.0 else 0 end as dy
from p o cross join k left join p on p.img = o.img and p.r = o.r + k.i and p.c = o.c + k.j group by o.img, o.r, o.c""")
_add("filter_box", lambda s, d: rounded(convolve.box(_values(s, d), 3)), f"""
with {_P} select o.img, o.r, o.c, round(sum(p.v) / 9, 6) + 0.0 as v from p o cross join range(-1, 2) i cross join range(-1, 2) j join p on p.img = o.img and p.r = {_FOLD['repeat']('o.r + i.range')} and p.c = {_FOLD['repeat']('o.c + j.range')} group by o.img, o.r, o.c""")
_TABLE = [0.0, 40.0, 45.0, 200.0, 250.0]
_add("point_look_up", lambda s, d: rounded(points.point_op(_values(s, d), _TABLE, 20.0, 50.0)), f"""
with {_P}, x as (select img, r, c, (v - 20) / 50 as u, greatest(0, least(3, floor((v - 20) / 50)))::int as i from p) select img, r, c, round({_TABLE}[i + 1] + (u - i) * ({_TABLE}[i + 2] - {_TABLE}[i + 1]), 6) + 0.0 as v from x""")
_add("stats_entropy", lambda s, d: rounded(points.entropy(_values(s, d), bins=16)), f"""
with {_P}, m as (select img, (max(v) - min(v)) / 16 as width, avg(v) as mean from p group by img), h as (select img, round((v - mean) / nullif(width, 0)) as k, count(*)::double as n from p join m using (img) group by all)
select img, {_r(_H, 'entropy')} from h group by img""")
_add("stats_difference", lambda s, d: rounded(points.difference_stats(raster.pixels(_tiles(s, d), "a", "f"), "a", "f")), f"""
with {_T}, m as (select img, min(a - f) as lo, max(a - f) as hi, avg(a - f) as mean, var_samp(a - f) as v, var_samp(a) as w from t group by img)
select img, lo, hi, {_r('mean', 'mean')}, {_r('sqrt(v)', 'sd')}, case when v < 2.3e-308 then 'inf'::double when w > 0 then round(10 * log10(w / v), 6) + 0.0 else '-inf'::double end as snr from m""")
_add("stats_median", lambda s, d: points.median(_values(s, d)), f"with {_P} select img, median(v) as median from p group by img")

# ------------------------------------------------------------ statistics and synthetic images

_add("stats_image", lambda s, d: rounded(stats.image_stats(raster.pixels(_tiles(s, d), "a", "b", "f"))), f"""
with {_T}, m as (select img, min(f) as lo, max(f) as hi, avg(f) as mean, var_samp(f) as var from t group by img), k as (select img, avg(pow(f - mean, 3)) as m3, avg(pow(f - mean, 4)) as m4 from t join m using (img) group by img)
select img, lo, hi, {_r('mean', 'mean')}, {_r('var', 'var')}, {_r('m3 / pow(nullif(var, 0), 1.5)', 'skew')}, {_r('m4 / pow(nullif(var, 0), 2)', 'kurt')} from m join k using (img)""")
_add("stats_histogram", lambda s, d: stats.histogram(raster.pixels(_tiles(s, d), "a", "b", "f"), "f", 4.0), f"with {_T} select img, floor(f / 4.0 + 0.5) * 4.0 as centre, count(*) as n from t group by all")
_add("stats_blocks", lambda s, d: rounded(stats.block_mean(raster.pixels(_mosaics(s, d), "f"), "f")), f"with {_MOSAIC} select img, r // 16 as \"R\", c // 16 as \"C\", {_r('sum(f) / 256', 'mean')} from t group by all")
_add("stats_channels", lambda s, d: rounded(stats.channel_stats(raster.pixels(_tiles(s, d), "a", "b"), "a", "b")), f"""
with {_T} select img, {', '.join(f'min({x}) as min_{x}, max({x}) as max_{x}, ' + _r(f'avg({x})', f'mean_{x}') + ', ' + _r(f'stddev_pop({x})', f'sd_{x}') for x in 'ab')} from t group by img""")

_SAMPLED = 1000
_add("stats_sample_union", lambda s, d: stats.sample_union(raster.pixels(_tiles(s, d), "a", "b", "f"), _SAMPLED), f"""
with {_T} select img, r, c, a, b, f from t qualify row_number() over (partition by img order by md5('42:' || img || ':' || r || ':' || c), r, c) <= greatest(1, {_SAMPLED} // (select count(distinct img) from t))""")
_add("stats_percentile_range", lambda s, d: rounded(points.percentile_range(raster.pixels(_tiles(s, d), "a", "b", "f"), "f")), f"""
with {_T}, m as (select img, (max(f) - min(f)) / 101.0::double as width, avg(f) as middle from t group by img), k as (select img, width, middle, coalesce(round((f - middle) / nullif(width, 0)), 0) as k, count(*) as n from t join m using (img) group by all),
u as (select *, sum(n) over (partition by img order by k) as upto from k), e as (select img, {', '.join(f"max(middle + width * (k - 0.5 + (64 * {q}::double - upto + n) / n)) filter (upto - n < 64 * {q}::double and upto >= 64 * {q}::double) as {x}" for x, q in (('p', 0.1), ('q', 0.9)))} from u group by img),
h as (select img, (p + q) / 2 as mid, case when (q - p) / 0.8::double > 2.220446049250313e-16 then (q - p) / 2 / 0.8::double else 0.5 end as half from e) select img, {_r('mid - half', 'lo')}, {_r('mid + half', 'hi')} from h""")

_GRID = "with g as (select (range // 48)::int as r, (range % 48)::int as c, range % 48 + 1 - 24.5 as x, range // 48 + 1 - 16.5 as y from range(32 * 48))"


def _soft(x: str, width: float, position: float, left: float, right: float) -> str:
    """A raised-cosine step, linear between the samples of its table."""
    at = f"(129 + 256 * ({x} - {position}) / {width})"
    i = f"greatest(0, least(257, floor({at})))"
    y = lambda k: f"({left} + {right - left} * pow(cos(pi() / 512 * (greatest(1, least({k}, 257)) - 257)), 2))"
    return f"{y(i)} + greatest(0, least(1, {at} - {i})) * ({y(f'({i} + 1)')} - {y(i)})"


_WAVE = f"(x * {2 * math.pi / 7 * math.cos(0.4)} + y * {2 * math.pi / 7 * math.sin(0.4)} + 0.1 + pi() / 2)"
for _name, _run, _sql in (
    ("ramp", lambda s: synth.ramp(s, 32, 48, 0.5, 2.0, 3.0), f"x * {2 * math.cos(0.5)} + y * {2 * math.sin(0.5)} + 3.0"),
    ("radius", lambda s: synth.radius(s, 32, 48, 1.5), "pow(x * x + y * y, 0.75)"),
    ("angle", lambda s: synth.angle(s, 32, 48, 0.3), "((atan2(y, x) + pi() - 0.3) - 2 * pi() * floor((atan2(y, x) + pi() - 0.3) / (2 * pi()))) - pi()"),
    ("disc", lambda s: synth.disc(s, 32, 48, 9.0), "case when x * x + y * y <= 81 then 1.0::double else 0.0::double end"),
    ("disc_soft", lambda s: synth.disc(s, 32, 48, 9.0, 2.0, 3.0, -1.0), _soft("sqrt(x * x + y * y)", 2.0, 9.0, 3.0, -1.0)),
    ("gaussian_covariance", lambda s: synth.gaussian(s, 32, 48, ((30.0, 5.0), (5.0, 12.0))), f"exp((30.0 * x * x - 10.0 * x * y + 12.0 * y * y) / -670.0) / (2 * pi() * {math.sqrt(335.0)})"),
    ("square", lambda s: synth.square(s, 32, 48, 7.0, 0.4, 2.0, 0.1), _soft(f"abs({_WAVE} - 2 * pi() * floor({_WAVE} / (2 * pi())) - pi())", 4 * math.pi / 7, math.pi / 2, -2.0, 2.0)),
    ("angular_sine", lambda s: synth.angular_sine(s, 32, 48, 3.0, 2.0, 0.3), "2.0 * sin(3.0 * (((atan2(y, x) + pi() - 0.3) - 2 * pi() * floor((atan2(y, x) + pi() - 0.3) / (2 * pi()))) - pi()) + 0.3)"),
    ("gaussian", lambda s: synth.gaussian(s, 32, 48, 30.0), "exp(-(x * x + y * y) / 60.0) / (60.0 * pi())"),
    ("zone_plate", lambda s: synth.zone_plate(s, 32, 48), "cos(pi() / 48 * (x * x + y * y))"),
    ("sine", lambda s: synth.sine(s, 32, 48, 7.0, 0.4), f"sin(2 * pi() / 7 * ({math.cos(0.4)} * c + {math.sin(0.4)} * r))"),
    ("impulse", lambda s: synth.impulse(s, 32, 48), "case when r = 16 and c = 24 then 1.0::double else 0.0::double end"),
):
    _add(f"synth_{_name}", lambda s, d, f=_run: rounded(f(s)), f"{_GRID} select r, c, round(({_sql})::double, 6) + 0.0 as v from g")
