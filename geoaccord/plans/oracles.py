"""SQL of the registered queries for another engine, over the same tables."""

from __future__ import annotations

import math

from geoaccord.fixtures import fixture_sql
from geoaccord.functions import projection as P
from geoaccord.operators.weighted import KERNELS
from geoaccord.pairs import pairs
from geoaccord.plans.file_queries import ORACLE_SQL as FILE_SQL
from geoaccord.plans.queries import BANDWIDTH, FIELDS, MAPPING, NEIGHBOURS, SMOOTHING, SWEEP

S, G, CAT = fixture_sql("sites"), fixture_sql("grid"), fixture_sql("catalog")
WHOLE = f"(select * from {S} where v_a is not null and v_b is not null and v_c is not null)"


def long(source: str, keep: str = "", fields=FIELDS) -> str:
    keep = keep + ", " if keep else ""
    return "(" + " union all ".join(f"select {keep}'{p.key}' as pair_key, '{p.label}' as pair_label, {p.y} as y, {p.x} as x from {source}" for p in pairs(list(fields))) + ")"


def weights(kernel: str, bandwidth: str) -> str:
    q = f"(d / {bandwidth})"
    return {"bisquare": f"case when {q} < 1 then pow(1 - {q} * {q}, 2) else 0 end", "gaussian": f"exp(-0.5 * {q} * {q})", "exponential": f"exp(-{q})"}[kernel]


def near(kernel: str, bandwidth: float, name: str = "nb") -> str:
    """i, j, d, w and the fields of both ends."""
    reach = bandwidth * KERNELS[kernel][1]
    return f"""s as materialized {WHOLE}, m as (select a.feature_id as i, b.feature_id as j, {', '.join(f'a.{f} as i_{f}, b.{f} as j_{f}' for f in FIELDS)},
  sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) as d from s a, s b),
  {name} as (select *, {weights(kernel, repr(bandwidth))} as w from m where d <= {reach!r})"""


def sums(rows: str = "nb", by: str = "i") -> str:
    parts = [f"select {by}, j, w, '{p.key}' as pair_key, j_{p.y} as y, j_{p.x} as x, i_{p.y} as yi, i_{p.x} as xi from {rows} where w > 0" for p in pairs(FIELDS)]
    return f"""l as ({' union all '.join(parts)}), t as (select {by}, pair_key, max(yi) as yi, max(xi) as xi, sum(w) as s0, sum(w * w) as q0, sum(case when i = j then w end) as wii,
  sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy, sum(w * y * y) as syy, sum(w * w * x) as qx, sum(w * w * x * x) as qxx,
  sum(w * (y - x)) as e1, sum(w * abs(y - x)) as e2, sum(w * (y - x) * (y - x)) as e3, sum(case when x <> 0 then w * abs(y - x) / x end) as e4 from l group by {by}, pair_key)"""


FIT = """f as (select *, (s0 * sxy - sx * sy) / det as slope, (sxx * sy - sx * sxy) / det as intercept, wii * ((sxx - sx * xi) + (s0 * xi - sx) * xi) / det as s_ii,
  (pow(sxx - sx * xi, 2) * q0 + 2 * (sxx - sx * xi) * (s0 * xi - sx) * qx + pow(s0 * xi - sx, 2) * qxx) / (det * det) as s_sq
  from (select *, case when s0 * sxx - sx * sx > 0 then s0 * sxx - sx * sx end as det from t)),
  fit as (select *, intercept + slope * xi as yhat, yi - (intercept + slope * xi) as residual from f)"""


def diagnosed(by: str = "pair_key") -> str:
    return f"""dg as (select *, 1 - rss / tss as r2, n - 2 * tr_s + tr_ss as edf, n * ln(rss / n) + n * ln(2 * pi()) + n * (n + tr_s) / (n - 2 - tr_s) as aicc, sqrt(rss / n) as residual_rmse
  from (select {by}, count(*) as n, sum(residual * residual) as rss, count(*) * var_pop(yi) as tss, sum(s_ii) as tr_s, sum(s_sq) as tr_ss from fit group by {by}))"""


ZERO = f"z as (select pair_key, max(case when x = 0 then 1 else 0 end) as zero from {long('s', fields=FIELDS)} group by pair_key)"
LOCAL = "select i as feature_id, t.pair_key, round(e1 / s0 + 1.2345e-7, 4) as lme, round(e2 / s0 + 1.2345e-7, 4) as lmae, round(case when zero = 0 then e4 / s0 end + 1.2345e-9, 6) as lmre, round(sqrt(greatest(0, e3 / s0)) + 1.2345e-7, 4) as lrmse from t join z on t.pair_key = z.pair_key"


def local_error(kernel: str, bandwidth: float) -> str:
    return f"with {near(kernel, bandwidth)}, {sums()}, {ZERO} {LOCAL}"


_ADAPTIVE = f"""with s as materialized {WHOLE}, m as (select a.feature_id as i, b.feature_id as j, {', '.join(f'a.{f} as i_{f}, b.{f} as j_{f}' for f in FIELDS)},
  sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) as d from s a, s b), k as (select i, d as b from (select i, d, row_number() over (partition by i order by d, j) as rn from m) where rn = {NEIGHBOURS}),
  nb as (select m.*, {weights('bisquare', 'k.b')} as w from m join k on m.i = k.i), {sums()}, {ZERO} {LOCAL}"""

_SWEPT = f"""{near('bisquare', max(SWEEP), 'widest')}, bw as (select unnest([{', '.join(map(repr, SWEEP))}]) as bandwidth),
  nb as (select m.*, bandwidth, {weights('bisquare', 'bandwidth')} as w from m, bw where d <= bandwidth), {sums('nb', 'bandwidth, i')}, {FIT}, {diagnosed('bandwidth, pair_key')}"""


def _layer(name: str, side: int) -> str:
    values = ", ".join(f"('{m[side]}', '{m[2]}')" for m in MAPPING)
    return f"(select p.*, minx + w as maxx, miny + h as maxy, w * h as area, 2 * (w + h) as perimeter, minx + w / 2 as cx, miny + h / 2 as cy, label from {fixture_sql(name)} p join (values {values}) t(value, label) on p.category = t.value)"


CANDIDATES = f"""a as materialized {_layer('poly_a', 0)}, b as materialized {_layer('poly_b', 1)},
  cand as materialized (select *, inter / (a_area + b_area - inter) as iou from (select a.label, a.feature_id as a_id, b.feature_id as b_id, a.area as a_area, b.area as b_area,
  (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) as inter
  from a join b on a.label = b.label and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy) where inter > 0)"""


def greedy_rounds(rounds: int = 8) -> str:
    """Rounds of edges that come first at both ends; the rounds suffice for the test tables (no edge is left)."""
    out = [f"{CANDIDATES}, e0 as materialized (select label, a_id, b_id, inter, iou from cand where iou >= 0.1)"]
    for k in range(rounds):
        out.append(f"""w{k} as materialized (select label, a_id, b_id, inter, iou from (select *, row_number() over (partition by label, a_id order by iou desc, inter desc, a_id, b_id) as ra,
  row_number() over (partition by label, b_id order by iou desc, inter desc, a_id, b_id) as rb from e{k}) where ra = 1 and rb = 1),
  e{k + 1} as materialized (select * from e{k} where not exists (select 1 from w{k} where w{k}.label = e{k}.label and w{k}.a_id = e{k}.a_id) and not exists (select 1 from w{k} where w{k}.label = e{k}.label and w{k}.b_id = e{k}.b_id))""")
    return ", ".join(out) + ", g as materialized (" + " union all ".join(f"select * from w{k}" for k in range(rounds)) + ")"


THRESHOLDS = "th as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as threshold)"
MEASURED = f"""{greedy_rounds()}, {THRESHOLDS}, me as materialized (select threshold, g.label, g.a_id, g.b_id, inter / (a.area + b.area - inter) as polygon_iou, (b.area - a.area) / a.area as area_error, abs(b.area - a.area) / a.area as area_abs_error,
  sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) as centroid_distance, abs(b.perimeter - a.perimeter) / a.perimeter as perimeter_error, (a.cx + b.cx) / 2 as px, (a.cy + b.cy) / 2 as py
  from g join a on a.feature_id = g.a_id and a.label = g.label join b on b.feature_id = g.b_id and b.label = g.label join th on iou >= threshold),
  tot as (select label, sum(ia) as a_total, sum(ib) as b_total from (select label, 1 as ia, 0 as ib from a union all select label, 0, 1 from b) group by label)"""


def _summary(by: str, source: str, median: str) -> str:
    return f"""select {by}, cast(a_total as bigint) as a_total, cast(b_total as bigint) as b_total, matched, round(mean_iou, 6) as mean_iou, round({median}, 6) as median_iou, round(mc, 4) as median_centroid_distance, round(ma, 6) as median_area_error,
  round(mp, 6) as median_perimeter_error, round(matched / a_total, 6) as a_rate, round(matched / b_total, 6) as b_rate, round(2 * matched / (a_total + b_total), 6) as balanced_rate,
  round(case when 2 * matched / (a_total + b_total) + coalesce(mi, 0) > 0 then 2 * (2 * matched / (a_total + b_total)) * coalesce(mi, 0) / (2 * matched / (a_total + b_total) + coalesce(mi, 0)) else 0 end, 6) as tradeoff
  from (select {by}, a_total, b_total, count(a_id) as matched, avg(polygon_iou) as mean_iou, median(polygon_iou) as mi, median(centroid_distance) as mc, median(area_abs_error) as ma, median(perimeter_error) as mp from {source} group by {by}, a_total, b_total)"""


_CATEGORY = "(select tot.label, th.threshold, a_total, b_total, a_id, polygon_iou, centroid_distance, area_abs_error, perimeter_error from tot cross join th left join me on me.label = tot.label and me.threshold = th.threshold)"
_OVERALL = "(select th.threshold, a_total, b_total, a_id, polygon_iou, centroid_distance, area_abs_error, perimeter_error from (select sum(a_total) as a_total, sum(b_total) as b_total from tot) cross join th left join me on me.threshold = th.threshold)"


def _smoothed(bandwidths) -> str:
    w = "exp(-(d * d) / (2 * bandwidth * bandwidth))"
    return f"""with {MEASURED}, mm as (select * from me where threshold = 0.3), bw as (select unnest([{', '.join(map(repr, bandwidths))}]) as bandwidth),
  sm as (select bandwidth, i as source_id, sum(w * area_error) / sum(w) as gw_area_me, sum(w * area_abs_error) / sum(w) as gw_area_mae, sqrt(sum(w * area_error * area_error) / sum(w)) as gw_area_rmse, sum(w * polygon_iou) / sum(w) as gw_iou,
  sum(w * centroid_distance) / sum(w) as gw_centroid, sum(w * perimeter_error) / sum(w) as gw_perimeter, count(*) as neighbours from (select *, {w} as w from (select x.a_id as i, y.*, sqrt((x.px - y.px) * (x.px - y.px) + (x.py - y.py) * (x.py - y.py)) as d from mm x, mm y) q, bw where d <= 3 * bandwidth) group by bandwidth, i)"""


def _focal(size: int) -> str:
    h = size // 2
    names = "n sx sy sxx syy sxy sd sa sdd sr nr".split()
    values = ["1.0", "x", "y", "x * x", "y * y", "x * y", "y - x", "abs(y - x)", "(y - x) * (y - x)", "case when abs(y) > 1e-12 then abs((y - x) / y) end", "case when abs(y) > 1e-12 then 1.0 end"]
    first = ", ".join(f"coalesce(case when ok then {v} end, 0)::double as {n}" for n, v in zip(names, values))
    row = ", ".join(f"sum({n}) over (partition by r order by c range between {h} preceding and {h} following) as {n}" for n in names)
    col = ", ".join(f"sum({n}) over (partition by c order by r range between {h} preceding and {h} following) as {n}" for n in names)
    return f"""(select r, c, cast(n as bigint) as n, case when n > 0 then sd / n end as local_me, case when n > 0 then sa / n end as local_mae, case when nr > 0 then sr / nr end as local_mre, case when n > 0 then sqrt(greatest(0, sdd / n)) end as local_rmse,
  case when n >= 3 and sxx - sx * sx / n > 1e-12 and syy - sy * sy / n > 1e-12 then greatest(-1, least(1, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))) end as local_corr,
  case when n >= 2 and sxx > 1e-12 then sxy / sxx end as coefficient,
  case when n >= 2 and sxx > 1e-12 and syy > 1e-12 then greatest(0, least(1, 1 - (syy - 2 * (sxy / sxx) * sxy + (sxy / sxx) * (sxy / sxx) * sxx) / syy)) end as local_r2
  from (select r, c, {col} from (select r, c, {row} from (select r, c, {first} from (select r, c, left_v as y, right_v as x, left_v is not null and right_v is not null as ok from {G}))))) """


def _resample(method: str) -> str:
    if method == "near":
        offsets, place = [(0, 0, "1.0")], ("floor(r + 0.5 + 0.5)", "floor(c + 0.25 + 0.5)")
    else:
        place = ("floor(r + 0.5)", "floor(c + 0.25)")
        if method == "bilinear":
            one = lambda f: [(0, 1 - f), (1, f)]
        else:
            a = -0.5
            n, w = (lambda t: ((a + 2) * t - (a + 3)) * t * t + 1), (lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a)
            one = lambda f: [(-1, w(f + 1)), (0, n(f)), (1, n(1 - f)), (2, w(2 - f))]
        offsets = [(p, q, repr(float(u * v))) for p, u in one(0.5) for q, v in one(0.25)]
    values = ", ".join(f"({p}, {q}, {w}::double)" for p, q, w in offsets)
    return f"""with g as {G} select t.r, t.c, round(case when abs(sum(case when s.right_v is not null then w end)) > 1e-12 then sum(w * s.right_v) / sum(case when s.right_v is not null then w end) end, 8) as value
  from (select r, c, cast({place[0]} as int) + p as sr, cast({place[1]} as int) + q as sc, w from g, (values {values}) o(p, q, w)) t left join g s on s.r = t.sr and s.c = t.sc group by t.r, t.c"""


def _classes(breaks: str) -> str:
    return f"with v as (select p_partkey, p_retailprice::double as v from part), b as ({breaks}) select p_partkey, cast(least(greatest(len(list_filter(breaks, lambda x: x <= v)) - 1, 0), len(breaks) - 2) as int) as class_id from v, b"


def _albers(lon0=105.0, lat0=0.0, lat1=25.0, lat2=47.0) -> str:
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    m1, m2, q0, q1, q2 = P._m_number(p1), P._m_number(p2), P._q_number(p0), P._q_number(p1), P._q_number(p2)
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return f"""select c_custkey, round(rho * sin(th), 2) as x, round({P.A * math.sqrt(c - n * q0) / n!r}::double - rho * cos(th), 2) as y from (select c_custkey, {P.A!r}::double * sqrt({c!r}::double - {n!r}::double * {1 - P.E2!r}::double * (s / (1 - {P.E2!r}::double * s * s) - ln((1 - {P.E1!r}::double * s) / (1 + {P.E1!r}::double * s)) / {2 * P.E1!r}::double)) / {n!r}::double as rho,
  {n!r}::double * radians(110 + (c_custkey % 97) / 16.0::double - {lon0!r}::double) as th from (select c_custkey, sin(radians(20 + (c_custkey % 89) / 4.0::double)) as s from customer))"""


def _utm(zone=50) -> str:
    n = P.FLAT / (2 - P.FLAT)
    radius = P.A / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    sh, ch = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)")
    east = "eta + " + " + ".join(f"{a!r}::double * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1))
    north = "xi + " + " + ".join(f"{a!r}::double * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1))
    return f"""select c_custkey, round(500000 + {0.9996 * radius!r}::double * ({east}), 2) as x, round({0.9996 * radius!r}::double * ({north}), 2) as y from (select c_custkey, atan2(t, cos(dl)) as xi, 0.5 * ln((1 + sin(dl) / sqrt(1 + t * t)) / (1 - sin(dl) / sqrt(1 + t * t))) as eta from
  (select *, {sh('u')} as t from (select c_custkey, dl, 0.5 * ln((1 + s) / (1 - s)) - {k!r}::double * 0.5 * ln((1 + {k!r}::double * s) / (1 - {k!r}::double * s)) as u from (select c_custkey, sin(radians(20 + (c_custkey % 89) / 4.0::double)) as s, radians(110 + (c_custkey % 97) / 16.0::double - {6 * zone - 183}) as dl from customer))))"""


def _l_overlap(a: str, b: str) -> str:
    """Overlap of two L-shapes: each is a rectangle less its upper right quarter, so sums of rectangle overlaps."""
    def box(t, upper):
        x1 = f"({t}.minx + ({t}.maxx - {t}.minx) / 2)" if upper else f"{t}.minx"
        y1 = f"({t}.miny + ({t}.maxy - {t}.miny) / 2)" if upper else f"{t}.miny"
        return x1, y1, f"{t}.maxx", f"{t}.maxy"

    def meet(p, q):
        return f"(greatest(0, least({p[2]}, {q[2]}) - greatest({p[0]}, {q[0]})) * greatest(0, least({p[3]}, {q[3]}) - greatest({p[1]}, {q[1]})))"

    return " ".join(f"{sign} {meet(box(a, u), box(b, v))}" for sign, u, v in (("", False, False), ("-", True, False), ("-", False, True), ("+", True, True)))


def _l_measures(t: str) -> str:
    """Area, perimeter and centroid of the L-shape in a rectangle."""
    return f"{t}.area * 0.75 as {t}_area, {t}.perimeter as {t}_perimeter, {t}.minx + ({t}.maxx - {t}.minx) * 5 / 12 as {t}_cx, {t}.miny + ({t}.maxy - {t}.miny) * 5 / 12 as {t}_cy"


def _l_summary() -> str:
    measured = f"""{greedy_rounds()}, {THRESHOLDS}, mm as materialized (select threshold, g.label, g.a_id, {_l_overlap('a', 'b')} as inter, {_l_measures('a')}, {_l_measures('b')} from g join a on a.feature_id = g.a_id and a.label = g.label
  join b on b.feature_id = g.b_id and b.label = g.label join th on iou >= threshold), me as materialized (select threshold, label, a_id, inter / (a_area + b_area - inter) as polygon_iou, abs(b_area - a_area) / a_area as area_abs_error,
  sqrt(pow(a_cx - b_cx, 2) + pow(a_cy - b_cy, 2)) as centroid_distance, abs(b_perimeter - a_perimeter) / a_perimeter as perimeter_error from mm),
  tot as (select label, sum(ia) as a_total, sum(ib) as b_total from (select label, 1 as ia, 0 as ib from a union all select label, 0, 1 from b) group by label)"""
    return f"with {measured} {_summary('label, threshold', _CATEGORY, 'coalesce(mi, 0)')}"


def _systems() -> str:
    """Snyder's formulas of the ellipsoidal cone and cylinder, with the co-latitude's tangent."""
    e2 = lambda inverse: f"(2 / {inverse}::double - 1 / {inverse}::double / {inverse}::double)"
    clarke, krassovsky = e2(294.978698213898), e2(298.3)
    t = lambda phi, e: f"(tan(pi() / 4 - {phi} / 2) / pow((1 - sqrt({e}) * sin({phi})) / (1 + sqrt({e}) * sin({phi})), sqrt({e}) / 2))"
    m = lambda phi, e: f"(cos({phi}) / sqrt(1 - {e} * pow(sin({phi}), 2)))"
    one, two, origin = "radians(24::double)", "radians(38::double)", "radians(30::double)"
    cone = f"n as (select (ln({m(one, clarke)}) - ln({m(two, clarke)})) / (ln({t(one, clarke)}) - ln({t(two, clarke)})) as n), k as (select n, {m(one, clarke)} / (n * pow({t(one, clarke)}, n)) as f from n)"
    rho = lambda phi: f"(6378206.4::double * f * pow({t(phi, clarke)}, n))"
    foot, scale = "0.3048006096012192::double", m("radians(42::double)", krassovsky)
    columns = {
        "lambert_x": f"({rho('phi')} * sin(n * radians(lon - 112.5))) / {foot} + 500000", "lambert_y": f"({rho(origin)} - {rho('phi')} * cos(n * radians(lon - 112.5))) / {foot} + 100000",
        "mercator_x": f"6378245 * {scale} * radians(lon - 51)", "mercator_y": f"-6378245 * {scale} * ln({t('phi', krassovsky)})", "web_x": "6378137 * radians(lon)", "web_y": "6378137 * ln(tan(pi() / 4 + phi / 2))",
    }
    listed = ", ".join(f"round({v}, 2) as {name}" for name, v in columns.items())
    return f"with p as (select c_custkey, 110 + (c_custkey % 97) / 16.0::double as lon, 20 + (c_custkey % 89) / 4.0::double as lat, radians(20 + (c_custkey % 89) / 4.0::double) as phi from customer), {cone} select c_custkey, {listed}, round(lon, 8) as lon, round(lat, 8) as lat from p, k"


def _repair() -> str:
    """Measures of the shapes of each kind, as sums of rectangles and triangles."""
    diagonal, edge = "2 * sqrt(w * w + h * h) + 2 * h", "2 * sqrt(0.09 * w * w + 0.04 * h * h) + 0.4 * h"
    kinds = [  # state, parts, area and perimeter, centre of mass and height as shares of w and h
        ("ok", 1, "0.75 * w * h", "2 * (w + h)", 5 / 12, 5 / 12, 1), ("ok", 2, "0.96 * w * h", "2.4 * (w + h)", (0.5 - 0.04 * 0.2) / 0.96, (0.5 - 0.04 * 0.2) / 0.96, 1), ("repaired", 2, "w * h / 2", diagonal, 0.5, 0.5, 1),
        ("ok", 2, "0.8 * w * h", "1.6 * w + 4 * h", 0.5, 0.5, 1), ("repaired", 1, "w * h", "2 * (w + h)", 0.5, 0.5, 1), ("repaired", 2, "0.64 * w * h", "2.4 * (w + h)", 0.5, 0.5, 1),
        ("repaired", 1, "w * h", "2 * (w + h)", 0.5, 0.5, 1), ("ok", 2, "0.94 * w * h", f"2 * (w + h) + {edge}", (0.5 - 0.06 * 0.2) / 0.94, 0.5, 1),
    ]
    pick = lambda k: "case feature_id % 8 " + " ".join(f"when {j} then {kind[k]!r}" if k in (0, 1, 4, 5, 6) else f"when {j} then {kind[k]}" for j, kind in enumerate(kinds)) + " end"
    off = "0.000012345"
    measures = {"area": pick(2), "perimeter": pick(3), "cx": f"minx + w * ({pick(4)})::double", "cy": f"miny + h * ({pick(5)})::double", "maxy": f"miny + h * ({pick(6)})"}
    return f"select feature_id, {pick(0)} as state, ({pick(1)})::int as parts, {', '.join(f'round({v} + {off}, 3) as {n}' for n, v in measures.items())} from {fixture_sql('poly_a')}"


def _overlay_shapes() -> str:
    off, inter = "0.000012345", _l_overlap("a", "b")
    areas = {"both": inter, "either": f"0.75 * a.area + 0.75 * b.area - ({inter})", "first": f"0.75 * a.area - ({inter})"}
    bounds = {f"{f}{v}": f"{w}(a.{f}{v}, b.{f}{v})" for f, w in (("min", "least"), ("max", "greatest")) for v in "xy"}
    return f"with {greedy_rounds()} select a_id, b_id, {', '.join(f'round({v} + {off}, 3) as {n}' for n, v in (areas | bounds).items())} from g join a on a.label = g.label and a.feature_id = a_id join b on b.label = g.label and b.feature_id = b_id"


def _plan() -> str:
    """Percent plans: halves round to even."""
    return f"""with base as (select 'adaptive' as mode, (select count(*) from {WHOLE})::double as b union all select 'metric', 5590.0::double union all select 'raster', 100.0::double),
  v as (select mode, p as percent, b * p / 100 as x from base, range(5, 101, 5) t(p)),
  r as (select mode, percent, case mode when 'adaptive' then greatest(2, round_even(x, 0)) when 'metric' then greatest(10, round_even(x / 10, 0) * 10) else case when greatest(3, round_even(x, 0)) % 2 = 0 then greatest(3, round_even(x, 0)) + 1 else greatest(3, round_even(x, 0)) end end as bandwidth from v)
  select mode, cast(min(percent) as int) as percent, bandwidth::double as bandwidth from r group by mode, bandwidth"""


ORACLE_SQL: dict[str, str] = {
    "pairwise_global_metrics": f"with s as {WHOLE} select pair_key, pair_label, round(avg(y - x), 4) as me, round(avg(abs(y - x)), 4) as mae, round(avg(case when x <> 0 then abs(y - x) / x end), 6) as mre, round(sqrt(avg((y - x) * (y - x))), 4) as rmse, round(corr(y, x), 6) as correlation, count(*) as samples, (select count(*) from {S}) - count(*) as dropped from {long('s')} group by pair_key, pair_label",
    "pairwise_matrix_metrics": f"with s as {WHOLE}, c as ({' union all '.join(f'''select '{a}' as field_i, '{b}' as field_j, {a} as y, {b} as x from s''' for a in FIELDS for b in FIELDS)}) select field_i, field_j, round(avg(y - x), 4) as me, round(avg(abs(y - x)), 4) as mae, round(case when max(case when x = 0 then 1 else 0 end) = 0 then avg(abs(y - x) / x) end, 6) as mre, round(sqrt(avg((y - x) * (y - x))), 4) as rmse from c group by field_i, field_j",
    "scatter_stats": f"select round(avg(v_a - v_c), 4) as me, round(avg(abs(v_a - v_c)), 4) as mae, round(sqrt(avg((v_a - v_c) * (v_a - v_c))), 4) as rmse, round(corr(v_a, v_c), 6) as r, round(regr_slope(v_a, v_c), 6) as slope, round(regr_intercept(v_a, v_c), 4) as intercept, count(*) as n from {S} where v_a is not null and v_c is not null",
    "scatter_matrix_metrics": f"select pair_key, pair_label, round(corr(y, x), 6) as r, round(sqrt(avg((y - x) * (y - x))), 4) as rmse, round(avg(abs(y - x)), 4) as mae, round(avg(y - x), 4) as me, count(*) as n from {long(S)} where y is not null and x is not null group by pair_key, pair_label",
    "local_summary_stats": " union all ".join(f"select '{f}' as field, count({f}) as n, round(min({f}), 4) as min, round(quantile_cont({f}, 0.25), 4) as q1, round(quantile_cont({f}, 0.5), 4) as median, round(quantile_cont({f}, 0.75), 4) as q3, round(max({f}), 4) as max, round(avg({f}), 4) as mean, round(stddev_samp({f}), 4) as sd from {S}" for f in FIELDS),
    "complete_cases": f"select feature_id, px, py, round(v_a, 4) as v_a, round(v_b, 4) as v_b, round(v_c, 4) as v_c from {WHOLE}",
    "missing_value_report": f"select field, missing from (select 'left_v' as field, sum(case when left_v is null then 1 else 0 end)::bigint as missing from {G} union all select 'right_v', sum(case when right_v is null then 1 else 0 end)::bigint from {G}) where missing > 0 order by missing desc, field limit 3",
    "distinct_values": "select event_type as value, min(event_id) as first_seen from events where event_type is not null group by event_type order by 2, 1 limit 500",
    "systematic_sample": "select c_custkey, c_name from customer where (c_custkey - (select min(c_custkey) from customer)) % (select greatest(1, count(*) // 100) from customer) = 0",
    "extent_union_intersection": f"select min(xmin) as union_xmin, min(ymin) as union_ymin, max(xmax) as union_xmax, max(ymax) as union_ymax, case when max(xmin) < min(xmax) and max(ymin) < min(ymax) then max(xmin) end as common_xmin, case when max(xmin) < min(xmax) and max(ymin) < min(ymax) then max(ymin) end as common_ymin, case when max(xmin) < min(xmax) and max(ymin) < min(ymax) then min(xmax) end as common_xmax, case when max(xmin) < min(xmax) and max(ymin) < min(ymax) then min(ymax) end as common_ymax from {CAT}",
    "catalog_consistency": f"select name, data_type, a as crs_off, b as resolution_off, c as format_off, case when a or b or c then concat_ws('+', case when a then 'reproject' end, case when b then 'resample' end, case when c then 'convert' end) else 'none' end as action from (select name, data_type, data_type <> 'attribute' and crs <> 'EPSG:32650' as a, coalesce(data_type = 'raster' and resolution <> 10, false) as b, format not in ('CSV', 'Excel') and format <> 'GeoTIFF' as c from {CAT})",
    "category_auto_mapping": f"with a as (select distinct category as v from {fixture_sql('poly_a')}), b as (select distinct case when category < 'C3' then substring(category, 2) else category end as v from {fixture_sql('poly_b')}), c as (select v from a intersect select v from b), x as (select v, row_number() over (order by try_cast(v as double) is null, try_cast(v as double), v) as n from a where v not in (select v from c)), y as (select v, row_number() over (order by try_cast(v as double) is null, try_cast(v as double), v) as n from b where v not in (select v from c)) select v as a_value, v as b_value from c union all select x.v, y.v from x full join y on x.n = y.n",
    "gw_local_error_fixed_bisquare": local_error("bisquare", BANDWIDTH),
    "gw_local_error_gaussian": local_error("gaussian", 150.0),
    "gw_local_error_exponential": local_error("exponential", 60.0),
    "gw_local_error_adaptive": _ADAPTIVE,
    "gw_local_correlation": f"with {near('bisquare', BANDWIDTH)}, {sums()} select i as feature_id, pair_key, round(case when (s0 * sxx - sx * sx) * (s0 * syy - sy * sy) > 0 then (s0 * sxy - sx * sy) / sqrt((s0 * sxx - sx * sx) * (s0 * syy - sy * sy)) end, 6) as local_corr from t",
    "gwr_coefficients": f"with {near('bisquare', BANDWIDTH)}, {sums()}, {FIT} select i as feature_id, pair_key, round(intercept, 3) as intercept, round(slope, 6) as slope, round(yhat, 4) as yhat, round(residual, 4) as residual, round(s_ii, 6) as s_ii from fit",
    "gwr_diagnostics": f"with {near('bisquare', BANDWIDTH)}, {sums()}, {FIT}, {diagnosed()} select pair_key, n, round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / (edf - 1), 6) as adj_r2, round(aicc, 2) as aicc, round(edf, 4) as edf, round(residual_rmse, 4) as residual_rmse from dg",
    "gwr_studentised_residuals": f"with {near('bisquare', BANDWIDTH)}, {sums()}, {FIT}, {diagnosed()} select i as feature_id, fit.pair_key, round(residual / sqrt(rss / edf * (1 - 2 * s_ii + s_sq)), 5) as stud_residual from fit join dg on dg.pair_key = fit.pair_key",
    "gwr_local_r2": f"with {near('bisquare', BANDWIDTH)}, {sums()}, {FIT}, mu as (select pair_key, avg(yi) as mean from fit group by pair_key) select l.i as feature_id, l.pair_key, round(1 - sum(w * fit.residual * fit.residual) / sum(w * (y - mean) * (y - mean)), 6) as local_r2 from l join fit on fit.i = l.j and fit.pair_key = l.pair_key join mu on mu.pair_key = l.pair_key group by l.i, l.pair_key",
    "gwr_bandwidth_sweep": f"with {_SWEPT} select bandwidth, pair_key, round(aicc, 2) as aicc, round(r2, 6) as r2, round(residual_rmse, 4) as residual_rmse from dg",
    "gwr_best_bandwidth": f"with {_SWEPT} select pair_key, arg_min(bandwidth, aicc) as best_bandwidth from dg group by pair_key",
    "percent_bandwidth_plan": _plan(),
    "bbox_candidates": f"with {CANDIDATES} select label, a_id, b_id, round(inter, 4) as rect_intersection, round(iou, 6) as rect_iou from cand",
    "greedy_match": f"with {greedy_rounds()} select label, a_id, b_id, round(iou, 6) as rect_iou from g",
    "match_threshold_sweep": f"with {greedy_rounds()}, {THRESHOLDS} select threshold, count(*) as matched, round(avg(iou), 6) as mean_iou from g join th on iou >= threshold group by threshold",
    "match_geometry_metrics": f"with {MEASURED} select label, a_id, b_id, round(polygon_iou, 6) as polygon_iou, round(area_error, 6) as area_error, round(area_abs_error, 6) as area_abs_error, round(centroid_distance, 4) as centroid_distance, round(perimeter_error, 6) as perimeter_error, round(px, 4) as px, round(py, 4) as py from me where threshold = 0.1",
    "category_threshold_summary": f"with {MEASURED} {_summary('label, threshold', _CATEGORY, 'coalesce(mi, 0)')}",
    "geometry_run_tables": f"with {MEASURED} {_summary('label, threshold', _CATEGORY, 'coalesce(mi, 0)')}",
    "overall_threshold_summary": f"with {MEASURED} {_summary('threshold', _OVERALL, 'mi')}",
    "recommended_threshold": f"with {MEASURED} select arg_max(threshold, 2 * matched / (a_total + b_total) * coalesce(mi, 0)) as recommended_threshold from (select threshold, a_total, b_total, count(a_id) as matched, median(polygon_iou) as mi from {_OVERALL} group by threshold, a_total, b_total)",
    "gw_match_smoothing": f"{_smoothed(SMOOTHING[:1])} select bandwidth, source_id, round(gw_area_me, 6) as gw_area_me, round(gw_area_mae, 6) as gw_area_mae, round(gw_area_rmse, 6) as gw_area_rmse, round(gw_iou, 6) as gw_iou, round(gw_centroid, 4) as gw_centroid, round(gw_perimeter, 6) as gw_perimeter, neighbours from sm",
    "gw_match_bandwidth_sweep": f"{_smoothed(SMOOTHING)} select bandwidth, round(median(gw_iou), 6) as gw_iou_median, round(median(gw_area_mae), 6) as gw_area_mae_median, round(median(gw_centroid), 4) as gw_centroid_median, round(median(gw_area_rmse), 6) as gw_rmse_median, round(median(neighbours), 2) as neighbor_median from sm group by bandwidth",
    "l_shape_overlay": f"with {greedy_rounds()} select a_id, b_id, round({_l_overlap('a', 'b')}, 4) as overlap, round(a.area * 0.75, 4) as a_area, round(a.perimeter, 4) as a_perimeter from g join a on a.label = g.label and a.feature_id = a_id join b on b.label = g.label and b.feature_id = b_id",
    "l_shape_threshold_summary": _l_summary(),
    "layer_measures": f"with a as {_layer('poly_a', 0)}, m as (select *, {_l_measures('a')} from a) select feature_id, label, 'ok' as state, round(minx, 4) as minx, round(miny, 4) as miny, round(maxx, 4) as maxx, round(maxy, 4) as maxy, round(a_area, 4) as area, round(a_perimeter, 4) as perimeter, round(a_cx, 4) as cx, round(a_cy, 4) as cy from m",
    "layer_quality": f"select count(*) as input, count(*) filter (feature_id % 7 = 0) as null_shapes, count(*) filter (feature_id % 7 = 1) as empty_shapes, count(*) filter (feature_id % 7 = 2) as invalid_shapes, count(*) filter (feature_id % 7 = 2) as repaired, count(*) filter (feature_id % 7 > 1 and w * h / case when feature_id % 7 = 2 then 2 else 1 end < 250) as too_small, count(*) filter (feature_id % 7 > 1 and w * h / case when feature_id % 7 = 2 then 2 else 1 end >= 250) as processed from {fixture_sql('poly_a')}",
    "layer_repair": _repair(),
    "overlay_shapes": _overlay_shapes(),
    "quality_stats": f"select count(*) as input, sum(case when w * h is null then 1 else 0 end)::bigint as null_shapes, sum(case when w * h <= 0 then 1 else 0 end)::bigint as empty_shapes, sum(case when w * h > 0 and w * h < 250 then 1 else 0 end)::bigint as too_small, sum(case when w * h >= 250 then 1 else 0 end)::bigint as processed from {fixture_sql('poly_a')}",
    "point_in_polygon": f"select s.feature_id, max(p.feature_id) as polygon_id, count(*) as hits from (select feature_id, px / 8 + 0.37::double as x, py / 9 + 0.41::double as y from {S}) s join {fixture_sql('poly_a')} p on x >= minx and x < minx + w and y >= miny and y < miny + h group by s.feature_id",
    "raster_pairwise_metrics": f"select 'left_v__vs__right_v' as pair_key, 'left_v ~ right_v' as pair_label, round(avg(left_v - right_v), 4) as me, round(avg(abs(left_v - right_v)), 4) as mae, round(avg(case when abs(left_v) > 1e-12 then abs((left_v - right_v) / left_v) end), 6) as mre, round(sqrt(avg(pow(left_v - right_v, 2))), 4) as rmse, round(corr(left_v, right_v), 6) as correlation, count(*) as valid_cells from {G} where left_v is not null and right_v is not null",
    "raster_local_error": f"select r, c, n, round(local_me + 1.2345e-7, 4) as local_me, round(local_mae + 1.2345e-7, 4) as local_mae, round(local_mre + 1.2345e-7, 4) as local_mre, round(local_rmse + 1.2345e-7, 4) as local_rmse from {_focal(5)}",
    "raster_local_correlation": f"select r, c, round(local_corr, 5) as local_corr from {_focal(5)}",
    "raster_local_regression": f"select r, c, round(coefficient, 5) as coefficient, round(local_r2, 5) as local_r2 from {_focal(9)}",
    "raster_window_sweep": " union all ".join(f"select {w} as window_size, round(median(local_mae), 4) as local_mae_median, round(median(local_rmse), 4) as local_rmse_median, round(median(local_corr), 5) as local_corr_median, round(median(coefficient), 5) as coefficient_median, round(median(local_r2), 5) as local_r2_median from {_focal(w)}" for w in (3, 5, 9)),
    "raster_block_mean": f"select r // 8 as r, c // 8 as c, round(avg(left_v), 4) as value from {G} group by 1, 2",
    "raster_percentile_stretch": f"with g as {G}, p as (select quantile_cont(left_v, 0.02) as lo, quantile_cont(left_v, 0.98) as hi from g) select r, c, cast(coalesce(floor(greatest(0, least(255, (left_v - lo) / (hi - lo) * 255))), 0) as int) as grey, case when left_v is null then 0 else 255 end as alpha from g, p",
    "raster_align_bilinear": _resample("bilinear"),
    "raster_align_nearest": _resample("near"),
    "raster_align_cubic": _resample("cubic"),
    "classify_equal_interval": _classes("select list_transform(range(0, 6), lambda i: case when i = 5 then hi else lo + (hi - lo) * i / 5 end) as breaks from (select min(v) as lo, max(v) as hi from v)"),
    "classify_quantile": _classes("select list_sort(list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as breaks from v"),
    "classify_manual": _classes("select list_sort(list_distinct(list_concat([lo], list_filter([1000.0::double, 1200.0::double, 99999.0::double], lambda x: x > lo and x < hi), [hi]))) as breaks from (select min(v) as lo, max(v) as hi from v)"),
    "classify_unique_topk": "with c as (select c_custkey % 97 as v, count(*) as n from customer group by 1), k as (select *, row_number() over (order by n desc, v) as rn, count(*) over () as m from c), t as (select v, n from k where m <= 64 or rn <= 63) select cast(row_number() over (order by v) - 1 as int) as class_id, cast(v as varchar) as class_label, n from t union all select 63, '其他', sum(n)::bigint from k where m > 64 and rn > 63 having count(*) > 0",
    "classify_unique_values": "select cast(row_number() over (order by p_size) - 1 as int) as class_id, cast(p_size as varchar) as label, count(*) as n from part group by p_size",
    "histogram_fixed": "with v as (select value::double as v from events where value is not null), e as (select min(v) as lo, max(v) as hi, case when max(v) > min(v) then (max(v) - min(v)) / 18 else 1.0 end as w from v), f as (select least(cast(floor((v - lo) / w) as int), 17) as b, count(*) as n from v, e group by 1) select cast(k as int) as bin, round(lo + k * w, 4) as bin_lo, round(lo + k * w + w, 4) as bin_hi, coalesce(n, 0) as n from range(0, 18) t(k) cross join e left join f on f.b = k",
    "kde_density": f"with v as (select c_acctbal::double as v from customer where c_acctbal is not null), e as (select min(v) as lo, max(v) as hi, greatest(stddev_pop(v) * pow(count(*)::double, -0.2), (max(v) - min(v)) / 80) as bw, (max(v) - min(v)) / 159 as step from v) select cast(k as int) as point, round(lo + k * step, 4) as x, round(sum(exp(-0.5 * pow((lo + k * step - v) / bw, 2))) * ((hi - lo) / 18 / (bw * {math.sqrt(2 * math.pi)!r}::double)), 4) as density from v, e, range(0, 160) t(k) group by k, lo, hi, bw, step",
    "project_albers": _albers(),
    "project_systems": _systems(),
    "project_utm": _utm(),
    "result_columns": f"with {near('bisquare', BANDWIDTH)}, {sums()} select s.feature_id, round(s.v_a, 4) as v_a, round(e1 / s0 + 1.2345e-7, 4) as lme, round(case when s0 is not null then sqrt(greatest(0, e3 / s0)) end + 1.2345e-7, 4) as lrmse from {S} s left join (select * from t where pair_key = 'v_a__vs__v_c') t on t.i = s.feature_id",
    "nearest_percent": "select p_partkey, v, p as nearest from (select p_partkey, v, p, row_number() over (partition by p_partkey order by abs(p - v), p) as rn from (select p_partkey, p_size * 2.0::double as v from part), (select (k * 5)::double as p from range(1, 21) t(k))) where rn = 1",
    "scalar_functions": "select c_custkey, case when length(c_name) > 12 then left(c_name, 12) || '…' else c_name end as short, regexp_replace(regexp_replace('#' || c_name || '!', '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') as tag, 'a__vs__' || c_name as pair, replace(c_name || ',x', ',', '，') as wide, try_cast(substring(c_name, 10, 9) as double) as number, strftime(try_strptime('202401' || lpad((c_custkey % 40)::varchar, 2, '0'), '%Y%m%d'), '%Y-%m-%d') as day from customer",
}

def _golden(rounds: int = 25) -> str:
    """Golden-section search of the bandwidth with the least AICc, a step a round."""
    ratio = repr((math.sqrt(5) - 1) / 2) + "::double"

    def loss(at: str) -> str:
        """AICc of the regression of v_a on v_c at the bandwidth ``p`` of a one-row source."""
        sums_of = "sum(w) as s0, sum(w * w) as q0, sum(case when i = j then w end) as wii, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy, sum(w * w * x) as qx, sum(w * w * x * x) as qxx"
        weighted = f"select i, j, yi, xi, y, x, pow(1 - (d / p) * (d / p), 2) as w from m, {at} where d < p"
        return f"(with t as (select i, 'all' as pair_key, max(yi) as yi, max(xi) as xi, {sums_of} from ({weighted}) group by i), {FIT}, {diagnosed()} select case when aicc is null or isnan(aicc) then 'inf'::double else aicc end as v from dg)"

    steps = [
        f"s as materialized {WHOLE}, m as materialized (select a.feature_id as i, b.feature_id as j, a.v_a as yi, a.v_c as xi, b.v_a as y, b.v_c as x, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) as d from s a, s b)",
        "box as (select sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)) as hi from s)", f"start as materialized (select hi / 5000 as lo, hi, hi - {ratio} * (hi - hi / 5000) as a, hi / 5000 + {ratio} * (hi - hi / 5000) as b from box)",
        f"la as materialized {loss('(select a as p from start)')}", f"lb as materialized {loss('(select b as p from start)')}", "g0 as materialized (select start.*, la.v as fa, lb.v as fb from start, la, lb)",
    ]
    for k in range(rounds):
        steps.append(f"n{k} as materialized (select *, hi - lo <= 1e-3 * hi as done, fa <= fb as low, case when fa <= fb then b - {ratio} * (b - lo) else a + {ratio} * (hi - a) end as p from g{k})")
        steps.append(f"l{k} as materialized {loss(f'(select p from n{k} where not done)')}")
        pick = lambda name, left, right: f"case when done then {name} when low then {left} else {right} end as {name}"
        steps.append(f"g{k + 1} as materialized (select {pick('lo', 'lo', 'a')}, {pick('hi', 'b', 'hi')}, {pick('a', 'p', 'b')}, {pick('b', 'a', 'p')}, {pick('fa', 'v', 'fb')}, {pick('fb', 'fa', 'v')} from n{k} left join l{k} on true)")
    return f"with {', '.join(steps)} select round((lo + hi) / 2, 2) as bandwidth from g{rounds}"


def _natural(classes: int = 5, sample: int = 1024) -> str:
    """Natural breaks by dynamic programming, a layer a class, over evenly spaced ones of the sorted values."""
    steps = [
        "p as (select p_retailprice::double as v, row_number() over (order by p_retailprice, p_partkey) - 1 as k, count(*) over () as n from part where p_retailprice is not null)",
        f"q as (select v, k, n, (n - 1) / {sample - 1}.0::double as step from p)", f"x as materialized (select i, v, sum(v) over (order by i) as s1, sum(v * v) over (order by i) as s2 from (select v, row_number() over (order by k) - 1 as i from q where n <= {sample} or floor(floor(k / step + 0.5) * step + 0.5) = k))",
        "c0 as materialized (select i as j, s2 - s1 * s1 / (i + 1) as cost, 0::bigint as f from x)",
    ]
    for k in range(1, classes):
        inside = "(x.s2 - e.s2) - (x.s1 - e.s1) * (x.s1 - e.s1) / (x.i - e.i)"
        steps.append(f"c{k} as materialized (select j, w.cost as cost, w.f as f from (select x.i as j, min(struct_pack(cost := c.cost + {inside}, f := e.i + 1)) as w from x join x e on e.i < x.i and e.i >= {k - 1} join c{k - 1} c on c.j = e.i group by x.i))")
    steps.append(f"b{classes} as (select max(i) as j from x)")
    for k in range(classes - 1, -1, -1):
        steps.append(f"b{k} as materialized (select c{k}.f - 1 as j, (select v from x where i = b{k + 1}.j) as v from b{k + 1} join c{k} on c{k}.j = b{k + 1}.j)")
    edges = " union all ".join(f"select {k + 1} as at, v as break from b{k}" for k in range(classes))
    return f"with {', '.join(steps)} select 0 as at, min(v) as break from x union all {edges}"


def _spaced_error(points: str, distance: str, bandwidth: float) -> str:
    """Local errors by a distance between (a.px, a.py) and (b.px, b.py), over all pairs of points."""
    return f"""with s as materialized {points}, m as (select a.feature_id as i, b.v_a - b.v_c as e, {distance} as d from s a, s b), w as (select i, e, pow(1 - (d / {bandwidth}) * (d / {bandwidth}), 2) as w from m where d < {bandwidth})
  select i as feature_id, round(sum(w * e) / sum(w) + 1.2345e-7, 4) as lme, round(sum(w * abs(e)) / sum(w) + 1.2345e-7, 4) as lmae from w group by i"""


_POLAR = f"(select feature_id, px * 0.09::double - 175.5::double as px, 88.5::double - py / 10000 as py, v_a, v_c from {WHOLE})"
#: The cosine rule loses small distances, so the sphere is told by the chord of unit vectors.
_CHORD = "sqrt(" + " + ".join(f"pow({v.format(t='a')} - {v.format(t='b')}, 2)" for v in ("cos(radians({t}.py)) * cos(radians({t}.px))", "cos(radians({t}.py)) * sin(radians({t}.px))", "sin(radians({t}.py))")) + ")"
_ARC = f"(2 * asin(least(1.0::double, {_CHORD} / 2)))"
#: The formula of Andoyer by sines of the latitudes.
_H, _G = f"({_ARC} + 3 * sin({_ARC})) / (2 * pow(sin({_ARC} / 2), 2))", f"({_ARC} - 3 * sin({_ARC})) / (1 + cos({_ARC}))"
_SINES = "sin(radians(a.py)) {} sin(radians(b.py))"
_ELLIPSOID = f"case when a.px = b.px and a.py = b.py then 0 else 6378.137::double * ({_ARC} - {1 / 298.257223563 / 4!r} * ({_H} * pow({_SINES.format('-')}, 2) + {_G} * pow({_SINES.format('+')}, 2))) end"
ORACLE_SQL |= {
    "gw_local_error_sphere": _spaced_error(_POLAR, f"6371.0088::double * {_ARC}", 60.0),
    "gw_local_error_great_circle": _spaced_error(_POLAR, _ELLIPSOID, 60.0),
    "gw_local_error_turned": _spaced_error(WHOLE, "pow(pow(abs((a.px - b.px) * cos(0.5) - (a.py - b.py) * sin(0.5)), 3) + pow(abs((a.px - b.px) * sin(0.5) + (a.py - b.py) * cos(0.5)), 3), 1 / 3.0::double)", 450.0),
    "project_and_back": "select c_custkey, round(lon, 7) as albers_lon, round(lat, 7) as albers_lat, round(lon, 6) as utm_lon, round(lat, 6) as utm_lat from (select c_custkey, 110 + (c_custkey % 97) / 16.0::double as lon, 20 + (c_custkey % 89) / 4.0::double as lat from customer)",
    "gwr_auto_bandwidth": _golden(),
    "classify_jenks": _natural(),
    "gwr_sweep_series": f"with {_SWEPT} select bandwidth, i as feature_id, pair_key, round(intercept, 3) as intercept, round(slope, 6) as slope, round(residual, 4) as residual from fit",
    "gw_match_sweep_sources": f"{_smoothed(SMOOTHING)} select bandwidth, source_id, round(gw_iou, 6) as gw_iou from sm",
    "neighbours_by_blocks": f"with s as materialized {WHOLE} select a.feature_id, count(*) as neighbours, round(sum(abs(a.px - b.px) + abs(a.py - b.py)), 4) as total from s a join s b on abs(a.px - b.px) + abs(a.py - b.py) <= 300 group by a.feature_id",
    "bandwidth_baseline": f"select count(*) as samples, round(sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)), 4) as diagonal from {WHOLE}",
    "pixel_sample": f"with v as (select *, row_number() over (order by r, c) - 1 as k, count(*) over () as n from {G} where left_v is not null and right_v is not null), s as (select *, (n - 1) / 499.0::double as step from v) select r, c, round(left_v, 4) as left_v, round(right_v, 4) as right_v from s where n <= 500 or floor(floor(k / step + 0.5) * step + 0.5) = k",
    "histogram_auto": "with v as (select value::double as v from events where value is not null), m as (select min(v) as lo, max(v) as hi, greatest(5, least(30, floor(sqrt(count(*))) * 2))::int as bins from v), e as (select *, case when hi > lo then (hi - lo) / bins else 1.0 end as w from m), f as (select least(cast(floor((v - lo) / w) as int), bins - 1) as b, count(*) as n from v, e group by 1) select k::int as bin, round(lo + k * w, 4) as bin_lo, round(lo + k * w + w, 4) as bin_hi, coalesce(n, 0) as n from e, range(0, 30) t(k) left join f on f.b = k where k < bins",
    "class_counts": "with v as (select c_acctbal::double as v from customer where c_acctbal is not null), e as (select min(v) as lo, max(v) as hi from v), b as (select list_transform(range(0, 8), lambda i: case when i = 7 then hi else lo + (hi - lo) * i / 7 end) as breaks from e), c as (select least(greatest(len(list_filter(breaks, lambda x: x <= v)) - 1, 0), 6) as class_id, count(*) as n from v, b group by 1) select k::int as class_id, coalesce(n, 0) as n from range(0, 7) t(k) left join c on class_id = k",
    "text_classes": "select n_regionkey::int as class_id, 'r' || n_regionkey as label, count(*) as n, ['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f'][n_regionkey + 1] as colour from nation group by n_regionkey",
    "percent_lookup": "select p_partkey, case when p_size % 2 = 0 and p_size between 2 and 50 then (p_size * 2)::int else 50 end as percent from part",
    "local_values": f"with {near('bisquare', BANDWIDTH)}, {sums()} select round(round(e1 / s0 + 1.2345e-7, 4), 4) as value from t where pair_key = 'v_a__vs__v_c'",
    "text_filter": "select p_partkey from part where contains(lower(p_name), 'ar')",
} | FILE_SQL
