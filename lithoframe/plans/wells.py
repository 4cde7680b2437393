"""Queries on logs, tops, zones and petrophysics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats as A
from ..operators import series, zones
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}
BUNDLE_SQL = """count(v) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std, round(coalesce(sum(v), 0), 4) AS sum,
  round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90"""
PHI, SW, VALUE = "view", "click", "purchase"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, **digits):
    """Doubles rounded for comparison, six digits unless given."""
    return df.select(*(F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def zones_of(spark, d):
    return zones.zones_from_tops(V.tops(spark, d), V.td(spark, d))


def scaled(spark, d, mnemonic, divisor=200.0):
    return V.log(spark, d, mnemonic).withColumn("value", F.least(F.col("value") / divisor, F.lit(1.0)))


@register("stats_bundle", f"{V.with_('curve')} SELECT mnemonic, {BUNDLE_SQL.replace('(v', '(value')} FROM curve GROUP BY mnemonic")
def _(spark, d):
    return rounded(A.spread(V.curve(spark, d), ["mnemonic"], "value"), sum=4)


@register("geomean", f"{V.with_('curve')} SELECT bore_id, round(exp(avg(CASE WHEN value > 0 THEN ln(value) END)), 6) AS geomean FROM curve GROUP BY bore_id")
def _(spark, d):
    return rounded(V.curve(spark, d).groupBy("bore_id").agg(A.geomean(F.col("value")).alias("geomean")))


@register(
    "stats_weighted",
    f"""{V.with_('curve')}, u AS (SELECT mnemonic, value AS v, md AS w FROM curve WHERE value IS NOT NULL AND md > 0),
 t AS (SELECT *, sum(w) OVER (PARTITION BY mnemonic) AS tot, sum(v * w) OVER (PARTITION BY mnemonic) / sum(w) OVER (PARTITION BY mnemonic) AS m,
   sum(w) OVER (PARTITION BY mnemonic ORDER BY v ROWS UNBOUNDED PRECEDING) AS run FROM u)
 SELECT mnemonic, count(*) AS count, round(max(m), 5) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sqrt(sum(w * (v - m) ** 2) / max(tot)), 5) AS std, round(sum(w * v), 2) AS sum,
  round(min(CASE WHEN run >= 0.1 * tot - 1e-12 * tot THEN v END), 6) AS p10, round(min(CASE WHEN run >= 0.5 * tot - 1e-12 * tot THEN v END), 6) AS p50, round(min(CASE WHEN run >= 0.9 * tot - 1e-12 * tot THEN v END), 6) AS p90 FROM t GROUP BY mnemonic""",
)
def _(spark, d):
    return rounded(A.spread(V.curve(spark, d), ["mnemonic"], "value", "md"), mean=5, std=5, sum=2)


@register(
    "scalar_math",
    f"""{V.with_('curve')} SELECT seq, round(CASE WHEN value - 50 > 0 THEN ln(value - 50) END, 6) AS ln, round(CASE WHEN value - 50 > 0 THEN log10(value - 50) END, 6) AS log10,
 round(CASE WHEN value - 50 >= 0 THEN sqrt(value - 50) END, 6) AS sqrt, round(exp(value / 100), 6) AS exp, round(value ** 2.0, 4) AS pow2, round(least(greatest(value, 20), 60), 6) AS clamped,
 round(greatest(value, 30), 6) AS clamp_min, round(value * 0.3048, 6) AS metres, abs(round(value - 50, 6)) AS abs, round(CASE WHEN seq % 5 <> 0 THEN value / (seq % 5) END, 6) AS divided FROM curve""",
)
def _(spark, d):
    v = F.col("value")
    return rounded(
        V.curve(spark, d).select(
            "seq", S.ln(v - 50).alias("ln"), S.log10(v - 50).alias("log10"), S.sqrt(v - 50).alias("sqrt"), F.exp(v / 100).alias("exp"), S.power(v, 2).alias("pow2"), S.clamp(v, 20, 60).alias("clamped"),
            S.clamp_min(v, 30).alias("clamp_min"), S.convert_length(v, "ft", "m").alias("metres"), F.abs(F.round(v - 50, 6)).alias("abs"), S.divided(v, F.col("seq") % 5).alias("divided"),
        ), pow2=4,
    )


#: Raw curve names by nation, and the families that they must come out as, written down by hand.
_RAW = (
    ("phi_2020", "PHIE"), ("SUWI", "SW"), ("Gr", "GR"), ("vcl_1999", "VSH"), ("Foo_2001", "Foo"), ("bar", "bar"), (" EffPhi_2024 ", "PHIE"), ("phi_t", "PHIT"), ("CNL", "NPHI"), ("SW_E_2021", "SW"), ("swtot", "SWT"), ("GAMMA", "GR"),
    ("VClay", "VSH"), ("kh", "PERM"), ("Dens", "RHOB"), ("DTCO_2011", "DT"), ("RDEP", "RT"), ("N_G", "NTG"), ("NET", "NET"), ("PORO", "PORO"), ("NTG_PhieLam", "NTG_PhieLam"), ("zden", "RHOB"), ("PHIE_20", "PHIE_20"), ("net_gross", "NTG"), ("klogh", "PERM"),
)


@register("canonical_mnemonic", "SELECT n_nationkey, f AS family FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{f}')" for k, (_, f) in enumerate(_RAW)) + ") v(k, f) ON n_nationkey = k")
def _(spark, d):
    raw = F.element_at(F.array(*(F.lit(x) for x, _ in _RAW)), F.col("n_nationkey").cast("int") + 1)
    return V.table(spark, d, "nation").select("n_nationkey", S.canonical_mnemonic(raw).alias("family"))


#: Some samples undefined, and a family for each log; errors have none.
_VALIDITY_SQL = f"""{V.with_('curve')}, f AS (SELECT *, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 11 = 0 THEN value * -0.01 ELSE value * 0.01 END AS v FROM curve),
 r AS (SELECT *, CASE mnemonic WHEN 'view' THEN v >= 0 AND v <= 1 WHEN 'click' THEN v >= 0 AND v <= 250 WHEN 'purchase' THEN v >= 1.0 AND v <= 3.5 ELSE true END AS ok FROM f)
 SELECT mnemonic, count(*) AS n, count(CASE WHEN NOT ok THEN 1 END) AS rejected, count(CASE WHEN ok AND v IS NOT NULL THEN 1 END) AS valid, round(avg(CASE WHEN ok THEN v END), 6) AS mean FROM r GROUP BY mnemonic"""


@register("validity_mask", _VALIDITY_SQL)
def _(spark, d):
    v = F.when(F.col("seq") % 7 == 0, F.lit(None)).when(F.col("seq") % 11 == 0, F.col("value") * -0.01).otherwise(F.col("value") * 0.01)
    m = F.col("mnemonic")
    family = F.when(m == "view", F.lit(" phie ")).when(m == "click", F.lit("GR")).when(m == "purchase", F.lit("Rhob")).otherwise(m)
    c = V.curve(spark, d).withColumn("v", v)
    rejected, kept = S.out_of_range(family, F.col("v")), S.mask_out_of_range(family, F.col("v"))
    return rounded(c.groupBy("mnemonic").agg(F.count("*").alias("n"), F.sum(rejected.cast("long")).alias("rejected"), F.sum((S.in_range(family, F.col("v"))).cast("long")).alias("valid"), F.avg(kept).alias("mean")))


@register("id_key", "SELECT c_custkey, replace(replace(replace(lower(trim(c_name)), '/', '_'), '-', '_'), ' ', '_') AS k FROM (SELECT c_custkey, replace(c_name, '#', '/ -') AS c_name FROM customer)")
def _(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.id_key(F.replace(F.col("c_name"), F.lit("#"), F.lit("/ -"))).alias("k"))


@register("zones_from_tops", f"{V.with_('curve', 'tops', 'zones')} SELECT bore_id, zone AS name, zone_ord, round(top_md, 6) AS top_md, round(base_md, 6) AS base_md FROM zones")
def _(spark, d):
    return rounded(zones_of(spark, d))


@register("zone_clip", f"{V.with_('curve', 'tops', 'zones')} SELECT seq, zone, round(md, 6) AS md FROM curve JOIN zones ON curve.bore_id = zones.bore_id AND md >= top_md AND md < base_md")
def _(spark, d):
    return rounded(zones.clip(V.curve(spark, d), zones_of(spark, d)).select("seq", "zone", "md"))


@register(
    "zone_stats",
    f"""{V.with_('curve', V.log_sql('l', VALUE), 'tops', 'zones')} SELECT z.bore_id, zone, zone_ord, {BUNDLE_SQL.replace('(v', '(value')} FROM zones z LEFT JOIN l ON l.bore_id = z.bore_id AND md >= top_md AND md < base_md GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(zones.zone_stats(V.log(spark, d, VALUE), zones_of(spark, d)), sum=4)


@register("zone_geomean", f"{V.with_('curve', V.log_sql('l', VALUE), 'tops', 'zones')} SELECT z.bore_id, zone, round(exp(avg(CASE WHEN value > 0 THEN ln(value) END)), 6) AS geomean, count(value) AS count FROM zones z JOIN l ON l.bore_id = z.bore_id AND md >= top_md AND md < base_md GROUP BY 1, 2")
def _(spark, d):
    return rounded(zones.zone_geomean(V.log(spark, d, VALUE), zones_of(spark, d)))


@register("wells_with_top", "WITH u AS (SELECT DISTINCT user_id AS bore_id FROM events) SELECT bore_id FROM u WHERE bore_id % 3 = 2")
def _(spark, d):
    bores = V.tops(spark, d).select("bore_id").distinct()
    tied = V.tops(spark, d).where("name = 'C' AND md = 420")
    return bores.join(tied, "bore_id", "left_semi")


_DZ = """CASE WHEN count(*) OVER w0 = 1 THEN 1.0 WHEN lag(md) OVER w IS NULL THEN lead(md) OVER w - md WHEN lead(md) OVER w IS NULL THEN md - lag(md) OVER w ELSE (lead(md) OVER w - lag(md) OVER w) / 2 END"""


@register("dz_weights", f"{V.with_('curve', V.log_sql('l', VALUE))} SELECT bore_id, round(md, 6) AS md, round(2 * ({_DZ}), 6) AS w FROM l WINDOW w AS (PARTITION BY bore_id ORDER BY md), w0 AS (PARTITION BY bore_id)")
def _(spark, d):
    return rounded(series.dz_weights(V.log(spark, d, VALUE), ["bore_id"]).select("bore_id", "md", (2 * F.col("w")).alias("w")))


@register("representative_thickness", f"{V.with_('curve', V.log_sql('l', VALUE))} SELECT bore_id, round(md, 6) AS md, round(coalesce(lead(md) OVER w, md) - coalesce(lag(md) OVER w, md), 6) AS h FROM l WINDOW w AS (PARTITION BY bore_id ORDER BY md)")
def _(spark, d):
    return rounded(series.representative_thickness(V.log(spark, d, VALUE), ["bore_id"]).select("bore_id", "md", (2 * F.col("h")).alias("h")))


def _lerp_sql(src: str, to: str, out: str) -> str:
    """As-of linear value of ``src`` at the depths of ``to``; every target row stays."""
    return f"""{out} AS (SELECT t.*, CASE WHEN q.md IS NULL THEN NULL WHEN p.md IS NULL THEN CASE WHEN q.md = t.md THEN q.value END ELSE p.value + (q.value - p.value) * ((t.md - p.md) / (q.md - p.md)) END AS {out}_v
 FROM {to} t ASOF LEFT JOIN {src} p ON t.bore_id = p.bore_id AND t.md > p.md ASOF LEFT JOIN {src} q ON t.bore_id = q.bore_id AND t.md <= q.md)"""


@register("at_md", f"{V.with_('curve', V.log_sql('a', PHI), V.log_sql('b', SW), _lerp_sql('a', 'b', 'x'))} SELECT bore_id, round(md, 6) AS md, round(x_v, 6) AS value FROM x")
def _(spark, d):
    to = V.log(spark, d, SW).select("bore_id", "md")
    return rounded(series.at_md(V.log(spark, d, PHI), to, ["bore_id"]))


def _method(method, expr):
    sql = f"""{V.with_('curve', V.log_sql('a', PHI), V.log_sql('b', SW))} SELECT t.bore_id, round(t.md, 6) AS md, round(CASE WHEN q.md = t.md THEN q.value WHEN p.md IS NULL OR q.md IS NULL THEN NULL ELSE {expr} END, 6) AS value
 FROM b t ASOF LEFT JOIN a p ON t.bore_id = p.bore_id AND t.md > p.md ASOF LEFT JOIN a q ON t.bore_id = q.bore_id AND t.md <= q.md"""

    @register(f"interpolate_{method}", sql)
    def _(spark, d):
        return rounded(series.interpolate(V.log(spark, d, PHI), V.log(spark, d, SW).select("bore_id", "md"), ["bore_id"], method))


for _name, _expr in (
    ("nearest", "CASE WHEN t.md - p.md <= q.md - t.md THEN p.value ELSE q.value END"), ("previous", "p.value"), ("next", "q.value"),
    ("linear", "p.value + (q.value - p.value) * ((t.md - p.md) / (q.md - p.md))"),
):
    _method(_name, _expr)


@register(
    "interpolate_spline",
    f"""{V.with_('curve', V.log_sql('a0', PHI), V.log_sql('b', SW))}, a AS (SELECT *, lag(md) OVER w AS bm, lag(value) OVER w AS bv, lead(md) OVER w AS am, lead(value) OVER w AS av FROM a0 WINDOW w AS (PARTITION BY bore_id ORDER BY md)),
 j AS (SELECT t.bore_id, t.md, p.md AS pm, p.value AS pv, q.md AS qm, q.value AS qv, p.bm, p.bv, q.am, q.av, (t.md - p.md) / (q.md - p.md) AS u FROM b t ASOF LEFT JOIN a p ON t.bore_id = p.bore_id AND t.md > p.md ASOF LEFT JOIN a q ON t.bore_id = q.bore_id AND t.md <= q.md)
 SELECT bore_id, round(md, 6) AS md, round(CASE WHEN qm = md THEN qv WHEN pm IS NULL OR qm IS NULL THEN NULL WHEN bm IS NULL OR am IS NULL THEN pv + (qv - pv) * u
  ELSE (2*u*u*u - 3*u*u + 1) * pv + (u*u*u - 2*u*u + u) * (qm - pm) * ((qv - bv) / (qm - bm)) + (3*u*u - 2*u*u*u) * qv + (u*u*u - u*u) * (qm - pm) * ((av - pv) / (am - pm)) END, 5) AS value FROM j""",
)
def _(spark, d):
    return rounded(series.interpolate(V.log(spark, d, PHI), V.log(spark, d, SW).select("bore_id", "md"), ["bore_id"], "spline"), value=5)


@register(
    "resample",
    f"""{V.with_('curve', V.log_sql('a', PHI))}, g AS (SELECT bore_id, lo + k * 24.0::DOUBLE AS md FROM (SELECT bore_id, min(md) AS lo, unnest(range(0, floor((max(md) - min(md)) / 24)::BIGINT + 1)) AS k FROM a GROUP BY 1)),
 {_lerp_sql('a', 'g', 'x')} SELECT bore_id, round(md, 6) AS md, round(CASE WHEN md = (SELECT min(md) FROM a WHERE a.bore_id = x.bore_id) THEN (SELECT arg_min(value, md) FROM a WHERE a.bore_id = x.bore_id) ELSE x_v END, 6) AS value FROM x""",
)
def _(spark, d):
    return rounded(series.resample(V.log(spark, d, PHI), ["bore_id"], 24.0))


@register("master_grid", f"{V.with_('curve')} SELECT bore_id, count(DISTINCT md) AS n FROM curve GROUP BY 1")
def _(spark, d):
    return series.master_grid(V.curve(spark, d)).groupBy("bore_id").agg(F.count("*").alias("n"))


_NET_SQL = f"""{V.with_('curve', 'tops', 'zones', V.log_sql('p0', PHI), V.log_sql('s0', SW), V.log_sql('l', VALUE))},
 p AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM p0), s AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM s0),
 {_lerp_sql('p', 'l', 'x')}, {_lerp_sql('s', 'x', 'y')}, net AS (SELECT bore_id, md, value FROM y WHERE coalesce(x_v >= 0.08 AND y_v <= 0.5, false))"""


def _net(spark, d):
    return zones.net_samples(V.log(spark, d, VALUE), scaled(spark, d, PHI), scaled(spark, d, SW), S.net_flag)


@register("net_samples", f"{_NET_SQL} SELECT bore_id, round(md, 6) AS md, round(value, 6) AS value FROM net")
def _(spark, d):
    return rounded(_net(spark, d).select("bore_id", "md", "value"))


def _weighted_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS count, round(max(m), 5) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sqrt(sum(w * (value - m) ** 2) / max(tot)), 5) AS std, round(sum(w * value), 3) AS sum,
 round(min(CASE WHEN run >= 0.1 * tot - 1e-12 * tot THEN value END), 6) AS p10, round(min(CASE WHEN run >= 0.5 * tot - 1e-12 * tot THEN value END), 6) AS p50, round(min(CASE WHEN run >= 0.9 * tot - 1e-12 * tot THEN value END), 6) AS p90
 FROM (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS tot, sum(w * value) OVER (PARTITION BY {keys}) / sum(w) OVER (PARTITION BY {keys}) AS m, sum(w) OVER (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING) AS run FROM cw WHERE value IS NOT NULL AND w > 0) GROUP BY {keys}"""


_CELL_SQL = f"""c AS (SELECT z.bore_id, zone, zone_ord, top_md, base_md, md, value FROM net JOIN zones z ON net.bore_id = z.bore_id AND md >= top_md AND md < base_md),
 cw AS (SELECT *, {_DZ} AS w FROM c WINDOW w AS (PARTITION BY bore_id, zone ORDER BY md), w0 AS (PARTITION BY bore_id, zone))"""


@register(
    "zone_table_net",
    f"""{_NET_SQL}, {_CELL_SQL}, ww AS ({_weighted_sql('bore_id, zone')}), f AS (SELECT bore_id, zone, zone_ord, round(any_value(base_md - top_md), 6) AS gross, count(*) AS samples FROM cw GROUP BY 1, 2, 3) SELECT * FROM f JOIN ww USING (bore_id, zone)""",
)
def _(spark, d):
    return rounded(zones.zone_table(_net(spark, d), zones_of(spark, d)), mean=5, std=5, sum=3)


@register(
    "zone_table_pooled",
    f"""{_NET_SQL}, {_CELL_SQL}, ww AS ({_weighted_sql('zone')}), f AS (SELECT zone, round(avg(g), 5) AS gross, sum(n)::BIGINT AS samples FROM (SELECT zone, bore_id, any_value(base_md - top_md) AS g, count(*) AS n FROM cw GROUP BY 1, 2) GROUP BY 1) SELECT * FROM f JOIN ww USING (zone)""",
)
def _(spark, d):
    return rounded(zones.pooled_zone_table(_net(spark, d), zones_of(spark, d)), mean=5, std=5, sum=3, gross=5)


@register("zone_table_pivot", f"""{V.with_('curve', V.log_sql('l', VALUE), 'tops', 'zones')}, s AS (SELECT z.bore_id, zone, avg(value) AS m FROM zones z JOIN l ON l.bore_id = z.bore_id AND md >= top_md AND md < base_md GROUP BY 1, 2)
 SELECT zone, {', '.join(f"round(avg(CASE WHEN bore_id % 8 = {k} THEN m END), 3) AS g{k}" for k in range(8))} FROM s GROUP BY zone""")
def _(spark, d):
    means = zones.clip(V.log(spark, d, VALUE), zones_of(spark, d)).groupBy("bore_id", "zone").agg(F.avg("value").alias("mean"))
    groups = means.groupBy((F.col("bore_id") % 8).alias("g"), "zone").agg(F.avg("mean").alias("mean"))
    wide = zones.pivot(groups, "mean", list(range(8)), bore="g")
    return wide.select("zone", *(F.col(str(k)).alias(f"g{k}") for k in range(8)))


_ALL_SQL = f"""{_NET_SQL}, {_CELL_SQL}, ww AS ({_weighted_sql('bore_id, zone')}), f AS (SELECT bore_id, zone, zone_ord, round(any_value(base_md - top_md), 3) AS gross, count(*) AS samples FROM cw GROUP BY 1, 2, 3),
 wa AS ({_weighted_sql('zone')}), fa AS (SELECT zone, min(zone_ord) AS zone_ord, round(avg(g), 3) AS gross, sum(n)::BIGINT AS samples FROM (SELECT zone, zone_ord, bore_id, any_value(base_md - top_md) AS g, count(*) AS n FROM cw GROUP BY 1, 2, 3) GROUP BY 1)
 SELECT bore_id::VARCHAR AS bore_id, zone, zone_ord, gross, samples, min, max, p50 FROM f JOIN ww USING (bore_id, zone) UNION ALL SELECT 'all', zone, zone_ord, gross, samples, min, max, p50 FROM fa JOIN wa USING (zone)"""


@register("zone_table_all", _ALL_SQL)
def _(spark, d):
    table = zones.zone_table_all(_net(spark, d), zones_of(spark, d))
    return rounded(table.select("bore_id", "zone", "zone_ord", "gross", "samples", "min", "max", "p50"), gross=3)


_VSH_SQL = f"""{V.with_('curve', 'tops', 'zones', V.log_sql('p0', PHI), V.log_sql('s0', SW), V.log_sql('v0', 'error'), V.log_sql('l', VALUE))},
 p AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM p0), s AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM s0), h AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM v0),
 {_lerp_sql('p', 'l', 'x')}, {_lerp_sql('s', 'x', 'y')}, {_lerp_sql('h', 'y', 'w')}, net AS (SELECT bore_id, md, value FROM w WHERE coalesce(x_v >= 0.08 AND y_v <= 0.5 AND w_v <= 0.4, false))"""


def _net_vsh(spark, d):
    flag = lambda phi, sw, vsh: S.net_flag(phi, sw, vsh, vsh_max=0.4)
    return zones.net_samples(V.log(spark, d, VALUE), scaled(spark, d, PHI), scaled(spark, d, SW), flag, vsh=scaled(spark, d, "error"))


@register("net_zone_stats", f"{_VSH_SQL} SELECT z.bore_id, zone, zone_ord, {BUNDLE_SQL.replace('(v', '(value')} FROM zones z LEFT JOIN net ON net.bore_id = z.bore_id AND md >= top_md AND md < base_md GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(zones.net_zone_stats(_net_vsh(spark, d), zones_of(spark, d)), sum=4)


@register("net_zone_geomean", f"{_VSH_SQL} SELECT z.bore_id, zone, zone_ord, round(exp(avg(CASE WHEN value > 0 THEN ln(value) END)), 6) AS mean, count(CASE WHEN value > 0 THEN 1 END) AS count FROM zones z LEFT JOIN net ON net.bore_id = z.bore_id AND md >= top_md AND md < base_md GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(zones.net_zone_stats(_net_vsh(spark, d), zones_of(spark, d), mean="geometric"))


@register(
    "net_pay",
    f"""{V.with_('curve', V.log_sql('p0', PHI), V.log_sql('s0', SW))}, s AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM s0), p AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS value FROM p0), {_lerp_sql('s', 'p', 'x')},
 h AS (SELECT bore_id, md, (coalesce(lead(md) OVER w, md) - coalesce(lag(md) OVER w, md)) / 2 AS h, coalesce(value >= 0.08 AND x_v <= 0.5, false) AS net FROM x WINDOW w AS (PARTITION BY bore_id ORDER BY md))
 SELECT bore_id, round(coalesce(sum(CASE WHEN net THEN h END), 0), 7) AS net_pay, round(CASE WHEN count(*) < 2 OR max(md) <= min(md) THEN 0 ELSE coalesce(sum(CASE WHEN net THEN h END), 0) / (max(md) - min(md)) END, 6) AS ntg FROM h GROUP BY 1""",
)
def _(spark, d):
    at = series.at_md(scaled(spark, d, SW), scaled(spark, d, PHI).withColumnRenamed("value", "phi"), ["bore_id"], out="sw")
    h = series.representative_thickness(at, ["bore_id"]).withColumn("net", S.net_flag(F.col("phi"), F.col("sw")))
    pay = F.coalesce(F.sum(F.when(F.col("net"), F.col("h"))), F.lit(0.0))
    span = F.max("md") - F.min("md")
    return rounded(h.groupBy("bore_id").agg(pay.alias("net_pay"), F.when((F.count("*") < 2) | (span <= 0), F.lit(0.0)).otherwise(F.try_divide(pay, span)).alias("ntg")), net_pay=7)


@register("characterise_lognormal", f"{V.with_('curve')} SELECT mnemonic, round(avg(value), 6) AS value, CASE WHEN count(CASE WHEN value > 0 THEN 1 END) < 2 OR stddev_pop(value) = 0 THEN 'deterministic' ELSE 'lognormal' END AS dist, round(avg(CASE WHEN value > 0 THEN ln(value) END), 6) AS p1, round(stddev_pop(CASE WHEN value > 0 THEN ln(value) END), 6) AS p2, NULL::DOUBLE AS p3 FROM curve GROUP BY mnemonic")
def _(spark, d):
    return rounded(V.curve(spark, d).groupBy("mnemonic").agg(*A.characterise(F.col("value"), "lognormal")))


@register("characterise_triangular", f"{V.with_('curve')} SELECT mnemonic, round(avg(value), 6) AS value, CASE WHEN count(value) < 2 OR stddev_pop(value) = 0 THEN 'deterministic' ELSE 'triangular' END AS dist, round(quantile_cont(value, 0.1), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS p2, round(quantile_cont(value, 0.9), 6) AS p3 FROM curve GROUP BY mnemonic")
def _(spark, d):
    return rounded(V.curve(spark, d).groupBy("mnemonic").agg(*A.characterise(F.col("value"), "triangular")))


#: Some depths are put back, so that series break.
_BROKEN = "c AS (SELECT bore_id, mnemonic, seq, CASE WHEN seq % 13 = 0 THEN md - 90 ELSE md END AS md FROM curve)"


@register("md_increasing", f"{V.with_('curve', _BROKEN)}, b AS (SELECT bore_id, mnemonic, seq, md, lag(md) OVER (PARTITION BY bore_id, mnemonic ORDER BY seq) AS before FROM c) SELECT bore_id, mnemonic, min(seq) AS at FROM b WHERE md <= before GROUP BY 1, 2")
def _(spark, d):
    broken = V.curve(spark, d).withColumn("md", F.when(F.col("seq") % 13 == 0, F.col("md") - 90).otherwise(F.col("md")))
    return series.increasing(broken, ["bore_id", "mnemonic"])


@register("mnemonic_inventory", f"{V.with_('curve')} SELECT lower(mnemonic) AS k, arg_min(mnemonic, seq) AS name, count(DISTINCT bore_id) AS bores FROM curve GROUP BY 1")
def _(spark, d):
    return V.curve(spark, d).groupBy(F.lower("mnemonic").alias("k")).agg(F.min_by("mnemonic", "seq").alias("name"), F.countDistinct("bore_id").alias("bores"))
