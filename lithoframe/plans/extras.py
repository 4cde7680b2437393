"""Queries on log expressions and on the static form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import uncertain as U
from ..operators import bores, logs, path, petro
from ..streaming import events
from . import expressions as X
from . import views as V
from .geometry import _AT_SQL
from .wells import _lerp_sql, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BASE = f"{V.with_('curve', V.log_sql('p', 'purchase'), V.log_sql('v', 'view'), V.log_sql('c', 'click'), _lerp_sql('v', 'p', 'x'), _lerp_sql('c', 'x', 'y'))}"


@register("log_expression", f"{_BASE} SELECT bore_id, round(md, 6) AS md, round(value * 2 + x_v / nullif(y_v, 0) - 1, 5) AS value FROM y")
def _(spark, d):
    e = X.channel("purchase") * 2 + X.channel("view") / X.channel("click") - 1
    return rounded(X.evaluate(V.curve(spark, d), e, "purchase"), value=5)


@register("log_where", f"{_BASE} SELECT bore_id, round(md, 6) AS md, round(value, 6) AS value FROM y WHERE coalesce(x_v > 40, false) AND NOT coalesce(y_v >= 60, false)")
def _(spark, d):
    return rounded(X.where(V.curve(spark, d), "purchase", (X.channel("view") > 40) & ~(X.channel("click") >= 60)))


def _events(spark, d):
    return V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("value").cast("double"))


@register("window_tumbling", "SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n, round(sum(value::DOUBLE), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    out = events.tumbling(_events(spark, d)).withColumn("start", F.unix_micros("start"))
    return rounded(out, total=4)


@register(
    "window_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(spark, d):
    return events.sessions(_events(spark, d)).withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")})


@register("last_values", "SELECT user_id, event_type, epoch_us(max(ts)) AS ts FROM events GROUP BY 1, 2")
def _(spark, d):
    return events.last_values(_events(spark, d)).select("user_id", "event_type", F.unix_micros("ts").alias("ts"))


@register("interval_join", "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY 1")
def _(spark, d):
    e = _events(spark, d)
    return events.paired(e.where("event_type = 'view'"), e.where("event_type = 'click'")).groupBy("user_id").agg(F.count("*").alias("n"))


_PAIR_SQL = f"""{V.with_('curve', V.log_sql('p0', 'view'), V.log_sql('s0', 'click'))}, p AS (SELECT bore_id, md, least(value / 200.0, 1.0) AS phi, row_number() OVER (PARTITION BY bore_id ORDER BY md) AS k FROM p0),
 s AS (SELECT bore_id, least(value / 200.0, 1.0) AS sw, row_number() OVER (PARTITION BY bore_id ORDER BY md) AS k FROM s0), j AS (SELECT bore_id, md, phi, sw FROM p JOIN s USING (bore_id, k)),
 h AS (SELECT *, (coalesce(lead(md) OVER w, md) - coalesce(lag(md) OVER w, md)) / 2 AS h, coalesce(phi >= 0.08 AND sw <= 0.5, false) AS net FROM j WINDOW w AS (PARTITION BY bore_id ORDER BY md)),
 b AS (SELECT bore_id, coalesce(sum(CASE WHEN net THEN h END), 0) AS pay, max(md) - min(md) AS span, count(*) AS n FROM h GROUP BY 1),
 l AS (SELECT 'net_pay' AS input, pay * 0.3048 AS v FROM b UNION ALL SELECT 'net_to_gross', CASE WHEN n < 2 OR span <= 0 THEN 0 ELSE pay / span END FROM b UNION ALL SELECT 'porosity', phi FROM h WHERE net UNION ALL SELECT 'water_saturation', sw FROM h WHERE net)"""


@register("model_inputs", f"{_PAIR_SQL} SELECT input, round(avg(v), 5) AS value, CASE WHEN count(v) < 2 OR stddev_pop(v) = 0 THEN 'deterministic' ELSE 'normal' END AS dist, round(avg(v), 5) AS p1, round(stddev_pop(v), 5) AS p2, NULL::DOUBLE AS p3 FROM l GROUP BY 1")
def _(spark, d):
    f = lambda m: V.log(spark, d, m).withColumn("value", F.least(F.col("value") / 200.0, F.lit(1.0)))
    return rounded(petro.model_inputs(petro.paired(f("view"), f("click")), "ft"), value=5, p1=5, p2=5)


@register("pick_curve", f"{V.with_('curve')}, c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'PHI_2019' WHEN seq % 3 = 1 THEN 'EFFPHI' ELSE 'GR' END AS name FROM curve), f AS (SELECT bore_id, min(CASE name WHEN 'EFFPHI' THEN 1 ELSE 2 END) AS first FROM c WHERE name <> 'GR' GROUP BY 1) SELECT c.seq FROM c JOIN f USING (bore_id) WHERE name <> 'GR' AND (CASE name WHEN 'EFFPHI' THEN 1 ELSE 2 END) = first")
def _(spark, d):
    name = F.when(F.col("seq") % 3 == 0, "PHI_2019").when(F.col("seq") % 3 == 1, "EFFPHI").otherwise("GR")
    c = V.curve(spark, d).withColumn("mnemonic", name).withColumn("load_seq", F.when(F.col("mnemonic") == "EFFPHI", 1).when(F.col("mnemonic") == "GR", 0).otherwise(2))
    return petro.pick_curve(c, "PHIE").select("seq")


@register("route_tops", "WITH w AS (SELECT n_name AS id, n_nationkey AS load_seq FROM nation WHERE n_nationkey % 2 = 0), r AS (SELECT n_nationkey AS rec, n_name || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ST2' ELSE 'X' END AS well FROM nation) SELECT rec, arg_min(id, load_seq) AS id, trim(substr(arg_min(well, load_seq), length(arg_min(id, load_seq)) + 2)) AS bore FROM r JOIN w ON replace(lower(well), ' ', '_') = replace(lower(id), ' ', '_') OR starts_with(replace(lower(well), ' ', '_'), replace(lower(id), ' ', '_') || '_') GROUP BY rec")
def _(spark, d):
    n = V.table(spark, d, "nation")
    tail = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, " ST2").otherwise("X")
    wells = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("load_seq"))
    return petro.route_tops(n.select(F.col("n_nationkey").alias("rec"), F.concat("n_name", tail).alias("well")), wells)


@register("uncertain_values", "SELECT p_partkey, round((p_size + p_size * 2) / 2.0, 6) AS uniform, round(exp(p_size / 10.0), 5) AS lognormal, 'assumed' AS provenance FROM part")
def _(spark, d):
    s = F.col("p_size").cast("double")
    p = V.table(spark, d, "part").select("p_partkey", U.uniform(s, s * 2).alias("u"), U.with_provenance(U.lognormal(s / 10, F.lit(1.0)), "assumed").alias("l"))
    return rounded(p.select("p_partkey", F.col("u.value").alias("uniform"), F.col("l.value").alias("lognormal"), F.col("l.provenance").alias("provenance")), lognormal=5)


_BORES_SQL = "WITH b AS (SELECT s_nationkey AS well, CASE s_suppkey % 4 WHEN 0 THEN '' ELSE 'ST' || (s_suppkey % 4) END AS bore, s_suppkey % 3 = 0 AS has_path FROM supplier), g AS (SELECT well, count(DISTINCT CASE WHEN has_path THEN bore END) AS n, min(CASE WHEN has_path THEN bore END) AS sole, list(bore) AS bores FROM b GROUP BY 1)"


def _bores(spark, d):
    k = F.col("s_suppkey") % 4
    return V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("well"), F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("ST"), k.cast("string"))).alias("bore"), (F.col("s_suppkey") % 3 == 0).alias("has_path"))


@register("bore_resolution", f"{_BORES_SQL} SELECT well, CASE WHEN well % 5 = 0 AND list_contains(bores, 'ST2') THEN 'ST2' WHEN n = 1 THEN sole ELSE '' END AS bore, CASE WHEN well % 5 = 0 AND list_contains(bores, 'ST2') THEN 'default' WHEN n = 1 THEN 'only path' ELSE 'main' END AS how FROM g")
def _(spark, d):
    defaults = V.table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("well"), F.lit("ST2").alias("bore"))
    return bores.resolve(_bores(spark, d), defaults)


@register("multibore_wells", f"{_BORES_SQL} SELECT well, n AS paths FROM g WHERE n > 1")
def _(spark, d):
    return bores.multibore(_bores(spark, d))


@register("bore_ids", "SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' A' ELSE ' ST2' END AS id FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey") % 3
    label = F.when(k == 0, F.lit("")).when(k == 1, F.lit("A")).otherwise(F.lit("ST2"))
    return V.table(spark, d, "supplier").select("s_suppkey", bores.bore_id(F.col("s_name"), label).alias("id"))


@register("active_paths", "WITH p AS (SELECT o_custkey % 100 AS bore_id, o_orderkey % 5 AS path_id, o_orderkey AS load_seq FROM orders), m AS (SELECT bore_id, path_id, max(load_seq) AS l FROM p GROUP BY 1, 2), b AS (SELECT bore_id, path_id, row_number() OVER (PARTITION BY bore_id ORDER BY (path_id = 2 AND bore_id % 3 = 0) DESC, l DESC, path_id DESC) AS k FROM m) SELECT p.bore_id, p.path_id, count(*) AS stations FROM p JOIN b ON p.bore_id = b.bore_id AND p.path_id = b.path_id AND k = 1 GROUP BY 1, 2")
def _(spark, d):
    p = V.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("bore_id"), (F.col("o_orderkey") % 5).alias("path_id"), F.col("o_orderkey").alias("load_seq"))
    chosen = p.where("bore_id % 3 = 0").select("bore_id").distinct().withColumn("path_id", F.lit(2).cast("long"))
    return bores.active(p, chosen).groupBy("bore_id", "path_id").agg(F.count("*").alias("stations"))


@register("path_range", f"{V.with_('survey')} SELECT bore_id, min(md) AS md_min, max(md) AS md_max FROM survey GROUP BY 1")
def _(spark, d):
    return path.md_range(path.from_input("stations", V.survey(spark, d).withColumn("seq", F.col("md")), 1000.0, 2000.0, 27.3))


@register("path_from_xyz", f"""{V.with_('point')}, s AS (SELECT *, point_id % 7 AS bore_id, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM point WINDOW w AS (PARTITION BY point_id % 7 ORDER BY point_id)) SELECT bore_id, round(sum(step) OVER (PARTITION BY bore_id ORDER BY point_id ROWS UNBOUNDED PRECEDING), 4) AS md, round(z, 4) AS z FROM s""")
def _(spark, d):
    rows = V.point(spark, d).select((F.col("point_id") % 7).alias("bore_id"), F.col("point_id").alias("seq"), "x", "y", "z")
    return rounded(path.from_input("xyz", rows).select("bore_id", "md", "z"), md=4, z=4)


@register("positioned_log", f"""{_AT_SQL.split(chr(10) + ' tg AS')[0].rstrip(',')}, lg AS (SELECT user_id AS bore, seq, md FROM (SELECT bore_id AS user_id, seq, md FROM ({V.SQL['curve'].split(' AS ', 1)[1][1:-1]}) WHERE mnemonic = 'view')),
 kk AS (SELECT lg.seq, lg.md, g.*, (lg.md - m0) / (m1 - m0) AS f, acos(least(greatest(n0 * n1 + e0 * e1 + d0 * d1, -1.0), 1.0)) AS beta FROM lg LEFT JOIN seg g ON lg.bore % 5 = g.bore_id AND lg.md >= m0 AND lg.md < m1),
 hh AS (SELECT *, sin((1 - f) * beta) / sin(beta) AS wa, sin(f * beta) / sin(beta) AS wb, (md - m0) / 2 * CASE WHEN f * beta < 1e-4 THEN 1 + (f * beta) ** 2 / 12 ELSE 2 / (f * beta) * tan(f * beta / 2) END AS hf FROM kk)
 SELECT seq, round(x0 + hf * (e0 + wa * e0 + wb * e1), 4) AS x, round(z0 - hf * (d0 + wa * d0 + wb * d1), 4) AS z FROM hh""")
def _(spark, d):
    curve = V.curve(spark, d).where("mnemonic = 'view'")
    every = curve.select("bore_id").distinct()
    ways = path.from_input("stations", V.survey(spark, d).withColumn("seq", F.col("md")), 1000.0, 2000.0, 27.3)
    own = every.withColumn("_k", F.col("bore_id") % 5).join(ways.withColumnRenamed("bore_id", "_k"), "_k").drop("_k")
    return rounded(path.positioned_log(curve, own).select("seq", "x", "z"), x=4, z=4)


@register("calculated_log_report", f"{V.with_('curve')}, b AS (SELECT bore_id, count(DISTINCT CASE WHEN mnemonic IN ('view', 'click') AND NOT (mnemonic = 'click' AND bore_id % 4 = 0) THEN mnemonic END) AS n FROM curve GROUP BY 1) SELECT bore_id, CASE WHEN n = 2 THEN 'created' ELSE 'skipped' END AS status FROM b")
def _(spark, d):
    c = V.curve(spark, d).where("NOT (mnemonic = 'click' AND bore_id % 4 = 0)")
    e = X.channel("view") + X.channel("click")
    return X.assign(c, "total", e, "view")[1].select("bore_id", "status")


@register("tops_in_order", f"{V.with_('tops')} SELECT bore_id, name, CASE name WHEN 'D' THEN 0 WHEN 'B' THEN 1 WHEN 'A' THEN 2 END AS ord FROM tops")
def _(spark, d):
    return bores.order_to_bores(V.tops(spark, d), ["D", "B", "A"]).select("bore_id", "name", "ord")


@register("view_bores", "WITH b AS (SELECT s_nationkey AS well, CASE s_suppkey % 4 WHEN 0 THEN '' ELSE 'ST' || (s_suppkey % 4) END AS bore, s_suppkey % 4 = 1 AS has_logs FROM supplier) SELECT well, CASE WHEN well % 5 = 0 AND max(bore = '') THEN '' ELSE coalesce(min(CASE WHEN has_logs THEN bore END), '') END AS bore FROM b GROUP BY 1")
def _(spark, d):
    b = _bores(spark, d).withColumn("has_logs", F.col("bore") == "ST1")
    defaults = b.where("well % 5 = 0 AND bore = ''").select("well", "bore")
    return bores.view_bore(b, defaults)


@register("raw_logs", f"""{V.with_('curve', V.log_sql('v', 'view'), V.log_sql('c', 'click'))}, g AS (SELECT bore_id, md FROM v UNION SELECT bore_id, md FROM c),
 gv AS (SELECT * FROM g WHERE bore_id IN (SELECT bore_id FROM v)), gc AS (SELECT * FROM g WHERE bore_id IN (SELECT bore_id FROM c)), {_lerp_sql('v', 'gv', 'x')}, {_lerp_sql('c', 'gc', 'y')},
 l AS (SELECT bore_id, 'view' AS mnemonic, md, x_v AS value FROM x UNION ALL SELECT bore_id, 'click', md, y_v FROM y) SELECT bore_id, mnemonic, round(md, 6) AS md, round(md - bore_id % 7, 6) AS tvd, round(value, 5) AS value FROM l""")
def _(spark, d):
    every = [V.log(spark, d, m).withColumn("mnemonic", F.lit(m)) for m in ("view", "click", "purchase")]
    curves = every[0].union(every[1]).union(every[2])
    kb = curves.select("bore_id").distinct().withColumn("kb", (F.col("bore_id") % 7).cast("double"))
    return rounded(logs.gather(curves, kb, names=["VIEW", "click"]), value=5)


@register("curve_flags", "SELECT p_partkey, p_partkey % 7 IN (0, 1, 3, 4, 6) AS flag FROM part")
def _(spark, d):
    names = F.array(*(F.lit(x) for x in ("NetFlag", "PAYFLAG", "GR", "myFacies", "lith", "LITHO", "CORE")))
    return V.table(spark, d, "part").select("p_partkey", logs.is_flag(F.get(names, (F.col("p_partkey") % 7).cast("int")), ["core"]).alias("flag"))


@register("flag_codes", f"{V.with_('curve')}, e AS (SELECT DISTINCT bore_id, mnemonic, round_even(value / 40, 0)::BIGINT AS code FROM curve) SELECT bore_id, mnemonic, string_agg(code::VARCHAR, ',' ORDER BY code) AS codes FROM e GROUP BY 1, 2")
def _(spark, d):
    codes = logs.flag_codes(V.curve(spark, d).withColumn("value", F.col("value") / 40))
    return codes.select("bore_id", "mnemonic", F.array_join("codes", ",").alias("codes"))
