"""Text formats as DataFrame expressions: a file per row for grids, a line per row for points and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sentinel

IRAP_UNDEFINED = 9999900.0
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, line`` in file order."""
    return _whole(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))


def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def irap_grid(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of IRAP classic grids: ``path``, the geometry, ``i, j, z``; values run along x first."""
    t = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    g = _whole(spark, path).select("path", t.alias("t")).where(F.size("t") >= 19)
    at = lambda k: F.get("t", F.lit(k))
    g = g.select(
        "path", at(1).cast("int").alias("nrow"), at(2).alias("xinc"), F.abs(at(3)).alias("yinc"), (at(3) < 0).alias("yflip"), at(4).alias("xori"), at(6).alias("yori"),
        at(8).cast("int").alias("ncol"), at(9).alias("rotation_deg"), F.posexplode(F.slice("t", 20, F.size("t"))).alias("k", "v"),
    ).where(F.col("k") < F.col("ncol") * F.col("nrow"))
    z = F.when(F.col("v") < IRAP_UNDEFINED, F.col("v"))
    return g.select("path", "ncol", "nrow", "xori", "yori", "xinc", "yinc", "rotation_deg", "yflip", (F.col("k") % F.col("ncol")).alias("i"), F.floor(F.col("k") / F.col("ncol")).cast("int").alias("j"), z.alias("z"))


def cps3_grid(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of CPS-3 grids; values run along x, rows from south to north; short files end undefined."""
    text = F.col("text")
    pick = lambda tag, k: F.try_element_at(_numbers(F.regexp_extract(text, rf"(?m)^{tag}([^\r\n]*)", 1)), F.lit(k))
    body = F.regexp_replace(text, r"(?m)^(?:FS|!|->)[^\r\n]*$", " ")
    g = _whole(spark, path).select(
        "path", pick("FSLIMI", 1).alias("xori"), pick("FSLIMI", 3).alias("yori"), pick("FSNROW", 1).cast("int").alias("nrow"), pick("FSNROW", 2).cast("int").alias("ncol"),
        pick("FSXINC", 1).alias("xinc"), pick("FSXINC", 2).alias("yinc"), F.element_at(_numbers(F.regexp_extract(text, r"(?m)^FSASCI([^\r\n]*)", 1)), -1).alias("undefined"), _numbers(body).alias("v"),
    )
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ncol") * F.col("nrow") - 1)))
    v = F.get("v", F.col("k"))
    z = F.when((F.abs(v) < 1e29) & ~(F.abs(v - F.col("undefined")) <= 1e-9 * F.greatest(F.abs("undefined"), F.lit(1.0))), v)
    return g.select("path", "ncol", "nrow", "xori", "yori", "xinc", "yinc", (F.col("k") % F.col("ncol")).alias("i"), F.floor(F.col("k") / F.col("ncol")).cast("int").alias("j"), z.alias("z"))


def cps3_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rings of CPS-3 line files: ``path, poly_id, vseq, x, y``; each ``->`` begins one."""
    run = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(spark, path).withColumn("poly_id", F.sum(F.col("line").startswith("->").cast("int")).over(run)).withColumn("v", _numbers(F.col("line")))
    rows = rows.where("poly_id > 0 AND get(v, 0) IS NOT NULL AND get(v, 1) IS NOT NULL AND get(v, 2) IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("path", "poly_id").orderBy("n")) - 1
    return rows.select("path", "poly_id", order.alias("vseq"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


#: Lines that are looked at, what says in them that a file has another format, and that format.
FOREIGN_LINES = 60
FOREIGN = (
    (r"(?im)^\s*~", "LAS"),
    (r"(?im)^\s*(?:->|FSASCI|FFASCI|FFATTR|FSNROW|FSXINC|FSLIMI)", "CPS-3"),
    (r"(?i)EARTHVISION|GRID_SIZE|GRID_SPACE|(?m:^\s*#.*FIELD:)", "EarthVision grid"),
)


def _plain(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain coordinate files; files of another format raise."""
    whole = _whole(spark, path)
    top = F.array_join(F.slice(F.split("text", r"\r?\n"), 1, FOREIGN_LINES), "\n")
    text = F.col("text")
    for pattern, name in FOREIGN:
        text = F.when(top.rlike(pattern), F.raise_error(F.concat(F.col("path"), F.lit(f" looks like {name}, not plain coordinates"))).cast("string")).otherwise(text)
    return whole.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))


def xyz_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of plain files; comments and separator rows (x = 999) are left out, a bad number or another format raises."""
    rows = _plain(spark, path).where(~F.trim("line").rlike(r"^(?:[#!].*)?$")).withColumn("v", _numbers(F.col("line")))
    bad = (F.size("v") < 3) | F.get("v", F.lit(0)).isNull() | F.get("v", F.lit(1)).isNull() | F.get("v", F.lit(2)).isNull()
    x = F.when(bad, F.raise_error(F.concat(F.lit("not three numbers: "), F.col("line"))).cast("double")).otherwise(F.get("v", F.lit(0)))
    return rows.select("path", F.col("n").alias("seq"), x.alias("x"), F.get("v", F.lit(1)).alias("y"), sentinel(F.get("v", F.lit(2))).alias("z")).where("x <> 999.0")


def xyz_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rings ended by separator rows; empty rings are dropped, another format raises."""
    run = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _plain(spark, path).where(~F.trim("line").rlike(r"^(?:[#!].*)?$")).withColumn("v", _numbers(F.col("line")))
    rows = rows.withColumn("end", (F.get("v", F.lit(0)) == 999.0).cast("int")).withColumn("poly_id", F.sum("end").over(run)).where("end = 0")
    order = F.row_number().over(Window.partitionBy("path", "poly_id").orderBy("n")) - 1
    return rows.select("path", "poly_id", order.alias("vseq"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


def earthvision(spark: SparkSession, path: str) -> DataFrame:
    """Defined nodes of EarthVision grids: ``path, seq, x, y, z, column, row``."""
    null = F.try_element_at(_numbers(F.regexp_extract("text", r"(?im)^#\s*null[^:\r\n]*:([^\r\n]*)", 1)), F.lit(1))
    rows = _whole(spark, path).select("path", null.alias("undefined"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    rows = rows.where(~F.trim("line").rlike(r"^(?:#.*)?$")).withColumn("v", _numbers(F.col("line"))).where("size(v) >= 3")
    z = F.get("v", F.lit(2))
    ok = (F.abs(z) < 1e29) & F.coalesce(F.abs(z - F.col("undefined")) > 1e-9 * F.greatest(F.abs("undefined"), F.lit(1.0)), F.lit(True))
    return rows.where(ok).select("path", F.col("n").alias("seq"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"), z.alias("z"), F.get("v", F.lit(3)).alias("column"), F.get("v", F.lit(4)).alias("row"))


def csv_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Points of a CSV file with named coordinates; other columns are attributes if every cell is a number."""
    raw = spark.read.option("header", True).csv(path)
    others = [c for c in raw.columns if c not in (x, y, z)]
    whole = raw.agg(*(F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in others)).head() if others else None
    keep = [c for c in others if whole[c]]
    return raw.select(*(F.col(f"`{a}`").cast("double").alias(b) for a, b in ((x, "x"), (y, "y"), (z, "z"))), *(F.col(f"`{c}`").cast("double").alias(c.strip().lower().replace(" ", "_").replace("-", "_")) for c in keep))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """``path, feature, type, coordinates, properties`` (JSON texts) of each feature of a collection, or of a feature a line."""
    one = "struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
    lines = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, one))
    every = F.when(F.col("text").rlike(r'"type"\s*:\s*"FeatureCollection"'), F.from_json("text", f"features array<{one}>")["features"]).otherwise(lines)
    f = _whole(spark, path).select("path", F.posexplode(every).alias("feature", "f"))
    return f.select("path", "feature", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Points with their numeric properties as a map; a missing z is 0."""
    f = geojson(spark, path).where("type = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>"))
    number = F.map_filter(F.transform_values("properties", lambda _, v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))), lambda _, v: v.isNotNull())
    return f.select("path", "feature", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"), F.coalesce(F.get("c", F.lit(2)), F.lit(0.0)).alias("z"), number.alias("attributes"))


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """Every ring or line of the features as a polygon of its own: ``path, poly_id, vseq, x, y``."""
    f = geojson(spark, path)
    line, area, many = (F.from_json("coordinates", t) for t in ("array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"))
    kinds = F.when(F.col("type") == "LineString", F.array(line)).when(F.col("type").isin("Polygon", "MultiLineString"), area).when(F.col("type") == "MultiPolygon", F.flatten(many))
    r = f.select("path", "feature", F.posexplode(kinds).alias("part", "ring"))
    ident = F.dense_rank().over(Window.partitionBy("path").orderBy("feature", "part")).alias("poly_id")
    return r.select("path", ident, "ring").select("path", "poly_id", F.posexplode("ring").alias("vseq", "c")).select("path", "poly_id", "vseq", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))


def tops_csv(spark: SparkSession, path: str, name: str = "name", md: str = "md") -> DataFrame:
    """``path, seq, name, md`` of formation tops in a CSV file, by column names; a depth that is no number raises."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    for column in (name, md):
        if column not in raw.columns:
            raise KeyError(f"no column {column}")
    depth = F.trim(F.col(f"`{md}`")).try_cast("double")
    depth = F.when(depth.isNull(), F.raise_error(F.concat(F.lit("not a depth: "), F.coalesce(F.col(f"`{md}`"), F.lit("")))).cast("double")).otherwise(depth)
    # this reader gives paths as URIs, the others as they are
    path = F.url_decode(F.replace(F.regexp_replace(F.input_file_name(), "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    return raw.select(path.alias("path"), F.monotonically_increasing_id().alias("seq"), F.col(f"`{name}`").alias("name"), depth.alias("md"))


def wellpath_head(spark: SparkSession, path: str) -> DataFrame:
    """``path, well, x, y, kb, crs`` of well path headers; what a header does not say is undefined."""
    say = lambda *labels: F.coalesce(*(F.nullif(F.trim(F.regexp_extract("text", rf"(?im)^#[^\n]*{label}[^:=\n]*[:=]?\s*([^\r\n]*)", 1)), F.lit("")) for label in labels))
    number = lambda c: F.regexp_extract(c, NUMBER, 0).try_cast("double")
    return _whole(spark, path).select(
        "path", say("WELL NAME", "WELL:").alias("well"), number(say("HEAD X", "X-COORDINATE")).alias("x"), number(say("HEAD Y", "Y-COORDINATE")).alias("y"),
        number(say(r"\bKB\b", "DATUM")).alias("kb"), say(r"\bCRS\b").alias("crs"),
    )


def wellpath(spark: SparkSession, path: str) -> DataFrame:
    """Stations of well path exports: columns 1 MD, 2 X, 3 Y, 5 TVD, 9 inclination, 11 azimuth."""
    rows = _lines(spark, path).where(~F.trim("line").startswith("#")).withColumn("v", _numbers(F.col("line")))
    rows = rows.where(F.size("v") >= 11).where(F.forall("v", lambda x: x.isNotNull()))
    return rows.select("path", F.col("n").alias("seq"), F.get("v", F.lit(0)).alias("md"), F.get("v", F.lit(1)).alias("x"), F.get("v", F.lit(2)).alias("y"), F.get("v", F.lit(4)).alias("tvd"), F.get("v", F.lit(8)).alias("inc"), F.get("v", F.lit(10)).alias("azi"))


def well_tops(spark: SparkSession, path: str) -> DataFrame:
    """Tops and contacts after ``END HEADER``: ``path, seq, md, kind, surface, well``; picks without depth are left out."""
    run = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = _lines(spark, path).withColumn("body", F.max((F.upper(F.trim("line")) == "END HEADER").cast("int")).over(run)).where("body = 1")
    f = F.transform(F.regexp_extract_all("line", F.lit(r'("[^"]*"|\S+)'), F.lit(1)), lambda x: F.regexp_replace(x, '"', ""))
    rows = rows.withColumn("f", f).where(F.size("f") >= 11).withColumn("md", F.get("f", F.lit(6)).try_cast("double"))
    return rows.where("md IS NOT NULL AND NOT isnan(md) AND md <> -999").select("path", F.col("n").alias("seq"), "md", F.get("f", F.lit(8)).alias("kind"), F.get("f", F.lit(9)).alias("surface"), F.get("f", F.lit(10)).alias("well"))


def las(spark: SparkSession, path: str) -> DataFrame:
    """Long curves of LAS 1.2, 2.0 and 3.0 files: ``path, mnemonic, unit, seq, md, value``; the first curve is depth.

    Wrapped data raise; ragged rows end undefined.
    """
    w = _whole(spark, path)
    text = F.col("text")
    section = lambda names: F.regexp_extract(text, rf"(?ims)^~(?:{names})[^\n]*\n(.*?)(?=^~|\Z)", 1)
    undefined = F.coalesce(F.regexp_extract(text, r"(?im)^\s*NULL\s*\.[^\s]*\s+([-+0-9.eE]+)", 1).try_cast("double"), F.lit(-999.25))
    wrapped = text.rlike(r"(?im)^\s*WRAP\s*\.\s+YES")
    curve = F.filter(F.split(section("C|Log_Definition"), r"\r?\n"), lambda x: x.rlike(r"^\s*[^#\s][^.]*\."))
    curve = F.transform(curve, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^.]*)\.", 1)).alias("mnemonic"), F.regexp_extract(x, r"^\s*[^.]*\.(\S*)", 1).alias("unit")))
    comma = F.when(text.rlike(r"(?im)^\s*DLM\s*\.\s+COMMA"), F.lit(r"\s*,\s*")).when(text.rlike(r"(?im)^\s*DLM\s*\.\s+TAB"), F.lit("\t")).otherwise(F.lit(r"\s+"))
    w = w.select("path", undefined.alias("undefined"), curve.alias("curves"), comma.alias("dlm"), F.when(wrapped, F.raise_error(F.lit("wrapped LAS data")).cast("string")).otherwise(section("A|Log_Data")).alias("data"))
    rows = w.select("path", "undefined", "curves", "dlm", F.posexplode(F.filter(F.split("data", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))).alias("seq", "line"))
    v = F.transform(F.split(F.trim("line"), F.col("dlm")), lambda x: x.try_cast("double"))
    rows = rows.select("path", "undefined", "seq", "curves", v.alias("v"))
    each = F.transform(F.sequence(F.lit(1), F.size("curves") - 1), lambda k: F.struct(F.get("curves", k)["mnemonic"].alias("mnemonic"), F.get("curves", k)["unit"].alias("unit"), F.get("v", k).alias("value")))
    rows = rows.where(F.size("curves") > 1).select("path", "seq", F.get("v", F.lit(0)).alias("md"), "undefined", F.inline(each))
    value = F.when((F.col("value") != F.col("undefined")) & ~F.isnan("value"), F.col("value"))
    return rows.where("md IS NOT NULL").select("path", "mnemonic", "unit", "seq", "md", value.alias("value"))


def problems(files: DataFrame) -> DataFrame:
    """``path, problem`` of files (``path, kind``) that their reader cannot take, by content; others are left out.

    Looks for what would make a reader fail or find nothing: wrapped LAS data or LAS without curves or data, rows of plain
    points that are no three numbers, grids without their header, well paths without their columns, GeoJSON that is none.
    """
    spark = files.sparkSession
    wanted = files.where(F.col("kind").isin("las", "xyz_points", "irap_grid", "cps3_grid", "wellpath", "geojson"))
    paths = [r["path"] for r in wanted.select("path").collect()]  # names of files, as readers get them
    if not paths:
        return files.select("path", F.lit("").alias("problem")).limit(0)
    text, kind = F.col("text"), F.col("kind")
    rows = F.filter(F.split(text, r"\r?\n"), lambda x: ~F.trim(x).rlike(r"^(?:[#!].*)?$"))
    short = F.exists(rows, lambda x: (F.size(v := _numbers(x)) < 3) | F.exists(F.slice(v, 1, 3), lambda n: n.isNull()))
    foreign = F.lit(False)
    top = F.array_join(F.slice(F.split("text", r"\r?\n"), 1, FOREIGN_LINES), "\n")
    for pattern, _ in FOREIGN:
        foreign = foreign | top.rlike(pattern)
    lacks = lambda pattern: ~text.rlike(pattern)
    numbers = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    found = (
        F.when((kind == "las") & text.rlike(r"(?im)^\s*WRAP\s*\.\s+YES"), "wrapped data")
        .when((kind == "las") & lacks(r"(?im)^~(?:C|Log_Definition)"), "no curves").when((kind == "las") & lacks(r"(?im)^~(?:A|Log_Data)"), "no data")
        .when((kind == "xyz_points") & foreign, "another format").when((kind == "xyz_points") & short, "a row is not three numbers")
        .when((kind == "irap_grid") & ((F.size(numbers) < 19) | F.exists(F.slice(numbers, 1, 19), lambda x: x.try_cast("double").isNull())), "no header")
        .when((kind == "cps3_grid") & (lacks(r"(?m)^FSLIMI") | lacks(r"(?m)^FSNROW")), "no header")
        .when((kind == "wellpath") & lacks(r"(?im)^\s*MD\s.*(?:INCL|AZIM)"), "no columns")
        .when((kind == "geojson") & F.try_parse_json(text).isNull() & F.exists(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "struct<type: string>")["type"].isNull()), "no JSON")
    )
    return _whole(spark, paths).join(wanted.select("path", "kind"), "path").select("path", found.alias("problem")).where("problem IS NOT NULL")


def crs_label(spark: SparkSession, path: str) -> DataFrame:
    """The label in a coordinate-system sidecar."""
    patterns = (r"(?is)<label>\s*(.*?)\s*</label>", r"(?is)<crs>\s*(.*?)\s*</crs>", r'(?i)\blabel\s*=\s*"([^"]*)"', r'(?i)\bname\s*=\s*"([^"]*)"')
    got = [F.regexp_extract("text", p, 1) for p in patterns]
    return _whole(spark, path).select("path", F.coalesce(*(F.when(g != "", g) for g in got)).alias("label"))
