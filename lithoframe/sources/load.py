"""Loading by content: what a file is decides which reader takes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import id_key
from ..operators import graph, petro, sets
from ..project import Project
from . import detect, shapes, text

SURFACES = {"irap_grid": text.irap_grid, "cps3_grid": text.cps3_grid}
POINTS = {"xyz_points": text.xyz_points, "csv_points": text.csv_points, "geojson": text.geojson_points, "earthvision": text.earthvision}
POLYGONS = {"xyz_points": text.xyz_polygons, "xyz_polygons": text.xyz_polygons, "geojson": text.geojson_rings, "cps3_lines": text.cps3_lines, "shapefile": shapes.shapefile_rings}


def _by_kind(spark: SparkSession, path: str, readers: dict, what: str) -> DataFrame:
    kinds = [r["kind"] for r in detect.scan(spark, path).select("kind").distinct().collect()]  # a dozen kinds at most
    if len(kinds) != 1 or kinds[0] not in readers:
        raise ValueError(f"{path} is {', '.join(sorted(str(k) for k in kinds)) or 'missing'}, not {what}")
    return readers[kinds[0]](spark, path)


def surface(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a grid file of any known format."""
    return _by_kind(spark, path, SURFACES, "a surface")


def points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file of any known format."""
    return _by_kind(spark, path, POINTS, "points")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rings of a file of any known format; plain coordinates are rings ended by separator rows."""
    return _by_kind(spark, path, POLYGONS, "polygons")


def _stem(path):
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def well_files(spark: SparkSession, folder: str, well: str) -> DataFrame:
    """``path, kind, bore`` of a well's files in a tree: those named after it, or all of them if none is.

    With several path files each is a bore, by what its name has after the well's id; logs go to the bore whose label
    is in their name, everything else to the main bore.
    """
    key = id_key(F.lit(well))
    files = detect.scan(spark, folder).withColumn("stem", id_key(F.regexp_replace(_stem(F.col("path")), "%20", " ")))
    files = files.withColumn("own", (F.col("stem") == key) | F.col("stem").startswith(F.concat(key, F.lit("_"))))
    named = not files.where("own").isEmpty()
    files = files.where("own") if named else files
    rest = F.trim(F.regexp_replace(F.when(F.col("own"), F.substring("stem", F.char_length(key) + 1, 1_000)).otherwise(F.lit("")), "_", " "))
    files = files.withColumn("label", F.upper(F.trim(rest)))
    labels = files.where("kind = 'wellpath'").select(F.col("label").alias("bore")).distinct()
    if labels.count() < 2:
        return files.select("path", "kind", F.lit("").alias("bore"))
    own = F.when(F.col("kind") == "wellpath", F.col("label"))
    met = files.join(F.broadcast(labels), F.array_contains(F.split("label", " "), F.col("bore")) & (F.col("kind") == "las"), "left")
    return met.groupBy("path", "kind", "label").agg(F.min("bore").alias("_bore")).select("path", "kind", F.coalesce(own, "_bore", F.lit("")).alias("bore"))


def well(spark: SparkSession, folder: str, name: str, head: tuple[float, float] | None = None, kb: float = 0.0) -> dict[str, DataFrame]:
    """``curves``, ``paths`` and ``tops`` of a well, each row with its ``bore``; kinds without files are left out.

    A file that its reader cannot take is left out with its reason, in ``skipped`` (path, kind, problem) if there are any. Without a path
    file, and with the well's ``head``, the main bore has a vertical one (two stations, z from ``kb``) over its logs' depths.
    """
    files = well_files(spark, folder, name).cache()
    skipped = graph.cut(text.problems(files).join(files.select("path", "kind"), "path").select("path", "kind", "problem"))
    good = files.join(skipped, "path", "left_anti")
    out = {} if skipped.isEmpty() else {"skipped": skipped}
    for kind, what, reader in (("las", "curves", text.las), ("wellpath", "paths", text.wellpath), ("tops_csv", "tops", text.tops_csv)):
        paths = [r["path"] for r in good.where(F.col("kind") == kind).collect()]  # a well's files
        if paths:
            rows = reader(spark, paths)
            out[what] = rows.join(files.select("path", "bore"), "path").withColumn("well", F.lit(name))
    if head is not None and "paths" not in out and "curves" in out:
        span = out["curves"].where("md IS NOT NULL").groupBy("well", "bore").agg(F.min("md").alias("low"), F.max("md").alias("high")).where("low < high")
        flat = span.select("well", "bore", F.explode(F.array("low", "high")).alias("md"))
        out["paths"] = flat.select(F.lit(None).cast("string").alias("path"), "well", "bore", "md", F.lit(float(head[0])).alias("x"), F.lit(float(head[1])).alias("y"), (F.col("md") - kb).alias("z"), F.lit(0.0).alias("inc"), F.lit(0.0).alias("azi"))
    files.unpersist()
    return out


def well_tops(spark: SparkSession, path, wells: DataFrame, bores: DataFrame, hints: list[str] = ()) -> dict:
    """``tops`` and ``contacts`` of a tops file for loaded wells (``id, load_seq``) and their ``bores`` (``id, bore``), and the ``strat`` column.

    Horizons are tops, others contacts (``id, bore, name, md``); picks of wells that are not loaded are left out. A bore
    that a well does not have is its main one. ``strat`` is a list of names, from the horizons of every well in the file,
    loaded or not, and the order of ``hints`` (``A < B``), whose sides must mean one horizon each.
    """
    recs = graph.cut(text.well_tops(spark, path).withColumn("rec", F.struct("path", "seq")))
    kind = F.lower("kind")
    met = recs.join(petro.route_tops(recs.select("rec", "well"), wells, bores), "rec")
    part = lambda what: met.where(kind == what).select("id", "bore", F.col("surface").alias("name"), "md")
    horizons = recs.where(kind == "horizon").select("well", F.col("surface").alias("name"), "md", "seq")
    return {"tops": part("horizon"), "contacts": part("other"), "strat": sets.strat_order(horizons, sets.resolve_hints(horizons, list(hints)))}


#: Words of a file's or folder's name that say what GeoJSON holds where its shapes do not, names that are no
#: well's, and ends of names that mean a bore.
POLYGON_WORDS, POINT_WORDS = ("poly", "outline", "boundary", "fault"), ("point", "sample", "welltop")
GENERIC = ("logs", "paths", "wells", "tops", "surfaces", "points", "polygons", "sample", "log", "core", "complogs", "comp_logs")
BORES = r"(?i)^(?:[ABC]|ST.*|COMPLOG.*)$"


def geojson_roles(spark: SparkSession, path) -> DataFrame:
    """``path, role`` of GeoJSON files: ``points`` or ``polygons`` by the shapes they hold, else by name, else ``ambiguous``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.decode("content", "ISO-8859-1")).alias("text"))
    area, point = F.col("text").rlike('"(?:multi)?polygon"'), F.col("text").rlike('"(?:multi)?point"')
    named = lambda words: F.lower(_stem(F.col("path"))).rlike("|".join(words))
    role = F.when(area & ~point, "polygons").when(point & ~area, "points").when(named(POLYGON_WORDS), "polygons").when(named(POINT_WORDS), "points")
    return files.select("path", role.otherwise("ambiguous").alias("role"))


def _well_token(token):
    """The well that a name stands for: number and block joined by a slash, or the name without a bore; none if it is generic."""
    parts = F.filter(F.split(F.regexp_replace(token, " ", "_"), "_"), lambda p: p != "")
    block = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).rlike("^[0-9]+$") & F.get(parts, F.lit(1)).rlike("^[0-9]")
    bore = (F.size(parts) >= 2) & F.element_at(parts, -1).rlike(BORES)
    whole = F.when(token.rlike("^[0-9]{2}.*_"), F.replace(token, F.lit("_"), F.lit("/"))).otherwise(token)
    out = F.when(block, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    out = out.when(bore, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")).when(F.lower(token).isin(*GENERIC), None)
    return F.when(F.size(parts) > 0, out.otherwise(whole))


def well_ids(files: DataFrame, folder: str) -> DataFrame:
    """``files`` (with ``path``) with the ``well`` that each belongs to, by its own name, else by the nearest folder's, else its stem."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    path = F.regexp_replace("path", "%20", " ")
    steps = F.split(path, "/")
    inside = F.slice(steps, F.greatest(F.array_position(steps, root), F.lit(1)).cast("int"), F.size(steps))
    above = F.reverse(F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))))
    stem = _stem(path)
    near = F.get(F.filter(F.transform(above, _well_token), lambda t: t.isNotNull()), F.lit(0))
    return files.withColumn("well", F.coalesce(_well_token(stem), near, stem))


def tree(spark: SparkSession, folder: str, unit: str = "m") -> tuple[Project, DataFrame]:
    """A project of everything in a folder tree, and ``path, kind, role, well, name, reason`` of its files.

    Files are read by kind, each kind as one table, however many files it has. Logs and paths belong to wells, by
    :func:`well_ids` (their bores are told apart by :func:`well`); tops to the wells they name (``pick_well``) or belong to; surfaces, points and polygons are named by their stem, or by their
    way from the folder where files of a role share one. ``reason`` says why a file was left out, broken ones included.
    """
    files = detect.scan(spark, folder)
    shapes_ = [r["path"] for r in files.where("kind = 'geojson'").select("path").collect()]
    roles = geojson_roles(spark, shapes_) if shapes_ else spark.createDataFrame([], "path string, role string")
    fixed = {"las": "curves", "wellpath": "paths", "tops": "tops", "tops_csv": "tops", "shapefile": "polygons", "xyz_polygons": "polygons", "cps3_lines": "polygons"}
    fixed |= dict.fromkeys(SURFACES, "surfaces") | {k: "points" for k in POINTS if k != "geojson"}
    by_kind = F.create_map(*(F.lit(x) for pair in fixed.items() for x in pair))[F.col("kind")]
    files = files.join(roles, "path", "left").withColumn("role", F.coalesce("role", by_kind))
    reason = F.when(F.col("kind").isNull(), "unknown kind").when(F.col("kind") == "xml", "sidecar").when(F.col("role") == "ambiguous", "points or polygons").when(F.col("role").isNull(), "no reader")
    # a file that its reader cannot take must not make the others of its kind fail
    bad = graph.cut(text.problems(files.select("path", "kind")))
    files = well_ids(files, folder).join(bad, "path", "left").withColumn("reason", F.coalesce(reason, "problem")).drop("problem")
    whole = F.regexp_replace(F.regexp_replace("path", "%20", " "), r"\.[^./]*$", "")
    inside = F.regexp_replace(whole, rf"^.*?/\Q{folder.rstrip('/').rsplit('/', 1)[-1]}\E/", "")
    shared = F.count("*").over(Window.partitionBy("role", "stem")) > 1
    files = files.withColumn("stem", _stem(F.regexp_replace("path", "%20", " "))).withColumn("name", F.when(shared, inside).otherwise(F.col("stem")))
    files = files.select("path", "kind", "role", "well", "name", "reason").cache()
    out = Project(spark, unit)
    groups: dict[tuple[str, str], list] = {}
    for r in files.where("reason IS NULL").orderBy("path").collect():  # names of files, not their content
        groups.setdefault((r["role"], r["kind"]), []).append(r)
    readers = {"curves": {"las": text.las}, "paths": {"wellpath": text.wellpath}, "tops": {"tops": text.well_tops, "tops_csv": text.tops_csv}, "surfaces": SURFACES, "points": POINTS, "polygons": POLYGONS}
    labels = files.select("path", "well", "name")
    for (role, kind), rows in groups.items():
        label = F.col("well") if role in ("curves", "paths") else F.col("name")
        own = labels.select("path", label.alias("name"), *(["well"] if role in ("curves", "paths", "tops") else []))
        table = readers[role][kind](spark, [r["path"] for r in rows])
        table = table.withColumnsRenamed({"name": "pick", "well": "pick_well"})
        table = table.join(F.broadcast(own) if len(rows) <= 100_000 else own, "path")
        names = list(dict.fromkeys(r["well"] if role in ("curves", "paths") else r["name"] for r in rows))
        out.elements[role] = out.elements[role].unionByName(table, allowMissingColumns=True) if role in out.elements else table
        out.names[role] = list(dict.fromkeys([*out.names.get(role, []), *names]))
    out.history.append(f"import {folder}")
    return out, files
