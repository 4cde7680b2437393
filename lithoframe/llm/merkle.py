"""Merkle manifest of a dataset: one root that stands for every row, and a proof for each row.

A leaf is the SHA-256 of a row's columns, each as ``-`` if null, else as its number of UTF-8 bytes, ``:`` and the value.
The leaves of a group stand in order of the key and every ``arity`` nodes become the SHA-256 of their hex digests until
one is left (a last run may be shorter, even one node); the groups' roots, ordered by group, are collapsed likewise.

Leaves are numbered by ranges of keys (a count per range gives its offset, so that no task has a whole group) and gathered
into blocks of ``arity ** HEIGHT`` in order. A block is one row whose levels higher-order functions collapse: ``sequence``
over levels and runs, ``transform`` and ``slice`` over nodes, ``aggregate`` from level to level. Block roots are the
leaves of the next tier, until each group has one. Proofs go down the same tiers.

A null group comes first, then groups by bytes; a null key comes first in its group; rows that repeat a key are ordered by
their digests, and equal rows have equal leaves, each its own place. A null text differs from an empty one. An empty
table has no root (None) and no proofs. Columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 3
#: Levels of a block: at most ``ARITY ** HEIGHT`` digests are one row.
HEIGHT = 6
#: Rows of a range of keys, about.
RANGE_ROWS = 250_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""

    def said(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*(said(v) for v in values))


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def levels(nodes: Column, height: Column, arity: int = ARITY) -> Column:
    """All levels of a block: ``nodes`` first, then ``height`` times the digests of its runs."""

    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), _div(F.size(below) - 1, arity))
        return F.transform(runs, lambda r: digest(_joined(F.slice(below, r * arity + 1, arity))))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))))


def siblings(all_levels: Column, at: Column, arity: int = ARITY, height: int = HEIGHT) -> Column:
    """The nodes beside the path from entry ``at`` (0-based) up, level by level, joined: ``left`` and ``right`` of it."""
    powers = F.array(*(F.lit(arity**k) for k in range(height)))

    def beside(level: Column) -> Column:
        node, nodes = _div(at, F.get(powers, level)), F.get(all_levels, level)
        first = _div(node, arity) * arity
        return F.struct(_joined(F.slice(nodes, first + 1, node - first)).alias("left"), _joined(F.slice(nodes, node + 2, first + arity - 1 - node)).alias("right"))

    steps = F.when(F.size(all_levels) > 1, F.sequence(F.lit(0), F.size(all_levels) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, beside)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """All digests of a path, one after another."""
    return _joined(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (a stored table) with ``pos``, 0-based in its group, and ``n``, the group's rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    # the number of a row only parts equal rows, so that many of them are not one range
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_row")
    placed = written(dealt.withColumn("_part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    every = Window.partitionBy(group)
    offsets = sizes.select(
        F.col(group).alias("_group"), F.col("_part").alias("_range"), F.sum("_size").over(every).alias("n"),
        F.coalesce(F.sum("_size").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    own = placed.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_row")) - 1)
    met = own.join(offsets, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_range")))
    return met.withColumn("pos", F.col("_offset") + F.col("_at")).drop("_group", "_range", "_offset", "_at", "_part", "_row")


def _tiers(rows: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Stored blocks, tier by tier: (grp, block, n, entries, levels); ``rows`` has grp, pos, n, hash and what else entries keep."""
    wide, out = arity**height, []
    while True:
        rest = [c for c in rows.columns if c not in ("grp", "pos", "n")]
        blocks = rows.groupBy("grp", F.expr(f"pos div {wide}").alias("block")).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("entries")
        )
        depth = sum(((F.col("n") > arity**k).cast("int") for k in range(height)), F.lit(0))
        out.append(written(blocks.withColumn("levels", levels(F.col("entries.hash"), depth, arity)), "blocks"))
        more = out[-1].where(F.col("n") > wide)
        if more.isEmpty():
            return out
        rows = more.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), _root().alias("hash"))


def _root() -> Column:
    return F.get(F.element_at("levels", -1), F.lit(0))


def _paths(tiers: list[DataFrame], tops: DataFrame, arity: int, height: int) -> DataFrame:
    """Each entry of the lowest tier with its path to the root; ``tops`` (grp, path) leads on from each group's root."""
    wide, above = arity**height, None
    for blocks in reversed(tiers):
        done = blocks.where(F.col("n") <= wide).select("grp", "block").join(tops, "grp")
        above = done if above is None else done.unionByName(above)
        each = blocks.join(above, ["grp", "block"]).select("grp", "levels", "path", F.posexplode("entries").alias("at", "entry"))
        path = F.concat(siblings(F.col("levels"), F.col("at"), arity, height), "path")
        found = each.select("grp", "entry", path.alias("path"))
        above = found.select("grp", F.col("entry.pos").alias("block"), "path")
    return found


@dataclass
class Manifest:
    """``tiers``: blocks of leaves and of block roots; ``groups`` (grp, subroot, path from it to the root); ``root``."""

    tiers: list[DataFrame]
    groups: DataFrame
    root: str | None
    arity: int
    height: int


def build(rows: DataFrame, group: str, key: str, digests: str, arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """The manifest of ``rows`` (group, key, digest of each leaf, and further columns that its entries keep)."""
    # one string per group, null first and then by bytes
    grp = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    own = rows.select(grp.alias("grp"), F.col(key).alias("key"), F.col(digests).alias("hash"), *(c for c in rows.columns if c not in (group, key, digests)))
    leaves = numbered(written(own, "leaves"), "grp", ["key", "hash"])
    tiers = _tiers(leaves, arity, height)
    wide = arity**height
    tops = [t.where(F.col("n") <= wide).select("grp", _root().alias("hash")) for t in tiers]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = numbered(written(subroots.select(F.lit("").alias("all"), F.col("grp").alias("of"), "hash"), "subroots"), "all", ["of"])
    upper = _tiers(subroots.withColumnRenamed("all", "grp"), arity, height)
    root = upper[-1].where(F.col("n") <= wide).select(_root()).head()
    start = rows.sparkSession.createDataFrame([("", [])], "grp string, path array<struct<left: string, right: string>>")
    groups = _paths(upper, start, arity, height).select(F.col("entry.of").alias("grp"), F.col("entry.hash").alias("subroot"), "path")
    return Manifest(tiers, written(groups, "groups"), root[0] if root else None, arity, height)


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf with its path: ``entry`` (pos, hash, key and what was kept), ``subroot`` and ``path``, a (left, right) a level."""
    found = _paths(manifest.tiers, manifest.groups.select("grp", "path"), manifest.arity, manifest.height)
    return found.join(manifest.groups.select("grp", "subroot"), "grp").select("entry", "subroot", "path")


def query(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and every document checked against it after line ends were lost in some."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0) & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(hit, of(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    manifest = build(rows, "source", "doc_id", "leaf")
    again = folded(F.coalesce("entry.changed", "entry.hash"), F.col("path"))
    return proofs(manifest).select(
        F.col("entry.key").alias("doc_id"), F.col("entry.hash").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _said(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, base: str) -> str:
    return f"""{name}(source, lvl, idx, n, h) AS ({base}
 UNION ALL SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY source, lvl, idx // 3, n)"""


# crc32 by the definition: 8 steps a byte with the reflected polynomial
SQL = f"""
WITH RECURSIVE crc(doc_id, s, k, c) AS (
 SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT doc_id, s, k + 1, list_reduce(list_prepend(xor(c, ascii(s[k + 1])::BIGINT), range(8)), lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE k < length(s)),
hit AS (SELECT doc_id FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 2 = 0),
l AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS used FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
{_tree("t", "SELECT source, 0, pos, n, leaf FROM p")},
s AS (SELECT source, h AS subroot, max(lvl) OVER (PARTITION BY source) AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree("u", "SELECT NULL::VARCHAR, 0, pos, n, subroot FROM s")},
pow AS (SELECT k, (3 ** k)::BIGINT AS p FROM range(40) x(k)),
leaf_no AS (SELECT row_number() OVER () AS i, p.doc_id, p.leaf, p.used, p.pos, p.source, s.subroot, s.pos AS spos, s.depth FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
own AS (SELECT i, lvl, string_agg(h, '' ORDER BY idx) FILTER (idx < pos // p) AS l, string_agg(h, '' ORDER BY idx) FILTER (idx > pos // p) AS r
        FROM leaf_no JOIN t ON leaf_no.source IS NOT DISTINCT FROM t.source AND t.n > 1 JOIN pow ON k = lvl WHERE idx // 3 = pos // p // 3 GROUP BY i, lvl),
top AS (SELECT spos, lvl, string_agg(h, '' ORDER BY idx) FILTER (idx < spos // p) AS l, string_agg(h, '' ORDER BY idx) FILTER (idx > spos // p) AS r
        FROM (SELECT pos AS spos FROM s) JOIN u ON u.n > 1 JOIN pow ON k = lvl WHERE idx // 3 = spos // p // 3 GROUP BY spos, lvl),
steps AS (SELECT i, lvl, coalesce(l, '') AS l, coalesce(r, '') AS r FROM own UNION ALL SELECT i, depth + lvl, coalesce(l, ''), coalesce(r, '') FROM leaf_no JOIN top USING (spos)),
fold(i, lvl, h) AS (SELECT i, 0, used FROM leaf_no UNION ALL SELECT f.i, f.lvl + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON f.i = s.i AND f.lvl = s.lvl),
ends AS (SELECT i, arg_max(h, lvl) AS folded_root FROM fold GROUP BY i),
said AS (SELECT i, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM steps GROUP BY i),
root AS (SELECT h FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM root) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM root) AS verified
FROM leaf_no JOIN ends USING (i) LEFT JOIN said USING (i)"""
