"""Source divergence audit: how far the words of each source are from those of every other source of its language.

Groups are (language, source); a language keeps the terms that at least ``LEAST_DOCS`` of its documents have. A group
gives each kept term the share ``p = 1 + floor(SCALE * (count + 1) / (all counts + terms))``, and ``floor((p - q)^2 / q)``
is what the term adds to the divergence from ``q``. Everything is exact in integers.

Sums over all pairs of sources are split by how many sources have a term. Heavy terms (more than ``LIGHT`` sources) are
dense tiles of terms x sources, summed pair by pair in numpy. Each pair starts from the absent shares of all terms, which a
dense tile takes off again. A light term differs from the share of an absent term in few sources only: every (source,
share) that occurs is weighed by its number of terms against the absent shares of the others, and pairs of sources that
share a light term are corrected from its posting. The partial sums add up to the dense result.

Texts are counted per task and group before anything is shuffled; a tile holds a bounded number of terms of at most
2 x ``SIDE`` sources, so no task has a whole language. Null language, source or text is ''. A document without terms still
has its group; a language without kept terms gives divergences of 0 and no terms. Repeated rows count as documents of
their own; equal values are ranked by the item's bytes; an empty table gives an empty result; columns that are not named
are not read. Sums fit 64 bits for vocabularies of up to ``SCALE`` terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, texts_of, written

SCALE = 1_000_000_000
LEAST_DOCS = 3
#: A term in at most so many sources of its language is light.
LIGHT = 8
#: Terms and sources of a tile; rows of shares that are weighed in one step.
TILE_TERMS, SIDE, TILE_SHARES = 1024, 256, 1 << 16
#: Ranks of terms that are returned.
TOP_TERMS = 200
#: Up to this many groups (about 100 bytes each) are broadcast; beyond, their terms are dealt over ``SALTS`` parts.
BROADCAST_GROUPS, SALTS = 100_000, 64
#: Different terms that a task holds before it hands them on, and bytes of a text that are split at once.
HELD, PIECE = 300_000, 4 << 20

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes):
    """Terms of a UTF-8 text in lists, for bounded pieces: runs of letters A-Z and of all characters beyond ASCII."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def tally(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of all texts, several rows per term."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on():
            for (a, b), (n, seen) in held.items():
                terms, k = list(n), len(n)
                cols = [pa.array([a] * k, pa.string()), pa.array([b] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
                yield from pa.Table.from_arrays(cols, names=names).to_batches(50_000)
            held.clear()

        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for at, off, data in texts_of(batch.column(2)):
                body, ends = data.tobytes(), off.tolist()
                for k in range(len(ends) - 1):
                    n, seen = held.setdefault(groups[at + k], (Counter(), Counter()))
                    own: set[bytes] = set()
                    for words in terms_of(body[ends[k] : ends[k + 1]]):
                        n.update(words)
                        own.update(words)
                    seen.update(own)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from handed_on()
        yield from handed_on()

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share of a term, exact for any count."""
    whole = lambda c: c.cast("decimal(19,0)")
    part = F.call_function("div", whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + terms))
    return F.when(terms > 0, part + 1).otherwise(F.lit(1).cast("long"))


def gain(p: Column, q: Column) -> Column:
    """What a term of shares ``p`` and ``q`` adds."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Audit:
    """Stored ``postings`` (kept terms by group) and ``groups`` (one row each) of a corpus."""

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, light: int = LIGHT, side: int = SIDE, tile_terms: int = TILE_TERMS, tile_shares: int = TILE_SHARES):
        of_term = Window.partitionBy("lang", "term")
        counts = tally(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = counts.withColumns({
            "docs": F.sum("docs").over(of_term), "spread": F.count("*").over(of_term), "total": F.sum("n").over(of_term),
            "first": (F.col("source") == F.min("source").over(of_term)).cast("long"),
        }).where(F.col("docs") >= least_docs)
        self.light, self.side, self.tile_terms, self.tile_shares = light, side, tile_terms, tile_shares
        self.postings = written(kept.drop("docs"), "postings")
        rare = F.when(F.col("spread") <= light, F.col("first")).otherwise(0)
        facts = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.sum("first").alias("terms"), F.sum(rare).alias("light_terms"))
        own = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
        none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        of_lang = Window.partitionBy("lang")
        groups = own.join(facts, ["lang", "source"], "left").withColumns({
            "idx": (F.row_number().over(of_lang.orderBy("source")) - 1).cast("int"), "sources": F.count("*").over(of_lang).cast("int"), "n_all": none(F.col("n_all")),
            "lang_all": none(F.sum("n_all").over(of_lang)), "terms": none(F.sum("terms").over(of_lang)), "light_terms": none(F.sum("light_terms").over(of_lang)),
        })
        absent = share(F.lit(0).cast("long"), F.col("n_all"), F.col("terms"))
        self.groups = written(groups.withColumn("absent", absent), "groups")

    def placed(self) -> DataFrame:
        """Postings with the facts of their group and the share ``p``."""
        if self.groups.count() <= BROADCAST_GROUPS:
            met = self.postings.join(F.broadcast(self.groups), ["lang", "source"])
        else:
            parts = self.groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = self.postings.withColumn("_part", F.pmod(F.hash("term"), F.lit(SALTS))).join(parts, ["lang", "source", "_part"]).drop("_part")
        return met.withColumn("p", share(F.col("n"), F.col("n_all"), F.col("terms")))

    def divergences(self) -> DataFrame:
        """``(lang, a, b, value)`` for every ordered pair of a language's sources, by their ``idx``."""
        placed = self.placed()
        heavy, light = placed.where(F.col("spread") > self.light), placed.where(F.col("spread") <= self.light)
        shares = written(light.groupBy("lang", "idx", "sources", "p").agg(F.count("*").alias("weight")), "shares")
        steps = shares.groupBy("lang").agg((F.count("*") / self.tile_shares).cast("int").alias("steps"))
        facts = self.groups.join(steps, "lang", "left").withColumns({"steps": F.coalesce("steps", F.lit(0)), "tiles": F.expr(f"(terms - light_terms) div {self.tile_terms}").cast("int")})
        block = F.expr(f"idx div {self.side}").cast("int")
        blocks = F.expr(f"sequence(0, (sources - 1) div {self.side})")
        # a source's rows go to each pair of blocks that its own block is in
        sides = lambda df: df.withColumn("_own", block).withColumn("_other", F.explode(blocks)).withColumns({"i": F.least("_own", "_other").cast("int"), "j": F.greatest("_own", "_other").cast("int")})
        none = F.lit(None)
        pick = lambda df, tile, term, p, weight: df.select("lang", "i", "j", tile.cast("int").alias("tile"), "idx", term.cast("string").alias("term"), p.alias("p"), weight.cast("long").alias("weight"))
        heads = sides(facts)
        each = lambda n: heads.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col(n))))
        deal = lambda df, n, *by: df.join(F.broadcast(facts.groupBy("lang").agg(F.first(n).alias("_n"))), "lang").withColumn("_tile", F.pmod(F.xxhash64(*by), F.col("_n") + 1))
        dense = pick(each("tiles").where("terms > light_terms"), F.col("_tile"), none, F.col("absent"), none).unionByName(
            pick(sides(deal(heavy, "tiles", "term")), F.col("_tile"), F.col("term"), F.col("p"), none)
        )
        # each pair starts from the absent shares of all terms, in tile 0
        base = F.when(F.col("_tile") == 0, F.col("terms")).otherwise(0)
        sparse = pick(each("steps"), F.col("_tile"), none, F.col("absent"), base).unionByName(
            pick(sides(deal(shares, "steps", "idx", "p")), F.col("_tile"), F.lit(""), F.col("p"), F.col("weight"))
        )
        schema, tile = "lang string, a int, b int, value long", ["lang", "i", "j", "tile"]
        sums = dense.groupBy(*tile).applyInArrow(_summed(_dense, self.side), schema).unionByName(sparse.groupBy(*tile).applyInArrow(_summed(_sparse, self.side), schema))
        exact = F.col("value").cast("decimal(20,0)")
        return sums.select("lang", "a", "b", exact.alias("value")).unionByName(self._shared(light)).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))

    def _shared(self, light: DataFrame) -> DataFrame:
        """Corrections of pairs that share a light term; a posting has at most ``light`` sources."""
        posting = light.groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "p", "absent")).alias("x")).where(F.size("x") > 1)
        pairs = posting.select("lang", "x", F.explode("x").alias("a")).select("lang", "a", F.explode("x").alias("b")).where("a.idx <> b.idx")
        f = lambda x, y: gain(F.col(x), F.col(y))
        more = f("a.p", "b.p") - f("a.p", "b.absent") - f("a.absent", "b.p") + f("a.absent", "b.absent")
        return pairs.select("lang", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), more.cast("decimal(20,0)").alias("value"))

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value, rank)``: every other source of the language."""
        named = lambda k, name: self.groups.select("lang", F.col("idx").alias(k), F.col("source").alias(name))
        rows = self.divergences().where("a <> b").join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
        return _ranked(rows.select("lang", "source", "item", "value"))

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """``(lang, source, item, value, rank)``: the terms that a group has more often than its language, to rank ``top``."""
        q = share(F.col("total"), F.col("lang_all"), F.col("terms"))
        rows = self.placed().withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
        # the limit on ranks reaches the tasks before the shuffle, so that each sends at most so many terms of a group
        return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _tile(table: pa.Table):
    """Heads (sources and absent shares, ascending), their weights, other rows, and the numbers of these rows' sources."""
    is_head = pc.is_null(table.column("term")).to_numpy()
    idx, p = table.column("idx").to_numpy(), table.column("p").to_numpy()
    weight = table.column("weight").fill_null(0).to_numpy()
    order = np.flatnonzero(is_head)[np.argsort(idx[is_head])]
    rows = np.flatnonzero(~is_head)
    return idx[order], p[order], weight[order], rows, np.searchsorted(idx[order], idx[rows]), p[rows], weight[rows]


def _summed(sums, side: int):
    """A function of tiles that returns ``sums`` for the ordered pairs that belong to a tile: both sources in one block, or one in each."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, i, j, _ = (k.as_py() for k in key)
        sources, value = sums(table)
        block = sources // side
        a, b = np.nonzero((block[:, None] != block) if i != j else np.ones(value.shape, bool))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(sources[a], pa.int32()), "b": pa.array(sources[b], pa.int32()), "value": pa.array(value[a, b], pa.int64())})

    return run


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a tile of heavy terms, less what they give where they are absent (as a term of other blocks is here)."""
    sources, absent, _, rows, at, p, _ = _tile(table)
    term = table.column("term").take(pa.array(rows)).combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.zeros(0, np.int64)
    shares = np.tile(absent, (int(term.max()) + 1 if len(term) else 0, 1))
    shares[term, at] = p
    value = np.stack([_gain(shares, shares[:, [b]]).sum(0) for b in range(len(sources))], axis=1)
    return sources, value - len(shares) * _gain(absent[:, None], absent)


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The start from absent terms, and what light terms that occur add to it against absent shares."""
    sources, absent, base, _, at, p, weight = _tile(table)
    start = _gain(absent[:, None], absent)
    value = start * base.max()
    for b in range(len(sources)):
        own, other = _gain(p, absent[b]) - start[at, b], _gain(absent[b], p) - start[b, at]
        np.add.at(value[:, b], at, weight * own)
        np.add.at(value[b], at, weight * other)
    return sources, value


def query(spark, sf_dir: str) -> DataFrame:
    """Divergences and telling terms of all documents' sources."""
    audit = Audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(audit.pairs(), "pair").unionByName(part(audit.terms(), "term"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
