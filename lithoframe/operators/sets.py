"""Set operations on element tables, and stratigraphic order from picks."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; where both have one, ``b`` wins."""
    return a.join(b, keys, "left_anti").unionByName(b)


def by_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    return elements.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags))))


def precedence(picks: DataFrame) -> DataFrame:
    """``above, below, wells``: how many wells have one pick strictly above another."""
    a, b = (picks.select("well", F.col("name").alias(n), F.col("md").alias(f"{n}_md")) for n in ("above", "below"))
    met = a.join(b, "well").where("above_md < below_md AND above <> below")
    return met.groupBy("above", "below").agg(F.count("*").alias("wells"))


def strat_order(picks: DataFrame, hints: list[tuple[str, str]] = (), most: int = 2_000_000) -> list[str]:
    """Names from top to bottom. Names and their edges, not picks, come to the driver, as the order is built one by one.

    ``most`` edges (about 200 MB) are its bound of memory, enough for 1,400 names that are all ordered among each other.

    Edges need a strict order in any well; hints count only where data do not order the names the other way. Among free
    names the one seen first goes first; in a cycle the first unplaced one.
    """
    first = picks.groupBy("name").agg(F.min(F.struct("seq", "name")).alias("s")).orderBy("s").select("name")
    names = [r["name"] for r in first.limit(most + 1).collect()]
    rows = precedence(picks).select("above", "below").limit(most + 1).collect()
    if max(len(rows), len(names)) > most:
        raise ValueError("too many names to order")
    under: dict[str, set[str]] = {n: set() for n in names}
    for r in rows:
        under[r["above"]].add(r["below"])

    def reaches(a: str, b: str) -> bool:
        seen, todo = {a}, [a]
        while todo:
            for n in data[todo.pop()]:
                if n == b:
                    return True
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return False

    data = {n: set(v) for n, v in under.items()}
    for a, b in hints:
        if a in under and b in under and not reaches(b, a):
            under[a].add(b)
    above = Counter(b for a, v in under.items() for b in v if b != a)
    place = {n: k for k, n in enumerate(names)}
    free = [k for k, n in enumerate(names) if not above[n]]
    heapq.heapify(free)
    placed, first, out = [False] * len(names), 0, []
    while len(out) < len(names):
        while first < len(names) and placed[first]:
            first += 1
        k = heapq.heappop(free) if free else first  # a cycle: the first unplaced one
        if placed[k]:
            continue
        placed[k] = True
        out.append(names[k])
        for n in under[names[k]]:
            above[n] -= 1
            if not above[n] and not placed[place[n]]:
                heapq.heappush(free, place[n])
    return out


def parse_hint(text: str) -> tuple[str, str]:
    """``(above, below)`` of ``A < B`` (A lies above) or ``A > B`` (A lies below)."""
    for sign, turn in (("<", 1), (">", -1)):
        left, found, right = text.partition(sign)
        if found:
            pair = (left.strip(), right.strip())[::turn]
            if not all(pair):
                raise ValueError(f"a side of the hint is empty: {text}")
            return pair
    raise ValueError(f"a hint needs < or >: {text}")


def resolve_hints(tops: DataFrame, hints: list[str]) -> list[tuple[str, str]]:
    """Hints with each side as the one top that it means: its name, its name without `` top``, or the only name with it.

    Only names that a side occurs in come to the driver.
    """
    pairs = [parse_hint(h) for h in hints]
    sides = sorted({x for p in pairs for x in p})
    if not sides:
        return []
    low = F.lower("name")
    known = tops.where(F.exists(F.array(*(F.lit(x.lower()) for x in sides)), lambda x: F.contains(low, x))).select("name").distinct()
    names = sorted(r[0] for r in known.collect())
    meant = {}
    for x in sides:
        like = [n for n in names if x.lower() in n.lower()]
        best = [n for n in like if n.lower() == x.lower()] or [n for n in like if n.lower() == f"{x.lower()} top"]
        if not like or not best and len(like) > 1:
            raise ValueError(f"{x}: {'matches ' + ', '.join(like) if like else 'no top has this name'}")
        meant[x] = (best or like)[0]
    return [(meant[a], meant[b]) for a, b in pairs]


def anti(elements: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Elements whose key ``others`` do not have."""
    return elements.join(others.select(*keys).distinct(), keys, "left_anti")
