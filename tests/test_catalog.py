"""Every registered query with SQL gives DuckDB's rows."""

import math

import pytest

from lithoframe.catalog import ORACLES, QUERIES


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


#: Too few rows in the smallest tables leave nothing of these.
SPARSE = {"duplicate_slots", "mesh_blocks_decimated", "mesh_decimated", "mesh_faults", "multibore_wells"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = canon(tuple(r[c] for c in cols) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    assert got or name in SPARSE, "no rows: the query compares nothing"
    if name not in ORACLES:
        return
    rel = duck.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = canon(tuple(r[i] for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
