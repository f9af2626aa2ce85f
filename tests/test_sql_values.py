import datetime as dt
import math
from pathlib import Path

import pytest

from quoteloom import plans


def plain(v):
    """One form of a value for both engines; NaN is null, dates have no time."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date().isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return float(v) if not isinstance(v, (list, tuple, dict)) else str(v)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-4)


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_values_match_sql(spark, small, name):
    """Sorted values of every core query with SQL, over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    done = con.execute(plans.sql()[name])
    columns = sorted(c[0] for c in done.description)
    at = [[c[0] for c in done.description].index(c) for c in columns]
    want = [tuple(plain(r[k]) for k in at) for r in done.fetchall()]
    df = plans.queries()[name](spark, small)
    assert sorted(df.columns) == columns
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    order = lambda r: tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v if v is not None else 0) for v in r)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(sorted(got, key=order), sorted(want, key=order)) if not all(map(close, a, b))]
    assert not bad, (len(bad), bad[:2])
