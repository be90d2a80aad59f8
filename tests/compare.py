"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(df, con, sql):
    scols, srows = rows_of_spark(df)
    dcols, drows = rows_of_duck(con, sql)
    assert scols == dcols, f"columns differ: spark={scols} duck={dcols}"
    assert len(srows) == len(drows), f"row count spark={len(srows)} duck={len(drows)}"
    s_sorted = sorted(srows, key=_key)
    d_sorted = sorted(drows, key=_key)
    for a, b in zip(s_sorted, d_sorted):
        assert a == b, f"first differing row:\n spark={a}\n duck ={b}"
    return len(srows)
