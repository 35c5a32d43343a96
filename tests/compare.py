from __future__ import annotations

import decimal
from collections import Counter


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
