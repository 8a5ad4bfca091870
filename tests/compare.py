"""Comparison of a query with its SQL, as multisets of rows with floats rounded."""

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def same(spark, duck, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(sql)
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns, name
    at = [theirs.index(c) for c in columns]
    other = sorted(tuple(norm(r[i]) for i in at) for r in result.fetchall())
    assert mine == other, name
