"""Rows of a DataFrame and of DuckDB, compared as multisets by column name."""

from collections import Counter


def counted(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    value = lambda x: None if x is None else repr(x + 0.0) if isinstance(x, float) else str(x)
    return Counter(tuple(value(r[i]) for i in at) for r in rows)


def assert_same(df, duck, sql):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = counted(df.collect(), df.columns), counted(cursor.fetchall(), names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
