"""Comparison of a query with its SQL: columns by name, rows as a bag, floats to nine digits."""

from __future__ import annotations

import decimal


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.9g}"
    return str(value)


def same(df, relation) -> bool:
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    place = [relation.columns.index(c) for c in cols]
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())
    assert mine == theirs
    return True
