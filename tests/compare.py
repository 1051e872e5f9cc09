"""Rows of a Spark query and of its SQL, made comparable."""

from __future__ import annotations

from decimal import Decimal


def plain(value):
    return float(value) if isinstance(value, Decimal) else value


def assert_same(frame, connection, sql: str) -> int:
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[i]) for i in at) for row in result.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
