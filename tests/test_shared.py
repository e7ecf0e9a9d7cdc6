"""Written tables: they outlive their lineage, and go when a scratch block ends."""

from __future__ import annotations

import os

from evalloom import shared


def test_scratch_tables_go(spark):
    path = lambda df: df._table.removeprefix("file:")
    outer = shared.written(spark.range(3), "outer")
    with shared.scratch(spark) as tables:
        a, b, c = (shared.written(spark.range(n), "inner") for n in (4, 5, 6))
        shared.discard(c)
        assert not os.path.exists(path(c)) and tables == [a._table, b._table]
        tables.remove(b._table)
    assert not os.path.exists(path(a)) and b.count() == 5 and outer.count() == 3
    shared.discard(b)
    shared.discard(outer)
    assert not os.path.exists(path(b)) and not os.path.exists(path(outer))
