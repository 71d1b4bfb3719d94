"""Tables written along the way and their removal."""

import os

from recordloom.durable import materialise, scope


def _folders(df):
    return {os.path.dirname(f).removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}


def test_scopes_remove_what_was_written_inside(spark):
    outer = materialise(spark.range(3), "outer")
    with scope(spark):
        first = materialise(spark.range(4), "first")
        with scope(spark):
            second = _folders(materialise(first, "second"))
        assert not any(map(os.path.exists, second))
        assert first.count() == 4
        first = _folders(first)
    assert first and not any(map(os.path.exists, first))
    assert outer.count() == 3
