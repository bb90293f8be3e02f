"""Sessions that queries run in keep generated methods small enough to be compiled."""

import pytest

from specula.sources.package import COMPILED, METHOD, ship


@pytest.mark.parametrize("before,after", [("65535", COMPILED), (None, COMPILED), ("4000", 4000)])
def test_method_limit(spark, before, after):
    was = spark.conf.get(METHOD, None)
    try:
        spark.conf.unset(METHOD) if before is None else spark.conf.set(METHOD, before)
        assert int(ship(spark).conf.get(METHOD)) == after
    finally:
        spark.conf.unset(METHOD) if was is None else spark.conf.set(METHOD, was)
