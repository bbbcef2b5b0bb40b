"""Clocks read whole keys in order, also where a join turns into a broadcast as the plan runs; trailing means."""

import math

import pytest
from conftest import DATA, canonical

from eventclock import catalog
from eventclock.operators import axes, clocks
from eventclock.sources import tables


@pytest.fixture
def late_broadcast(spark):
    """As with large tables: joins are by shuffle until a side of few rows is known, and tasks stay apart."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k in changed:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["dollar", "logdollar", "range", "logdollar_rc"])
def test_a_key_is_never_read_in_parts(spark, duck, late_broadcast, name):
    ticks = tables.ticks(spark, DATA).repartition(4)  # several tasks hold ticks of each key
    found = axes.build(ticks, name, tables.TICK_CUTS[0]).collect()
    want = duck.sql(f"SELECT key, bar_ix, ts, log_close FROM ({catalog.oracle_sql()[f'axis_{name}']})").fetchall()
    assert canonical(found) == canonical(want)


def test_the_trailing_mean_is_that_of_the_sql(duck):
    """Over equal values a bar's sum just reaches the threshold; its last bit decides."""
    x = math.log(1 + 56.25 * 21)
    means = [m for (m,) in duck.sql(f"SELECT avg(x) OVER (ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) FROM (SELECT i, CAST({x!r} AS DOUBLE) AS x FROM range(1000) u(i)) ORDER BY i").fetchall()]
    clock, limit, total = clocks.Recalibrated(19.9 * x, 20, 400, 40), 19.9 * x, 0.0
    for i, mean in enumerate(means):
        total += x
        ends = total >= limit
        assert clock.step(x) == ends
        if ends:
            total, limit = 0.0, 20 * mean if i >= 39 else limit
        assert clock.threshold == limit
