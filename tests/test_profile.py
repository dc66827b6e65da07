import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sleuthflow.operators import profile

START = datetime(2026, 1, 1)
SCHEMA = "grp string, ts timestamp, who string, amount double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for n in range(20_000):
        group = "hot" if n % 3 else f"g{n % 5}"
        out.append((group, START + timedelta(hours=n % 960), f"w{rng.randrange(6000)}", rng.lognormvariate(3, 2)))
    out += [("g0", START, None, None), ("g0", START, None, float("nan")), ("none", START, None, None), (None, START, "w1", 1.0), ("late", None, "w1", 2.0)]
    return out


@pytest.fixture(scope="module")
def stored(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return profile.daily_profile(df, ["grp"], "ts", ["who"], ["amount"]).cache()


def known(rows):
    return sorted(r[3] for r in rows if r[3] is not None and r[3] == r[3])


def check(found, mine):
    amounts, names = known(mine), {r[2] for r in mine if r[2] is not None}
    assert found.n_rows == len(mine) and found.who_missing == sum(r[2] is None for r in mine)
    assert found.amount_missing == len(mine) - len(amounts)
    assert abs(found.who_distinct - len(names)) <= 3 * profile.distinct_error() * len(names) + 1e-9
    if not amounts:
        assert found.amount_median is None and found.amount_sum is None
        return
    assert (found.amount_min, found.amount_max) == (amounts[0], amounts[-1]) and found.amount_sum == pytest.approx(sum(amounts))
    for name, p in (("median", 0.5), ("high", 0.95)):
        value = found[f"amount_{name}"]
        low, high = sum(x < value for x in amounts), sum(x <= value for x in amounts)
        slack = 2 * profile.rank_error() * len(amounts) + 1
        assert low - slack <= p * len(amounts) <= high + slack


def test_whole_range_and_part_of_it(spark, rows, stored):
    quantiles = {"median": 0.5, "high": 0.95}
    found = {r.grp: r for r in profile.merged(stored, ["grp"], ["who"], ["amount"], quantiles).collect()}
    assert set(found) == {r[0] for r in rows}
    for group, one in found.items():
        check(one, [r for r in rows if r[0] == group])
    until = START + timedelta(days=10)
    part = stored.where(F.col("day") < F.lit(until.date()))
    for one in profile.merged(part, ["grp"], ["who"], ["amount"], quantiles).collect():
        check(one, [r for r in rows if r[0] == one.grp and r[1] is not None and r[1] < until])


def test_profiles_of_two_loads_merge(spark, rows, stored):
    halves = [profile.daily_profile(spark.createDataFrame(rows[k::2], SCHEMA), ["grp"], "ts", ["who"], ["amount"]) for k in (0, 1)]
    both = profile.merged(halves[0].unionByName(halves[1]), ["grp"], ["who"], ["amount"], {})
    for one in both.collect():
        assert one.n_rows == sum(r[0] == one.grp for r in rows)
    assert both.count() == len({r[0] for r in rows})


def test_no_rows(spark):
    nothing = profile.daily_profile(spark.createDataFrame([], SCHEMA), ["grp"], "ts", ["who"], ["amount"])
    assert nothing.count() == 0 and profile.merged(nothing, ["grp"], ["who"], ["amount"]).count() == 0
