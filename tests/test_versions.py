"""Version ranges in columns against a plain version, one pair at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import versions
from marlstone.plans import registry

VERSION = re.compile(r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


def version_key(v: str | None):
    m = VERSION.match(v or "")
    if not m:
        return None
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in (m[4] or "").split(".")) if m[4] else ((2, 0, ""),)
    return (int(m[1]), int(m[2]), int(m[3]), pre)


def satisfies(v: str | None, wanted: str | None) -> bool | None:
    """Whether a version is in a range (comparators, ^, ~, x, hyphen-free, ||); prereleases count; null if either is malformed."""
    have = version_key(v)
    if have is None or wanted is None:
        return None
    for part in wanted.split("||"):
        ok = True
        for c in part.split():
            m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?v?(\d+|[x*])(?:\.(\d+|[x*]))?(?:\.(\d+|[x*]))?(?:-([0-9A-Za-z.-]+))?", c)
            if not m:
                return None
            op, nums = m[1] or "=", [int(x) if x and x.isdigit() else None for x in m.groups()[1:4]]
            low = version_key(".".join(str(x or 0) for x in nums) + (f"-{m[5]}" if m[5] else ""))
            least = lambda *t: (*t, ((0, -1, ""),))
            if nums[0] is None:
                continue
            up = least(nums[0] + 1, 0, 0) if nums[1] is None else least(nums[0], nums[1] + 1, 0) if nums[2] is None else None
            if op == "^":
                high = least(nums[0] + 1, 0, 0) if nums[0] or nums[1] is None else least(0, nums[1] + 1, 0) if nums[1] or nums[2] is None else least(0, 0, nums[2] + 1)
                ok &= low <= have < high
            elif op == "~":
                ok &= low <= have < (least(nums[0] + 1, 0, 0) if nums[1] is None else least(nums[0], nums[1] + 1, 0))
            elif op == "=":
                ok &= have == low if up is None else low <= have < up
            else:
                ok &= {">=": have >= low, "<": have < low, ">": have > low if up is None else have >= up, "<=": have <= low if up is None else have < up}[op]
        if ok:
            return True
    return False


GOLDEN = [
    ("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.2.5", "~0.2", True), ("1.0.0-rc.1", ">=1.0.0-rc.0 <2.0.0", True), ("1.5.0", "1.x", True), ("0.3.0", "^0.2.3", False), ("x", "*", None), ("1.0.0", "^a", None),
    ("3.1.0", "^1 || ^3", True), ("1.0.0-alpha", "<1.0.0", True), ("1.0.0-alpha", "1.0.0", False), ("1.0.0-alpha.1", ">1.0.0-alpha", True), ("1.0.0-alpha.beta", ">1.0.0-alpha.1", True), ("1.0.0-2", "<1.0.0-11", True), ("1.0.0-11", "<1.0.0-a", True),
    ("2.0.0-rc.1", "^1.2.0", False), ("1.2.0-rc.1", "^1.2.0", False), ("1.0.0+build.5", "=1.0.0", True), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.2.9", "<=1.2", True), ("1.3.0", ">1.2", True), (None, "*", None), ("1.0.0", None, None), ("1.0.0", "", True),
]


def got(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, v string, r string")
    return [x.ok for x in df.select("i", versions.version_satisfies(F.col("v"), F.col("r")).alias("ok")).orderBy("i").collect()]


def test_golden(spark):
    assert got(spark, [x[:2] for x in GOLDEN]) == [x[2] for x in GOLDEN]


def test_random_pairs(spark):
    r = random.Random(11)
    number = lambda: r.choice(["0", "1", "2", "10", "007"])
    pre = lambda: r.choice(["", "", "-a", "-1", "-a.1", "-rc.10", "-2.b", "-00"])
    version = lambda: f"{r.choice(['', 'v'])}{number()}.{number()}.{number()}{pre()}"

    def comparator():
        parts = [r.choice([number(), number(), "x", "*"]) for _ in range(r.randint(1, 3))]
        return r.choice(["", "^", "~", ">=", "<=", ">", "<", "="]) + ".".join(parts) + (pre() if len(parts) == 3 else "")

    pairs = [(version(), " || ".join(" ".join(comparator() for _ in range(r.randint(0, 2))) for _ in range(r.randint(1, 2)))) for _ in range(1500)]
    assert got(spark, pairs) == [satisfies(*p) for p in pairs]


@pytest.mark.parametrize("name", ["version_ranges", "plugin_errors"])
def test_no_python_in_the_plans(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_one_range_is_read_once(spark, tmp_path):
    """The intervals of a range of the query's own aren't made for each row, and one partition becomes many."""
    from marlstone.plans import registry

    spark.range(60).selectExpr("id p_partkey", "cast(id % 5 as int) p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = registry.queries()["version_ranges"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1 and "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.p_partkey: r.ok for r in found.collect()} == {k: k % 3 == 1 and k % 7 >= 2 or k % 3 == 2 and k % 7 == 3 for k in range(60)}
    odd = spark.createDataFrame([("1.2.3",), ("x",), (None,)], "v string")
    for wanted in ("^1.2.0", "1.x || >3", "bad range", ""):
        got = versions.with_satisfied(odd, "v", wanted).select("v", "ok").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, odd.select("v", versions.version_satisfies(F.col("v"), F.lit(wanted)).alias("ok")).collect()), key=repr)
