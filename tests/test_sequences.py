"""Sequence operators against plain loops on random rows."""

import random

from stratalog.operators import ranking as R
from stratalog.operators import sequences as S

ROWS = "sid string, bin string, t bigint, seq bigint, family string, cmd string, secs double, err boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_anchored_bursts(spark):
    rows = [("s", "git", t, i, f"f{i}", "c", 1.0, False) for i, t in enumerate([0, 300, 600, 601, 700, 1201, 1202])]
    got = S.bursts(frame(spark, rows)).orderBy("burst").collect()
    assert [(r.burst, r.first_t, r.rows) for r in got] == [(0, 0, 3), (1, 601, 3), (2, 1202, 1)]
    assert S.bursts(frame(spark, rows).where("false")).count() == 0


def test_bursts_like_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.choice([None, *range(0, 5000, 90)]), i, rng.choice("pqr"), rng.choice(["c", "cc", None]), 1.0, False) for i in range(400)]
    want = {}
    for sid, b, t, seq, f, *_ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3])):
        groups = want.setdefault((sid, b), [])
        if not groups or t - groups[-1][0] > 600:
            groups.append([t, 0, set()])
        groups[-1][1] += 1
        groups[-1][2].add(f)
    got = {(r.sid, r.bin, r.first_t): (r.rows, tuple(r.families)) for r in S.bursts(frame(spark, rows)).collect()}
    assert got == {(k[0], k[1], g[0]): (g[1], tuple(sorted(g[2]))) for k, groups in want.items() for g in groups}


def test_retry_chains(spark):
    rows = [("s", "b", 0, 0, "f", "c", 1.0, True), ("s", "b", 200, 1, "f", "c", 1.0, False), ("s", "b", 300, 2, "g", "d", 1.0, False), ("s", "b", 450, 3, "f", "c", 1.0, False)]
    assert [(r.cmd, r.retries) for r in S.retry_chains(frame(spark, rows)).collect()] == [("c", 2)]
    late = [("s", "b", 0, 0, "f", "c", 1.0, True), ("s", "b", 301, 1, "f", "c", 1.0, False)]
    assert S.retry_chains(frame(spark, late)).count() == 0


def test_retries_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), "b", rng.randrange(0, 9000, 50), i, "f", rng.choice("cde"), 1.0, rng.random() < 0.3) for i in range(500)]
    want, by = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        by.setdefault((r[0], r[5]), []).append(r)
    for (sid, cmd), rs in by.items():
        used = set()
        for i, r in enumerate(rs):
            if not r[7] or i in used:
                continue
            last, n = r[2], 0
            for j in range(i + 1, len(rs)):
                if rs[j][2] - last > 300:
                    break
                used.add(j)
                last, n = rs[j][2], n + 1
            if n:
                want.append((sid, cmd, n))
    assert sorted(tuple(r)[:2] + (r.retries,) for r in S.retry_chains(frame(spark, rows)).collect()) == sorted(want)


def test_ranking_says_what_it_leaves_out(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", None)], "k string, m int")
    assert [tuple(r) for r in R.ranking(df, "m", "k", 2).collect()] == [("c", 3, 4), ("a", 2, 4)]
    assert R.ranking(df.where("false"), "m", "k", 2).count() == 0


def test_prefix_sums_over_chunks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    got = {r.at: r.before_v for r in S.prefix_sums(df, ["g"], ["at"], ["v"], F.floor(F.col("at") / 37)).collect()}
    sums, want = {}, {}
    for g, at, v in rows:
        want[at] = sums.get(g, 0)
        sums[g] = want[at] + v
    assert got == want


def test_running_and_filling(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("s", 1, None), ("s", 2, 5), ("s", 3, None), ("s", 4, 1)], "g string, at int, v int")
    got = df.select("at", S.forward_fill(F.col("v"), ["g"], ["at"]).alias("f"), S.running_before(F.col("v"), ["g"], ["at"]).alias("b")).orderBy("at").collect()
    assert [(r.f, r.b) for r in got] == [(None, 0), (5, 0), (5, 5), (1, 5)]
