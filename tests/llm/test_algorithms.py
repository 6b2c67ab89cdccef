"""Runs, sketches and encoding: against brute force, exact ranks and the public library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import commands, req, runs, tokenize

SAME = [
    ["git status", " git \\\n  status", "time git status;", "cd ~/work/app && git status 2>&1 | tail -40", "set -e\ngit status", "# x\ngit status # y", "FORCE_COLOR=0 \\\n  git  status || true", "timeout 60 git status && echo ok; echo exit=$?", "git status > /tmp/x.log", "(git status)", "bash -lc 'git status'", "export A=1; git status", "nice -n 10 git status", "time -p git status", "sudo -u me git status", "echo start; git status", "stdbuf -oL git status", "timeout -s KILL 5 git status"],
    ['rg -n "a b" x', "rg -n 'a b' x", "rg -n a\\ b x"], ["cp a /tmp/out-35e5be49.log", "cp a /tmp/tmp.CDTIkr", "cp a /var/tmp/b37b3a89-63e5-45d1-a648-9e3c13905485"], ["docker build -t x:1767546729 ui", "docker build -t x:1782013171 ui"], ["bun --filter=web", "bun --filter web"],
]
OTHER = ["git show 00dd56b1", "git show aedcf9d4", "cat /tmp/foo.txt", "cat /tmp/bar.txt", "gh run view 299950", "gh run view 299951", "a && b", "a", "echo hi", "echo ho", "echo 'x' >> a.csv", "echo 'x' >> b.csv", "cd x", "cd y", "export A=1", "a | grep x", "a | grep y", "", "a b", "'a b'"]


@pytest.mark.parametrize("group", SAME)
def test_same_work(group):
    assert len({commands.command_key(c) for c in group}) == 1

PS = [0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999]


def test_other_work():
    assert len({commands.command_key(c) for c in OTHER}) == len(OTHER)
    assert commands.command_key(None) is None


BASH = "sid string, t bigint, row_id bigint, cmd string, key string, part int"


def brute(rows):
    out, cur = [], None
    for sid, t, rid, cmd, *_ in sorted({r[:4] for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        key = commands.command_key(cmd)
        if cur and cur[0] == (sid, key) and key is not None:
            cur[1].append(rid)
        else:
            cur = ((sid, key), [rid])
            out.append(cur)
    return sorted((k[0] or "", min(r), max(r), len(r)) for k, r in out)


@pytest.mark.parametrize("partitions", [1, 3, 13])
def test_runs_like_a_loop(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(60)]), i, rng.choice(["ls", "ls ", "time ls", "cat x", None, ""]), "clash", 0) for i in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = runs.collapse(spark.createDataFrame(rows + rng.choices(rows, k=100), BASH)).collect()
        pairs = runs.collapse(spark.createDataFrame(rows, BASH), 2).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(rows)
    assert sorted((r.sid or "", r.low_row_id, r.high_row_id, r.n) for r in got) == want
    assert pairs == sum(n > 1 for *_, n in want)


def test_runs_of_nothing(spark):
    assert runs.collapse(spark.createDataFrame([], BASH)).count() == 0
    long = "x" * 300_000
    assert runs.collapse(spark.createDataFrame([("s", 1, 1, long, "", 0), ("s", 1, 2, f"time {long}", "", 0)], BASH), 2).count() == 1


@pytest.mark.parametrize("kind", ["lognormal", "ties", "sorted", "reversed"])
def test_sketch_error(kind):
    rng, n = np.random.default_rng(1), 120_000
    x = {"lognormal": rng.lognormal(size=n), "ties": rng.integers(0, 300, n).astype(float), "sorted": np.arange(n) * 1.0, "reversed": np.arange(n)[::-1] * 1.0}[kind]
    whole = req.Sketch()
    for part in np.array_split(x, 61):
        whole.merge(req.Sketch.unpack(req.Sketch(part).pack()))
    assert whole.n == n == sum(len(v) << h for h, v in enumerate(whole.levels)) and len(whole.pack()) < 80_000
    exact = np.sort(x)
    ps = [0.1, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0]
    for p, q in zip(ps, whole.quantiles(ps)):
        low, high, want = np.searchsorted(exact, q, "left") + 1, np.searchsorted(exact, q, "right"), int(np.ceil(p * n))
        assert (0 if low <= want <= high else min(abs(low - want), abs(high - want))) <= req.EPS * (n - want + 1)


@pytest.mark.parametrize("kind", ["spread", "sorted", "ties"])
def test_error_of_ten_million_values(kind):
    n, rng = 10_000_000, np.random.default_rng(7)
    values = rng.lognormal(3, 2, n) if kind == "spread" else np.arange(n, dtype=float) if kind == "sorted" else rng.integers(0, 5_000, n).astype(float)
    days = []
    for at in range(0, n, 50 * 4_096):
        day = req.Sketch()
        for k in range(at, min(n, at + 50 * 4_096), 4_096):
            day.merge(req.Sketch(values[k : k + 4_096]))
        days.append(req.Sketch.unpack(day.pack()))
    mine = np.sort(values[: 50 * 4_096])
    checks = [(days[0].quantiles(PS), mine)]
    whole = req.Sketch()
    for day in days:
        whole.merge(day)
    checks.append((whole.quantiles(PS), np.sort(values)))
    for got, ordered in checks:
        for p, q in zip(PS, got):
            want = max(1, int(np.ceil(p * len(ordered))))
            low, high = np.searchsorted(ordered, q, "left") + 1, np.searchsorted(ordered, q, "right")
            assert max(0, low - want, want - high) <= req.EPS / 4 * (len(ordered) - want + 1) + 1
    assert len(whole.pack()) < 80_000


def test_small_sketches_are_exact():
    s = req.Sketch(np.array([3.0, 1.0, 2.0, -5.0]))
    assert s.quantiles([0.25, 0.5, 0.75, 1.0]) == [-5.0, 1.0, 2.0, 3.0]
    assert req.Sketch().quantiles([0.5]) == [None]


def test_days_merge(spark):
    rows = [(i, f"k{i % 2}" if i % 7 else None, float(i) if i % 5 else None, i % 3) for i in range(900)] + [(1000, "k0", float("nan"), 0)]
    df = spark.createDataFrame(rows * 2, "row_id bigint, k string, v double, d int").withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")))
    days = req.sketch_days(req.distinct_values(df, "t", "k", "v", F.col("day")))
    whole = {r.key_value: r for r in req.read_quantiles(req.merge_days(days), [0.5], ["median"]).collect()}
    for k in ("k0", "k1", None):
        mine = sorted(v for _, key, v, _ in rows if key == k and v is not None and v == v)
        assert whole[k].n == len(mine) and abs(mine.index(whole[k].median) - len(mine) // 2) <= 1 + req.EPS * len(mine)
    assert req.read_quantiles(days, [0.5], ["m"]).count() == 9
    assert req.sketch_days(req.distinct_values(df.where("false"), "t", "k", "v", F.col("day"))).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")


PIECES = ["'s", "'ll", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "b1", "2", "é", "你", "!", "\xa0", "'ve", "'S", "'d", "\x1c", "\x00", "<|endoftext|>", "😀", "ſ", "̀", "٣", "²", "Ⅷ", "x'm", "　", "‍"]


def test_encoding_like_the_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary[1])
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(20_000)] + ["a" * 5000, " " * 999, "ab" * 3000 + "\n"]
    with open(vocabulary[0], "rb") as f:
        own = tokenize.merger(f.read())
    done = own.encode(texts)
    assert [d[0].tolist() for d in done] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for t, (_, starts) in zip(texts, done):
        assert (starts[0] == 0 and starts[-1] < len(t)) if t else not len(starts)


def test_scan_is_composition():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 8, (50, 8)).astype(np.uint8)
    got, state = tokenize.scan(f.copy()), np.arange(8)
    for i in range(50):
        state = f[i][state]
        assert (got[i] == state).all()


def test_encode_table(spark, vocabulary):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " \n "), (4, " \n "), (None, "x"), (5, "é😀" * 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = tokenize.encode(df, vocabulary[0], offsets=True)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 7 and got[2].ids == got[3].ids == [] and got[1].offsets == [0, 5] and len(got[4].ids) > 0
    back = {r.doc_id: r.text for r in tokenize.decode(out, vocabulary[0]).collect()}
    assert back == {k: v or "" for k, v in rows}
    assert tokenize.encode(df.where("false"), vocabulary[0]).count() == 0
