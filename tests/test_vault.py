"""Vaults on disk, rule by rule, and similarity against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.operators import prefixes
from stratalog.operators import similarity as M
from stratalog.operators import vault as V
from stratalog.plans import vault as P
from stratalog.render import sinks

GOOD = "---\nname: {0}\ndescription: d\ntype: user\n---\n"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vaults")
    vaults = {
        "broken": {"MEMORY.md": "- [Home](home.md)\n- [Near](near-match.md)", "home.md": GOOD.format("home") + "see [[does-not-exist]]\n[x](missing.md)\n[[near-mtch]]\n[[near-match]] [[home]] [w](https://a.b) ![i](pic.png)", "near-match.md": GOOD.format("near-match") + "text"},
        "orphans": {"MEMORY.md": "# Index\n- [[listed]] — hook\n- just a bullet\n- [[listed]]\n- [Gone](gone.md)", "listed.md": GOOD.format("listed") + "[[orphan-topic]]", "orphan-topic.md": "no front matter \nTODO later\nfixed yesterday"},
        "prose": {"MEMORY.md": "# Notes\n\nAll in one."}, "stray": {"MEMORY.md": "- [A](a.md)", "a.md": GOOD.format("a") + "x", "pic.png": "x"},
        "rules": {"MEMORY.md": "- [B](Bad_na-me.md)", "Bad_na-me.md": "---\nname: Other\ntype: odd\n---\n# Other\n", "blank.md": GOOD.format("blank") + "  \n", "leak.md": GOOD.format("leak") + "ok\nAUTH_TOKEN=abc123def456ghi789"},
        "long": {"MEMORY.md": "\n".join(f"- [N{i}](n{i}.md)" for i in range(213)), "n0.md": GOOD.format("n0") + "same", "n1.md": GOOD.format("n1") + "Same"},
    }
    for vault, files in vaults.items():
        for name, text in files.items():
            (root / vault).mkdir(exist_ok=True)
            (root / vault / name).write_text(text)
    return root, {(r.vault, r.check, r.note, r.line) for r in V.audit(V.read_vaults(spark, str(root))).collect()}


def of(found, vault, *, without=("IDX01", "IDX02")):
    return {(c, n, line) for v, c, n, line in found[1] if v == vault and c not in without}


def test_links(found):
    assert of(found, "broken") == {("LNK02", "home", 2), ("LNK01", "home", 3), ("LNK03", "home", 4)}


def test_index(found):
    assert ("orphans", "IDX01", "orphan-topic", None) in found[1] and ("orphans", "IDX02", "MEMORY.md", 5) in found[1]
    assert of(found, "orphans") == {("IDX07", "MEMORY.md", 3), ("IDX08", "MEMORY.md", 2), ("SCH01", "orphan-topic", None), ("HYG01", "orphan-topic", None), ("HYG05", "orphan-topic", 2), ("STA01", "orphan-topic", 3)}
    assert {c for v, c, *_ in found[1] if v == "prose"} == {"IDX11"}
    assert of(found, "stray") == {("IDX10", "pic.png", None)}
    assert of(found, "long") == {("IDX04", "MEMORY.md", None), ("IDX05", "MEMORY.md", 201), ("DUP01", "n1", None)}


def test_note_rules(found):
    assert of(found, "rules") == {("SCH02", "Bad_na-me", None), ("SCH03", "Bad_na-me", None), ("SCH08", "Bad_na-me", None), ("IDX09", "Bad_na-me", None), ("HYG04", "Bad_na-me", None), ("SCH09", "blank", None), ("HYG01", "blank", None), ("SEC01", "leak", 2)}


def test_reindex_and_severity(spark, found, tmp_path):
    files = V.read_vaults(spark, str(found[0])).where("vault = 'orphans'")
    n = V.notes(files.where("file <> 'MEMORY.md'").withColumn("slug", F.regexp_replace("file", ".md$", "")), "vault", "slug", "slug", "text")
    entries = V.index_entries(files.where("file = 'MEMORY.md'").select("vault", "text"))
    assert [r.entry for r in V.reindex(entries, n).orderBy("ord").collect()] == ["- [listed](listed.md) — hook", "- [orphan-topic](orphan-topic.md)"]
    paths = sinks.write_index(V.reindex(entries, n), str(tmp_path))
    assert open(paths[0]).read().startswith("- [listed]")
    f = V.with_severity(V.audit(V.read_vaults(spark, str(found[0]))))
    assert {r.severity for r in V.at_least(f, "high").select("severity").distinct().collect()} == {"critical", "high"}
    assert {r.vault: r.ok for r in V.acceptable(f).collect()}["rules"] is False
    assert V.triage(f).where("note = 'leak'").first().top_issue == "SEC01"
    assert V.ordered(f).first().check == "SEC01"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("n", F.lit(1)).withColumn("s", F.lit(1))


def test_pairs_like_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(25)]
    texts = [" ".join(w if rng.random() > 0.02 else "z" for w in rng.choice(base).split()) for _ in range(120)] + ["", None, "a"]
    shingle = lambda t: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    sets = {i: shingle(t) for i, t in enumerate(texts) if t and shingle(t)}
    cls = {i: min(j for j, s in sets.items() if s == mine) for i, mine in sets.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(set(cls.values())), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = M.sets(docs(spark, texts), "id", "text")
    assert {r.key: r.cls for r in rows.collect()} == cls
    assert want and {(r.a, r.b) for r in M.pairs(M.classes(rows)).collect()} == want


def near_by_force(texts):
    """Class of each text, and (shared, na, nb) of all pairs of classes."""
    shingle = lambda t: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    sets = {i: shingle(t) for i, t in enumerate(texts) if t and shingle(t)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    return {i: first[s] for i, s in sets.items()}, {(i, j): (len(s & r), len(s), len(r)) for s, i in first.items() for r, j in first.items() if i < j}


def test_near_dups_like_brute_force(spark, tmp_path):
    rng = random.Random(12)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 60))) for _ in range(25)]
    texts = [" ".join(w if rng.random() > 0.02 else "z" for w in rng.choice(base).split()) for _ in range(150)]
    texts += ["a b c d e f g h " * 3 + rng.choice("xyz") * rng.randint(0, 3) for _ in range(40)]  # copies, and shingles that many have
    texts += ["", None, "a b c d", "a b c d e", "A. b, c\td--E"]
    cls, shared = near_by_force([t and re.sub(r"[^a-z0-9]+", " ", t.lower()) for t in texts])
    want = {p: n / (a + b - n) for p, (n, a, b) in shared.items() if n / (a + b - n) >= 0.8}
    root = {i: i for p in want for i in p}
    for _ in root:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    at = vault_of(spark, tmp_path, texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # most shingles go over several batches
    try:
        assert want and {(r.a, r.b): r.jaccard for r in P.near_dup_pairs(spark, at).collect()} == {p: round(j, 6) for p, j in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.cls, r.links) for r in P.near_dup_classes(spark, at).collect()} == {i: (c, sum(c in p for p in want)) for i, c in cls.items()}
    assert {r.node: r.root for r in P.near_dup_clusters(spark, at).collect()} == root


def test_prefix_words_and_ties():
    texts = ["", "-- !", "a b c", "a b\u00e9c", "a", "x a b c", "a b c-a b c"]
    row, h = prefixes.hashes(pa.array(["left out", *texts])[1:], 3)
    assert row.tolist() == [2, 3, 5, 5, 6, 6, 6, 6] and h[0] == h[1] == h[3] == h[4] == h[7] != h[2]
    rows, kept = prefixes.distinct(row, h)
    assert [(kept[rows == i]).tolist() for i in (2, 6)] == [[h[0]], sorted({int(x) for x in h[4:]})]
    rows, kept = prefixes.distinct(np.zeros(3, dtype=np.int64), np.array([1, 2, 1], dtype=np.uint64))  # alike in all bits of the number they are sorted by
    assert rows.tolist() == [0, 0] and kept.tolist() == [1, 2]


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_dups_shuffle_less_than_the_sets(spark, tmp_path):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = [" ".join(word() for _ in range(300)) for _ in range(400)]
    texts += [t.rsplit(" ", 1)[0] for t in texts]  # each is near one other
    at, before = vault_of(spark, tmp_path, texts), shuffled(spark)
    assert P.near_dup_clusters(spark, at).count() == 800
    assert shuffled(spark) - before < 2.5 * sum(map(len, texts))  # eight bytes for each shingle are 1.3 times the text, and a set is shuffled more than once


def test_alike_like_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([3, 5, 8, 40]))) for _ in range(60)]
    shingle = lambda t: frozenset(tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2))
    sets = {i: shingle(t) for i, t in enumerate(texts)}
    first = sorted({min(j for j, s in sets.items() if s == mine) for mine in sets.values()})
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(first, 2)}
    jaccard = {p: n / len(sets[p[0]] | sets[p[1]]) for p, n in shared.items()}
    inside = {p: n / min(len(sets[p[0]]), len(sets[p[1]])) for p, n in shared.items()}
    c = M.classes(M.sets(docs(spark, texts), "id", "text", 3))
    for j, k in ((0.18, 2), (2, 0.7), (0.08, 2)):
        want = {p for p in shared if jaccard[p] >= j or inside[p] >= k}
        assert want and {(r.a, r.b) for r in M.alike(c, j, k, 7).collect()} == want  # blocks of 7: most shingles are hot


def test_missing_links_between_notes(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(11))
    text = lambda i, more="": f"{same} " + " ".join(f"n{i}x{k}" for k in range(40)) + more
    rows = [(1, "v", "one", text(1, " [[two]]")), (2, "v", "two", text(2)), (3, "v", "three", text(3)), (4, "w", "four", text(4)), (5, "v", "five", text(2)), (6, "v", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, slug string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda: {(r.a, r.b) for r in P.note_missing_link(spark, str(tmp_path)).collect()}
    assert got() == {(1, 2), (1, 3), (2, 3)}  # 5 is a copy of 2 that 1 doesn't link
    spark.createDataFrame([(7, "x", "p", text(7, " [[q]]")), (8, "x", "q", text(8)), (9, "x", "r", text(9, " [[p]]"))], "doc_id bigint, source string, slug string, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert got() == {(1, 2), (1, 3), (2, 3), (8, 9)}


def exchanged(df):
    """The columns by which the plan's rows are shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [{c.split("#")[0].strip() for c in m.split(",")} for m in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def vault_of(spark, tmp_path, texts):
    rows = [(i, f"v{i % 2}", f"n{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, source string, slug string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def overlaps(texts):
    """(shared, na, nb) of the pairs of classes in each of two vaults."""
    shingle = lambda t: frozenset(tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2))
    out = {}
    for v in range(2):
        sets = {}
        for i, t in enumerate(texts):
            if i % 2 == v and shingle(t):
                sets.setdefault(shingle(t), i)
        out |= {(f"v{v}", i, j): (len(s & r), len(s), len(r)) for s, i in sets.items() for r, j in sets.items() if i < j}
    return out


def test_subsumed_notes_shuffle_no_pairs(spark, tmp_path):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdef", k=30))
    texts = [" ".join(base[: rng.choice([4, 5, 29])]) + " " + " ".join(rng.choices("uvwxyz", k=rng.choice([1, 2, 40]))) for _ in range(80)] + ["a b", ""]
    df = P.note_subsumption(spark, vault_of(spark, tmp_path, texts))
    want = {p for p, (n, a, b) in overlaps(texts).items() if n / min(a, b) >= 0.7 and n / (a + b - n) < 0.18}
    assert want and {(r.vault, r.a, r.b) for r in df.collect()} == want
    assert all(not by & {"h", "a", "b"} for by in exchanged(df))


def test_similar_notes_shuffle_no_pairs(spark, tmp_path):
    texts = [" ".join(f"w{(i * 7 + k) % 60}" for k in range(3 + i % 25)) for i in range(90)]
    df = P.similar_notes(spark, vault_of(spark, tmp_path, texts))
    want = {p for p, (n, a, b) in overlaps(texts).items() if n / (a + b - n) >= 0.18}
    assert want and {(r.vault, r.a, r.b) for r in df.collect()} == want
    assert all(not by & {"h", "a", "b"} for by in exchanged(df))


def test_texts_in_blocks_like_brute_force(spark, tmp_path):
    rng = random.Random(10)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([3, 5, 8, 40]))) for _ in range(60)]
    texts += [texts[0], "a b c a b c a", "b c a b c a b"]  # a copy, and two texts with equal sets
    rows = P.plain(spark, vault_of(spark, tmp_path, texts))
    for j, k in ((0.18, 2), (2, 0.7), (0.08, 2)):
        want = {p for p, (n, a, b) in overlaps(texts).items() if n / (a + b - n) >= j or n / min(a, b) >= k}
        assert {(r.grp, r.a, r.b) for r in M.alike(M.texts(rows, "note", "body", 3, "vault", 7), j, k, k=3).collect()} == want


def test_linked_notes_in_blocks(spark, tmp_path):
    rng = random.Random(11)
    same = " ".join(f"w{i}" for i in range(12))
    texts = [f"{same} " + " ".join(f"n{i % 24}x{k}" for k in range(30)) + "".join(f" [[n{rng.randrange(60)}|]]" for _ in range(rng.randrange(60))) for i in range(60)]
    rows = P.plain(spark, vault_of(spark, tmp_path, texts)).withColumn("text", F.split("body", r" \[").getItem(0)).withColumn("links", V.link_targets(F.col("body")))
    member = F.when(F.size("links") > 0, F.struct(F.lower("slug").alias("slug"), "links")).otherwise(F.struct(F.lower("slug").alias("slug"), F.lit(None).cast("array<string>").alias("links")))
    links = {(i, int(x)) for i, t in enumerate(texts) for x in re.findall(r"\[\[n(\d+)", t) if int(x) % 2 == i % 2 and int(x) != i}
    assert links and {(i, int(x[1:])) for i, xs in ((r.note, r.links) for r in rows.collect()) for x in xs if int(x[1:]) % 2 == i % 2 and int(x[1:]) != i} == links
    cls = {c: [i for i in range(60) if i % 24 == c] for c in range(24)}
    whole = lambda p, q: all((x, y) in links or (y, x) in links for x in cls[p] for y in cls[q])
    want = {(p, q) for p, q in itertools.combinations(range(24), 2) if p % 2 == q % 2 and not whole(p, q)}
    for block in (3, 1000):
        c = M.texts(rows, "note", "text", 3, "vault", block, notes=F.count("*"), members=F.collect_list(member))
        assert {(r.a, r.b) for r in M.alike(c, 0.08, 2, k=3).collect()} == want
    assert len(want) < len([1 for p, q in itertools.combinations(range(24), 2) if p % 2 == q % 2])
    assert all(not by & {"h", "a", "b"} for by in exchanged(P.note_missing_link(spark, str(tmp_path))))


def test_components_compute_edges_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    got = M.components(spark.createDataFrame([(1, 2), (3, 2), (5, 5), (7, 8)], "a int, b int").mapInArrow(run, "a int, b int"))
    assert {r.node: r.root for r in got.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and rows.value == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_matches_like_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("ab-c", k=rng.randint(1, 7)))
    targets, slugs = {word() for _ in range(30)}, {word() for _ in range(30)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(t, s) for t in targets for s in slugs if t in s or s in t or distance(t, s) <= 2}
    t = spark.createDataFrame([("v", x) for x in targets], "vault string, target string")
    s = spark.createDataFrame([("v", x) for x in slugs], "vault string, slug string")
    assert {(r.target, r.slug) for r in V.near_matches(t, s).collect()} == want


def test_contradictions(spark):
    df = spark.createDataFrame([(1, "v", "always velvet lantern on main"), (2, "v", "never velvet lantern"), (3, "v", "velvet"), (4, "w", "never velvet lantern")], "id int, v string, text string")
    assert [tuple(r) for r in M.contradictions(df.where("id <> 3"), "id", "text", "v").collect()] == [("v", 1, 2, 2)]
    assert M.contradictions(df, "id", "text", "v").count() == 0  # velvet isn't rare any more


def test_snapshot_and_undo(tmp_path):
    vault, back = tmp_path / "v", tmp_path / "v" / "backups"
    vault.mkdir()
    (vault / "a.md").write_text("1")
    sinks.snapshot(str(vault), str(back), "20260101")
    (vault / "a.md").write_text("2")
    (vault / "b.md").write_text("new")
    sinks.undo(str(vault), str(back))
    assert (vault / "a.md").read_text() == "1" and not (vault / "b.md").exists()


def test_index_against_files(spark):
    index = spark.createDataFrame([("v", "- [[a]] — the hook\n- [[gone]]\n- [B](b.md) - Same ")], "vault string, text string")
    rows = spark.createDataFrame([("v", "1", "A", "another"), ("v", "2", "b", "same"), ("v", "3", "c", None)], "vault string, note string, slug string, description string")
    entries = V.index_entries(index)
    assert {(r.target, r.status) for r in V.index_diff(entries, rows).collect()} == {("a", "both"), ("b", "both"), ("c", "file only"), ("gone", "index only")}
    assert [(r.note, r.hook) for r in V.hook_drift(entries, rows).collect()] == [("1", "the hook")]


def test_near_matches_of_all_lengths(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abc", k=n))
    targets = {word(rng.randint(1, 14)) for _ in range(60)} | {word(2000)}

    def change(w):
        i = rng.randrange(len(w))
        return w[:i] + rng.choice(["", "x", w[i], "ab"]) + w[i + rng.randint(0, 1) :]

    slugs = {s for w in targets for s in (change(w), change(change(w) or "a"), w[1:4])} - {""}
    t = spark.createDataFrame([("v", x) for x in targets], "vault string, target string")
    s = spark.createDataFrame([("v", x) for x in slugs], "vault string, slug string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    got = V.near_matches(t, s)
    assert {(r.target, r.slug) for r in got.collect()} == {(a, b) for a in targets for b in slugs if a in b or b in a or (abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_link_rules_read_links_once(spark, tmp_path):
    df = P.link_findings(spark, vault_of(spark, tmp_path, ["[[n0]] [[quite-lost]]\n[x](gone.md)", "[[n33333]]"]))
    assert {tuple(r) for r in df.collect()} == {("v0", "LNK03", "0", 1, "n0", 1), ("v0", "LNK02", "0", 2, "gone", 1)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 0  # links are checkpointed, not found again by each rule
