"""Scalar functions against literal values."""

import pytest
from pyspark.sql import functions as F

from stratalog.functions import frontmatter, redaction, shell
from stratalog.functions import numbers as N
from stratalog.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("x", "digits", "want"), [(1.005, 2, 1.0), (-2.5, 0, -2.0), (2.5, 0, 3.0), (None, 2, 0.0), (float("inf"), 1, 0.0), (-0.0, 0, 0.0)])
def test_half_up(spark, x, digits, want):
    assert one(spark, N.half_up(F.lit(x).cast("double"), digits)) == want


def test_numbers(spark):
    cases = [
        (N.thousands_short(F.lit(999)), "999"), (N.thousands_short(F.lit(5310)), "5.3k"), (N.thousands_short(F.lit(531202)), "531k"), (N.thousands_short(F.lit(2_000_000)), "2.00M"),
        (N.tokens_short(F.lit(1200)), "1.2k"), (N.grouped(F.lit(1000)), "1,000"), (N.bytes_short(F.lit(512)), "512 B"), (N.bytes_short(F.lit(2048)), "2.0 KB"), (N.bytes_short(F.lit(2 << 20)), "2.0 MB"),
        (N.percent(F.lit(0.412)), "41.2%"), (N.duration_words(F.lit(0)), "—"), (N.duration_words(F.lit(5)), "5s"), (N.duration_words(F.lit(65)), "1m 5s"), (N.duration_words(F.lit(3660)), "1h 1m"),
        (N.zone(F.lit(0.5), 0.4), "warn"), (N.gauge(F.lit(190), F.lit(10)), "bad"), (N.plural(F.lit(1), "row", "rows"), "1 row"), (N.iso_of(F.lit(0)), ""), (N.iso_of(F.lit(1)), "1970-01-01T00:00:01.000Z"),
        (N.safe_div(F.lit(1), F.lit(0)), 0.0), (N.epoch(F.lit("2026-01-01T00:00:00.999Z")), 1767225600), (N.epoch(F.lit("2026-01-01T00:00:00")), 1767225600), (N.epoch(F.lit("nonsense")), None),
        (N.duration_sec(F.lit(5000), F.lit(4000)), 0.0), (N.duration_sec(F.lit(None).cast("bigint"), F.lit(4000)), None),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (i, got[i], want)


def test_text(spark):
    cases = [
        (T.length16(F.lit("a😀b")), 4), (T.est_tokens(F.lit("")), 0), (T.est_tokens(F.lit("abcd")), 1), (T.est_tokens(F.lit("x" * 400)), 100), (T.clip(F.lit("abcdef"), 3, "…"), "abc…"), (T.clip(F.lit("abc"), 3, "…"), "abc"),
        (T.first_line(F.lit("\n  \n  hit \nx")), "hit"), (T.first_line(F.lit("")), ""), (T.collapse(F.lit(" a \n b ")), "a b"), (T.error_signature(F.lit("ENOENT: no such file 'a.ts'")), "ENOENT: no such file <str>"),
        (T.error_signature(F.lit("see https://x.y/z at /a/b.c 12")), "see <url> at <path> <n>"), (T.normalize_slug(F.lit(" dir/Note-One.md#part|alias ")), "note-one"), (T.edit_distance(F.lit("near-mtch"), F.lit("near-match")), 1),
        (T.edit_distance(F.lit("a"), F.lit("abcdef")), 99), (T.request_key(F.lit("fix the typecheck errors")), ""), (T.request_key(F.lit("Fix errors in typecheck of parser, quickly")), "errors fix parser quickly typecheck"),
        (T.strip_harness(F.lit("a <system-reminder>x\ny</system-reminder> b")), "a  b"), (T.matchable(F.lit("A\n> q\n```x```")), "a\n \n "), (T.mime_of(F.lit("a.PNG")), "image/png"), (T.mime_of(F.lit("a")), "application/octet-stream"),
        (T.or_none(F.lit("  ")), "none"), (T.group_of(F.lit("IDX09")), "IDX"), (T.encode_slug(F.lit("/a/b.c")), "-a-b-c"), (T.common_prefix(F.lit("-home-a"), F.lit("-home-b")), "-home-"),
        (T.shingles(F.lit("a b c d")), ["a b c", "b c d"]), (T.shingles(F.lit("a b")), []), (T.clip_error(F.lit("x token=abc  y")), "x token=[redacted] y"), (T.escape_html(F.lit("<a&'\">")), "&lt;a&amp;&#39;&quot;&gt;"),
        (T.blank(F.lit("  \n")), True), (T.primary_arg(F.lit("Read"), F.lit('{"path":"p","file_path":""}')), "p"), (T.primary_arg(F.lit("Bash"), F.lit("{}")), None), (T.cap(F.lit("abcd"), 2), "ab\n… [2 more chars]"),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (i, got[i], want)


@pytest.mark.parametrize(
    ("cmd", "family", "name"),
    [
        ("bun run typecheck --filter web", "bun run typecheck", "bun"), ("cd /some/path && pnpm build", "pnpm build", "pnpm"), ("npx tsx x.ts", "tsx x", "tsx"), ("bunx tsx x.ts", "tsx x", "tsx"), ("git log -1", "git log", "git"),
        ("FOO=1 time git log", "git log", "git"), ("git \\\n  status", "git status", "git"), ("echo 'a; b' > x", "echo", "echo"), ("", "", ""), (None, "", ""),
    ],
)
def test_families(cmd, family, name):
    assert shell.normalize(cmd)[:2] == (family, name)


def test_masks_and_segments():
    assert shell.masked('cp /a/b "quoted string" 01234567-89ab-cdef-0123-456789abcdef deadbeef123') == "cp <path> <str> <lit> <lit>"
    assert "--glob=<v>" in shell.masked("rg --glob=*.ts TODO")
    assert shell.split_segments("a && b || c; d | e\nf &") == (["a", "b", "c", "d", "e", "f"], True)
    assert shell.split_segments("a '&&' $(b; c) 2>&1") == (["a '&&' $(b; c) 2>&1"], False)
    assert shell.normalize("cat <<EOF\nx && y\nEOF")[3] == 1


@pytest.mark.parametrize(
    ("text", "gone", "label"),
    [
        ("OPENAI_KEY=sk-" + "a1B2c3" * 5, "a1B2c3", "openai-key"), ("token: ghp_" + "A" * 36, "AAAA", "github"), ("AUTH_TOKEN=abc123def456ghi789", "ghi789", ""), ("AWS_ACCESS_KEY_ID=AKIA" + "A1B2" * 4, "AKIA", "aws-access-key-id"),
        ('token = "' + "0123456789abcdef" * 2 + '01234567"', "abcdef", ""), ("postgres://u:pw12345@h/db", "pw12345", ""), ("x -----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY----- y", "abc", "private-key-block"),
    ],
)
def test_secrets_go(text, gone, label):
    for dialect in redaction.RULES:
        out = redaction.redact(text, dialect)
        assert gone not in out and "[REDACTED" in out
    assert not label or label in redaction.redact(text, redaction.LABELLED)


@pytest.mark.parametrize("text", ["the build passed in 12s", "commit 0123456789abcdef0123456789abcdef01234567", "password=changeme", "token: ${TOKEN}", "", None, "API_VERSION=20240101"])
def test_harmless_text_stays(text):
    assert redaction.redact(text) == text


def test_redaction_columns(spark):
    df = spark.createDataFrame([("Bearer " + "a1" * 12,), (None,)], "x string")
    assert [r[0] for r in df.select(redaction.redact_shapes(F.col("x"))).collect()] == ["Bearer [REDACTED]", None]
    assert [r[0] for r in df.select(redaction.redact_udf()("x")).collect()] == ["Bearer [REDACTED]", None]
    assert redaction.first_secret_line("ok\nAUTH_TOKEN=abc123def456ghi789") == 2


def test_frontmatter():
    nested = frontmatter.parse("---\nname: 'A b'\ndescription: \"d\"\nmetadata:\n  type: user\n  odd: 1\n---\nbody\n")
    assert (nested["shape"], nested["name"], nested["type"], nested["quoted"], nested["extra"], nested["body"]) == ("nested", "A b", "user", True, {"odd": "1"}, "body\n")
    flat = frontmatter.parse("﻿---\r\nname: x\r\ntype: user\r\n---\r\na\r\nb")
    assert (flat["shape"], flat["type"], flat["body"]) == ("flat", "user", "a\nb")
    assert frontmatter.parse("---\nname: x\nno end")["shape"] == "none"
    assert frontmatter.parse(None)["body"] == ""


def test_sql_names(spark):
    from stratalog.functions import register

    register.register(spark)
    row = spark.sql("""SELECT normalize_command('cd x && git log -1').family AS f, redact('AUTH_TOKEN=abc123def456ghi789') AS r, entropy('ab') AS e, pretty_json('{"a":1}') AS p, secret_line('x') AS s, parse_frontmatter('x').shape AS m""").first()
    assert (row.f, row.r, row.e, row.p, row.s, row.m) == ("git log", "AUTH_TOKEN=[REDACTED]", 1.0, '{\n  "a": 1\n}', None, "none")


def test_commands_of_all_families(spark, tmp_path):
    from stratalog.plans import misc

    rows = [(i, f"tool{i} run --x {i}") for i in range(120)] + [(0, "tool0 run --x 0"), (500, None)]
    spark.createDataFrame(rows, "row_id bigint, cmd string").write.parquet(str(tmp_path / "bash_rows.parquet"))
    got = {r.row_id: r for r in misc.normalize_command(spark, str(tmp_path)).collect()}
    assert len(got) == len({r.family for r in got.values()}) == 120 and all(r.normalized and r.chain_length == 1 for r in got.values())


def test_html_behind_character_200(spark, tmp_path):
    import hashlib

    from stratalog.plans import misc

    texts = ["x" * 300 + f"<b a='{c}'>&" for c in "yz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.sha for r in misc.html_escape_whole(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha1(("x" * 300 + f"&lt;b a=&#39;{c}&#39;&gt;&amp;").encode()).hexdigest() for i, c in enumerate("yz")}


@pytest.mark.parametrize("dialect", [redaction.PLAIN, redaction.LABELLED])
@pytest.mark.parametrize("secret", ["AAAA3859" + "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c", "0f1e2d3c4b5a6978" * 38])
def test_hex_runs_of_any_length_and_beginning(dialect, secret):
    assert secret[:32] not in redaction.redact(f"api_key blob {secret} end", dialect)
    assert redaction.redact(f"commit {secret}", dialect) == f"commit {secret}"
