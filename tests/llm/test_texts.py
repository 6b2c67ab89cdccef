"""Personal information, leaks and languages."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from stratalog.llm import language, leaks, pii


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@x-y.example now", [("a.b+c@x-y.example", "email")]), ("A_B9@MAIL.X.TEST", [("A_B9@MAIL.X.TEST", "email")]), ("to=a@b.test&tel=07700 900041", [("a@b.test", "email"), ("07700 900041", "phone")]),
        ("user a.b [at] post [dot] velden [dot] example gone", [("a.b [at] post [dot] velden [dot] example", "email")]), ("x(at)y.example", [("x(at)y.example", "email")]), ("joe at mail dot test", [("joe at mail dot test", "email")]),
        ("git@forge.x.test:team/a.git", []), ("ssh deploy@edge.x.test uptime", []), ("update @a/b@2.41.0", []), ("https://u@host.test/x", []),
        ("TEL:+44 7700 900 094", [("+44 7700 900 094", "phone")]), ("(415) 555 0179", [("(415) 555 0179", "phone")]), ("+1 (206) 555-0181.", [("+1 (206) 555-0181", "phone")]), ("+1.646.555.0102", [("+1.646.555.0102", "phone")]),
        ("030 / 23125 112", [("030 / 23125 112", "phone")]), ("+49 30 23125-129", [("+49 30 23125-129", "phone")]), ("01 99 00 38 10", [("01 99 00 38 10", "phone")]), ("312-555-0129 busy", [("312-555-0129", "phone")]),
        ("code 312-445, order 4759-2259-59, job 9027272727, 10.28.0.6:8028, 2026-03-07 10:33:00, 00237650-ca10-47e8-a53a-cc8d5841e111", []),
        ("SSN 907 96 3489", [("SSN 907 96 3489", "id_number")]), ("902-36-6861", [("902-36-6861", "id_number")]), ("QQ 80 22 31 C", [("QQ 80 22 31 C", "id_number")]), ("Steuer-ID 54 496 395 193", [("Steuer-ID 54 496 395 193", "id_number")]),
        ("74807696N", [("74807696N", "id_number")]), ("passport C1854852", [("passport C1854852", "id_number")]), ("commit 31060254f", []),
        ("at 58 Juniper Road, Quillmarsh now", [("58 Juniper Road, Quillmarsh", "address")]), ("Flat 19, 57 Cobbler Lane", [("Flat 19, 57 Cobbler Lane", "address")]), ("Lindenhofstr. 40, 00257 Velden", [("Lindenhofstr. 40, 00257 Velden", "address")]),
        ("63 rue des Trois Aubiers, 00821 Velden", [("63 rue des Trois Aubiers, 00821 Velden", "address")]), ("Calle de las Acequias 158, 2º D, Velden", [("Calle de las Acequias 158, 2º D, Velden", "address")]),
        ("Sandgruben Allee 146, 00889 Tinfern", [("Sandgruben Allee 146, 00889 Tinfern", "address")]), ("take 31 Street View tiles, Lane 6 is slower than Road Map mode", []),
    ],
)
def test_forms(text, want):
    assert kinds(text) == want


TEXTS = ["from: Odalys Kornblatt <odalys.kornblatt@x.example>", "FN:Imke Grauwald", "Author: Imke Kornblatt <grauwald+ci@y.test>", "ping Odalys Grauwald please", "Kornblatt, Imke says no", "I. Grauwald and odalys kornblatt", "the Release Notes and the Green Build page", "Road Map by ODALYS GRAUWALD", "only odalys@x.example", "git log --author='Imke Kornblatt-Grauwald'", "", None, "x" * 100_000]


def test_names_by_disclosure(spark):
    df = spark.createDataFrame([(i, t, "t", "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "t", "clash")], "row_id bigint, text string, tbl string, kind string")
    texts = pii.gather({("m", "text"): df})
    got = {r.row_id for r in pii.find(texts).where("kind = 'name'").collect()}
    assert got == {0, 1, 2, 3, 4, 5, 7, 9}
    assert {tuple(r) for r in pii.find(texts, limit=1).collect()} == {tuple(r) for r in pii.find(texts).collect()}
    clean = {r.row_id: r.text for r in pii.sanitise(texts).collect()}
    assert clean[0] == "from: [NAME] <[EMAIL]>" and clean[3] == "ping [NAME] please" and clean[6] == TEXTS[6] and clean[10] == ""
    assert pii.find(texts.where("false")).count() == 0


WORDS = [f"w{i}" for i in range(400)]


def corrupt(words, edits, rng):
    words = list(words)
    for at in sorted(rng.sample(range(1, len(words) - 1), edits), reverse=True):
        what = rng.choice("cda")
        words[at : at + (what != "a")] = [] if what == "d" else ["zz"]
    return words


@pytest.mark.parametrize("text", ["vera.holm (ät) firma (punkt) de", "vera.holm (At) firm (dot) com", "vera.holm (Arroba) firm (punto) es", "nom [chez] domaine [point] fr"])
def test_spelled_signs(text):
    assert [k for _, _, k in pii.spans(text)] == ["email"]


def test_joined_terms_like_broadcast_ones(spark):
    names = ["Ugo Dell'Acqua", "Ada Dall’Orsi", "Eva Lind-Holm"]
    told = [f"{n} <{n.split()[0].lower()}.{p}@example.org>" for n, p in zip(names, ["dell.acqua", "dall.orsi", "lind.holm"]) for _ in range(4)]
    rows = list(enumerate([*told, *(f"ask {n} about it" for n in names), "nobody here", ""]))
    texts = pii.gather({("m", "text"): spark.createDataFrame(rows + rows[:1], "row_id bigint, text string")})
    broadcast = sorted(tuple(r) for r in pii.find(texts).collect())
    assert {r[1] for r in broadcast if r[3] == "name"} == set(range(15))
    assert sorted(tuple(r) for r in pii.find(texts, limit=0).collect()) == broadcast
    assert sorted(tuple(r) for r in pii.sanitise(texts, limit=0).collect()) == sorted(tuple(r) for r in pii.sanitise(texts).collect())


def test_names_told_once(spark):
    told = ["Zora Quill <zora.quill@example.org> wrote it", "Author: Ilse Vandermeer", "Mark Brown <mbrown@example.org>", "from: Petra Quandt"]
    plain = ['"name": "Run Tests"'] + ["mark the brown line and mark it again, brown on brown, mark", "run tests, run tests, run tests and run tests, run tests"] * 3
    df = spark.createDataFrame(list(enumerate(told + plain)), "row_id bigint, text string")
    texts = pii.gather({("m", "text"): df})
    found = lambda t: {r.row_id for r in pii.find(t).where("kind = 'name'").collect()}
    assert found(texts) == found(texts.unionByName(texts).unionByName(texts)) == {0, 1, 2, 3}
    assert {r.row_id: r.text for r in pii.sanitise(texts).collect()}[2] == "[NAME] <[EMAIL]>"


def test_leaks_of_edited_passages():
    rng = random.Random(6)
    for _ in range(150):
        item = rng.choices(WORDS, k=rng.randint(20, 90))
        searcher = leaks.Searcher([(1, " ".join(item)), (2, " ".join(rng.choices(WORDS, k=60)))])
        size = rng.randint(20, len(item))
        at = rng.randint(0, len(item) - size)
        passage = corrupt(item[at : at + size], size // 8, rng)
        assert searcher.leaks(" ".join(["q"] * 9 + passage + ["q"] * 30)) == [1]
        assert searcher.leaks(" ".join(["q"] * 9 + item[:17] + ["q"] * 30)) == []


def least(item, doc):
    """Whether any span of 20 words or more of the item is within an eighth of any part of the document: brute force."""
    for a in range(len(item)):
        rows = [0] * (len(doc) + 1)
        for n, w in enumerate(item[a:], 1):
            prev, rows[0] = rows[0], n
            for j, d in enumerate(doc, 1):
                prev, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, prev + (w != d))
            if n >= 20 and min(rows) <= n // 8:
                return True
    return False


def test_leaks_like_brute_force():
    rng, seen = random.Random(8), set()
    for _ in range(120):
        item = rng.choices(WORDS, k=40)
        size = rng.randint(16, 40)
        doc = ["q"] * 3 + corrupt(item[:size], rng.randint(1, size // 4), rng) + ["q"] * 3
        want = least(item, doc)
        seen.add(want)
        assert leaks.Searcher([(1, " ".join(item))]).leaks(" ".join(doc)) == [1] * want
    assert seen == {True, False}


def test_what_does_not_count():
    plain = leaks.words("Der Meißel von l'eau sold 12 barrels, twice a week; the end")
    for text in ("DER MEISSEL VON L’EAU SOLD 12 BARRELS TWICE A WEEK THE END", "> Der Meißel von\n> l'eau sold 12 barrels,\n> twice a week; the end", "  1| Der Meißel von l'eau\n  2| sold 12 barrels,\n  3| twice a week; the end",
                 "<p>Der <b>Meißel</b> von l&#39;eau sold 12 barrels, twice a week; the end</p>", '{"input": "Der Mei\\u00dfel von l\'eau sold 12 barrels,\\ntwice a week; the end"}'[11:-2], "Der **Meißel** von _l'eau_ sold 12 `barrels`, twice a week; the end"):
        assert leaks.words(text) == plain, text
    assert leaks.words(None) == leaks.words(" \n") == []


def test_a_searcher_takes_the_memory_stated():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(1_000)]
    tracemalloc.start()
    searcher = leaks.Searcher(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= leaks.BYTES_A_CHARACTER * sum(len(t) for _, t in items) * 1.5  # small tables weigh more
    assert searcher.leaks("x " + items[7][1] + " y") == [7]


def test_leak_table(spark):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, None), (3, ""), (None, item), (4, "x " * 200_000 + item)], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(7, item), (7, item), (8, " ".join(WORDS[40:60])), (9, None), (10, "short"), (11, item.upper())], "item_id bigint, text string")
    want = {(d, i) for d in (1, None, 4) for i in (7, 11)}
    assert {tuple(r) for r in leaks.find_leaks(docs, items).collect()} == want
    assert {tuple(r) for r in leaks.find_leaks(docs, items, at_once=100).collect()} == want
    assert leaks.find_leaks(docs, items).count() == len(want)
    assert leaks.find_leaks(docs, items.where("false")).count() == leaks.find_leaks(docs.where("false"), items).count() == 0


SENTENCES = {
    "en": ["The worker returns zero even when tests are skipped.", "Please keep the note short and read it again later.", "Nobody had noticed that the page was already dead."],
    "de": ["Der Dienst meldet Erfolg, obwohl die Tests übersprungen wurden.", "Die Notiz muss kurz bleiben und wird später gelesen.", "Niemand hatte bemerkt, dass die Seite schon tot war."],
    "es": ["El servicio termina bien aunque se omitan las pruebas.", "La nota debe ser breve y se lee otra vez más tarde.", "Nadie había notado que la página ya no funciona."],
    "ja": ["この規則は別の項目には当てはまりません。", "利用者は三回も訂正したあとで作業を終えました。", "このメモは短く書いてください。"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(SENTENCES[lang if rng.random() > 0.1 else "en"], k=4)), lang) for lang in SENTENCES for _ in range(40)]
    return language.fit(rows)


def test_labels(spark):
    rows = ["en", "EN", "en_GB", "English", "deu", "German", "de-AT", "日本語", "xx", "und", "unknown", "", None, " fr ", "Brazilian Portuguese", "xx-de"]
    df = spark.createDataFrame([(r,) for r in rows], "l string")
    assert [r[0] for r in df.select(language.named(F.col("l"))).collect()] == ["en"] * 4 + ["de"] * 3 + ["ja"] + [None] * 5 + ["fr", "pt", None]


def test_units_without_code():
    text = "---\nname: x\n---\n# Head\nOne two. Three four!\nfive\n\n- item\n* other one\n```sh\nls -la\n```\n$ git status\n2026-01-01T00:00:00Z INFO x=1\n| a | b |\n> quoted line\nlast one"
    assert language.units(text) == ["One two.", "Three four!", "five", "item", "other one", "quoted line last one"]
    for unit, start, end in language.placed_units(text.replace("\n", "\r\n")):
        assert text.replace("\n", "\r\n")[start:end].split()[-1] == unit.split()[-1]
    assert language.units(None) == language.units("") == language.units(" \n\t") == []


def test_held_out_sentences(model):
    for lang, text in (("en", "The page was read again and nobody had noticed it."), ("de", "Die Tests wurden später gelesen, obwohl niemand die Seite bemerkt hatte."), ("es", "Nadie había omitido las pruebas aunque la página termina bien."), ("ja", "利用者はこの項目を短く訂正してください。")):
        at, scores = language.judge(language.Scorer(model), [text])
        assert language.LANGUAGES[at[0]] == lang and language.chances(scores)[0, at[0]] > 0.9
    at, _ = language.judge(language.Scorer(model), ["last but not least", "", "Wczoraj wieczorem poszliśmy zobaczyć nową sztukę znanego reżysera", "x" * 50 + " is no code and it was later read again"])
    assert at.tolist() == [-1, -1, len(language.LANGUAGES), 0]


def test_passages(spark, model):
    en, de, ja = (" ".join(SENTENCES[x]) for x in ("en", "de", "ja"))
    rows = [(1, en, "en"), (2, en, "de"), (3, f"{en}\n\n{de}", "English"), (4, f"{en} {SENTENCES['de'][0]}", "en"), (5, ja, None), (6, None, "en"), (7, "", None), (8, "```\nlet x = 1;\n```", "xx"), (9, en * 2000, "unknown"), (1, en, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("units", F.lit(0))
    assert {tuple(r) for r in language.mislabelled(df, model).collect()} == {(2, "en"), (3, "de"), (5, "ja"), (9, "en")}
    found = language.passages(df, model)
    for r in found.join(df, "doc_id").where("doc_id < 6").collect():
        assert r.text[r.start : r.end].split()[0] in " ".join(SENTENCES[r.lang]) and 0.5 < r.confidence <= 1
    assert [(r.lang, r.units) for r in found.where("doc_id = 3").orderBy("passage").collect()] == [("en", 3), ("de", 3)]
    whole = {r.doc_id: r for r in language.document_languages(df.dropDuplicates(["doc_id"]), found).collect()}
    assert whole[2].lang == "en" and whole[6].lang is None and 0 < whole[3].confidence <= 1
    assert language.mislabelled(df.where("false"), model).count() == 0


def test_training_from_a_table(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(SENTENCES[lang], k=4)), lang) for i, lang in enumerate(list(SENTENCES) * 30)] + [(999, None, "en"), (998, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.mislabelled(df, language.train(df, sample=20)).count() == 0
    assert language.passages(df, language.train(df.where("false"))).count() == 0


def test_long_japanese_sentences():
    sentence = "この文書は毎日の作業の記録であり、昨日の会議で決まったことと今日の予定を短くまとめてから、関係する全員に送るために書かれたものであることを忘れないでください。"
    assert len(sentence) > 60 and len(language.tokens(sentence)) > 20
    assert language.tokens("https://example.org/a?b=c" + sentence) == language.tokens(sentence)
    assert language.tokens("x" * 70) == language.tokens("https://example.org/a") == []
