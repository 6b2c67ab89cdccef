"""Note vaults: `documents` by source, and test items by suite for pairwise similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.functions import text as T
from stratalog.operators import similarity as M
from stratalog.operators import vault as V
from stratalog.plans.catalogue import Catalogue
from stratalog.plans.people import _quote
from stratalog.sources.facts import sql_half_up
from stratalog.sources.tables import checkpointed, table

query = Catalogue()

_CLEAN = r"regexp_replace(body, '\s+', ' ', 'g')"
_NOTES = f"""n AS (SELECT *, lower(slug) AS lslug FROM (SELECT source AS vault, doc_id AS note, slug, coalesce(text, '') AS text,
  CASE WHEN regexp_matches(coalesce(text, ''), {_quote(V.FENCED)}) THEN replace(regexp_replace(text, {_quote(V.FENCED)}, ''), chr(13) || chr(10), chr(10)) ELSE coalesce(text, '') END AS body FROM documents))"""
_SLUG = lambda x: rf"lower(trim(regexp_replace(list_last(string_split(trim(regexp_replace(trim({x}), '[#|].*$', '')), '/')), '(?i)\.md$', '')))"
_LINKS = rf"""r AS (SELECT vault, note, slug, generate_subscripts(ls, 1) AS line, unnest(ls) AS row FROM (SELECT vault, note, slug, string_split(body, chr(10)) AS ls FROM n)),
  k AS (SELECT vault, note, slug, line, 'wiki' AS kind, unnest(regexp_extract_all(row, '\[\[([^\]\n]+)\]\]', 1)) AS raw FROM r
    UNION ALL SELECT vault, note, slug, line, 'markdown', raw FROM (SELECT vault, note, slug, line, unnest(regexp_extract_all(row, '(?:^|[^!])\[[^\]\n]*\]\(([^)\s]+)[^)]*\)', 1)) AS raw FROM r) WHERE NOT regexp_matches(raw, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)')),
  l AS (SELECT vault, note, slug, line, kind, {_SLUG('raw')} AS target FROM k),
  s AS (SELECT vault, lslug AS target, count(*) AS hits, min(note) AS "to" FROM n WHERE slug IS NOT NULL GROUP BY ALL),
  e AS (SELECT l.*, coalesce(s.hits, 0) AS hits, s."to" FROM l LEFT JOIN s ON s.vault = l.vault AND s.target = l.target)"""


def sql(body: str) -> str:
    return f"WITH {_NOTES}, {_LINKS} {body}"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return V.notes(table(spark, sf, "documents"), "source", "doc_id", "slug", "text")


def plain(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with body alone: no Python where no front matter field is asked for."""
    return table(spark, sf, "documents").select(F.col("source").alias("vault"), F.col("doc_id").alias("note"), "slug", V.body(F.col("text")).alias("body"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    n = plain(spark, sf)
    return V.resolve(V.links(n), n)


@query(sql("SELECT vault, note, line, kind, target, count(*) AS n FROM l GROUP BY ALL"))
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return V.links(plain(spark, sf)).groupBy("vault", "note", "line", "kind", "target").agg(F.count("*").alias("n"))


@query(sql('SELECT DISTINCT vault, note, target, hits, "to" FROM e'))
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("vault", "note", "target", "hits", "to").distinct()


_DEGREES = 'd AS (SELECT n.vault, n.note, (SELECT count(*) FROM e WHERE e.hits > 0 AND e.note = n.note) AS out_degree, (SELECT count(*) FROM e WHERE e.hits > 0 AND e."to" = n.note AND e.note <> n.note) AS in_degree FROM n)'


@query(sql(f", {_DEGREES} SELECT * FROM d"))
def link_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return V.degrees(plain(spark, sf), _resolved(spark, sf))


@query(sql(f", {_DEGREES} SELECT vault, note FROM d WHERE out_degree = 0 AND in_degree = 0"))
def link_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Notes without links either way."""
    return V.degrees(plain(spark, sf), _resolved(spark, sf)).where("out_degree = 0 and in_degree = 0").select("vault", "note")


@query(sql("SELECT vault, note, line, kind, target, count(*) AS n FROM e WHERE hits = 0 GROUP BY ALL"))
def link_broken(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).where("hits = 0").groupBy("vault", "note", "line", "kind", "target").agg(F.count("*").alias("n"))


def _near(spark: SparkSession, sf: str, resolved: DataFrame) -> DataFrame:
    """Both sides are words alone; they are written once, since each meets the other in three ways."""
    lost = checkpointed(resolved.where("hits = 0 and target <> ''").select("vault", "target").distinct())
    slugs = table(spark, sf, "documents").where("slug <> ''").select(F.col("source").alias("vault"), F.lower("slug").alias("slug")).distinct()
    return V.near_matches(lost, checkpointed(slugs))


_NEAR = """t AS (SELECT DISTINCT vault, target FROM e WHERE hits = 0 AND target <> ''), c AS (SELECT DISTINCT vault, lslug AS slug FROM n WHERE slug <> ''),
  m AS (SELECT t.vault, t.target, c.slug, CASE WHEN abs(length(target) - length(slug)) > 3 THEN 99 ELSE levenshtein(target, slug) END AS distance FROM t JOIN c USING (vault) WHERE contains(target, slug) OR contains(slug, target) OR levenshtein(target, slug) <= 2)"""


@query(sql(f", {_NEAR} SELECT vault, target, slug, CAST(distance AS INT) AS distance FROM m"))
def near_match(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs that an unresolved target may mean."""
    return _near(spark, sf, _resolved(spark, sf))


@query(sql(f""", {_NEAR}, f AS (SELECT vault, target, count(*) AS near, min(slug) AS guess FROM m GROUP BY ALL), x AS (
    SELECT vault, 'LNK03' AS "check", note, line, target AS evidence FROM e WHERE "to" = note UNION ALL SELECT vault, 'LNK04', note, line, target FROM e WHERE hits > 1
    UNION ALL SELECT e.vault, 'LNK01', note, line, guess FROM e JOIN f USING (vault, target) WHERE hits = 0 AND kind = 'wiki' AND near = 1 UNION ALL SELECT vault, 'LNK02', note, line, target FROM e WHERE hits = 0 AND kind = 'markdown')
  SELECT vault, "check", CAST(note AS VARCHAR) AS note, CAST(line AS INT) AS line, evidence, count(*) AS n FROM x GROUP BY ALL"""))
def link_findings(spark: SparkSession, sf: str) -> DataFrame:
    resolved = checkpointed(_resolved(spark, sf))
    return V.link_rules(resolved, _near(spark, sf, resolved)).groupBy(*V.FINDING).agg(F.count("*").alias("n"))


_LN = "string_split(body, chr(10))"
_FM = lambda k: rf"regexp_extract(regexp_extract(text, {_quote(V.FENCED)}), '(?m)^[ \t]*{k}:[ \t]*(.*?)[ \t\r]*$', 1)"
_RULES = rf"""x AS (SELECT *, regexp_matches(text, {_quote(V.FENCED)}) AS fenced, nullif({_FM('name')}, '') AS name, nullif({_FM('description')}, '') AS description, nullif({_FM('type')}, '') AS type FROM n),
  f AS (SELECT vault, 'SCH01' AS "check", note, NULL::INT AS line, NULL AS evidence FROM x WHERE NOT fenced
    UNION ALL SELECT vault, 'SCH02', note, NULL, concat_ws(', ', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN description IS NULL THEN 'description' END, CASE WHEN type IS NULL THEN 'type' END) FROM x WHERE fenced AND (name IS NULL OR description IS NULL OR type IS NULL)
    UNION ALL SELECT vault, 'SCH03', note, NULL, type FROM x WHERE type NOT IN ('user', 'feedback', 'project', 'reference')
    UNION ALL SELECT vault, 'SCH08', note, NULL, name FROM x WHERE {_SLUG('name')} <> slug
    UNION ALL SELECT vault, 'SCH09', note, NULL, NULL FROM x WHERE trim({_CLEAN}) = ''
    UNION ALL SELECT vault, 'IDX09', note, NULL, NULL FROM x WHERE regexp_matches(slug, '[A-Z]') OR (contains(slug, '-') AND contains(slug, '_'))
    UNION ALL SELECT vault, 'HYG01', note, NULL, NULL FROM x WHERE len(list_filter({_LN}, lambda z: regexp_matches(z, '[ \t]+$'))) > 0 OR contains(body, chr(13))
    UNION ALL SELECT vault, 'HYG04', note, NULL, NULL FROM x WHERE trim(regexp_replace(list_filter({_LN}, lambda z: regexp_matches(z, '^#\s+\S'))[1], '^#\s+', '')) = name
    UNION ALL SELECT vault, 'HYG05', note, CAST(list_position(list_transform({_LN}, lambda z: regexp_matches(z, {_quote(V.PLACEHOLDER)})), true) AS INT), NULL FROM x WHERE regexp_matches(body, {_quote(V.PLACEHOLDER)})
    UNION ALL SELECT vault, 'STA01', note, CAST(list_position(list_transform({_LN}, lambda z: regexp_matches(z, {_quote(V.RELATIVE)})), true) AS INT), NULL FROM x WHERE regexp_matches(body, {_quote(V.RELATIVE)}))"""


@query(sql(f', {_RULES} SELECT vault, "check", CAST(note AS VARCHAR) AS note, line, evidence FROM f'))
def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return V.note_rules(notes(spark, sf)).select(*V.FINDING)


_SEV = "CASE WHEN \"check\" IN ('IDX02', 'IDX04', 'IDX05') THEN 'high' WHEN \"check\" IN ('IDX01', 'IDX11', 'SCH01', 'SCH02', 'SCH03', 'SCH09', 'STA01', 'DUP01') THEN 'med' WHEN \"check\" = 'SEC01' THEN 'critical' ELSE 'low' END"


@query(sql(f', {_RULES} SELECT "check", {_SEV} AS severity, count(*) AS n FROM f WHERE {_SEV} IN (\'critical\', \'high\', \'med\') GROUP BY ALL'))
def severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = V.at_least(V.with_severity(V.note_rules(notes(spark, sf))), "med")
    return f.groupBy("check", "severity").agg(F.count("*").alias("n"))


@query(sql(f""", {_RULES}, g AS (SELECT *, {_SEV} AS severity, list_position(['critical', 'high', 'med', 'low'], {_SEV}) AS rank FROM f)
  SELECT vault, CAST(note AS VARCHAR) AS note, count(*) AS n, arg_min(severity, rank) AS worst, arg_min("check", (rank, "check")) AS top_issue FROM g GROUP BY vault, note"""))
def vault_triage(spark: SparkSession, sf: str) -> DataFrame:
    return V.triage(V.with_severity(V.note_rules(notes(spark, sf))))


@query(sql(", " + r"""c AS (SELECT *, regexp_replace(body, '\s+', ' ', 'g') AS flat FROM n) SELECT vault, count(*) AS notes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) FILTER (trim(flat) = '') AS empty, count(DISTINCT slug) AS slugs FROM c GROUP BY vault"""))
def vault_overview(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("vault"), "slug", F.coalesce("text", F.lit("")).alias("text"))
    blank = T.blank(V.body(F.col("text")))
    return docs.groupBy("vault").agg(F.count("*").alias("notes"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(blank).alias("empty"), F.countDistinct("slug").alias("slugs"))


@query("SELECT source AS vault, coalesce(note_type, 'unknown') AS type, count(*) AS n FROM documents GROUP BY ALL")
def vault_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("vault"), F.coalesce("note_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


@query(sql(rf", h AS (SELECT vault, sha1(lower(trim({_CLEAN}))) AS body_hash, note FROM n WHERE trim({_CLEAN}) <> '') SELECT vault, body_hash, min(note) AS first, count(*) AS copies FROM h GROUP BY ALL HAVING count(*) > 1"))
def dup_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that several notes of a vault share."""
    n = plain(spark, sf).withColumn("body_hash", T.body_hash(F.col("body")))
    return V.duplicates(n)


@query("SELECT source AS vault, lower(slug) AS slug, count(*) AS n, min(doc_id) AS first FROM documents WHERE slug IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def dup_slug(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("slug is not null")
    return d.groupBy(F.col("source").alias("vault"), F.lower("slug").alias("slug")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(sql(r", b AS (SELECT vault, note, len(regexp_extract_all(body, '(?m)^## ')) AS sections, len(regexp_extract_all(body, '(?m)^- ')) AS bullets FROM n) SELECT vault, note, sections, bullets FROM b WHERE sections >= 2 OR bullets >= 8"))
def oversized(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of several sections or many bullets."""
    n = plain(spark, sf)
    cols = {"sections": F.regexp_count("body", F.lit("(?m)^## ")).cast("bigint"), "bullets": F.regexp_count("body", F.lit("(?m)^- ")).cast("bigint")}
    return n.withColumns(cols).where("sections >= 2 or bullets >= 8").select("vault", "note", "sections", "bullets")


@query(sql(rf""", y AS (SELECT n.vault, n.note, d.note_type AS type, regexp_matches(body, {_quote(V.HAS_WHY)}) AS why, regexp_matches(body, {_quote(V.HAS_HOW)}) AS how FROM n JOIN documents d ON d.doc_id = n.note)
  SELECT vault, note, concat_ws(' + ', CASE WHEN NOT why THEN 'Why' END, CASE WHEN type = 'feedback' AND NOT how THEN 'How to apply' END) AS missing FROM y WHERE type IN ('feedback', 'project') AND (NOT why OR (type = 'feedback' AND NOT how))"""))
def missing_why_how(spark: SparkSession, sf: str) -> DataFrame:
    n = plain(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("note"), "note_type"), "note").where("note_type in ('feedback', 'project')")
    why, how = ~F.col("body").rlike(V.HAS_WHY), (F.col("note_type") == "feedback") & ~F.col("body").rlike(V.HAS_HOW)
    return n.select("vault", "note", F.concat_ws(" + ", F.when(why, "Why"), F.when(how, "How to apply")).alias("missing")).where("missing <> ''")


def _shingled(columns: str, text: str, k: int, source: str) -> str:
    """Rows of `source` with `sh`, the sorted distinct shingles of a text; its words are split once."""
    w = f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda z: z <> '')"
    sh = f"list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))))"
    return f"SELECT {columns}, {sh} AS sh FROM (SELECT {columns}, {w} AS w FROM {source})"


_NEARDUP = f"""sd AS ({_shingled('note', 'body', M.K, 'n')}), t AS (SELECT note, sh, min(note) OVER (PARTITION BY sh) AS cls FROM sd WHERE len(sh) > 0), c AS (SELECT cls, sh, len(sh) AS n FROM t WHERE note = cls),
  x AS (SELECT cls, n, unnest(sh) AS h FROM c), p AS (SELECT a.cls AS a, b.cls AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.h = b.h AND a.cls < b.cls GROUP BY ALL HAVING jaccard >= {M.LEAST})"""


def _near_dups(spark: SparkSession, sf: str) -> DataFrame:
    texts = M.lowered(plain(spark, sf), "note", "body")
    return M.near(texts, M.classed(M.signed(texts)))


@query(sql(f", {_NEARDUP} SELECT a, b, {sql_half_up('jaccard', 6)} AS jaccard FROM p"))
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes of equal five-word shingle sets with a similarity of 0.8 or more."""
    return _near_dups(spark, sf).select("a", "b", N.half_up(F.col("jaccard"), 6).alias("jaccard"))


@query(sql(f", {_NEARDUP}, d AS (SELECT a AS cls FROM p UNION ALL SELECT b FROM p), q AS (SELECT cls, count(*) AS links FROM d GROUP BY cls) SELECT note AS doc_id, cls, coalesce(links, 0) AS links FROM t LEFT JOIN q USING (cls)"))
def near_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's class and how many other classes it is near."""
    texts = M.lowered(plain(spark, sf), "note", "body")
    rows = checkpointed(M.signed(texts))
    links = M.near(texts, M.classed(rows)).select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    sets = rows.drop("prefix")
    members = sets.join(M.classed(sets), ["d1", "d2", "n"]).withColumnRenamed("key", "doc_id")
    return members.join(links, "cls", "left").select("doc_id", "cls", F.coalesce("links", F.lit(0)).alias("links"))


@query(sql(f""", {_NEARDUP}, g AS (WITH RECURSIVE y AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT DISTINCT a AS node, a AS root FROM y UNION SELECT y.b, r.root FROM r JOIN y ON y.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node)
  SELECT node, root FROM g"""))
def near_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Connected classes, each with the smallest of its cluster."""
    return M.components(_near_dups(spark, sf))


# Test items are few and fixed in number: the pair operators with low thresholds run on them, a suite being a vault.
_REL = f"""i AS ({_shingled('item_id, suite', 'text', 3, 'eval_items')}), q AS (SELECT item_id, suite, sh, min(item_id) OVER (PARTITION BY suite, sh) AS cls FROM i WHERE len(sh) > 0),
  c AS (SELECT suite, cls, len(sh) AS n, unnest(sh) AS h FROM q WHERE item_id = cls), p AS (SELECT a.suite, a.cls AS a, b.cls AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard, count(*) / least(any_value(a.n), any_value(b.n)) AS containment
    FROM c a JOIN c b ON a.h = b.h AND a.suite = b.suite AND a.cls < b.cls GROUP BY ALL)"""


def _related(spark: SparkSession, sf: str) -> DataFrame:
    return M.related(M.classes(M.sets(table(spark, sf, "eval_items"), "item_id", "text", 3, "suite"))).withColumnRenamed("grp", "suite")


@query(f"WITH {_REL} SELECT suite, a, b, {sql_half_up('jaccard', 6)} AS jaccard FROM p WHERE jaccard >= 0.18")
def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf).where("jaccard >= 0.18").select("suite", "a", "b", N.half_up(F.col("jaccard"), 6).alias("jaccard"))


@query(f"WITH {_REL} SELECT suite, a, b, {sql_half_up('containment', 6)} AS containment FROM p WHERE containment >= 0.7 AND jaccard < 0.18")
def subsumption(spark: SparkSession, sf: str) -> DataFrame:
    """One holds most of the other, yet they aren't alike."""
    return _related(spark, sf).where("containment >= 0.7 and jaccard < 0.18").select("suite", "a", "b", N.half_up(F.col("containment"), 6).alias("containment"))


@query(f"WITH {_REL} SELECT suite, a, b, {sql_half_up('jaccard', 6)} AS jaccard FROM p WHERE jaccard >= 0.08 AND jaccard < 0.18")
def missing_link(spark: SparkSession, sf: str) -> DataFrame:
    """Related items; items carry no links, so none is taken out."""
    return _related(spark, sf).where("jaccard >= 0.08 and jaccard < 0.18").select("suite", "a", "b", N.half_up(F.col("jaccard"), 6).alias("jaccard"))


# The same over all notes of each vault.
_ALIKE = f"""i AS ({_shingled('note, vault', 'body', 3, 'n')}), q AS (SELECT note, vault, sh, min(note) OVER (PARTITION BY vault, sh) AS cls FROM i WHERE len(sh) > 0),
  c AS (SELECT vault, cls, len(sh) AS n, unnest(sh) AS h FROM q WHERE note = cls), p AS (SELECT a.vault, a.cls AS a, b.cls AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard, count(*) / least(any_value(a.n), any_value(b.n)) AS containment
    FROM c a JOIN c b ON a.h = b.h AND a.vault = b.vault AND a.cls < b.cls GROUP BY ALL)"""


def _alike(spark: SparkSession, sf: str, jaccard: float, containment: float) -> DataFrame:
    return M.alike(M.texts(plain(spark, sf), "note", "body", 3, "vault"), jaccard, containment, k=3).withColumnRenamed("grp", "vault")


@query(sql(f", {_ALIKE} SELECT vault, a, b, {sql_half_up('jaccard', 6)} AS jaccard FROM p WHERE jaccard >= 0.18"))
def similar_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes of a vault's notes with equal three-word shingle sets that are alike."""
    return _alike(spark, sf, 0.18, 2).select("vault", "a", "b", N.half_up(F.col("jaccard"), 6).alias("jaccard"))


@query(sql(f", {_ALIKE} SELECT vault, a, b, {sql_half_up('containment', 6)} AS containment FROM p WHERE containment >= 0.7 AND jaccard < 0.18"))
def note_subsumption(spark: SparkSession, sf: str) -> DataFrame:
    """One note holds most of the other, yet they aren't alike."""
    return _alike(spark, sf, 2, 0.7).where("jaccard < 0.18").select("vault", "a", "b", N.half_up(F.col("containment"), 6).alias("containment"))


@query(sql(f""", {_ALIKE}, lp AS (SELECT DISTINCT l.vault, least(l.note, n.note) AS x, greatest(l.note, n.note) AS y FROM l JOIN n ON n.vault = l.vault AND n.lslug = l.target AND n.note <> l.note),
  lc AS (SELECT lp.vault, least(u.cls, v.cls) AS a, greatest(u.cls, v.cls) AS b, count(*) AS linked FROM lp JOIN q u ON u.note = x AND u.vault = lp.vault JOIN q v ON v.note = y AND v.vault = lp.vault GROUP BY ALL), z AS (SELECT vault, cls, count(*) AS notes FROM q GROUP BY ALL)
  SELECT vault, a, b, {sql_half_up('jaccard', 6)} AS jaccard FROM p WHERE jaccard >= 0.08 AND jaccard < 0.18 AND NOT EXISTS (SELECT 1 FROM lc JOIN z za ON za.vault = lc.vault AND za.cls = lc.a JOIN z zb ON zb.vault = lc.vault AND zb.cls = lc.b WHERE lc.vault = p.vault AND lc.a = p.a AND lc.b = p.b AND linked = za.notes * zb.notes)"""))
def note_missing_link(spark: SparkSession, sf: str) -> DataFrame:
    """Related notes that aren't linked either way; a pair of classes stays as long as two notes of theirs aren't linked."""
    n = plain(spark, sf).withColumn("links", V.link_targets(F.col("body")))
    member = F.when(F.col("slug").isNotNull() | (F.size("links") > 0), F.struct(F.lower("slug").alias("slug"), "links"))
    found = M.alike(M.texts(n, "note", "body", 3, "vault", notes=F.count("*"), members=F.collect_list(member)), 0.08, 2, k=3).where("jaccard < 0.18")
    return found.select(F.col("grp").alias("vault"), "a", "b", N.half_up(F.col("jaccard"), 6).alias("jaccard"))


_TERMS = "list_distinct(list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda z: length(z) >= 5))"
_LEAN = ", ".join(rf"CAST(sign(len(regexp_extract_all(lower(body), '\b{x}\b')) - len(regexp_extract_all(lower(body), '\b{y}\b'))) AS INT) AS l{i}" for i, (x, y) in enumerate(M.OPPOSITES))


@query(sql(f""", w AS (SELECT vault, note, unnest({_TERMS}) AS term FROM n), d AS (SELECT vault, term FROM w GROUP BY ALL HAVING count(*) = 2), z AS (SELECT w.* FROM w JOIN d USING (vault, term)),
  m AS (SELECT a.vault, a.note AS a, b.note AS b, count(*) AS terms FROM z a JOIN z b ON a.vault = b.vault AND a.term = b.term AND a.note < b.note GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT vault, note, {_LEAN} FROM n)
  SELECT m.vault, a, b, terms FROM m JOIN o p ON p.note = a JOIN o q ON q.note = b WHERE p.l0 * q.l0 < 0 OR p.l1 * q.l1 < 0 OR p.l2 * q.l2 < 0 OR p.l3 * q.l3 < 0"""))
def contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of a vault with rare terms in common that lean opposite ways."""
    return M.contradictions(plain(spark, sf), "note", "body", "vault").withColumnRenamed("grp", "vault")


_RED = f"""g AS (SELECT list_distinct(flatten(list(sh))) AS gs FROM ({_shingled('instruction', 'instruction', 3, '(SELECT DISTINCT instruction FROM eval_items WHERE instruction IS NOT NULL)')})), sd AS ({_shingled('note', 'body', 3, 'n')}),
  u AS (SELECT note, len(list_intersect(sh, gs)) AS shared, len(sh) AS ns, len(gs) AS ng FROM sd, g WHERE len(sh) > 0)"""


@query(sql(f", {_RED} SELECT note, {sql_half_up('shared / (ns + ng - shared)', 6)} AS jaccard FROM u WHERE shared / (ns + ng - shared) >= 0.15"))
def redundancy(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that repeat the shared instructions. Their shingles are one small row: the distinct instructions are counted first."""
    texts = table(spark, sf, "eval_items").where("instruction is not null").select("instruction").distinct().limit(10_001).collect()
    if len(texts) > 10_000:
        raise ValueError("shared instructions are expected to be few")
    common = spark.createDataFrame([(r.instruction,) for r in texts], "instruction string").select(F.explode(T.shingles(F.col("instruction"))).alias("x")).agg(F.collect_set("x").alias("gs"))
    n = plain(spark, sf).select("note", T.shingles(F.col("body")).alias("s")).where("size(s) > 0").crossJoin(F.broadcast(common))
    shared = F.size(F.array_intersect("s", "gs"))
    return n.select("note", (shared / (F.size("s") + F.size("gs") - shared)).alias("j")).where("j >= 0.15").select("note", N.half_up(F.col("j"), 6).alias("jaccard"))


def index(spark: SparkSession, sf: str) -> DataFrame:
    """(vault, text): an index that lists every link of a vault's notes once, by target; what a vault says of itself."""
    entry = F.concat(F.lit("- ["), "target", F.lit("]("), "target", F.lit(".md)"))
    rows = V.links(plain(spark, sf)).select("vault", "target").where("target <> ''").distinct()
    return rows.groupBy("vault").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("text"))


_INDEX = "v AS (SELECT vault, target, row_number() OVER (PARTITION BY vault ORDER BY '- [' || target || '](' || target || '.md)') AS line, '- [' || target || '](' || target || '.md)' AS row FROM (SELECT DISTINCT vault, target FROM l WHERE target <> ''))"


@query(sql(f", {_INDEX} SELECT vault, note FROM n WHERE vault IN (SELECT vault FROM v) AND NOT EXISTS (SELECT 1 FROM v WHERE v.vault = n.vault AND v.target = n.lslug)"))
def index_orphans(spark: SparkSession, sf: str) -> DataFrame:
    n, ix = plain(spark, sf), index(spark, sf)
    entries = V.index_entries(ix)
    found = V.index_rules(entries, n, V.states(ix, entries, n))
    return found.where("check = 'IDX01'").select("vault", F.col("note").try_cast("bigint").alias("note"))


@query(sql(f", {_INDEX} SELECT v.vault, CAST(line AS INT) AS line, row AS evidence FROM v WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.vault = v.vault AND n.lslug = v.target)"))
def index_dangling(spark: SparkSession, sf: str) -> DataFrame:
    n, ix = plain(spark, sf), index(spark, sf)
    entries = V.index_entries(ix)
    return V.index_rules(entries, n, V.states(ix, entries, n)).where("check = 'IDX02'").select("vault", "line", "evidence")


@query(sql(f", {_INDEX}, o AS (SELECT *, CAST(coalesce(sum(octet_length(encode(row)) + 1) OVER (PARTITION BY vault ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM v) SELECT vault, CAST(line AS INT) AS line, off AS \"offset\", line > 200 OR off >= 25600 AS below_fold FROM o"))
def byte_offset_fold(spark: SparkSession, sf: str) -> DataFrame:
    return V.index_entries(index(spark, sf)).select("vault", "line", "offset", "below_fold")


@query(sql(f""", {_INDEX}, h AS (SELECT vault, lslug AS target, min(slug) AS slug FROM n WHERE slug IS NOT NULL GROUP BY ALL)
  SELECT h.vault, CAST(row_number() OVER (PARTITION BY h.vault ORDER BY v.line NULLS LAST, h.slug) AS INT) AS ord, h.slug FROM h LEFT JOIN v USING (vault, target)"""))
def reindex_order(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical index of each vault: old entries first in their order, then new notes by slug."""
    made = V.reindex(V.index_entries(index(spark, sf)), notes(spark, sf))
    return made.select("vault", "ord", F.regexp_extract("entry", r"\]\((.*?)\.md\)", 1).alias("slug"))


@query()
def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter fields of every note; the parser has its tests on literal notes."""
    return notes(spark, sf).select("vault", "note", "shape", "name", "description", "type", "extra")


@query()
def index_findings(spark: SparkSession, sf: str) -> DataFrame:
    n, ix = plain(spark, sf), index(spark, sf)
    entries = V.index_entries(ix)
    return V.index_rules(entries, n, V.states(ix, entries, n))


_PARA = r"list_filter(regexp_split_to_array(body, '\n[ \t]*\n'), lambda z: trim(regexp_replace(z, '\s+', ' ', 'g')) <> '')"


@query(sql(rf""", a AS (SELECT note, unnest({_PARA}) AS para FROM n), b AS (SELECT note, len(regexp_extract_all(para, '[.!?](?:\s|$)')) AS sentences, len(regexp_extract_all(para, '\S+')) AS words FROM a)
  SELECT note, count(*) AS paragraphs, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(words) AS BIGINT) AS words, {sql_half_up('count(*) FILTER (sentences = 1) / count(*)', 4)} AS single_share, CAST(max(words) AS BIGINT) AS longest FROM b GROUP BY note"""))
def prose_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, sentences and words of each note, the share of one-sentence paragraphs, and the longest."""
    paras = F.filter(F.split("body", r"\n[ \t]*\n"), lambda p: ~T.blank(p))
    p = plain(spark, sf).select("note", F.explode(paras).alias("para"))
    p = p.select("note", F.regexp_count("para", F.lit(r"[.!?](?:\s|\z)")).cast("bigint").alias("sentences"), F.regexp_count("para", F.lit(r"\S+")).cast("bigint").alias("words"))
    return p.groupBy("note").agg(
        F.count("*").alias("paragraphs"), F.sum("sentences").alias("sentences"), F.sum("words").alias("words"), N.half_up(F.count_if(F.col("sentences") == 1) / F.count("*"), 4).alias("single_share"), F.max("words").alias("longest")
    )


@query(sql(rf""", a AS (SELECT note, generate_subscripts(ps, 1) AS k, unnest(ps) AS para FROM (SELECT note, {_PARA} AS ps FROM n)), b AS (SELECT note, k, len(regexp_extract_all(para, '[.!?](?:\s|$)')) AS c FROM a),
  w AS (SELECT note, c, lag(c) OVER o AS c1, lag(c, 2) OVER o AS c2, lag(c, 3) OVER o AS c3 FROM b WINDOW o AS (PARTITION BY note ORDER BY k)) SELECT note, count(*) AS runs FROM w WHERE c = c1 AND c = c2 AND c = c3 GROUP BY note"""))
def prose_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with four paragraphs in a row of as many sentences."""
    paras = F.filter(F.split("body", r"\n[ \t]*\n"), lambda p: ~T.blank(p))
    p = plain(spark, sf).select("note", F.posexplode(paras).alias("k", "para")).withColumn("c", F.regexp_count("para", F.lit(r"[.!?](?:\s|\z)")))
    w = Window.partitionBy("note").orderBy("k")
    same = (F.col("c") == F.lag("c").over(w)) & (F.col("c") == F.lag("c", 2).over(w)) & (F.col("c") == F.lag("c", 3).over(w))
    return p.withColumn("same", same).where("same").groupBy("note").agg(F.count("*").alias("runs"))


@query(sql(f""", {_INDEX}, a AS (SELECT DISTINCT vault, lslug AS target FROM n WHERE slug <> ''), v2 AS (SELECT DISTINCT vault, target FROM v)
  SELECT coalesce(a.vault, v2.vault) AS vault, coalesce(a.target, v2.target) AS target, CASE WHEN v2.target IS NULL THEN 'file only' WHEN a.target IS NULL THEN 'index only' ELSE 'both' END AS status FROM a FULL JOIN v2 ON a.vault = v2.vault AND a.target = v2.target"""))
def index_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Index against files, both sides labelled."""
    entries = V.index_entries(index(spark, sf))
    return V.index_diff(entries, plain(spark, sf).where("slug <> ''"))


@query()
def hook_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries whose hook says something else than the note's description; the rule has its tests on literal vaults."""
    return V.hook_drift(V.index_entries(index(spark, sf)), notes(spark, sf))


@query(sql(rf""", w AS (SELECT note, len(regexp_extract_all(body, '\S+')) AS words, len(regexp_extract_all(body, '(?i)\b[a-z]+[''’](?:t|s|re|ve|ll|d|m)\b')) AS short FROM n)
  SELECT note, words, short AS contractions, {sql_half_up('coalesce(short * 90.0::DOUBLE / nullif(words, 0), 0)', 2)} AS per_90 FROM w WHERE words > 0"""))
def prose_contractions(spark: SparkSession, sf: str) -> DataFrame:
    """Contractions of each note, and for every 90 words."""
    w = plain(spark, sf).select("note", F.regexp_count("body", F.lit(r"\S+")).cast("bigint").alias("words"), F.regexp_count("body", F.lit(r"(?i)\b[a-z]+['’](?:t|s|re|ve|ll|d|m)\b")).cast("bigint").alias("contractions"))
    return w.where("words > 0").select("note", "words", "contractions", N.half_up(N.safe_div(F.col("contractions") * 90.0, F.col("words")), 2).alias("per_90"))


@query(sql(rf""", a AS (SELECT note, unnest({_PARA}) AS para FROM n), op AS (SELECT note, lower(regexp_extract(para, '^\s*(\S+)', 1)) AS opener FROM a), g AS (SELECT note, opener, count(*) AS k, sum(count(*)) OVER (PARTITION BY note) AS total FROM op WHERE opener <> '' GROUP BY note, opener)
  SELECT note, opener, k, {sql_half_up('k / total', 4)} AS share FROM g WHERE k > 1 AND k / total > 0.15"""))
def prose_openers(spark: SparkSession, sf: str) -> DataFrame:
    """Words that open more than 15 percent of a note's paragraphs, and more than one."""
    paras = F.filter(F.split("body", r"\n[ \t]*\n"), lambda p: ~T.blank(p))
    o = plain(spark, sf).select("note", F.explode(paras).alias("p")).select("note", F.lower(F.regexp_extract("p", r"^\s*(\S+)", 1)).alias("opener")).where("opener <> ''")
    g = o.groupBy("note", "opener").agg(F.count("*").alias("k"))
    total = g.groupBy("note").agg(F.sum("k").alias("total"))
    share = F.col("k") / F.col("total")
    return g.join(total, "note").where((F.col("k") > 1) & (share > 0.15)).select("note", "opener", "k", N.half_up(share, 4).alias("share"))


@query(sql("SELECT vault, count(*) AS notes, count(*) FILTER (contains(lower(body), 'cache')) AS about FROM n GROUP BY vault"))
def vault_browse(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of each vault, and those that mention a word: the facet search of the explorer."""
    n = plain(spark, sf)
    return n.groupBy("vault").agg(F.count("*").alias("notes"), F.count_if(F.contains(F.lower("body"), F.lit("cache"))).alias("about"))


QUERIES, ORACLES = query.queries, query.oracles
