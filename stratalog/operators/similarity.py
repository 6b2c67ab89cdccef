"""Set similarity of texts: near duplicates, containment, clusters, shared rare terms.

Equal sets are one class, so copies never meet each other. Pairs of classes come from an inverted index
on each set's rarest shingles: two sets with a Jaccard similarity of t or more share one of the
|s| - ceil(t * |s|) + 1 rarest of either, so the join on those loses no pair, and frequent shingles, which
would pair everything with everything, are hardly ever among them.
"""

from __future__ import annotations

from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import text as T
from stratalog.operators import overlap, prefixes
from stratalog.sources.tables import checkpointed

K, LEAST = 5, 0.8


def sets(df: DataFrame, key: str, text: str, k: int = K, group: str | None = None) -> DataFrame:
    """(grp, key, cls, s): cls is the smallest key with an equal shingle set in the group; s, for that key alone, is the set as sorted 64-bit hashes.

    Texts too short for a shingle are left out. A set is known by two hashes and its size. Each class's smallest key is an aggregate with map-side
    combining, so a text that a third of all rows copy arrives as one partial a task; its rows are joined back with that single row,
    which adaptive skew joins split.
    """
    rows = df.select((F.col(group) if group else F.lit("")).alias("grp"), F.col(key).alias("key"), F.array_sort(F.array_distinct(T.shingle_hashes(F.col(text), k))).alias("s")).where(F.size("s") > 0)
    rows = rows.withColumns({"d1": F.xxhash64("s"), "d2": F.xxhash64(F.lit(7), "s"), "size": F.size("s")})
    same = rows.groupBy("grp", "d1", "d2", "size").agg(F.min("key").alias("cls"))
    return rows.join(same, ["grp", "d1", "d2", "size"]).select("grp", "key", "cls", F.when(F.col("key") == F.col("cls"), F.col("s")).alias("s"))


def classes(set_rows: DataFrame) -> DataFrame:
    """One row a class, with its shingles."""
    return set_rows.where("key = cls").select("grp", "cls", "s")


def pairs(class_rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(grp, a, b, jaccard), a < b, of all class pairs with a similarity of `least` or more."""
    c = class_rows.select("grp", "cls", F.size("s").alias("n"), F.explode("s").alias("h"))
    df = c.groupBy("grp", "h").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("grp", "cls")
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    prefix = c.join(df, ["grp", "h"]).withColumns({"at": F.row_number().over(mine.orderBy("df", "h")), "shared": F.count("*").over(mine)})
    # Shingles of one class only can't be shared, but they do take up places of the prefix.
    prefix = prefix.where(F.col("at") + F.col("n") - F.col("shared") <= keep).select("grp", "cls", "n", "h")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.cls") < F.col("b.cls")) & (F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n") - 1e-9))
    met = met.select(F.col("a.grp").alias("grp"), F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()
    return judged(met, class_rows).where(F.col("jaccard") >= least)


def judged(met: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Candidate pairs with shared shingles, Jaccard similarity and containment."""
    x = class_rows.select("grp", F.col("cls").alias("a"), F.col("s").alias("sa"))
    y = class_rows.select("grp", F.col("cls").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    rows = met.join(x, ["grp", "a"]).join(y, ["grp", "b"]).select("grp", "a", "b", both.alias("shared"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return rows.withColumns({"jaccard": F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), "containment": F.col("shared") / F.least("na", "nb")})


def related(class_rows: DataFrame) -> DataFrame:
    """All pairs that share any shingle, with counts. For groups of a bounded size: the result itself can be their square."""
    h = class_rows.select("grp", "cls", F.size("s").alias("n"), F.explode("s").alias("h"))
    a, b = h.alias("a"), h.alias("b")
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.cls") < F.col("b.cls")))
    rows = met.groupBy(F.col("a.grp").alias("grp"), F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(F.count("*").alias("shared"), F.first("a.n").alias("na"), F.first("b.n").alias("nb"))
    return rows.withColumns({"jaccard": F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), "containment": F.col("shared") / F.least("na", "nb")})


def lowered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s) for `signed` and `near`; words are told apart in Python, where their shingles are hashed."""
    return df.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("s"))


def _counted(rows: DataFrame, k: int) -> Broadcast:
    """About how many shingles (of s; with k of 0, s is a hash) each of 2 ** BITS buckets has, a byte each: 4 MB, whatever the corpus."""
    schema = "part int, codes binary"
    found = rows.mapInArrow(prefixes.counter(k), schema).repartition("part").mapInArrow(prefixes.summed, schema).collect()
    codes = b"".join(bytes(r.codes) for r in sorted(found, key=lambda r: r.part))
    return rows.sparkSession.sparkContext.broadcast(codes or bytes(1 << prefixes.BITS))


def signed(texts: DataFrame, least: float = LEAST, k: int = K) -> DataFrame:
    """(key, d1, d2, n, prefix) of `lowered` texts: a set of shingles is known by two digests and its size, and sent as hashes of its rarest shingles alone."""
    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(prefixes.signer(k, least, _counted(texts.select("s"), k)), f"key {kind}, d1 bigint, d2 bigint, n int, prefix binary")


def classed(signed_rows: DataFrame) -> DataFrame:
    """One row a set, with or without prefix, cls its smallest key; copies are combined before they are shuffled."""
    return signed_rows.groupBy(*(c for c in signed_rows.columns if c != "key")).agg(F.min("key").alias("cls"))


def near(texts: DataFrame, class_rows: DataFrame, least: float = LEAST, k: int = K) -> DataFrame:
    """(a, b, jaccard), a < b, of all pairs of `classed` sets with a similarity of `least` or more.

    What is shuffled are hashes of prefixes, then the words (they compress, hashes of all shingles don't) of texts that may be like another; for those the texts are read again.
    """
    kind = class_rows.schema["cls"].dataType.simpleString()
    places = class_rows.select("cls", "n", "prefix").mapInArrow(prefixes.entries, f"h bigint, cls {kind}, n int, at int")
    met = places.repartition("h").sortWithinPartitions("h").mapInArrow(prefixes.meeting(least), f"a {kind}, b {kind}")
    met = checkpointed(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    marks = _counted(met.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("s")), 0)
    few = texts.withColumn("id", F.xxhash64("key")).mapInArrow(prefixes.wanted(marks), f"key {kind}, s string")
    x, y = (few.select(F.col("key").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    rows = met.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(prefixes.judge(k), f"a {kind}, b {kind}, shared bigint, na bigint, nb bigint")
    return rows.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


#: Texts, and characters of text, of a block; groups with more are cut in blocks, and each pair of blocks is a place of its own.
BLOCK, CHARS = 10_000, 8_000_000


def texts(df: DataFrame, key: str, text: str, k: int, group: str, block: int = BLOCK, **more: Column) -> DataFrame:
    """(grp, of, cls, s) for `alike`: s is the text's words with single blanks, of the number of blocks of its group; texts too short for a shingle are left out.

    Words are sent instead of hashes of shingles: they compress, hashes don't. Equal ones are one row with the smallest key, combined before they are shuffled; `more` are
    further aggregates of those. Only groups of several blocks are broadcast, of which a corpus of n texts has n / block at most and a few by length.
    """
    size = df.groupBy(F.col(group).alias("grp")).agg(F.greatest(F.ceil(F.sum(F.length(text)) / CHARS), F.ceil(F.count("*") / block)).cast("int").alias("of")).where("of > 1")
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))
    rows = df.withColumns({"grp": F.col(group), "s": words}).where(F.col("grp").isNotNull() & F.col("s").rlike(rf"^(?:\w+ ){{{k - 1}}}\w"))
    rows = rows.groupBy("grp", "s").agg(F.min(key).alias("cls"), *[c.alias(n) for n, c in more.items()])
    return rows.join(F.broadcast(size), "grp", "left").withColumn("of", F.coalesce("of", F.lit(1)))


def alike(class_rows: DataFrame, jaccard: float, containment: float, block: int = BLOCK, k: int = 0) -> DataFrame:
    """(grp, a, b, jaccard, containment), a < b, of pairs of classes with at least that Jaccard similarity or that containment; for groups of any size.

    class_rows: of `classes`, or of `texts` with the `k` of its shingles. Pairs that share a shingle are nearly all pairs of a vault, so none is shuffled: each pair of a group's
    blocks is a place to which both blocks' rows are sent, shingles shared are counted there one row against a block, and only pairs that are alike leave it.
    A set's block follows from the set, so texts with equal sets meet and are one class. With members (see `linked`), pairs that are linked are left out.
    """
    if "of" not in class_rows.columns:
        size = class_rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
        class_rows = class_rows.join(size, "grp")
    hashes = F.array_distinct(T.shingle_hashes(F.col("s"), k) if k else F.col("s"))
    digest = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda z, h: z.bitwiseXOR(h))
    at = F.when(F.col("of") > 1, F.pmod(digest, F.col("of"))).otherwise(0).cast("int")
    rows = class_rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    more = [c for c in ("notes", "members") if c in rows.columns]
    rows = rows.select("grp", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", "cls", "s", *more)
    rows = rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    kind = class_rows.schema["cls"].dataType.simpleString()
    return rows.mapInArrow(overlap.searcher(k, jaccard, containment), f"grp string, a {kind}, b {kind}, jaccard double, containment double")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components, root the smallest node.

    Large-star and small-star rounds: the number of rounds is logarithmic in a component's size. Each round is checkpointed to the shared folder; only a
    single checksum a round goes to the driver.
    """
    both = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    now, seen = both, None
    while True:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        best = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(best, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = checkpointed(small)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    nodes = both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).distinct()
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def rare_terms(df: DataFrame, key: str, text: str, group: str, most: int = 2) -> DataFrame:
    """(grp, key, term) of terms that at most `most` texts of the group have."""
    t = df.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.explode(T.terms(F.col(text))).alias("term"))
    rare = t.groupBy("grp", "term").agg(F.count("*").alias("df")).where(F.col("df").between(2, most))
    return t.join(rare.select("grp", "term"), ["grp", "term"])


#: Words of which a text leans to one or the other.
OPPOSITES = [("main", "master"), ("always", "never"), ("enabled", "disabled"), ("safari", "chromium")]


def leans(text: Column) -> Column:
    """For each of OPPOSITES: 1, -1 or 0, by which word the text has more of."""
    low = F.lower(text)
    return F.array(*[F.signum(F.regexp_count(low, F.lit(rf"\b{x}\b")) - F.regexp_count(low, F.lit(rf"\b{y}\b"))).cast("int") for x, y in OPPOSITES])


def contradictions(df: DataFrame, key: str, text: str, group: str, shared: int = 2) -> DataFrame:
    """(grp, a, b, terms): pairs with so many rare terms in common that lean opposite ways. A rare term is in two texts, so it makes one pair."""
    r = rare_terms(df, key, text, group)
    a, b = r.alias("a"), r.alias("b")
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.key") < F.col("b.key")))
    met = met.groupBy(F.col("a.grp").alias("grp"), F.col("a.key").alias("a"), F.col("b.key").alias("b")).agg(F.count("*").alias("terms")).where(F.col("terms") >= shared)
    side = df.select(F.col(group).alias("grp"), F.col(key).alias("key"), leans(F.col(text)).alias("l"))
    x, y = side.select("grp", F.col("key").alias("a"), F.col("l").alias("la")), side.select("grp", F.col("key").alias("b"), F.col("l").alias("lb"))
    opposite = F.exists(F.zip_with("la", "lb", lambda p, q: p * q), lambda v: v < 0)
    return met.join(x, ["grp", "a"]).join(y, ["grp", "b"]).where(opposite).select("grp", "a", "b", "terms")
