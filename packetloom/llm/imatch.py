"""I-Match document fingerprints, in DataFrame operations.

The lexicon is the terms whose inverse document frequency, counted over all documents, lies in a
band. It is cut into randomised subsets: at each of four rates (1/16, 1/64, 1/256, 1/1024) sixteen
disjoint subsets. A text's distinct terms in a subset are sorted and hashed; the fingerprint is the
64 hashes, 4 hex digits each (``----``: no term there). Large subsets tell texts apart, small ones
outlive edits: the likeness of two fingerprints is the best share of equal hashes over the four
rates, among the subsets that hold a term of either text (at least ``LEAST`` of them).

Terms are known by their 64-bit hash. The band bounds the lexicon: at most 1 / ``rarest`` times the
mean number of distinct terms of a document can reach the document frequency ``rarest`` of all
documents, whatever their number. It is broadcast below ``BROADCAST_TERMS`` and joined by a shuffle
beyond.

Documents are put next to one another by blocks of doc_id, cut at quantiles over all of them. A
block also holds a copy of the first document of the next block, so a text is shuffled once and all
later steps stay where it lies.

Cases: a null text counts as empty; equal texts count once for the band; a text without any term in
the band takes all its terms, and one without any term a hash of its whole text; equal texts have
equal fingerprints, and equal fingerprints the likeness 1; a null doc_id comes last in descending
order; rows that repeat a doc_id are ordered by their texts' hash; with one document the next is
itself; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.io import written

#: Rates are 2**-b; subsets at each rate; subsets that a likeness rests on at least.
RATE_BITS, SUBSETS, LEAST = (4, 6, 8, 10), 16, 4

#: The band of document frequencies, as shares of all documents.
RAREST, COMMONEST = 1 / 1000, 1 / 50

BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """The distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """The hashes of the terms in the band, over whole texts; equal texts count once."""
    # Texts stay out of the shuffle: a row per digest names the one that counts.
    rows = docs.select("text", F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    one = written(rows.groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "digests")
    n = one.count()
    later = rows.join(one.filter("copies > 1").select("sha", F.col("row").alias("first")), "sha", "left").filter("first IS NULL OR row = first")
    counted = later.select(F.explode(terms(F.col("text"))).alias("t")).select(F.xxhash64("t").alias("term"))
    return counted.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df").between(max(1, n * rarest), max(1, n * commonest))).select("term")


def cut_points(docs: DataFrame, blocks: int) -> list[int]:
    """Where doc_ids are cut into blocks of nearly equal counts."""
    shares = [i / blocks for i in range(1, blocks)]
    if not shares:
        return []
    return sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or []))


def _block(cuts: list[int]) -> Column:
    """How many cuts are at or below doc_id, by binary search; 0 for a null."""
    if not cuts:
        return F.lit(0)
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    held = ",".join(f"{c}L" for c in cuts)
    step = f"IF(a + s <= {len(cuts)} AND get(array({held}), a + s - 1) <= doc_id, a + s, a)"
    return F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (a, s) -> {step})")


def neighbours(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(block, seq, ghost, doc_id, text, next_text): documents in descending order of doc_id with the one after."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = cut_points(rows, blocks or min(1 << 14, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("block", _block(cuts))
    firsts = {r.block: r.first for r in rows.groupBy("block").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    after = {b: firsts[order[(i + 1) % len(order)]] for i, b in enumerate(order)}  # the doc_id that follows a block
    spread = ", ".join(f"({b}, CAST({'NULL' if d is None else d} AS BIGINT))" for b, d in after.items()) or "(0, CAST(NULL AS BIGINT))"
    ends = spark.sql(f"SELECT * FROM VALUES {spread} AS t(block, first)")
    ghosts = rows.drop("block").join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first")))
    both = rows.select("block", "doc_id", "text", F.lit(False).alias("ghost")).union(ghosts.select("block", "doc_id", "text", F.lit(True)))
    w = Window.partitionBy("block").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return both.withColumn("seq", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def edited(text: str = "text", after: str = "next_text") -> Column:
    """The text with its last third replaced by as many code points of the next one's start."""
    n = F.char_length(text)
    third = (n / 3).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - third), F.substring(F.coalesce(F.col(after), F.lit("")), F.lit(1), third))


def _subsets(h: Column) -> Column:
    """The subsets (0 to 63) that a term's hash lies in."""
    found = []
    for level, bits in enumerate(RATE_BITS):
        r = F.shiftrightunsigned(h, 13 * level).bitwiseAND((1 << bits) - 1)
        found.append(F.when(r < SUBSETS, r + level * SUBSETS))
    return F.array_compact(F.array(*found))


def _likeness(a: str, b: str) -> Column:
    """The best share of equal hashes over the rates; 1 for equal fingerprints."""
    best = []
    for level in range(len(RATE_BITS)):
        x, y = (F.slice(F.col(c), level * SUBSETS + 1, SUBSETS) for c in (a, b))
        pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
        held = F.size(F.filter(pairs, lambda p: (p["x"] != "----") | (p["y"] != "----")))
        same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != "----")))
        best.append(same / F.greatest(held, F.lit(LEAST)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(*best))


def fingerprints(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, blocks: int | None = None) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and their likenesses."""
    words = written(lexicon(docs, rarest, commonest), "lexicon").withColumn("known", F.lit(True))
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = neighbours(docs, blocks).withColumn("edited", edited())
    own = ("block", "seq", "ghost", "doc_id", "n_chars")
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    each = rows.select("block", "seq", "ghost", "doc_id", F.char_length("text").alias("n_chars"), F.explode(texts).alias("x"))
    each = each.filter("NOT ghost OR x.which = 0").select(*own, "x.which", F.col("x.t").alias("t"))
    # One more entry per text, behind a NUL, carries its digest and stands in for texts without terms.
    mark = F.concat(F.lit("\0"), F.sha2("t", 256))
    each = each.select(*own, "which", terms(F.col("t")).alias("terms"), mark.alias("mark"))
    hashes = F.transform("terms", lambda t: F.xxhash64(t))
    words_ = F.transform("terms", lambda t: F.struct(t.alias("word"), F.lit(None).cast("array<bigint>").alias("all")))
    each = each.select(*own, "which", F.inline(F.array_append(words_, F.struct(F.col("mark").alias("word"), hashes.alias("all")))))
    each = each.withColumn("marked", F.col("word").startswith("\0")).withColumn("term", F.xxhash64("word"))
    known = each.join(words, "term", "left").filter("known OR marked")
    # Kinds: 0 a term of the lexicon, 2 the digest, with the hashes of all terms.
    kind = F.when(F.col("marked"), 2).otherwise(0)
    where = F.when(F.col("marked"), F.array(F.lit(0).cast("long"))).otherwise(_subsets(F.col("term")))
    placed = known.select(*own, "which", kind.alias("kind"), "term", "all", F.when(F.col("marked"), F.substring("word", 2, 64)).alias("sha"), F.explode(where).alias("subset"))
    hashed = placed.groupBy(*own, "which", "kind", "subset").agg(F.array_sort(F.collect_list("term")).alias("sorted"), F.first("sha", ignorenulls=True).alias("sha"), F.first("all", ignorenulls=True).alias("all"))
    short = lambda terms_: F.lower(F.lpad(F.hex(F.xxhash64(terms_).bitwiseAND(0xFFFF)), 4, "0"))
    entry = F.struct("kind", "subset", short(F.col("sorted")).alias("h"), "sha", "all")
    text = hashed.groupBy(*own, "which").agg(F.collect_list(entry).alias("e"))
    mark_ = F.element_at(F.filter("e", lambda x: x["kind"] == 2), 1)
    text = text.withColumn("sha", mark_["sha"]).withColumn("all", mark_["all"])
    text = text.withColumn("use", F.when(F.exists("e", lambda x: x["kind"] == 0), 0).when(F.size("all") > 0, 1).otherwise(2))
    held = F.map_from_entries(F.transform(F.filter("e", lambda x: x["kind"] == F.col("use")), lambda x: F.struct(x["subset"], x["h"])))
    text = text.withColumn("held", held)
    every = F.sequence(F.lit(0).cast("long"), F.lit(len(RATE_BITS) * SUBSETS - 1).cast("long"))
    def of_all(i: Column) -> Column:
        """The hash of all the text's terms in a subset."""
        inside = F.array_sort(F.filter("all", lambda t: F.array_contains(_subsets(t), i)))
        return F.when(F.size(inside) > 0, short(inside)).otherwise("----")

    slots = F.when(F.col("use") == 1, F.transform(every, of_all)).when(F.col("use") == 2, F.array(F.concat(F.lit("x"), F.substring("sha", 1, 16)))).otherwise(
        F.transform(every, lambda i: F.coalesce(F.try_element_at(F.col("held"), i), F.lit("----")))
    )
    both = text.withColumn("slots", slots).groupBy(*own).agg(
        F.first(F.when(F.col("which") == 0, F.col("slots")), ignorenulls=True).alias("f"),
        F.first(F.when(F.col("which") == 1, F.col("slots")), ignorenulls=True).alias("g"),
        F.first(F.when(F.col("which") == 1, F.col("sha")), ignorenulls=True).alias("edited_sha256"),
    )
    after = Window.partitionBy("block").orderBy("seq")
    both = both.withColumn("h", F.lead("f").over(after)).filter("NOT ghost")
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        F.array_join("f", "").alias("fingerprint"),
        F.array_join("g", "").alias("edited_fingerprint"),
        _likeness("f", "g").alias("near_edited"),
        _likeness("f", "h").alias("near_next"),
    )
