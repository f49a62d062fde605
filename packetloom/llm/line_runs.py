"""Line dedup: maximal repeated runs of lines lose their later copies, in DataFrame operations.

A document is a sequence of line identifiers (128-bit digests). The suffixes of all sequences are
sorted into buckets by prefix doubling: at depth k two places are in one bucket if their next k lines
are equal, and depth 2k follows from joining each place's bucket with the bucket k lines on. A bucket
is an interval of the suffix array whose longest common prefix is k or more; it is named by its first
place instead of its rank, as the order among intervals decides nothing here. Places that stand alone
leave at once, and doubling goes on until all do.

The intervals between two powers of two are found by going down again: of an interval of length l,
the places whose next 2^i lines after it are equal form the interval of length l + 2^i. A place that
isn't the first of its interval goes on within it; the first one stays behind for those that are left.
Where a place can go no further, l is its longest common prefix with any earlier place: (start, len,
first) is a repeated run that can't be made longer to the right. Runs that lie in the run of the
place before are left out, so what is left is maximal on both sides.

A line is deleted if it lies in a run of consecutive lines, of at least ``min_lines`` lines and
``min_words`` words, that occurs earlier: at a smaller doc_id or further up. The first copy of every
line stays.

Cases: lines end at a newline only; a null text counts as empty, one empty line; rows of one doc_id
(nulls last) are ordered by their texts' hash, and rows that repeat both are one document and are cut
alike; a document may lose all its lines and stays with an empty text; an empty table gives no rows.
Extra columns, whatever their names, are carried by ``cut`` and not read by ``deletions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.io import freed, written

#: What makes a run worth deleting.
MIN_LINES, MIN_WORDS = 1, 3

#: A document's key: doc_id (nulls last), then its text's hash.
KEY = ["_none", "_doc", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key): the whole row as one column, so that no name of the user's can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        doc.isNull().alias("_none"),
        F.coalesce(doc, F.lit(0).cast("long")).alias("_doc"),
        F.xxhash64(text).alias("_hash"),
    )


def _lines() -> Column:
    return F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """(key, pos, line, words) for each line."""
    rows = _keyed(docs.select("doc_id", "text")).select(*KEY, F.posexplode(_lines()).alias("pos", "text"))
    return rows.select(*KEY, "pos", F.unhex(F.md5(F.col("text").cast("binary"))).alias("line"), F.regexp_count("text", F.lit(r"\S+")).alias("words"))


def _place(pos: str = "pos") -> Column:
    return F.struct(*KEY, F.col(pos).alias("pos"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """Depth 1: the places whose line occurs again, with their bucket's first place as ``head``.

    The buckets are written, so that the join deals out its own rows and a common line can be split among tasks.
    """
    buckets = rows.groupBy("line").agg(F.count("*").alias("n"), F.min(_place()).alias("head")).filter("n > 1").drop("n")
    buckets = written(buckets, "buckets")
    out = written(rows.join(buckets, "line").select(*KEY, "pos", "words", "head").distinct(), "depth-1")
    freed(buckets)
    return out


def doubled(places: DataFrame, k: int) -> DataFrame:
    """Depth 2k from depth k: (key, pos, head), without places that are alone; the steps are written, as above."""
    on = places.select(*KEY, (F.col("pos") - k).alias("pos"), F.col("head").alias("then"))
    pairs = written(places.select(*KEY, "pos", "head").join(on, [*KEY, "pos"]), f"pairs-{2 * k}")
    buckets = written(pairs.groupBy("head", "then").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1").drop("n"), "buckets")
    out = written(pairs.join(buckets, ["head", "then"]).select(*KEY, "pos", F.col("first").alias("head")), f"depth-{2 * k}")
    freed(pairs, buckets)
    return out


def intervals(places: DataFrame) -> list[DataFrame]:
    """The buckets (key, pos, head) of depth 1, 2, 4, ... until no place shares one."""
    levels = [places]
    while True:
        deeper = doubled(levels[-1], 1 << (len(levels) - 1))
        if deeper.isEmpty():
            return levels
        levels.append(deeper)


def _stayed(level: DataFrame, deeper: DataFrame | None) -> DataFrame:
    """Places of an interval with its head, without those that aren't the first of a deeper one; lone heads go."""
    if deeper is not None:
        gone = deeper.filter(_place() != F.col("head"))
        level = level.join(gone.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    level = written(level.select(*KEY, "pos", "head"), "stayed")
    alive = written(level.filter(_place() != F.col("head")).select("head").distinct(), "alive")
    out = written(level.join(alive, "head").select(*KEY, "pos", "head"), "open")
    freed(level, alive)
    return out


def repeats(levels: list[DataFrame]) -> DataFrame:
    """(key, start, len, first): each place's longest common prefix with earlier places, and the first place with that prefix."""
    length = lambda n: F.lit(n).cast("int").alias("len")
    rows = _stayed(levels[-1], None).select(*KEY, "pos", length(1 << (len(levels) - 1)), "head")
    for i in range(len(levels) - 2, -1, -1):
        step = levels[i].select(*KEY, F.col("pos").alias("at"), F.col("head").alias("then"))
        pairs = rows.withColumn("at", F.col("pos") + F.col("len")).join(step, [*KEY, "at"], "left").drop("at")
        pairs = written(pairs, "pairs")
        longer = written(pairs.groupBy("len", "head", "then").agg(F.count("*").alias("n"), F.min(_place()).alias("first")), "longer")
        # How many of an interval's places stay: every one without a partner, and the first of each longer interval.
        stay = longer.groupBy("len", "head").agg(F.sum(F.when(F.col("then").isNull(), F.col("n")).otherwise(1)).alias("left"))
        stay = written(stay, "stay")
        named = written(longer.join(stay, ["len", "head"]), "named")
        same = [pairs[c].eqNullSafe(named[c]) for c in ("len", "head", "then")]
        more = (named["then"].isNotNull() & (named["n"] > 1)).alias("more")
        met = pairs.join(named, same).select(*KEY, "pos", pairs["len"], pairs["head"], more, named["first"], "left")
        new = F.struct((F.col("len") + (1 << i)).cast("int").alias("len"), F.col("first").alias("head"))
        old = F.struct("len", "head")
        stays = (~F.col("more") | (_place() == F.col("first"))) & (F.col("left") > 1)
        both = F.array_compact(F.array(F.when(F.col("more"), new), F.when(stays, old)))
        opened = _stayed(levels[i], levels[i + 1])
        before, rows = rows, met.select(*KEY, "pos", F.inline(both)).unionByName(opened.select(*KEY, "pos", length(1 << i), "head"))
        rows = written(rows, "interval")
        freed(before, pairs, longer, stay, named, opened, levels[i + 1])
    return rows.filter(_place() != F.col("head")).select(*KEY, F.col("pos").alias("start"), "len", F.col("head").alias("first"))


def runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, len, words, first): maximal repeated runs that are later copies, ``first`` being the place of the first copy."""
    every = written(lines(docs), "lines")
    places = repeated_lines(every)
    freed(every)
    found = repeats(intervals(places))
    upto = F.sum("words").over(Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    counted = places.select(*KEY, "pos", "words", upto.alias("upto"))
    ends = counted.select(*KEY, F.col("pos").alias("last"), F.col("upto").alias("all"))
    begun = found.join(counted.withColumnRenamed("pos", "start"), [*KEY, "start"]).withColumn("last", F.col("start") + F.col("len") - 1)
    rows = begun.join(ends, [*KEY, "last"]).withColumn("words", F.col("all") - F.col("upto") + F.col("words"))
    rows = rows.filter((F.col("len") >= min_lines) & (F.col("words") >= min_words))
    before = F.max("last").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).filter("before IS NULL OR last > before")
    return rows.select(*KEY, "start", "len", "words", "first", "before")


def deletions(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, dels): the places of each document's deleted lines, ascending."""
    own = runs(docs, min_lines, min_words).withColumn("new", F.greatest("start", F.coalesce(F.col("before") + 1, F.lit(0))))
    gone = own.select(*KEY, F.explode(F.expr("sequence(new, start + len - 1)")).alias("pos"))
    return gone.groupBy(*KEY).agg(F.array_sort(F.collect_set("pos")).alias("dels"))


def marked(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, _lines, _dels, _text): each row of docs, its lines, the deleted ones (null: none), and the text that is left."""
    gone = written(deletions(docs, min_lines, min_words).withColumnRenamed("dels", "_dels"), "deleted")
    rows = _keyed(docs).join(gone, KEY, "left").withColumn("_lines", _lines())
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("_dels")),
            lambda j: F.slice(
                F.col("_lines"),
                F.when(j == 0, 0).otherwise(F.get(F.col("_dels"), j - 1) + 1) + 1,
                F.when(j == F.size("_dels"), F.size("_lines")).otherwise(F.get(F.col("_dels"), j)) - F.when(j == 0, 0).otherwise(F.get(F.col("_dels"), j - 1) + 1),
            ),
        )
    )
    return rows.withColumn("_text", F.when(F.col("_dels").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")))


def cut(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines deleted from ``text``, and ``n_chars`` (where there is one) counted anew."""
    rows = marked(docs, min_lines, min_words)
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        counted = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("_dels").isNull(), F.col("row.n_chars")).otherwise(counted)
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: its lines, how many and which are deleted, and the text that is left."""
    rows = marked(docs.select("doc_id", "text"), min_lines, min_words)
    return rows.select(
        "row.doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dels"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join(F.col("_dels").cast("array<string>"), ","), F.lit("")).alias("deleted"),
        F.coalesce("_text", F.lit("")).alias("text"),
    )
