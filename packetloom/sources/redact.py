"""Pseudonyms for internal addresses and host names in texts, and back (RED-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.operators import matching

#: What looks like an address or a dotted name, and the ranges that are internal everywhere.
ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b|(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}"
NAME = r"(?i)\b(?:[a-z0-9_-]+\.)+[a-z0-9_-]+\b"
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10", "::1/128")


def redacted(texts: DataFrame, id_: str = "id", text: str = "text", ranges: DataFrame | None = None, domains: DataFrame | None = None, spelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts whose internal addresses and host names are HOST_n tokens of their document, and the tokens (id, value, token).

    ``ranges`` (value) are further internal ranges or addresses; ``domains`` (value) the internal domains, of
    any number: names are only looked for where they are given, whole names at or below a domain. Tokens count
    in the order of appearance, addresses before names; a value has one token in its document. What looks
    like an address but can't be read stays; with ``spelled`` it goes too where it begins like an internal one.
    """
    spark = texts.sparkSession
    nets = spark.createDataFrame([(n,) for n in INTERNAL], "value string")
    nets = nets if ranges is None else nets.union(ranges.select("value"))
    found = _found(texts, id_, text, ADDRESS)
    inside = matching.matches(found, "shown", nets).select("shown").distinct()
    if spelled:
        inside = inside.union(found.filter(E.is_private("shown") & ~E.is_ip("shown")).select("shown").distinct())
    none = texts.select(F.col(id_)).limit(0).withColumn("n", F.lit(0).cast("long"))
    tokens = _numbered(found.join(inside, "shown"), id_, none)
    out = _replaced(texts, id_, text, ADDRESS, tokens)
    if domains is not None:
        names = _found(out, id_, text, NAME)
        held = domains.select(F.lower(F.regexp_replace(F.trim("value"), r"^\.+|\.+$", "")).alias("side")).filter("side != ''").distinct()
        labels = F.split(F.lower("shown"), r"\.")
        sides = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        below = names.select("shown").distinct().select("shown", F.explode(sides).alias("side")).join(held, "side", "left_semi").select("shown").distinct()
        counted = tokens.groupBy(id_).agg(F.count("*").alias("n"))
        more = _numbered(names.join(below, "shown"), id_, counted)
        out, tokens = _replaced(out, id_, text, NAME, more), tokens.unionByName(more)
    return out, tokens


def _found(texts: DataFrame, id_: str, text: str, pattern: str) -> DataFrame:
    """(id, shown, place): what fits the pattern in each text, at its first place."""
    each = texts.select(F.col(id_), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("place", "shown"))
    return each.groupBy(id_, "shown").agg(F.min("place").alias("place"))


def _numbered(found: DataFrame, id_: str, before: DataFrame) -> DataFrame:
    """Tokens in the order of appearance, behind those (n) that a document has already."""
    place = F.row_number().over(Window.partitionBy(id_).orderBy("place"))
    rows = found.withColumn("_k", place).join(before, id_, "left")
    return rows.select(id_, F.col("shown").alias("value"), F.concat(F.lit("HOST_"), (F.col("_k") + F.coalesce("n", F.lit(0))).cast("string")).alias("token"))


def _swapped(text: str, pattern: str) -> Column:
    """The text with what fits the pattern replaced by its entry in ``_t``, where it has one."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.transform(F.split(F.col(text), pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.try_element_at("_t", F.get(hits, i)), F.get(hits, i), F.lit("")))), "")


def _replaced(texts: DataFrame, id_: str, text: str, pattern: str, tokens: DataFrame, of: str = "value", to: str = "token") -> DataFrame:
    held = tokens.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct(of, to))).alias("_t"))
    out = texts.join(held, id_, "left")
    return out.withColumn(text, F.when(F.col("_t").isNull(), F.col(text)).otherwise(_swapped(text, pattern))).select(*texts.columns)


def restored(texts: DataFrame, tokens: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """The inverse of ``redacted``; twice, as a name may hold an address's token."""
    once = _replaced(texts, id_, text, r"HOST_\d+", tokens, "token", "value")
    return _replaced(once, id_, text, r"HOST_\d+", tokens, "token", "value")
