"""Lists, indicator dumps and findings files (SRC-10..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V


def entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed entries without comments, each once (SRC-13)."""
    bare = F.trim(F.regexp_replace(F.col(value), r"\s*#.*$", ""))
    return lines.select(bare.alias("value")).filter("value != ''").distinct()


def fingerprints(lines: DataFrame, value: str = "value") -> DataFrame:
    """The first word of each entry, lower-cased, and its kind by shape (SRC-14)."""
    fp = F.lower(F.split(F.col("value"), r"\s+")[0])
    out = entries(lines, value).select(fp.alias("fp")).distinct()
    return out.withColumn("kind", F.when(F.col("fp").rlike("^[0-9a-f]{32}$"), "ja3").otherwise("ja4"))


def host_of(url: str) -> Column:
    bare = F.regexp_replace(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.nullif(F.regexp_extract(bare, r"^(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1), F.lit(""))


def url_list(rows: DataFrame, url: str = "url", feed: str = "urls") -> DataFrame:
    """URLs reduced to hosts, addresses and names apart (SRC-10)."""
    out = rows.select(host_of(url).alias("value")).filter("value IS NOT NULL").distinct()
    return out.withColumns({"kind": F.when(E.is_ip("value"), "ip").otherwise("domain"), "feed": F.lit(feed)})


def indicator_kind(value: str, said: str) -> Column:
    """The kind that a value proves to be of, null where it is not valid."""
    v, s = F.col(value), F.lower(F.col(said))
    cidr = v.rlike(r"^\d+\.\d+\.\d+\.\d+/([12]?\d|3[0-2])$") & E.ip_key(F.split(v, "/")[0]).isNotNull()
    return (
        F.when(s.startswith("ip") & cidr, "cidr")
        .when(s.startswith("ip") & E.is_ip(v), "ip")
        .when(s.isin("domain", "hostname", "domain-name", "url") & E.valid_domain(v), "domain")
        .when(s.isin("md5", "sha1", "sha256", "file", "hash") & E.valid_hash(v), "hash")
    )


def attributes(dump: DataFrame, feed: str) -> DataFrame:
    """An attribute dump (type, value, tags) as indicators (SRC-11); ``a|b`` values give both parts."""
    rows = dump.select(F.explode(F.arrays_zip(F.split("type", r"\|").alias("t"), F.split("value", r"\|").alias("v"))).alias("p"), "tags")
    rows = rows.select(F.trim("p.t").alias("said"), F.lower(F.trim("p.v")).alias("raw"), "tags")
    value = F.when(F.lower("said") == "url", host_of("raw")).otherwise(F.col("raw"))
    out = rows.withColumn("value", value).withColumn("kind", indicator_kind("value", "said")).filter("kind IS NOT NULL")
    return out.groupBy("value", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags")).withColumn("feed", F.lit(feed))


def patterns(dump: DataFrame, feed: str) -> DataFrame:
    """A dump of patterns such as [domain-name:value = 'x'] as indicators (SRC-12)."""
    value = F.lower(F.trim(F.regexp_extract("pattern", r"=\s*'([^']*)'\s*\]?\s*$", 1)))
    said = F.regexp_extract("pattern", r"\[\s*([a-z0-9-]+)", 1)
    said = F.when(said.startswith("ipv"), "ip").otherwise(said)
    out = dump.select(value.alias("value"), said.alias("said")).withColumn("kind", indicator_kind("value", "said"))
    return out.filter("kind IS NOT NULL").select("value", "kind").distinct().withColumn("feed", F.lit(feed))


def valid_finding() -> Column:
    """What an imported finding must be (SRC-15)."""
    ok = F.col("severity").isin(list(V.SEVERITIES)) & F.col("score").between(0, 100) & (F.coalesce("type", F.lit("")) != "")
    at = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return F.coalesce(ok & at & F.coalesce("status", F.lit("")).isin("", "acknowledged", "escalated", "dismissed"), F.lit(False))


def import_findings(rows: DataFrame, next_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Accepted findings with new ids and remapped correlations, and the rejected rows."""
    good, bad = rows.filter(valid_finding()), rows.filter(~valid_finding())
    # New ids keep the old order: counts per block of old ids, then places within a block.
    block = F.floor(F.col("id") / 4096)
    offset = good.groupBy(block.alias("_b")).agg(F.count("*").alias("_n"))
    offset = offset.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = good.withColumn("_b", block).withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy("id"))).join(offset, "_b")
    ids = numbered.select(F.col("id").alias("old"), (F.col("_o") + F.col("_p") + next_id - 1).cast("long").alias("new"))
    out = good.join(ids, good.id == ids.old).drop("old").withColumn("_old", F.col("id")).withColumn("id", F.col("new")).drop("new")
    if "correlations" in rows.columns:
        mapped = out.select("_old", F.explode("correlations").alias("old")).join(ids, "old").groupBy("_old").agg(F.sort_array(F.collect_list("new")).alias("correlations"))
        out = out.drop("correlations").join(mapped, "_old", "left")
    return out.drop("_old"), bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
