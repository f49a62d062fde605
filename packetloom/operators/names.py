"""Registrable domains by a public-suffix list of any size (SCL-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_rules(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, exact, wild, exempt): a suffix list, one row per name on its right side.

    Lines are in the public list's form: a rule up to the first white space, ``*.name`` for all names right
    below, ``!name`` for one that isn't a suffix after all; empty lines and ``//`` comments count as nothing. Names
    are in lower case and, where they aren't ASCII, in the form that queries have them (xn--).
    """
    rule = F.lower(F.regexp_extract(F.coalesce(F.col(value), F.lit("")), r"^\s*(\S*)", 1))
    rows = lines.select(F.regexp_replace(rule, r"\.+$", "").alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    wild, exempt = F.col("rule").startswith("*."), F.col("rule").startswith("!")
    key = F.when(wild, F.expr("substring(rule, 3)")).when(exempt, F.expr("substring(rule, 2)")).otherwise(F.col("rule"))
    flags = rows.select(key.alias("key"), (~wild & ~exempt).alias("exact"), wild.alias("wild"), exempt.alias("exempt"))
    return flags.filter("key != ''").groupBy("key").agg(*(F.bool_or(c).alias(c) for c in ("exact", "wild", "exempt")))


def with_apex(rows: DataFrame, rules: DataFrame, query: str = "query") -> DataFrame:
    """``rows`` with ``apex``, the registrable domain of a lower-case name: one label more than its public suffix.

    Of the rules on a name's right side the longest counts, an exemption before all others; a name that no rule
    fits has its last label for a suffix. A name that is a suffix itself, or isn't well formed, has its last two labels.

    Distinct names meet the rules by one join, whatever the number and the kinds of rules: a name asks by
    each of its right sides. Then rows take their name's answer.
    """
    labels, n = F.split("_name", r"\."), F.size(F.split("_name", r"\."))
    names = rows.select(F.regexp_replace(F.col(query), r"\.$", "").alias("_name")).filter("_name IS NOT NULL").distinct()
    sides = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("key")))
    asked = names.select("_name", n.alias("_n"), F.inline(sides)).join(rules, "key")
    below = F.when(F.col("exact"), F.col("k")).otherwise(0)
    deeper = F.when(F.col("wild") & (F.col("_n") > F.col("k")), F.col("k") + 1).otherwise(0)
    found = asked.groupBy("_name").agg(F.max(F.when(F.col("exempt"), F.col("k") - 1)).alias("_exempt"), F.max(F.greatest(below, deeper)).alias("_suffix"))
    depth = F.coalesce("_exempt", F.greatest(F.col("_suffix"), F.lit(1)), F.lit(1)) + 1
    fine = ~F.col("_name").rlike(r"^\.|\.\.|\.$") & (n >= depth)
    last = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    apex = F.when(fine, last(depth)).otherwise(F.when(n >= 2, last(F.lit(2))).otherwise(F.col("_name")))
    answers = names.join(found, "_name", "left").select("_name", apex.alias("apex"))
    return rows.drop("apex").withColumn("_name", F.regexp_replace(F.col(query), r"\.$", "")).join(answers, "_name", "left").drop("_name")
