"""Joins with lists, ranges, rules and indicators (JOIN-3..14, DET-36..38).

Ranges, of IPv4 and IPv6, are matched by equi joins: a range is named by its prefix, an address is exploded
into its prefixes of the lengths that occur, so no pair of address and range is formed in vain. Lists are small
by nature, but none is broadcast by hint: Spark broadcasts what its statistics prove small.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.sources import logs
from packetloom.sources.scratch import written

#: Characters of the pieces by which wildcards are found; with a ? for any character inside them, their shapes are few.
GRAMS = (8, 4, 2, 1)


def typed(entries: DataFrame, value: str = "value") -> DataFrame:
    """List entries with their kind: ip, cidr, glob or exact text."""
    v = F.trim(F.col(value))
    base, bits = F.get(F.split(v, "/"), 0), F.get(F.split(v, "/"), 1).try_cast("int")
    cidr = v.rlike(r"^[^/]+/\d+$") & F.when(E.ip_key(base).isNotNull(), bits <= 32).otherwise(E.ip_hex(base).isNotNull() & (bits <= 128))
    kind = F.when(F.coalesce(cidr, F.lit(False)), "cidr").when(E.is_ip(v), "ip").when(v.rlike(r"[*?]"), "glob").otherwise("text")
    return entries.withColumn("_kind", kind).withColumn("_v", F.when(F.col("_kind") == "cidr", F.lower(v)).otherwise(E.canonical(v)))


def _four(key: Column, bits: Column) -> Column:
    return F.concat_ws("/", F.lit("4"), bits.cast("string"), (key - F.pmod(key, F.pow(F.lit(2.0), F.lit(32) - bits).cast("long"))).cast("string"))


def _six(digits: Column, bits: Column) -> Column:
    """The first bits of 32 hexadecimal digits: whole digits, then what is left of the next one as a number."""
    whole, left = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4)).cast("int")
    next_ = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 2)
    return F.concat_ws("/", F.lit("6"), bits.cast("string"), F.concat(F.substring(digits, F.lit(1), whole), F.when(left > 0, F.concat(F.lit("+"), F.substring(F.lpad(next_, 4, "0"), F.lit(1), left))).otherwise("")))


def prefixes(address: Column | str, lengths: Sequence[tuple[int, int]]) -> Column:
    """The address's prefixes of the given (family, length)s, each as a text; of its own family only."""
    return E.let(E.canonical(address), lambda known: _prefixes(E.col(address), known, lengths))


def _prefixes(address: Column, known: Column, lengths: Sequence[tuple[int, int]]) -> Column:
    """Those of an address whose canonical spelling is ``known``."""
    own = {family: F.array(*(F.lit(n) for f, n in lengths if f == family)) for family in {f for f, _ in lengths}}
    none = F.lit(None).cast("array<string>")
    four = E.let(E.ip_key(known), lambda key: F.when(key.isNotNull(), F.transform(own[4], lambda n: _four(key, n)))) if 4 in own else none
    digits = F.contains(address, F.lit(":")) & (F.length(known) == 32) & ~F.contains(known, F.lit(":"))
    six = F.when(digits, F.transform(own[6], lambda n: _six(known, n))) if 6 in own else none
    return F.coalesce(four, six)


def with_prefix(cidrs: DataFrame, value: str = "_v") -> DataFrame:
    base, bits = F.get(F.split(value, "/"), 0), F.get(F.split(value, "/"), 1).cast("int")
    return cidrs.withColumn("_p", F.when(E.ip_key(base).isNotNull(), _four(E.ip_key(base), bits)).otherwise(_six(E.ip_hex(base), bits)))


@dataclass(frozen=True)
class Listed:
    """A list ready to be matched: its entries by the keys that matching values ask by (``_p``), and which kinds of keys occur.

    Exact entries are filed under their spelling, ranges under their prefix, wildcards under a piece of
    theirs (``_like``: what a value that asks for it must be like). Equal entries are filed once. The kinds are found
    by one job over the list, and one more over its wildcards: at most 33 and 129 lengths of ranges, and the shapes of
    pieces, 71 at most. A list that is matched more than once is made ready once and passed on; its keys stay cached until ``close``.
    """

    keys: DataFrame
    lengths: tuple[tuple[int, int], ...]
    shapes: tuple[str, ...]
    columns: tuple[str, ...]

    def close(self) -> None:
        self.keys.unpersist()


def listed(entries: DataFrame | Listed) -> Listed:
    if isinstance(entries, Listed):
        return entries
    entries = written(entries.distinct(), "entries")  # read several times; feeds repeat entries, so they are told apart before they are looked at
    rows, columns = typed(entries), entries.columns
    family = F.when(F.contains("_v", F.lit(":")), 6).otherwise(4)
    length = F.when(F.col("_kind") == "cidr", F.struct(family, F.get(F.split("_v", "/"), 1).cast("int")))
    found = rows.agg(F.collect_set(length), F.coalesce(F.bool_or(F.col("_kind") == "glob"), F.lit(False))).first()
    lengths, shapes = tuple(sorted((f, n) for f, n in found[0] if n is not None)), ()
    like = F.lit(None).cast("string").alias("_like")
    keys = rows.filter(F.col("_kind").isin("ip", "text")).select(F.concat(F.lit("="), F.col("_v")).alias("_p"), like, *columns)
    if lengths:
        keys = keys.union(with_prefix(rows.filter(F.col("_kind") == "cidr")).select("_p", like, *columns))
    if found[1]:  # neither an address nor a range has a * or ?, so wildcards are told apart by it alone
        globs = entries.filter(F.trim("value").rlike(r"[*?]"))
        keys = keys.union(glob_keys(globs.withColumn("_glob", F.lower(F.trim("value")))).select("_p", "_like", *columns))
    keys = keys.persist()
    if found[1]:
        shapes = tuple(sorted(keys.filter("_like IS NOT NULL").agg(F.collect_set(F.regexp_extract("_p", r"^[#?]*", 0))).first()[0]))
    return Listed(keys, lengths, shapes, tuple(columns))


def value_keys(value: Column | str, lengths: Sequence[tuple[int, int]]) -> Column:
    """All keys that a value asks by: its spelling, and its prefixes of the lengths that occur."""

    def keys(known: Column) -> Column:
        own = F.array(F.concat(F.lit("="), known))
        return F.concat(own, F.coalesce(_prefixes(E.col(value), known, lengths), F.array().cast("array<string>"))) if lengths else own

    return E.let(E.canonical(value), keys)


def _pieces(text: Column, shape: str) -> Column:
    """The distinct pieces of a shape in a text, with ? where the shape has it; the empty shape: the empty piece, which every text has."""
    size = len(shape)
    if not size:
        return F.array(F.lit(""))
    plain = [(m.start(), m.end()) for m in re.finditer("#+", shape)]

    def piece(i: Column) -> Column:
        parts, at = [], 0
        for start, end in plain:
            parts += [F.lit("?" * (start - at))] * (start > at) + [F.substring(text, i + start, F.lit(end - start))]
            at = end
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), piece))).otherwise(F.array().cast("array<string>"))


def _windows(glob: Column) -> Column:
    """A wildcard's pieces of all sizes, between its *, that begin and end with a plain character; ? inside them stands for any."""

    sized = lambda part, size: F.transform(F.sequence(F.lit(1), F.length(part) - size + 1), lambda i: F.substring(part, i, size))
    windows = lambda part: F.flatten(F.transform(F.filter(F.array(*map(F.lit, GRAMS)), lambda size: size <= F.length(part)), lambda size: sized(part, size)))
    own = F.filter(F.flatten(F.transform(F.split(glob, r"\*"), windows)), lambda x: ~x.startswith("?") & ~x.endswith("?"))
    return F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.array(F.lit("")))


def glob_keys(globs: DataFrame) -> DataFrame:
    """Wildcards (``_glob``, ...) with ``_p``, that of their pieces that the fewest of them have behind its shape, and ``_like``.

    A value can match only wildcards whose piece it holds. Of equally rare pieces one without ? counts, then a
    longer one. Wildcards without any plain character are filed under the empty piece.
    """
    held = globs.select("_glob").distinct().select("_glob", F.explode(_windows(F.col("_glob"))).alias("_piece"))
    counts = held.groupBy("_piece").agg(F.count("*").alias("_n"))
    rank = F.struct("_n", F.length(F.regexp_replace("_piece", r"[^?]", "")).alias("any"), (-F.length("_piece")).alias("size"), "_piece")
    best = held.join(counts, "_piece").groupBy("_glob").agg(F.min(rank).alias("_b"))
    shape = F.regexp_replace("_b._piece", r"[^?]", "#")
    keyed = best.select("_glob", F.concat_ws("|", shape, F.col("_b._piece")).alias("_p"), glob_like(F.col("_glob")).alias("_like"))
    return globs.join(keyed, "_glob")


def glob_like(glob: Column) -> Column:
    """A wildcard as a LIKE pattern: * any text, ? one character."""
    return F.translate(F.regexp_replace(glob, r"([\\%_])", r"\\$1"), "*?", "%_")


def asked(value: Column | str, ready: Listed) -> Column:
    """All keys that a value asks a list by."""
    low = F.lower(E.col(value))
    filed = lambda shape: F.transform(_pieces(low, shape), lambda x: F.concat(F.lit(f"{shape}|"), x))
    return F.concat(value_keys(value, ready.lengths), *(filed(shape) for shape in ready.shapes))


def fits(value: Column | str) -> Column:
    """Whether what a value asked for matches it; keys settle all but wildcards."""
    return F.col("_like").isNull() | F.like(F.lower(E.col(value)), F.col("_like"))


def matches(values: DataFrame, column: str, entries: DataFrame | Listed) -> DataFrame:
    """(column, entry columns...) pairs of distinct values and list entries that match (JOIN-6, JOIN-7).

    One equi join for entries of all kinds: a value asks by its spelling, by its prefixes, and, where the list
    has wildcards, by the pieces that it holds; wildcards that share a piece with it are then
    compared with it. The plan doesn't grow with the list.
    """
    ready = listed(entries)
    own = values.select(column).filter(F.col(column).isNotNull()).distinct()
    keep = [c for c in ready.columns if c != column]
    met = own.withColumn("_p", F.explode(asked(column, ready))).join(ready.keys.select("_p", "_like", *keep), "_p")
    out = met.filter(fits(column)).select(column, *keep)
    # An entry has one key, and a value asks by each once: pairs are distinct unless a column of the entries is left out.
    return out if column not in ready.columns else out.distinct()


def side_matches(findings: DataFrame, entries: DataFrame | Listed, sides: Sequence[str] = ("src_ip", "dst_ip")) -> DataFrame:
    """(_ip, entry columns...): ``matches`` of the addresses of all sides, asked once."""
    return matches(findings.select(F.explode(F.array(*sides)).alias("_ip")), "_ip", entries)


def listed_rows(findings: DataFrame, entries: DataFrame | Listed, sides: Sequence[str] = ("src_ip", "dst_ip")) -> DataFrame:
    """``ioc_match`` where either side is on the list."""
    hit = side_matches(findings, entries, sides).select("_ip").distinct()
    out, flag = findings, F.lit(False)
    for side in sides:
        out = out.join(hit.select(F.col("_ip").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
        flag = flag | F.coalesce(f"_{side}", F.lit(False))
    return out.withColumn("ioc_match", flag).drop(*(f"_{s}" for s in sides))


def hide_listed(findings: DataFrame, entries: DataFrame | Listed) -> DataFrame:
    """Rows with neither side on the allowlist (JOIN-10)."""
    hit = side_matches(findings, entries).select("_ip").distinct()
    for side in ("src_ip", "dst_ip"):
        findings = findings.join(hit.withColumnRenamed("_ip", side), side, "left_anti")
    return findings


def hide_suppressed(findings: DataFrame, rules: DataFrame, now: float) -> DataFrame:
    """Rows whose source or destination has no rule in force (JOIN-9)."""
    live = rules.filter(F.col("expiry").isNull() | (F.col("expiry") > now)).select("target").distinct()
    for side in ("src_ip", "dst_ip"):
        findings = findings.join(live.withColumnRenamed("target", side), side, "left_anti")
    return findings


def _side_keys(rule: Column) -> Column:
    """How a rule's side is filed: * for any, =text, /prefix of a range, or .k.name for names below; null where it can't be read."""
    base, bits = F.get(F.split(rule, "/"), 0), F.get(F.split(rule, "/"), 1).try_cast("int")
    four = F.when(bits.between(0, 32), _four(E.ip_key(base), bits))
    six = F.when(bits.between(0, 128), _six(E.ip_hex(base), bits))
    return (
        F.when(rule == "", "*")
        .when(rule.startswith("*."), F.concat(F.lit("."), F.substring(rule, F.lit(3), F.length(rule))))
        .when(F.contains(rule, F.lit("/")), F.concat(F.lit("/"), F.coalesce(four, six)))
        .otherwise(F.concat(F.lit("="), rule))
    )


def _met(values: DataFrame, side: str, held: DataFrame, lengths: Sequence[tuple[int, int]]) -> DataFrame:
    """(side, _key): the filed sides that each distinct value meets, of those that occur in rules."""
    low = F.lower(side)
    labels = F.split(low, r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ranges = F.coalesce(prefixes(side, lengths), F.array().cast("array<string>")) if lengths else F.array().cast("array<string>")
    keys = F.concat(F.array(F.lit("*"), F.concat(F.lit("="), low)), below, F.transform(ranges, lambda x: F.concat(F.lit("/"), x)))
    return values.select(side).filter(F.col(side).isNotNull()).distinct().select(side, F.explode(keys).alias("_key")).join(held, "_key", "left_semi")


def hide_pairs(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Pair rules: port exact, an empty field matches all, a side is exact, a range or *.suffix (JOIN-8).

    Rules are filed under generalised keys. A side's distinct values are expanded into the keys that they may meet,
    and only keys that occur in rules go on; so a finding has few of them, whatever the number of
    rules' shapes. Then one join over the keys of all fields finds what is hidden. The plan has the same
    size for any rules; a rule whose range can't be read hides nothing.
    """
    wanted = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {"port": "dst_port", "finding_type": "type", "sensor": "sensor"}
    sides = {"src": "src_ip", "dst": "dst_ip"}
    held = rules.select(*(_side_keys(F.lower(wanted(c))).alias(f"_{c}") for c in sides), *(wanted(c).alias(f"_{c}") for c in fields)).dropna().distinct().persist()
    # Which lengths of ranges occur, on either side: one small job.
    length = lambda c: F.when(F.col(c).startswith("/"), F.struct(F.substring(c, 2, 1).cast("int"), F.get(F.split(c, "/"), 2).cast("int")))
    found = held.agg(*(F.collect_set(length(f"_{c}")) for c in sides)).first()
    columns = [*sides.values(), *fields.values()]
    asked = findings.select(*columns).distinct()
    met = asked
    for (c, side), lengths in zip(sides.items(), found):
        keys = _met(asked, side, held.select(F.col(f"_{c}").alias("_key")).distinct(), sorted((f, n) for f, n in lengths))
        met = met.join(keys.withColumnRenamed("_key", f"_{c}"), side)
    for c, value in fields.items():
        met = met.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(F.coalesce(F.col(value).cast("string"), F.lit("")), F.lit("")))))
    hidden = met.join(held, [f"_{c}" for c in (*sides, *fields)], "left_semi").select(*(F.col(c).alias(f"_h_{c}") for c in columns)).distinct()
    same = [findings[c].eqNullSafe(hidden[f"_h_{c}"]) for c in columns]
    return findings.join(hidden, same, "left_anti")


def flag_benign(findings: DataFrame, benign: DataFrame) -> DataFrame:
    """``benign`` where the row's JA3 or JA4 is marked so by kind and fingerprint (JOIN-11)."""
    for kind in ("ja3", "ja4"):
        own = benign.filter(F.col("kind") == kind).select(F.col("fp").alias(kind)).distinct().withColumn(f"_{kind}", F.lit(True))
        findings = findings.join(own, kind, "left")
    return findings.withColumn("benign", F.coalesce("_ja3", "_ja4", F.lit(False))).drop("_ja3", "_ja4")


#: Egress that confirms a beacon to the same destination, and the beacons whose destination is the real far end.
EGRESS = ("Admin Protocol Egress", "Data Exfiltration", "Database Protocol Egress", "Protocol on Unexpected Port")
FAR_BEACONS = ("Beacon", "HTTP Beacon", "Port-Hopping Beacon")


def corroborated(beacons: DataFrame, others: DataFrame) -> DataFrame:
    """Beacons with the sorted types of egress findings of the same source to the same destination (JOIN-4).

    Only the beacons of ``FAR_BEACONS`` can be confirmed; the others have null, like those without egress.
    """
    keys = ["sensor", "src_ip", "dst_ip"]
    named = (F.coalesce("src_ip", F.lit("")) != "") & (F.coalesce("dst_ip", F.lit("")) != "")
    by = others.filter(F.col("type").isin(*EGRESS) & named).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("_egress"))
    by = by.select(F.coalesce("sensor", F.lit("")).alias("_s"), "src_ip", "dst_ip", "_egress")
    out = beacons.withColumn("_s", F.coalesce("sensor", F.lit(""))).join(by, ["_s", "src_ip", "dst_ip"], "left")
    return out.withColumn("corroboration", F.when(F.col("type").isin(*FAR_BEACONS), F.col("_egress"))).select(*beacons.columns, "corroboration")


def resolver_context(findings: DataFrame, resolvers: DataFrame, cap: int = 512) -> DataFrame:
    """Beacons on port 53 with what the sensor's DNS log says of the pair (JOIN-3); sensors without DNS rows are skipped.

    A pair with queries is a resolver in use, with its domains counted up to ``cap``. Without any, the
    flow's service decides: labelled dns, the log has a gap; else it is transport without DNS.
    """
    asked = resolvers.select("sensor", F.col("src").alias("src_ip"), F.col("resolver").alias("dst_ip"), "queries", "apexes", "overflow")
    rows = findings.filter((F.col("type") == "Beacon") & (F.col("dst_port") == "53")).join(resolvers.select("sensor").distinct(), "sensor", "left_semi").join(asked, ["sensor", "src_ip", "dst_ip"], "left")
    domains = F.concat(F.col("apexes").cast("string"), F.when(F.col("overflow"), "+").otherwise(""))
    services = F.transform(F.split(F.lower(F.coalesce("service", F.lit(""))), ","), lambda x: F.trim(x))
    text = (
        F.when(F.col("queries").isNotNull(), F.format_string("active resolver for this source (%d queries, %s domains) \u2014 per-domain cadence is scored by DNS Beacon.", "queries", domains))
        .when(F.array_contains(services, "dns"), "DPD recognized DNS on this pair but dns.log carries no queries for it \u2014 possible dns.log coverage gap.")
        .otherwise("no DNS queries observed on this pair \u2014 port-53 transport without DNS semantics.")
    )
    return rows.withColumn("dns_context", text).drop("overflow")


def beacon_notes(findings: DataFrame, resolvers: DataFrame) -> DataFrame:
    """Findings whose texts tell what egress and the DNS log add to a beacon (DET-44); nothing else changes."""
    said = resolver_context(findings, written(resolvers, "resolvers")).select("id", "dns_context")  # read twice
    out = corroborated(findings, findings).join(said, "id", "left")
    egress = F.when(F.col("corroboration").isNotNull(), F.concat(F.lit(" | Exfil-over-C2 corroboration: same destination also shows "), "corroboration", F.lit("."))).otherwise("")
    dns = F.when(F.col("dns_context").isNotNull(), F.concat(F.lit(" | DNS context: "), "dns_context")).otherwise("")
    return out.withColumn("detail", F.concat(F.coalesce("detail", F.lit("")), egress, dns)).select(*findings.columns)


def siblings(findings: DataFrame, kind: str = "ja3") -> DataFrame:
    """How many other beacons share the fingerprint (JOIN-20): counted once per fingerprint, then joined."""
    n = findings.filter(F.col(kind).isNotNull()).groupBy(kind).agg((F.count("*") - 1).alias("siblings"))
    return findings.join(n, kind, "left").fillna({"siblings": 0})


def suggested(history: DataFrame, findings: DataFrame, rules: DataFrame, least_days: int = 14) -> DataFrame:
    """Identities seen on many days, with an acknowledged finding, that no pair rule covers yet (JOIN-12).

    ``history`` (finding_type, src_ip, dst_ip, dst_port, host, uri, sensor, day, max_score): an identity is all of
    it but day and score. A history row without sensor meets findings of any; a rule's empty type or sensor
    covers all. Both are equi joins: the side that is told apart is expanded by the keys it may meet.
    """
    flow, text = ["src_ip", "dst_ip", "dst_port"], lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = ["finding_type", *flow, "host", "uri", "sensor"]
    seen = history.withColumns({c: text(c) for c in ("host", "uri", "sensor")})
    held = rules.select(F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("port").alias("dst_port"), text("finding_type").alias("_type"), text("sensor").alias("_sensor")).distinct()
    either = lambda c: F.explode(F.array_distinct(F.array(text(c), F.lit(""))))
    asked = seen.select(*identity).distinct().withColumn("_type", either("finding_type")).withColumn("_sensor", either("sensor"))
    covered = asked.join(held, [*flow, "_type", "_sensor"], "left_semi").select(*identity).distinct()
    known = findings.filter("status = 'acknowledged'").select(F.col("type").alias("finding_type"), *flow, either("sensor").alias("sensor"), text("analyst").alias("analyst"))
    known = known.groupBy("finding_type", *flow, "sensor").agg(F.max("analyst").alias("acked_by"))
    out = seen.groupBy(*identity).agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.max("max_score").alias("peak_score"))
    return out.filter(F.col("days") >= least_days).join(known, ["finding_type", *flow, "sensor"]).join(covered, identity, "left_anti")


def evidence(findings: DataFrame, records: DataFrame, hours: float = 2.0, most: int = 50) -> DataFrame:
    """Records of a finding's source and destination around its time, the nearest ``most`` (JOIN-13).

    ``findings`` (id, src_ip, dst_ip, at), ``records`` (src, dst, ts, ...); equally near ones by time, then uid.
    """
    own = findings.select("id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "at")
    return _nearest(own, records, ["src", "dst"], hours, most)


def _nearest(own: DataFrame, records: DataFrame, keys: Sequence[str], hours: float, most: int) -> DataFrame:
    """The nearest records of each finding (id, keys, at), no more than ``most`` before and as many after it being joined.

    A key's records are numbered in the order of time: counts per block of time first, then places within a block.
    A finding's own place among them says which numbers are next to it, and these are fetched by an equi join, so n
    findings and m records of a key make n times 2 ``most`` rows, not n times m.
    """
    span, block = hours * 3600, max(hours * 3600 / 8, 60.0)
    rest = [c for c in records.columns if c not in (*keys, "ts")]
    tie = F.col("uid") if "uid" in records.columns else F.lit(None).cast("string")
    # Among records of one time the first uid is the nearest from either side, so there are two numberings.
    data = records.select(*keys, "ts", tie.alias("_tie"), F.struct(*(F.col(c) for c in rest)).alias("_rest") if rest else F.lit(None).alias("_rest"), F.lit(None).cast("string").alias("_id"))
    data = data.filter("ts IS NOT NULL")
    asked = own.filter("at IS NOT NULL").select(*keys, F.col("at").cast("double").alias("ts"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(data.schema["_rest"].dataType).alias("_rest"), F.to_json(F.struct("id")).alias("_id"))
    # Keys without a finding take no part.
    data = data.join(asked.select(*keys).distinct(), list(keys), "left_semi")
    both = data.withColumn("ts", F.col("ts").cast("double")).unionByName(asked).withColumn("_block", F.floor(F.col("ts") / block))
    record = F.when(F.col("_id").isNull(), 1).otherwise(0)
    counts = both.groupBy(*keys, "_block").agg(F.sum(record).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A finding stands behind the records of its own time: "up to" counts those before it or with it.
    place = lambda tie_order: F.sum(record).over(Window.partitionBy(*keys, "_block").orderBy("ts", F.col("_id").isNotNull(), tie_order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumns({"_up": place(F.asc("_tie")), "_down": place(F.desc("_tie"))}).join(counts.select(*keys, "_block", offset.alias("_o")), [*keys, "_block"])
    held = ranked.filter("_id IS NULL")
    numbers = F.array(F.struct(F.lit("after").alias("_side"), (F.col("_o") + F.col("_up")).alias("_k")), F.struct(F.lit("before").alias("_side"), (F.col("_o") + F.col("_down")).alias("_k")))
    held = held.select(*keys, "ts", "_tie", "_rest", F.inline(numbers))
    seen = F.col("_o") + F.col("_up")
    wanted = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.struct(F.lit("after").alias("_side"), (seen + i).alias("_k"))),
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(F.lit("before").alias("_side"), (seen - i).alias("_k"))),
    )
    finders = ranked.filter("_id IS NOT NULL").select(*keys, "_id", F.col("ts").alias("at"), F.inline(wanted))
    near = finders.join(held, [*keys, "_side", "_k"]).filter(F.abs(F.col("ts") - F.col("at")) <= span)
    w = Window.partitionBy("_id").orderBy(F.abs(F.col("ts") - F.col("at")), "ts", "_tie", "_side", "_k")
    best = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    kind = own.schema["id"].dataType.simpleString()
    return best.select(F.from_json("_id", f"id {kind}")["id"].alias("id"), *keys, "at", "ts", *(F.col(f"_rest.{c}").alias(c) for c in rest), "place")


def raw_evidence(findings: DataFrame, logs: Mapping[str, DataFrame], hours: float = 2.0, most: int = 50) -> DataFrame:
    """(id, log_type, uid, ts, place): the nearest records in the logs that a finding's type points to (JOIN-13, LKP-13).

    A destination that is a name meets DNS queries of it or below it, and HTTP hosts without their port;
    an address meets the record's destination. ``logs`` maps a log to its records (uid, src, dst, ts, and
    query or host).
    """
    own = findings.select("id", F.col("src_ip").alias("src"), F.lower("dst_ip").alias("target"), "at", F.explode(E.log_types("type")).alias("log_type"), E.is_ip("dst_ip").alias("_ip"))
    parts = []
    for name, records in logs.items():
        rows = records.withColumn("uid", F.col("uid") if "uid" in records.columns else F.lit(None).cast("string"))
        mine = own.filter(F.col("log_type") == name)
        by_ip = rows.select("uid", "src", "ts", F.lower("dst" if "dst" in rows.columns else "resolver").alias("target"))
        by_name = by_ip
        if "query" in rows.columns:  # every parent of a name is a key
            labels = F.split(F.lower(F.regexp_replace("query", r"\.$", "")), r"\.")
            above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
            by_name = rows.filter("query IS NOT NULL").select("uid", "src", "ts", F.explode(above).alias("target"))
        elif "host" in rows.columns:
            by_name = rows.select("uid", "src", "ts", F.lower(E.host_without_port("host")).alias("target"))
        # A log without names meets all targets by their spelling: its records are numbered once.
        for held, flag in ((by_ip, F.lit(True)),) if by_name is by_ip else ((by_ip, F.col("_ip")), (by_name, ~F.col("_ip"))):
            parts.append(_nearest(mine.filter(flag).drop("_ip"), held, ["src", "target"], hours, most).select("id", F.lit(name).alias("log_type"), "uid", "ts", "at"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    w = Window.partitionBy("id").orderBy(F.abs(F.col("ts") - F.col("at")), "ts", "log_type", "uid")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("at")


def cross_notes(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, note): one note per finding and indicator hit that share an address (JOIN-14)."""
    hit = hits.select(F.col("dst_ip").alias("ip"), "source").distinct()
    plain = findings.filter(~F.col("type").startswith("TI Hit"))
    sides = plain.select("id", F.col("src_ip").alias("ip")).union(plain.select("id", F.col("dst_ip").alias("ip")))
    note = F.concat(F.lit("Indicator hit on "), F.col("ip"), F.lit(" from "), F.col("source"))
    return sides.join(hit, "ip").select("id", note.alias("note")).distinct()


def context(findings: DataFrame, most: int = 8) -> DataFrame:
    """Per finding: other types of its source and of its destination, and the destination's hosts (JOIN-18)."""

    def types(side: str, name: str) -> DataFrame:
        counted = findings.groupBy(side, "type").agg(F.count("*").alias("n"))
        w = Window.partitionBy(side).orderBy(F.desc("n"), "type")
        top = counted.withColumn("r", F.row_number().over(w))
        listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "type", "n")))), lambda x: F.concat(x["type"], F.lit(" x"), x["n"].cast("string")))
        return top.groupBy(side).agg(F.array_join(listed, ", ").alias(f"{name}_types"), F.greatest(F.count("*") - most, F.lit(0)).alias(f"{name}_more"))

    hosts = findings.groupBy("dst_ip").agg(F.countDistinct("src_ip").alias("dst_hosts"))
    return findings.select("id", "src_ip", "dst_ip").join(types("src_ip", "src"), "src_ip", "left").join(types("dst_ip", "dst"), "dst_ip", "left").join(hosts, "dst_ip", "left")


def full_context(findings: DataFrame, members: DataFrame | None = None, allowed: DataFrame | Listed | None = None, most: int = 8) -> DataFrame:
    """``context`` with the other types on the finding's pair, the roll-ups that hold it, its source's risk, and which of its sides are allowed (JOIN-18).

    ``members`` is the membership table of roll-ups: a finding is in few of them.
    """
    pair = ["sensor", "src_ip", "dst_ip"]
    kinds = findings.groupBy(*pair).agg(F.sort_array(F.collect_set("type")).alias("_kinds"))  # as many as there are types at most
    risk = findings.filter("type = 'Host Risk Score'").groupBy("src_ip").agg(F.max("score").alias("host_risk"))
    out = context(findings, most).join(findings.select("id", "sensor", "type"), "id").join(kinds, pair, "left").join(risk, "src_ip", "left")
    out = out.withColumn("pair_types", F.array_join(F.array_remove("_kinds", F.col("type")), ", ")).drop("_kinds", "type")
    if members is not None:
        held = members.groupBy(F.col("member").alias("id")).agg(F.sort_array(F.collect_set("rollup")).alias("rollups"))
        out = out.join(held, "id", "left")
    if allowed is not None:
        hit = side_matches(findings, allowed).select("_ip").distinct()
        for side in ("src_ip", "dst_ip"):
            out = out.join(hit.select(F.col("_ip").alias(side), F.lit(True).alias(f"{side}_allowed")), side, "left").fillna({f"{side}_allowed": False})
    return out


# Threat indicators


def indicator_hits(records: DataFrame, indicators: DataFrame, dst: str = "dst") -> DataFrame:
    """TI hits per (dst, src): distinct destinations first, sources only for those that hit (DET-37).

    ``indicators`` (value, feed, score); several feeds merge into the best score and a sorted list.
    """
    found = matches(records, dst, indicators)
    merged = found.groupBy(dst).agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("feed")), "+").alias("source"))
    rows = records.filter(F.col(dst).isNotNull()).join(merged, dst)
    out = rows.groupBy(dst, "src").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.min("port").alias("port"), F.first("score").alias("score"), F.first("source").alias("source"))
    kind = F.when(E.is_ip(dst), "TI Hit (IP)").otherwise("TI Hit (Domain)")
    return out.withColumns({"type": kind, "severity": F.when(F.col("score") >= 95, "CRITICAL").otherwise("HIGH")})


def destinations(conn: DataFrame | None = None, dns: DataFrame | None = None, http: DataFrame | None = None, findings: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """(dst, src, ts, port, log): what was contacted, by address in connections, by name in queries and HTTP hosts, and by findings (DET-37).

    Rows of findings name a destination without a source. With ``counted``, records of one source, destination and log
    are one row with their number ``n`` and their least time and port, so that names are read once for each of these.
    """
    parts = []
    if counted:
        ends = lambda df, *by: None if df is None else df.groupBy(*by).agg(F.count("*").alias("n"), *(F.min(F.col(c).cast(kind)).alias(c) for c, kind in (("ts", "double"), ("port", "string")) if c in df.columns))
        conn, dns, http, findings = ends(conn, "dst", "src"), ends(dns, "query", "src"), ends(http, "host", "src"), ends(findings, "dst_ip")
    n = [F.col("n")] if counted else []
    external = lambda c: F.col(c).isNotNull() & ~E.is_private(c) & ~E.is_local_infra(c)
    if conn is not None:
        parts.append(conn.filter(external("dst") & E.is_ip("dst")).select("dst", "src", "ts", F.col("port").cast("string").alias("port"), F.lit("conn").alias("log"), *n))
    if dns is not None:
        name = F.lower(F.regexp_replace("query", r"\.+$", ""))
        parts.append(dns.filter("query IS NOT NULL").select(name.alias("dst"), "src", "ts", F.lit("53").alias("port"), F.lit("dns").alias("log"), *n).filter((F.col("dst") != "") & ~E.is_ip("dst")))
    if http is not None:
        host = F.lower(E.host_without_port("host"))
        parts.append(http.filter(F.coalesce("host", F.lit("")) != "").select(host.alias("dst"), "src", "ts", F.col("port").cast("string").alias("port"), F.lit("http").alias("log"), *n))
    if findings is not None:
        rows = findings.filter(external("dst_ip") & ~F.col("dst_ip").startswith("("))
        parts.append(rows.select(F.lower("dst_ip").alias("dst"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("double").alias("ts"), F.lit(None).cast("string").alias("port"), F.lit("findings").alias("log"), *n))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def threat_hits(seen: DataFrame, indicators: DataFrame) -> DataFrame:
    """TI hits per (dst, src) over ``destinations``: evidence of the preferred log, one row without source where only findings name it (DET-37).

    Sources of one destination merge into the best score and a sorted list. Preferred are connections for
    addresses and HTTP over DNS for names.
    """
    found = matches(seen, "dst", indicators)
    # Both tables are small beside the records and asked several times: the records are read once for each.
    merged = written(found.groupBy("dst").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("feed")), "+").alias("source")), "threat-merged")
    rank = E.pick(F.col("log"), {"conn": 0, "http": 1, "dns": 2, "findings": 3})
    n = F.sum("n") if "n" in seen.columns else F.count("*")
    by_log = seen.join(merged.select("dst"), "dst", "left_semi").groupBy("dst", "src", rank.alias("rank")).agg(n.alias("n"), F.min("ts").alias("first"), F.min("port").alias("port"), F.first("log").alias("log"))
    best = by_log.groupBy("dst", "src").agg(F.min_by(F.struct("n", "first", "port", "log"), "rank").alias("b")).select("dst", "src", "b.*")
    best = written(best, "threat-best")
    named = best.filter("src IS NOT NULL").select("dst").distinct()
    out = best.filter("src IS NOT NULL").unionByName(best.filter("src IS NULL").join(named, "dst", "left_anti").withColumn("src", F.lit("(TI)")))
    kind = F.when(E.is_ip("dst"), "TI Hit (IP)").otherwise("TI Hit (Domain)")
    return out.join(merged, "dst").withColumns({"type": kind, "severity": F.when(F.col("score") >= 95, "CRITICAL").otherwise("HIGH")})


def hash_hits(files: DataFrame, indicators: DataFrame, columns: Sequence[str] = ("md5", "sha1", "sha256")) -> DataFrame:
    """First hit per (receiver, hash), hashes of a record in order (DET-38); ``rx`` and ``tx`` are single addresses.

    Records without file hosts are those of the connection's two ends.
    """
    held = [c for c in columns if c in files.columns]
    rows = logs.file_ends(files).select("rx", "tx", "ts", F.posexplode(F.array(*held)).alias("pos", "hash")).filter(F.coalesce("hash", F.lit("")) != "")
    rows = rows.withColumn("hash", F.lower("hash")).join(indicators.select(F.lower("value").alias("hash"), "feed").distinct(), "hash")
    w = Window.partitionBy("rx", "hash").orderBy("ts", "pos", "feed")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "pos").withColumn("score", F.lit(90))


def url_hits(http: DataFrame, hosts: DataFrame, score: int = 96) -> DataFrame:
    """HTTP hosts on a URL list, first per (src, host, feed) (DET-36)."""
    rows = http.withColumn("name", F.lower(E.host_without_port("host"))).join(hosts.select(F.lower("value").alias("name"), "feed").distinct(), "name")
    w = Window.partitionBy("src", "name", "feed").orderBy("ts", "dst")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("score", F.lit(score))
