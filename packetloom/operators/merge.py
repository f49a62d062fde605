"""Run-to-run merges of whole tables (MRG): each takes tables and returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V
from packetloom.operators.rollups import fingerprint
from packetloom.sources.scratch import written

KEPT = ("id", "status", "analyst", "analyst_note", "detected_at")


def winners(run: DataFrame) -> DataFrame:
    """One row per identity: the highest score, then the first (WIN-8)."""
    order = ["timestamp", "detail"] if "id" not in run.columns else ["id"]
    w = Window.partitionBy("fp").orderBy(F.desc("score"), *order)
    return fingerprint(run).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _older_names(fp_of: DataFrame) -> DataFrame:
    """(fp, try, older): the identities under which earlier versions kept a row, without host and URI, then without sensor."""
    blank = lambda *cs: fp_of.withColumns({c: F.lit("") for c in cs if c in fp_of.columns})
    host, sensor = [c for c in ("hostname", "uri") if c in fp_of.columns], ["sensor"]
    http = (F.col("type") == "HTTP Beacon") & F.lit(bool(host))
    tries = [(1, host, http), (2, [*host, *sensor], http), (3, sensor, ~http)]
    out = None
    for n, gone, when in tries:
        own = blank(*gone).withColumnRenamed("fp", "_fp").filter(when)
        rows = fingerprint(own).select(F.col("_fp").alias("fp"), F.lit(n).alias("try"), F.col("fp").alias("older")).filter("fp != older")
        out = rows if out is None else out.union(rows)
    return out


def merge_run(history: DataFrame, run: DataFrame, now: str, full: bool = True) -> DataFrame:
    """A run merged into the findings table (MRG-1; full=False keeps roll-ups, MRG-2).

    A row of the run with a known identity keeps the history's id, triage and detection time; others
    get the next ids and ``is_new``. A row whose identity is new takes over a history row that is left under
    an older form of it, each at most one. History without a match stays, roll-ups only if the run is
    partial. New ids are dealt by blocks of the identity's hash: counts per block, then places within a
    block. Where the run has ``id`` and ``correlations``, these are translated (``translated``).
    """
    kept = [c for c in (*KEPT, "notes", "status_ts") if c in history.columns]
    old = fingerprint(history)
    new = winners(run).drop(*(c for c in (*kept, "is_new") if c in run.columns))
    both = old.select("fp", F.struct(*history.columns).alias("o")).join(new.select("fp", F.struct(*(c for c in new.columns if c != "fp")).alias("n")), "fp", "full")
    both = written(both, "both")  # the steps below read it a dozen times
    lone = _older_names(both.filter("o IS NULL").select("fp", "n.*")).join(both.filter("n IS NULL").select(F.col("fp").alias("older"), F.col("o").alias("before")), "older")
    first = lone.groupBy("older").agg(F.min(F.struct("try", "fp")).alias("w"), F.first("before").alias("before")).select("older", "w.*", "before")
    taken = first.groupBy("fp").agg(F.min(F.struct("try", "older")).alias("w"), F.min_by("before", F.struct("try", "older")).alias("before")).select("fp", "w.older", "before")
    taken = written(taken, "taken")
    gone = taken.select(F.col("older").alias("fp"))
    both = both.join(gone, "fp", "left_anti").join(taken.select("fp", "before"), "fp", "left").withColumn("o", F.coalesce("o", "before")).drop("before")
    if full:
        both = both.filter(F.col("n").isNotNull() | ~F.col("o.type").isin(list(V.ROLLUPS)))
    fresh = F.col("o").isNull()
    both = both.withColumn("_b", F.conv(F.substring("fp", 1, 3), 16, 10).cast("int"))  # 4096 blocks
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy("_b").agg(F.count_if(fresh).alias("_n"))  # at most 4096 rows
    offsets = offsets.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    place = F.sum(fresh.cast("int")).over(Window.partitionBy("_b").orderBy("fp"))
    rows = both.withColumn("_p", place).join(F.broadcast(offsets), "_b").join(F.broadcast(top))
    makes = {"status": F.lit(""), "analyst": F.lit(""), "analyst_note": F.lit(""), "detected_at": F.lit(now), "id": (F.col("_top") + F.col("_o") + F.col("_p")).cast("long")}
    names = list(dict.fromkeys([*(c for c in new.columns if c != "fp"), *KEPT, "is_new", *history.columns]))
    cols = {}
    for c in names:
        held = F.col(f"o.{c}") if c in history.columns else F.lit(None)
        if c == "is_new":
            cols[c] = fresh
        elif c in kept or c in KEPT:
            cols[c] = F.when(fresh, makes.get(c, F.lit(None))).otherwise(held)
        else:
            cols[c] = F.when(F.col("n").isNotNull(), F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(held)
    out = rows.select("fp", F.col("n").isNotNull().alias("_ran"), *(v.alias(c) for c, v in cols.items()))
    if {"id", "correlations"} <= set(run.columns):
        out = translated(out, run, history)
    return out.drop("fp", "_ran")


def translated(merged: DataFrame, run: DataFrame, history: DataFrame) -> DataFrame:
    """``correlations`` of the run's rows with the table's ids in place of the run's.

    A run's id stands for the row that its identity ended up in, a negative one for a history row; ids that
    are neither are dropped.
    """
    ids = fingerprint(run).select("fp", F.col("id").alias("ref")).join(merged.select("fp", F.col("id").alias("to")), "fp").select("ref", "to").distinct()
    known = history.select(F.col("id").alias("there")).distinct()
    refs = merged.filter("_ran").select("fp", F.posexplode("correlations").alias("pos", "ref"))
    refs = refs.join(ids, "ref", "left").join(known, F.abs("ref") == F.col("there"), "left")
    refs = refs.withColumn("to", F.when(F.col("ref") < 0, F.col("there")).otherwise(F.coalesce("to", "there"))).filter("to IS NOT NULL")
    held = refs.groupBy("fp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("_to"))
    kind = merged.schema["correlations"].dataType
    new = F.coalesce(F.col("_to"), F.array().cast("array<bigint>")).cast(kind)
    return merged.join(held, "fp", "left").withColumn("correlations", F.when(F.col("_ran") & F.col("correlations").isNotNull(), new).otherwise(F.col("correlations"))).drop("_to")


def merge_members(members: DataFrame, run_members: DataFrame, merged: DataFrame, full: bool = True) -> DataFrame:
    """The membership table (rollup_fp, rollup, fp, member) after a run is merged, in the table's ids (DET-41).

    ``merged`` is the findings table after ``merge_run``. A run's roll-up or member is found by identity, a
    member that only the history had (``historical`` in ``run_members``) by its id, whatever identity that
    row has by now. Roll-ups of the run replace their former members; in a partial run the others keep theirs,
    as long as roll-up and member exist.
    """
    ids = written(fingerprint(merged).select("fp", "id"), "merged-ids")  # read three times
    roll = ids.select(F.col("fp").alias("rollup_fp"), F.col("id").alias("rollup"))
    run = run_members.drop("rollup").join(roll, "rollup_fp")
    fresh = run.filter("NOT historical").drop("member").join(ids.withColumnRenamed("id", "member"), "fp")
    old = run.filter("historical").drop("fp").join(ids.withColumnRenamed("id", "member"), "member")
    columns = ["rollup_fp", "rollup", "fp", "member"]
    out = fresh.select(*columns).unionByName(old.select(*columns))
    if not full:
        again = members.join(run_members.select("rollup_fp").distinct(), "rollup_fp", "left_anti").drop("rollup", "fp")
        out = out.unionByName(again.join(roll, "rollup_fp").join(ids.withColumnRenamed("id", "member"), "member").select(*columns))
    return out.distinct()


def merge_history(history: DataFrame, findings: DataFrame, day: str) -> DataFrame:
    """Daily figures per identity: the last score always, the best with its sub-scores when it is beaten (MRG-3)."""
    subs = ["ts_score", "ds_score", "hist_score", "dur_score"]
    rank = lambda: -E.severity_rank("severity")
    now = fingerprint(findings).select("fp", F.lit(day).alias("day"), "type", "src_ip", "dst_ip", F.col("score").alias("max_score"), "severity", *subs, F.col("score").alias("last_score"), F.lit(1).alias("_p"))
    both = history.withColumn("_p", F.lit(0)).unionByName(now)
    best = F.max_by(F.struct("type", "src_ip", "dst_ip", "max_score", "severity", *subs), F.struct("max_score", rank().alias("s"), (-F.col("_p")).alias("p")))
    return both.groupBy("fp", "day").agg(best.alias("b"), F.max_by("last_score", "_p").alias("last_score")).select("fp", "day", "b.*", "last_score")


def merge_indicators(table: DataFrame, incoming: DataFrame, now: float) -> DataFrame:
    """Indicators by (feed, value, kind): the first sighting stays, the last moves (MRG-4)."""
    rows = table.select("feed", "value", "kind", "first_seen", "last_seen").unionByName(
        incoming.select("feed", "value", "kind").distinct().withColumns({"first_seen": F.lit(now), "last_seen": F.lit(now)})
    )
    return rows.groupBy("feed", "value", "kind").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_counts(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Added and refreshed indicators per feed."""
    keys = ["feed", "value", "kind"]
    known = table.select(*keys).distinct().withColumn("known", F.lit(True))
    return incoming.select(*keys).distinct().join(known, keys, "left").groupBy("feed").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("refreshed"))


def aged(table: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows last seen before the cutoff go; unknown times stay (MRG-5)."""
    return table.filter(F.col(column).isNull() | (F.col(column) >= cutoff))


def set_status(findings: DataFrame, ids: DataFrame, status: str, analyst: str) -> tuple[DataFrame, DataFrame]:
    """The table with a new status for the ids, and the rows' values before (MRG-6)."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = findings.join(hit, "id", "left")
    new = rows.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "analyst": F.when(F.col("_hit"), analyst).otherwise(F.col("analyst"))}).drop("_hit")
    return new, rows.filter("_hit").select("id", "status", "analyst")


def dismiss_campaign(findings: DataFrame, dst: str, port: str) -> DataFrame:
    """All findings of one destination and port (MRG-7)."""
    return findings.withColumn("status", F.when((F.col("dst_ip") == dst) & F.col("dst_port").eqNullSafe(port), "dismissed").otherwise(F.col("status")))


def rename_sensor(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumn("sensor", F.when(F.col("sensor") == old, new).otherwise(F.col("sensor")))


def drop_sensor(table: DataFrame, prefix: str) -> DataFrame:
    return table.filter(~F.coalesce(F.col("sensor").startswith(prefix), F.lit(False)))


def add_notes(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes (id, note) appended where they are not there yet (MRG-9)."""
    new = notes.groupBy("id").agg(F.sort_array(F.collect_set("note")).alias("_new"))
    held = F.coalesce("notes", F.array().cast("array<string>"))
    return findings.join(new, "id", "left").withColumn("notes", F.when(F.col("_new").isNull(), F.col("notes")).otherwise(F.concat(held, F.array_except("_new", held)))).drop("_new")


def retracted(notifications: DataFrame, visible: DataFrame) -> DataFrame:
    """Notifications are dismissed where their finding is gone or hidden (MRG-10)."""
    seen = visible.select(F.col("id").alias("finding_id")).distinct().withColumn("_v", F.lit(True))
    return notifications.join(seen, "finding_id", "left").withColumn("dismissed", F.col("dismissed") | F.col("_v").isNull()).drop("_v")


def list_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed entries (SET-2)."""
    added = after.select("value").subtract(before.select("value")).withColumn("change", F.lit("added"))
    return added.union(before.select("value").subtract(after.select("value")).withColumn("change", F.lit("removed")))
