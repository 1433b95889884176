"""Splits that keep related records together (problem 3).

A record is linked to keys (its repository, its own id, the record a negative took its output from); records that
share a key, directly or through others, form a component and get one split. Components are a persisted table
(key, component, split, rows) that is updated with every batch: new links are merged by hooking the larger root under
the smaller and pointer jumping, until no link joins two roots. A component that was there keeps its split. New ones
fill what the splits lack: large ones the emptiest split first, all others by a hash of the component, in proportion to
what is left. A merge of persisted components with different splits is quarantined: it is not carried out, both keep
their keys and splits, and the records that would join them are marked and follow the one of more rows. Records that
had different splits before there was a table are no merge: all rows of their component follow the split of most.

Records without any key are components of their own. Null keys are none. The number of rows, not of components, is
brought near the target shares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small_enough, stable

#: A new component of at least this share of all rows is placed by size; there are at most its inverse of these.
LARGE = 0.002
#: Steps of the hash by which the other components are spread.
SLOTS = 4096

STATE = "key string, component long, split string, n_rows long"


def repo_key(instance_id: Column) -> Column:
    """Repository of an id, that is all before its last number, in whatever case, separators and blanks it is spelled."""
    flat = F.regexp_replace(F.lower(F.trim(instance_id)), "[^a-z0-9]+", "-")
    return F.concat(F.lit("repo:"), F.regexp_replace(F.regexp_replace(flat, "^-|-$", ""), "-[^-]*$", ""))


def id_key(instance_id: Column) -> Column:
    return F.concat(F.lit("id:"), F.lower(F.trim(instance_id)))


def record_keys(source: Column, instance_id: Column, origin: Column) -> Column:
    """Keys of a record: a repository for real ones, the own id for others, and the origin of a negative's output."""
    made = lambda x: F.lower(F.trim(x)).startswith("synthetic")
    own = F.when(source == "swe", repo_key(instance_id)).otherwise(id_key(instance_id))
    return F.array_distinct(F.array_compact(F.array(own, F.when(made(origin), id_key(origin)).otherwise(repo_key(origin)))))


def _side(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it is small, so that a hot key of the other side meets no shuffle; else left to the join."""
    return F.broadcast(df) if small_enough(df) else df


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph: links (a, b) of nodes, all of them in ``nodes`` (node)."""
    parent = stable(nodes.select("node", F.col("node").alias("root")))
    open_ = stable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while open_.take(1):
        # every root hooks under the smallest root it is linked to
        hook = open_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        parent = parent.join(hook, "node", "left").select("node", F.coalesce("to", "root").alias("root"))
        parent = stable(parent)
        while True:
            # nodes that others point to and that are no roots; few after a round or two, even in a giant component
            below = parent.where("node <> root")
            up = stable(below.join(below.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("above")))
            if not up.take(1):
                break
            parent = stable(parent.join(_side(up), "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        root = parent.withColumnRenamed("root", "r")
        open_ = open_.join(root.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
        open_ = stable(open_.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return parent


def fill(sizes: list[tuple[int, int]], room: dict[str, float]) -> dict[int, str]:
    """Split of each (component, rows), largest first, always the split with most room; ``room`` is changed."""
    out = {}
    for component, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(sorted(room), key=lambda s: room[s])
        out[component] = best
        room[best] -= n
    return out


def update(records: DataFrame, targets: list[tuple[str, float]], state: DataFrame | None = None, conflicts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, new state, quarantined).

    records: id, keys (array<string>), was (split of an earlier assignment or null). assigned: id, component, split, was,
    status ('kept', 'new', 'moved' if the record had another split, 'quarantined' if its component met several).
    quarantined: component, splits that met, n_rows. Components of ``state`` with different splits are held apart;
    records that link only keys of one of them go with it. With ``conflicts``, records that had different splits are
    reported as quarantined too, and follow the split of most rows.
    """
    spark = records.sparkSession
    names = [s for s, _ in targets]
    if state is None:
        state = spark.createDataFrame([], STATE)
    rows = stable(records.select("id", F.when(F.size("keys") > 0, F.array_sort(F.array_distinct("keys"))).otherwise(F.array(F.concat(F.lit("row:"), F.col("id").cast("string")))).alias("keys"), F.when(F.col("was").isin(names), F.col("was")).alias("was")))
    node = F.xxhash64
    old = state.select(node("key").alias("node"), "key", "component", "split", "n_rows")
    keyed = rows.select(F.explode("keys").alias("key")).distinct().select(node("key").alias("node"), "key")
    nodes = keyed.select("node").union(old.select("node")).union(old.select(F.col("component").alias("node"))).distinct()
    first = F.col("keys")[0]
    links = rows.where("size(keys) > 1").select(node(first).alias("a"), F.explode(F.slice("keys", 2, 1 << 30)).alias("k")).select("a", node("k").alias("b")).distinct()
    links = links.union(old.select(F.col("node").alias("a"), F.col("component").alias("b")))
    root = stable(components(links, nodes))
    of = stable(rows.select("id", "was", node(first).alias("node")).join(root, "node").select("id", "was", F.col("root").alias("component")))
    # votes for the split a component has: earlier components by their rows, records by their earlier split
    earlier = old.groupBy("component", "split").agg(F.max("n_rows").alias("n")).join(root.withColumnRenamed("node", "component").withColumnRenamed("root", "r"), "component").select(F.col("r").alias("component"), "split", "n", F.lit(1).alias("held"), F.col("component").alias("own"))
    cast = of.where("was is not null").groupBy("component", F.col("was").alias("split")).agg(F.count("*").alias("n")).withColumns({"held": F.lit(0), "own": F.col("component")})
    votes = earlier.unionByName(cast).groupBy("component").agg(F.max(F.struct("held", "n", "split", "own")).alias("top"), F.array_size(F.collect_set(F.when(F.col("held") == 1, F.col("split")))).alias("met"), F.array_sort(F.collect_set(F.when((F.col("held") == 1) | F.lit(conflicts), F.col("split")))).alias("splits"))
    size = of.groupBy("component").agg(F.count("*").alias("n_new"))
    had = old.groupBy("component").agg(F.max("n_rows").alias("n")).join(root.withColumnRenamed("node", "component"), "component").groupBy(F.col("root").alias("component")).agg(F.sum("n").alias("n_old"))
    comps = stable(
        size.join(had, "component", "full")
        .join(votes, "component", "left")
        .select("component", (F.coalesce("n_new", F.lit(0)) + F.coalesce("n_old", F.lit(0))).alias("n_rows"), F.col("top.split").alias("split"), F.col("top.own").alias("own"), (F.coalesce("met", F.lit(0)) > 1).alias("apart"), F.coalesce("splits", F.array().cast("array<string>")).alias("splits"))
    )
    total = comps.agg(F.sum("n_rows")).first()[0] or 0
    room = {s: share * total for s, share in targets}
    for r in comps.where("split is not null").groupBy("split").agg(F.sum("n_rows").alias("n")).collect():
        room[r.split] = room.get(r.split, 0.0) - r.n
    room = {s: room[s] for s in names}
    fresh = comps.where("split is null")
    large = fresh.where(F.col("n_rows") >= max(2, math.ceil(LARGE * total)))
    placed = fill([(r.component, r.n_rows) for r in large.select("component", "n_rows").collect()], room)  # at most 1 / LARGE
    slot = F.pmod(F.xxhash64("component", F.lit(9)), F.lit(SLOTS))
    small = fresh.where(F.col("n_rows") < max(2, math.ceil(LARGE * total))).groupBy(slot.alias("slot")).agg(F.sum("n_rows").alias("n")).collect()
    by_slot = {}
    for r in sorted(small, key=lambda r: (-r.n, r.slot)):
        best = max(sorted(room), key=lambda s: room[s])
        by_slot[r.slot] = best
        room[best] -= r.n
    big = spark.createDataFrame([(k, v) for k, v in placed.items()], "component long, big string")
    slots = spark.createDataFrame([(k, v) for k, v in by_slot.items()], "slot long, slotted string")
    comps = comps.join(F.broadcast(big), "component", "left").withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")
    comps = stable(comps.select("component", "n_rows", "splits", "own", "apart", F.col("split").alias("had"), F.coalesce("split", "big", "slotted").alias("split")))
    # records of components that are held apart: those with keys of one old component only stay with it
    mine = rows.select("id", F.explode("keys").alias("key"), F.size("keys").alias("all")).join(old.select("key", F.col("component").alias("old"), F.col("split").alias("old_split")), "key")
    mine = mine.groupBy("id").agg(F.count("*").alias("n"), F.first("all").alias("all"), F.min("old").alias("old"), F.max("old").alias("high"), F.first("old_split").alias("old_split")).where("n = all and old = high").select("id", "old", "old_split")
    placed = of.join(comps, "component").join(mine, "id", "left")
    alone = F.col("apart") & F.col("old").isNotNull()
    split = F.when(alone, F.col("old_split")).otherwise(F.col("split"))
    assigned = placed.select(
        "id", F.when(alone, F.col("old")).when(F.col("apart"), F.col("own")).otherwise(F.col("component")).alias("component"), split.alias("split"), "was",
        F.when(~alone & (F.size("splits") > 1), "quarantined").when(F.col("was").isNotNull() & (F.col("was") != split), "moved").when(F.col("had").isNull(), "new").otherwise("kept").alias("status"),
    )
    keys = keyed.join(old.select("node"), "node", "left_anti").withColumns({"old": F.lit(None).cast("long"), "old_split": F.lit(None).cast("string"), "old_rows": F.lit(None).cast("long")})
    keys = keys.unionByName(old.select("node", "key", F.col("component").alias("old"), F.col("split").alias("old_split"), F.col("n_rows").alias("old_rows")))
    stays = F.col("apart") & F.col("old").isNotNull()
    after = keys.join(root, "node").withColumnRenamed("root", "component").join(comps.select("component", "own", "apart", "split", "n_rows"), "component")
    after = after.select("key", F.when(stays, F.col("old")).when(F.col("apart"), F.col("own")).otherwise(F.col("component")).alias("component"), F.when(stays, F.col("old_split")).otherwise(F.col("split")).alias("split"), F.when(stays, F.col("old_rows")).otherwise(F.col("n_rows")).alias("n_rows"))
    return assigned, after, comps.where("size(splits) > 1").select("component", "splits", "n_rows")


def advance(records: DataFrame, targets: list[tuple[str, float]], path: str) -> tuple[DataFrame, DataFrame]:
    """(assigned, quarantined) as of :func:`update`, by the component table kept under ``path``.

    Records that are not in the table yet are merged into it and a new version of it is written; the others keep their
    status unless a merge changes it. A version counts once all its parts are written. One writer at a time.
    """
    spark = records.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    last = 0
    while is_there(f"{path}/{last + 1}/quarantined/_SUCCESS"):
        last += 1
    part = lambda name, v: spark.read.parquet(f"{path}/{v}/{name}")
    fresh = records.join(part("records", last).select("id"), "id", "left_anti") if last else records
    if not last or fresh.take(1):
        key = F.coalesce(F.array_min("keys"), F.concat(F.lit("row:"), F.col("id").cast("string"))).alias("key")
        assigned, state, bad = update(fresh, targets, part("state", last) if last else None, conflicts=True)
        bad = stable(bad)
        made = assigned.join(fresh.select("id", key), "id").select("id", "key", "was", "split", "status")
        state.write.mode("overwrite").parquet(f"{path}/{last + 1}/state")
        if last:
            now = part("state", last + 1).select("key", F.col("split").alias("now"))
            status = F.when(F.col("now") != F.col("split"), "moved").otherwise(F.col("status"))
            kept = part("records", last).join(now, "key").select("id", "key", "was", F.col("now").alias("split"), status.alias("status"))
            made = made.unionByName(kept)
            bad = part("quarantined", last).unionByName(bad)
        made.write.mode("overwrite").parquet(f"{path}/{last + 1}/records")
        bad.write.mode("overwrite").parquet(f"{path}/{last + 1}/quarantined")
        last += 1
    known = part("records", last).join(records.select("id"), "id", "left_semi")
    return known.join(part("state", last).select("key", "component"), "key").select("id", "component", "split", "was", "status"), part("quarantined", last)
