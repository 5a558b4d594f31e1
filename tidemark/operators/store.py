"""The feed store as set operations on snapshots: every function maps tables to tables.

Plain parquet has no row-level changes: a snapshot is read, rewritten by joins and unions, and
written to a new place; ``sources.snapshots`` swaps the pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.chains import parent_chains
from tidemark.tables import kept


def lookup(df: DataFrame, key: int, col: str = "id") -> DataFrame:
    """The row of a key; none where it is missing."""
    return df.where(F.col(col) == key)


def known_urls(items: DataFrame, source_id: int) -> DataFrame:
    """Distinct urls stored for a source."""
    return items.where(F.col("source_id") == source_id).select("url").distinct()


def listed(df: DataFrame, by: str) -> DataFrame:
    """All rows in order of ``by``, ties by id."""
    return df.orderBy(by, "id")


def states_or_default(ids: DataFrame, states: DataFrame) -> DataFrame:
    """The state of each ``item_id``, unread and unstarred where none is stored."""
    return ids.join(states, "item_id", "left").select(
        "item_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_read", "is_starred")), F.coalesce("updated_at", F.lit(0)).cast("bigint").alias("updated_at")
    )


def numbered(df: DataFrame, start: Column | int, *order: str, name: str = "id") -> DataFrame:
    """``df`` with consecutive numbers after ``start`` in order of ``order``.

    Rows are sorted over partitions; each partition's numbers begin after the counts of those before
    it, so no task numbers all rows. The sorted rows are written once, so counts and numbers are of one order.
    """
    placed = kept(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.lit(start) if isinstance(start, int) else start
    return placed.join(F.broadcast(before), "_p").withColumn(name, start + F.col("_b") + F.col("_m") - F.col("_low") + 1).drop("_p", "_m", "_n", "_low", "_b")


def insert_sources(sources: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """``sources`` with the rows of ``new(seq, url, ...)`` of which the url is new, and the rejected rows.

    Timestamps are ``now``, the interval defaults to an hour, ids continue the greatest.
    """
    first = Window.partitionBy("url").orderBy("seq")
    ranked = new.withColumn("_k", F.row_number().over(first)).join(sources.select("url", F.lit(True).alias("_known")), "url", "left")
    fresh = ranked.where("_k = 1 and _known is null").drop("_k", "_known")
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    made = numbered(fresh, top, "seq").drop("seq").withColumns({"created_at": F.lit(now).cast("bigint"), "updated_at": F.lit(now).cast("bigint")})
    made = made.withColumn("poll_interval", F.coalesce(F.col("poll_interval"), F.lit(3600)).cast("bigint")) if "poll_interval" in made.columns else made.withColumn("poll_interval", F.lit(3600).cast("bigint"))
    return sources.unionByName(made, allowMissingColumns=True), ranked.where("_k > 1 or _known").drop("_k", "_known")


def first_of_batch(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return batch.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_k = 1").drop("_k")


def upsert_items(items: DataFrame, batch: DataFrame, seq: str = "id") -> DataFrame:
    """Rows of ``batch`` that are stored: the first of each (source_id, guid) that ``items`` lacks; a stored row never changes."""
    return first_of_batch(batch, ["source_id", "guid"], seq).join(items.select("source_id", "guid"), ["source_id", "guid"], "left_anti").select(batch.columns)


def insert_items(items: DataFrame, batch: DataFrame, now: int, seq: str = "seq") -> DataFrame:
    """``items`` with what ``upsert_items`` stores of ``batch``: ids continue the greatest in order of ``seq``, ``fetched_at`` and ``created_at`` are ``now``."""
    fresh = upsert_items(items, batch, seq)
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    stamped = numbered(fresh.drop("id"), top, seq).withColumns({c: F.lit(now).cast("bigint") for c in ("fetched_at", "created_at")})
    return items.unionByName(stamped.select(*(c for c in items.columns if c in stamped.columns)), allowMissingColumns=True)


def upsert_results(items: DataFrame, batch: DataFrame, seq: str = "id") -> DataFrame:
    """For each row of ``batch`` the id that its (source_id, guid) has in the end, and whether this row made it."""
    stored = items.select("source_id", "guid", F.col("id").alias("stored_id"))
    first = F.min(seq).over(Window.partitionBy("source_id", "guid"))
    return batch.withColumn("_f", first).join(stored, ["source_id", "guid"], "left").select(
        F.col(seq), F.coalesce("stored_id", "_f").alias("item_id"), (F.col("stored_id").isNull() & (F.col(seq) == F.col("_f"))).alias("is_new")
    )


def new_urls(found: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``(source_id, url)`` of ``found`` that ``items`` lacks."""
    return found.select("source_id", "url").dropDuplicates().join(items.select("source_id", "url"), ["source_id", "url"], "left_anti")


def upsert_states(states: DataFrame, patches: DataFrame) -> DataFrame:
    """The last state of each item, by ``updated_at`` and then ``seq``; stored states come before patches."""
    both = states.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(patches)
    rest = [c for c in states.columns if c != "item_id"]
    return both.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("x")).select("item_id", "x.*")


def patch(stored: DataFrame, changes: DataFrame, cols: list[str], now: int, key: str = "id") -> DataFrame:
    """``stored`` with each non-null value of ``changes`` in ``cols``; changed rows get ``updated_at`` = ``now``."""
    other = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in cols))
    joined = stored.join(other, F.col(key) == F.col("_key"), "left")
    news = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in cols} | {"updated_at": F.when(F.col("_key").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))}
    return joined.withColumns(news).select(stored.columns)


def read_transition(flag: Column, at: Column, new: Column, now: Column) -> tuple[Column, Column]:
    """A flag and the time it was set, after a patch: set keeps an earlier time, unset clears it, null leaves both."""
    return F.coalesce(new, flag), F.when(new.isNull(), at).when(new, F.coalesce(at, now))


def fold_states(patches: DataFrame) -> DataFrame:
    """Patches ``(item_id, ts, seq, is_read, is_starred)`` folded in order, from unread and unstarred: the final state of each item.

    A flag is its last value that is not null; a flag that is set has the first time it was set
    after it was last unset. Both are aggregates of constant size, so no row gathers an item's patches.
    """
    flags = ("read", "starred")
    placed = patches.select("item_id", "ts", "is_read", "is_starred", F.struct("ts", "seq", "is_read", "is_starred").alias("o"))
    ends = placed.groupBy(F.col("item_id").alias("_item")).agg(
        *(F.expr(f"max_by(is_{f}, o) filter (where is_{f} is not null)").alias(f"last_{f}") for f in flags),
        *(F.expr(f"max(o) filter (where not is_{f})").alias(f"off_{f}") for f in flags), F.max("o").getField("ts").alias("updated_at"),
    )
    since = (
        placed.join(ends.select("_item", "off_read", "off_starred"), F.col("item_id").eqNullSafe(F.col("_item")))
        .groupBy("item_id").agg(*(F.expr(f"min(ts) filter (where is_{f} and (off_{f} is null or o > off_{f}))").alias(f"{f}_at") for f in flags))
    )
    return since.join(ends, F.col("item_id").eqNullSafe(F.col("_item"))).select(
        "item_id", *(F.coalesce(f"last_{f}", F.lit(False)).alias(f"is_{f}") for f in flags), *(F.when(F.col(f"last_{f}"), F.col(f"{f}_at")).alias(f"{f}_at") for f in flags), "updated_at"
    )


def tombstones_for(entity: str, ids: DataFrame, now: int) -> DataFrame:
    """A tombstone for each id, stored or not."""
    return ids.select(F.lit(entity).alias("entity_type"), F.col("id").cast("bigint").alias("entity_id"), F.lit(now).cast("bigint").alias("deleted_at"))


def delete_sources(sources: DataFrame, items: DataFrame, states: DataFrame, ids: DataFrame, now: int):
    """``sources, items, states`` without the given sources and all that hangs on them, and the tombstones: one a source."""
    left = items.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(items.columns)
    gone = items.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("id").alias("item_id"))
    return sources.join(ids, "id", "left_anti"), left, states.join(gone, "item_id", "left_anti").select(states.columns), tombstones_for("source", ids, now)


def unset_missing(df: DataFrame, col: str, gone: DataFrame) -> DataFrame:
    """``df`` with ``col`` null where it names a deleted id; ``updated_at`` stays."""
    return df.join(gone.select(F.col("id").alias("_gone")), F.col(col) == F.col("_gone"), "left").withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).select(df.columns)


def delete_folders(folders: DataFrame, sources: DataFrame, ids: DataFrame, now: int):
    """``folders`` and ``sources`` without the given folders, what hung on them freed, and the tombstones."""
    return unset_missing(folders.join(ids, "id", "left_anti").select(folders.columns), "parent_id", ids), unset_missing(sources, "folder_id", ids), tombstones_for("folder", ids, now)


def sweep_victims(items: DataFrame, states: DataFrame, before: int) -> DataFrame:
    """Items fetched before ``before`` that are not starred."""
    return items.where(F.col("fetched_at") < before).join(states.where("is_starred").select(F.col("item_id").alias("id")), "id", "left_anti").select(items.columns)


def sweep(items: DataFrame, states: DataFrame, before: int, now: int):
    """``items`` and ``states`` without the victims, and a tombstone for each."""
    ids = sweep_victims(items, states, before).select("id")
    return (
        items.join(ids, "id", "left_anti").select(items.columns),
        states.join(ids.select(F.col("id").alias("item_id")), "item_id", "left_anti").select(states.columns),
        tombstones_for("item", ids, now),
    )


def purge_tombstones(tombstones: DataFrame, before: int) -> DataFrame:
    return tombstones.where(~(F.col("deleted_at") < before))


def months_back(day: Column, months: int) -> Column:
    """A date some calendar months earlier; a day that the month lacks runs over into the next."""
    return F.date_add(F.add_months(F.trunc(day, "MONTH"), -months), F.dayofmonth(day) - 1)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, col: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows of which ``col`` names no row of ``parents``."""
    return df.where(F.col(col).isNotNull()).join(parents.select(F.col(key).alias(col)), col, "left_anti").select(df.columns)


def sync_arm(df: DataFrame, change: str, since: int, cap: int | None = None) -> DataFrame:
    """Rows changed after ``since``, oldest first, at most ``cap``."""
    rows = df.where(F.col(change) > since).orderBy(change, "id" if "id" in df.columns else "item_id" if "item_id" in df.columns else "entity_id")
    return rows.limit(cap) if cap else rows


def sync_cursor(arms: list[tuple[DataFrame, str]], since: int) -> DataFrame:
    """The next cursor: the last change among all arms, items as capped, or ``since``."""
    tops = None
    for df, change in arms:
        top = df.agg(F.max(change).alias("t"))
        tops = top if tops is None else tops.union(top)
    return tops.agg(F.greatest(F.lit(since).cast("bigint"), F.coalesce(F.max("t"), F.lit(since)).cast("bigint")).alias("cursor"))


def folder_depths(folders: DataFrame) -> DataFrame:
    """Number of ancestors of every folder, 11 for a cycle."""
    return parent_chains(folders, most=11).select("id", "depth")


def split_new_folders(folders: DataFrame, new: DataFrame, deepest: int = 2) -> tuple[DataFrame, DataFrame]:
    """New folders ``(name, parent_id)`` that fit, and those whose name is empty or parent too deep, with a reason."""
    depth = folder_depths(folders).select(F.col("id").alias("parent_id"), "depth")
    judged = new.join(depth, "parent_id", "left").withColumn(
        "reason", F.when(F.coalesce("name", F.lit("")) == "", "name is required").when(F.col("parent_id").isNotNull() & (F.coalesce("depth", F.lit(0)) + 1 > deepest), "too deep")
    ).drop("depth")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def insert_folders(folders: DataFrame, new: DataFrame, now: int, deepest: int = 2) -> tuple[DataFrame, DataFrame]:
    """``folders`` with the rows of ``new(seq, name, parent_id)`` that fit, stamped ``now``, and the rejected rows with a reason; ids continue the greatest."""
    fit, rejected = split_new_folders(folders, new, deepest)
    top = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    made = numbered(fit, top, "seq").withColumns({c: F.lit(now).cast("bigint") for c in ("created_at", "updated_at")})
    return folders.unionByName(made.select(*(c for c in folders.columns if c in made.columns)), allowMissingColumns=True), rejected


def update_folders(folders: DataFrame, changes: DataFrame, now: int, deepest: int = 2) -> tuple[DataFrame, DataFrame]:
    """``folders`` with ``changes(id, name, parent_id)``, one a folder, and the changes whose new parent is too deep.

    An empty or null name and a null parent leave what is stored; every changed folder gets ``updated_at`` = ``now``.
    Changes of folders that are not stored are ignored. A new parent is judged by the depths before any change.
    """
    depth = folder_depths(folders).select(F.col("id").alias("parent_id"), "depth")
    judged = changes.join(depth, "parent_id", "left").withColumn("too_deep", F.col("parent_id").isNotNull() & (F.coalesce("depth", F.lit(0)) + 1 > deepest))
    fit = judged.where(~F.col("too_deep")).select("id", F.when(F.col("name") != "", F.col("name")).alias("name"), "parent_id")
    return patch(folders, fit, ["name", "parent_id"], now), judged.where("too_deep").select(changes.columns)


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` and the given aggregates of it, which its own first job computes: read them by ``.get`` after that."""
    seen = Observation()
    return df.observe(seen, *(c.alias(name) for name, c in counts.items())), seen


def upsert_items_counted(items: DataFrame, batch: DataFrame, seq: str = "id") -> tuple[DataFrame, Observation]:
    """What ``upsert_items`` stores, with ``stored`` and ``rejected``, the numbers of rows that are new and that are not, of the one job that writes the result.

    The judged batch is observed before the rows that are not stored are dropped.
    """
    order = Window.partitionBy("source_id", "guid").orderBy(seq)
    known = items.select("source_id", "guid", F.lit(True).alias("_known")).distinct()
    judged = batch.withColumn("_k", F.row_number().over(order)).join(known, ["source_id", "guid"], "left").withColumn("_new", (F.col("_k") == 1) & F.col("_known").isNull())
    seen_rows, seen = counted(judged, stored=F.count_if("_new"), rejected=F.count_if(~F.col("_new")))
    return seen_rows.where("_new").select(batch.columns), seen
