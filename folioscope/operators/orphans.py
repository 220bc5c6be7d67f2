"""References to records that do not exist, direct and inherited.

A reference is a value in a child column together with the time of the row
that holds it.  It is *direct* orphan when no row of the parent table with
that key is live at that time, and *inherited* orphan when rows are live but
all of them are orphans themselves.  The foreign-key graph is swept from the
roots down (a fixpoint; cyclic graphs are swept again until nothing changes).

Defined results: rows whose reference or time is null hold no reference; a
parent row without ``loaded_at`` is never live, but its key exists; a parent
row whose ``deleted_at`` is not after its ``loaded_at`` is never live; repeated
rows count once; empty parents make every reference ``missing``; columns that
no key names are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpoint


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names ``parent.key``; ``time`` dates the child row."""

    child: str
    column: str
    time: str
    parent: str
    key: str


def _references(rows: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct (value, time) of a foreign key: a hot key shrinks before any join."""
    return (
        rows.select(F.col(fk.column).alias("value"), F.col(fk.time).alias("at"))
        .where("value is not null and at is not null")
        .distinct()
    )


def _live_spells(rows: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """Disjoint intervals in which a key has a live row.

    Merging first leaves at most one interval for any (key, time), so the join
    with the references never multiplies rows.
    """
    spells = (
        rows.select(F.col(key).alias("key"), F.col(loaded).alias("start"), F.col(deleted).alias("stop"))
        .where("key is not null and start is not null and (stop is null or stop > start)")
        .withColumn("stop", F.coalesce("stop", F.lit("9999-12-31").cast("timestamp_ntz").cast(rows.schema[loaded].dataType)))
        .groupBy("key", "start")
        .agg(F.max("stop").alias("stop"))
    )
    before = Window.partitionBy("key").orderBy("start")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spells.withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1))
        .withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("island")
    )


def _dead(references: DataFrame, spells: DataFrame) -> DataFrame:
    """References whose time lies in no live interval of their key."""
    inside = (
        (references["value"] == spells["key"])
        & (references["at"] >= spells["start"])
        & (references["at"] < spells["stop"])
    )
    return references.join(spells, inside, "left_anti")


def _direct(references: DataFrame, parent: DataFrame, fk: ForeignKey, loaded: str, deleted: str) -> DataFrame:
    known = (
        parent.where(F.col(fk.key).isNotNull())
        .groupBy(F.col(fk.key).alias("known"))
        .agg(F.min(loaded).alias("first"), F.count_if(F.col(loaded).isNull()).alias("undated"))
    )
    dead = _dead(references, _live_spells(parent, fk.key, loaded, deleted))
    return dead.join(known, dead["value"] == known["known"], "left").select(
        "value",
        "at",
        F.when(F.col("known").isNull(), "missing")
        .when((F.col("undated") == 0) & (F.col("first") > F.col("at")), "late")
        .otherwise("deleted")
        .alias("reason"),
    )


def _order(fks: Sequence[ForeignKey]) -> tuple[list[ForeignKey], bool]:
    """Keys with the parents' own keys first; whether the graph has a cycle."""
    done: list[ForeignKey] = []
    left = list(fks)
    while left:
        ready = [k for k in left if not any(o.child == k.parent for o in left)]
        if not ready:
            return done + left, True
        done += ready
        left = [k for k in left if k not in ready]
    return done, False


def find_orphans(
    tables: Mapping[str, DataFrame],
    fks: Sequence[ForeignKey],
    loaded: str = "loaded_at",
    deleted: str = "deleted_at",
) -> DataFrame:
    """Orphans of every key: ``ref_table, ref_column, ref_value, ref_time, period, reason, kind``.

    ``kind`` is ``direct`` (reason ``missing``, ``late`` or ``deleted``) or
    ``inherited`` (reason ``inherited``).  One row per distinct value and time.
    """
    order, cyclic = _order(fks)
    references = {k: _references(tables[k.child], k) for k in order}
    direct = {k: _direct(references[k], tables[k.parent], k, loaded, deleted) for k in order}
    inherited: dict[ForeignKey, DataFrame | None] = dict.fromkeys(order)

    def sound(table: str) -> DataFrame | None:
        """The table without its orphan rows; None if it has no keys of its own."""
        rows, own = tables[table], [k for k in order if k.child == table]
        for k in own:
            bad = direct[k].select("value", "at")
            if inherited[k] is not None:
                bad = bad.unionByName(inherited[k].select("value", "at"))
            bad = bad.distinct()
            rows = rows.join(bad, (rows[k.column] == bad["value"]) & (rows[k.time] == bad["at"]), "left_anti")
        return rows if own else None

    def sweep() -> None:
        for k in order:
            rows = sound(k.parent)
            if rows is None:
                continue
            unsound = _dead(references[k], _live_spells(rows, k.key, loaded, deleted))
            own = direct[k].select(F.col("value").alias("v"), F.col("at").alias("t"))
            inherited[k] = unsound.join(
                own, (unsound["value"] == own["v"]) & (unsound["at"] == own["t"]), "left_anti"
            ).select("value", "at")

    sweep()
    if cyclic:
        found = -1
        while True:
            for k in order:
                if inherited[k] is not None:
                    inherited[k] = checkpoint(inherited[k])
            now = sum(f.count() for f in inherited.values() if f is not None)
            if now == found:
                break
            found = now
            sweep()

    parts = []
    for k in order:
        for kind, frame in (("direct", direct[k]), ("inherited", inherited[k])):
            if frame is not None:
                parts.append(
                    frame.select(
                        F.lit(k.child).alias("ref_table"),
                        F.lit(k.column).alias("ref_column"),
                        F.col("value").cast("string").alias("ref_value"),
                        F.col("at").alias("ref_time"),
                        F.date_format("at", "yyyy-MM").alias("period"),
                        (F.col("reason") if kind == "direct" else F.lit("inherited")).alias("reason"),
                        F.lit(kind).alias("kind"),
                    )
                )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct orphaned values per table, column and month, direct against inherited."""
    return orphans.groupBy("ref_table", "ref_column", "period").agg(
        F.countDistinct(F.when(F.col("kind") == "direct", F.struct("ref_value", "ref_time"))).alias("direct_refs"),
        F.countDistinct(F.when(F.col("kind") == "inherited", F.struct("ref_value", "ref_time"))).alias("inherited_refs"),
        F.count_if(F.col("reason") == "missing").alias("missing_refs"),
        F.count_if(F.col("reason") == "late").alias("late_refs"),
        F.count_if(F.col("reason") == "deleted").alias("deleted_refs"),
    )
