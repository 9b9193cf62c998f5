"""Merging the state of several devices: sets, last write, upsert, replacement, toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from strandmark.functions.values import or_default


def merged_set(local: Column, remote: Column) -> Column:
    """Local entries, then remote ones not among them."""
    return F.array_union(F.coalesce(local, F.array().cast("array<string>")), F.coalesce(remote, F.array().cast("array<string>")))


def to_insert(merged: Column, remote: Column) -> Column:
    """What the remote side lacks."""
    return F.array_except(merged, F.coalesce(remote, F.array().cast("array<string>")))


def has_data(profile: str = "") -> Column:
    """A profile counts as filled with a time and an education, field or experience; regions alone don't count."""
    at = lambda c: F.coalesce(F.col(f"{profile}.{c}" if profile else c), F.lit(""))
    updated = F.col(f"{profile}.updated_at" if profile else "updated_at")
    return updated.isNotNull() & ((at("education") != "") | (at("field_of_study") != "") | (at("experience") != ""))


def is_filled(education: Column, field: Column, experience: Column, regions: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return filled(education) | filled(field) | filled(experience) | (F.coalesce(F.size(regions), F.lit(0)) > 0)


def newer_profile(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """The newer of two filled profiles, the remote one if they are equally old; the filled one if only one is."""
    sided = local.withColumn("_remote", F.lit(False)).unionByName(remote.withColumn("_remote", F.lit(True))).filter(has_data())
    others = [c for c in local.columns if c != key]
    best = sided.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("updated_at", "_remote")).alias("_p"))
    return best.select(key, *(F.col(f"_p.{c}").alias(c) for c in others))


def latest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key. An aggregate, so that tasks combine before the shuffle."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rows.columns if c not in keys))


def _orderable(t: DataType) -> bool:
    if isinstance(t, (MapType, VariantType)):
        return False
    if isinstance(t, ArrayType):
        return _orderable(t.elementType)
    return not isinstance(t, StructType) or all(_orderable(f.dataType) for f in t.fields)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old``; columns that ``new`` lacks keep their old values.

    Of several writes to one key the last by ``order`` counts; columns of ``order`` that ``old`` lacks only decide. Without ``order`` the
    greatest row counts, maps and variants by their JSON.
    """
    if len(new.columns) > 1:
        others = [f for f in new.schema if f.name != key]
        new = latest(new, [key], order or [f.name if _orderable(f.dataType) else F.to_json(F.struct(f.name)) for f in others])
    else:
        new = new.distinct()
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c != key:
            pick.append((F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c))
    return joined.select(*pick)


def with_log(stored: DataFrame, log: DataFrame, keys: list[str], order: list[str], removal: str) -> DataFrame:
    """Stored values as a log of writes and removals leaves them: the last entry of each key by ``order`` counts, and a removal takes the
    key away, stored or not. Rows have the columns of ``stored``; keys that the log doesn't name stay as they are."""
    last = latest(log, keys, order)
    kept = stored.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(~F.coalesce(F.col(removal), F.lit(False))).select([F.col(f"`{c}`") for c in stored.columns]))


def replace_set(stored: DataFrame, sent: DataFrame, user: str, senders: DataFrame | None = None) -> DataFrame:
    """Users who sent a set have just that set; the others keep theirs. ``senders`` also names users whose set is empty now."""
    touched = sent.select(user) if senders is None else sent.select(user).union(senders.select(user))
    return stored.join(touched.distinct(), user, "left_anti").unionByName(sent)


def delete_by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.coalesce(F.col(key) != F.lit(value), F.lit(True)))


def bulk_rows(sets: DataFrame, user: str, items: str, name: str) -> DataFrame:
    """One row for each entry of an array."""
    return sets.select(user, F.explode(items).alias(name))


def profile_row(local: DataFrame, now: Column) -> DataFrame:
    """What is sent to the profile table: empty and zero values become the defaults, a profile without a time gets ``now``."""
    texts = ("education", "field_of_study", "experience", "keywords", "exclusions_freetext", "start_date")
    none = F.array().cast("array<string>")
    changes = {c: F.nullif(F.col(c), F.lit("")) for c in texts if c in local.columns}
    changes |= {c: F.coalesce(F.col(c), none) for c in ("desired_regions", "exclusions") if c in local.columns}
    if "languages" in local.columns:
        changes["languages"] = F.coalesce(F.col("languages"), F.create_map().cast("map<string,string>"))
    if "updated_at" in local.columns:
        changes["updated_at"] = F.coalesce(F.col("updated_at"), now)
    return local.withColumns(changes | {"workload_min": or_default(F.col("workload_min"), 50), "workload_max": or_default(F.col("workload_max"), 100)})


def toggle_state(clicks: DataFrame, user: str, item: str, order: list[str], clear: str = "alle") -> DataFrame:
    """Items that are on after all clicks: an odd number of clicks since the last one on ``clear``.

    Two aggregates and a join by user; no user's clicks are gathered.
    """
    at = F.struct(*order)
    cleared = clicks.filter(F.col(item) == clear).groupBy(user).agg(F.max(at).alias("_cleared"))
    since = clicks.filter(F.col(item) != clear).withColumn("_at", at).join(cleared, user, "left").filter(F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared")))
    return since.groupBy(user, item).agg(F.count("*").alias("_n")).filter(F.col("_n") % 2 == 1).drop("_n")


def first_k(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first rows of each key, numbered from 1; the window keeps ``k`` rows a key before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n", n).filter(F.col("n") <= k)


def reset(profiles: DataFrame, users: DataFrame, key: str = "id") -> DataFrame:
    """Profiles of these users lose all entries and get the default workload; the others stay."""
    marked = profiles.join(users.select(F.col(key), F.lit(True).alias("_reset")).distinct(), key, "left")
    defaults = {"workload_min": F.lit(50), "workload_max": F.lit(100)}
    kept = lambda f: F.when(F.col("_reset"), defaults.get(f.name, F.lit(None)).cast(f.dataType)).otherwise(F.col(f.name))
    return marked.select(*(F.col(key) if f.name == key else kept(f).alias(f.name) for f in profiles.schema))
