"""Defaults, clamps, JSON and other value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def or_default(c: Column, default) -> Column:
    """The default where the value is null, empty or zero."""
    empty = F.lit(0) if isinstance(default, int) else F.lit("")
    return F.coalesce(F.nullif(c, empty), F.lit(default))


def if_null(c: Column, default) -> Column:
    """The default only where the value is null."""
    return F.coalesce(c, F.lit(default))


def clamp_workload(low: Column, high: Column, edited: str) -> tuple[Column, Column]:
    """Keeps low <= high by moving the bound that wasn't edited ("low" or "high" was)."""
    return (low, F.greatest(low, high)) if edited == "low" else (F.least(low, high), high)


def map_text(c: Column) -> Column:
    """``KEY: value`` pairs, keys in upper case and sorted."""
    pairs = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.upper(e["key"]), F.lit(": "), e["value"])), ", ")


def merged(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins. Nulls are empty maps."""
    empty = F.create_map().cast("map<string,string>")
    l, r = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(l, lambda k, _: ~F.array_contains(F.map_keys(r), k)), r)


def parsed_or(c: Column, schema: str | DataType, fallback: Column) -> Column:
    """JSON text by schema; text that isn't JSON, and null, give ``fallback``."""
    return F.when(F.try_parse_json(c).isNull(), fallback).otherwise(F.from_json(c, schema))


def json_list(c: Column, element: str = "string") -> Column:
    """A stored list; absent or broken values are the empty list."""
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


REPLY = "struct<matches:array<struct<title:string,organization:string,url:string,score:int,reason:string,highlights:array<string>,concerns:array<string>,pensum:string,location:string,languages:string,salary_hint:string,deadline:string>>,summary:string,tips:string>"


def reply(c: Column) -> Column:
    """A model's reply; one that isn't JSON is all summary."""
    none = F.from_json(F.lit("[]"), REPLY[len("struct<matches:") : REPLY.index(",summary:")])
    return parsed_or(c, REPLY, F.struct(none.alias("matches"), c.alias("summary"), F.lit("").alias("tips")))


def projected(c: Column, *fields: str) -> Column:
    """An array of structs with only these fields."""
    return F.transform(c, lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def form_record(choices: dict[str, Column], texts: dict[str, Column], languages: Column) -> Column:
    """A form as one struct: texts are trimmed, languages without a level dropped."""
    parts = [v.alias(k) for k, v in choices.items()] + [F.trim(v).alias(k) for k, v in texts.items()]
    return F.struct(*parts, F.map_filter(languages, lambda _, v: v != "").alias("languages"))


def toggled(selected: Column, item: Column, clear: str = "alle") -> Column:
    """The selection after a click on an item; the item that means all clears it."""
    kept = F.when(F.array_contains(selected, item), F.array_remove(selected, item)).otherwise(F.array_append(selected, item))
    return F.when(item == clear, F.array().cast("array<string>")).otherwise(kept)


def exclusive(selected: Column, everything: str = "*") -> Column:
    """A selection in which the item for everything stands alone."""
    return F.when(F.array_contains(selected, everything), F.array(F.lit(everything))).otherwise(selected)


def without_position(c: Column, index: Column) -> Column:
    return F.filter(c, lambda _, i: i != index)


def at_position(c: Column, index: Column) -> Column:
    """Counted from 0; null where there is no such element."""
    return F.get(c, index)
