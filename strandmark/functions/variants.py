"""JSON without a fixed schema, as variants: parsed once, asked by path, expanded by the schema that its rows turn out to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def parsed(c: Column) -> Column:
    """Text as a variant; text that isn't JSON, and null, are null."""
    return F.try_parse_json(c)


def field(v: Column, path: str, kind: str) -> Column:
    """What stands at a path, as a type; null if it isn't there or can't be one. Objects and arrays as text are JSON."""
    return F.try_variant_get(v, path, kind)


def as_json(v: Column) -> Column:
    """The value as JSON text, keys of objects in alphabetical order."""
    return F.to_json(v)


def found_schema(df: DataFrame, column: str) -> StructType:
    """The fields that the objects of a column have, over all rows: one aggregate, of which a single row comes to the driver. A field whose
    values have no type in common stays a variant; values that aren't objects have no fields."""
    said = df.agg(F.schema_of_variant_agg(F.when(F.schema_of_variant(column).startswith("OBJECT"), F.col(column)))).first()[0]
    found = _parse_datatype_string(said.replace("OBJECT<", "STRUCT<")) if said and said.startswith("OBJECT<") else StructType()
    return found if isinstance(found, StructType) else StructType()


def expanded(df: DataFrame, column: str, schema: StructType | None = None) -> DataFrame:
    """The fields of a variant as columns, by ``schema`` or by the one that is found; further columns stay, and go before a field of their name. A
    field whose name has both kinds of quotes can't be reached by a path and stays in the variant."""
    schema = found_schema(df, column) if schema is None else schema
    there = {c.lower() for c in df.columns}
    reached = [f for f in schema if f.name.lower() not in there and not {"'", '"'} <= set(f.name)]
    at = lambda name: f"$[\"{name}\"]" if "'" in name else f"$['{name}']"
    return df.select("*", *(field(F.col(column), at(f.name), f.dataType.simpleString()).alias(f.name) for f in reached))
