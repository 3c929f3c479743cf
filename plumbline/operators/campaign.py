"""Checks and tables of a campaign: settings, designs, caches and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from plumbline.operators.relational import positions


def require_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows, if they have all these columns; the missing ones are named in the error."""
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def flattened(rows: DataFrame, separator: str = "_") -> DataFrame:
    """rows with the fields of structs, at any depth, as columns named by their path; arrays and maps as JSON."""

    def walk(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in kind.fields:
            at = (*path, field.name)
            column = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(field.dataType, StructType):
                out += walk(field.dataType, at)
            else:
                out.append((F.to_json(column) if isinstance(field.dataType, (ArrayType, MapType)) else column).alias(separator.join(at)))
        return out

    return rows.select(*walk(rows.schema, ()))


#: Names of value types in a table of settings.
TYPES = {"string": "str", "boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float"}


def settings_rows(rows: DataFrame, key: Sequence[str], separator: str = "_") -> DataFrame:
    """key, parameter, value (text) and value_type of every setting of rows, nested ones by their path.

    A null is an empty text of type NoneType; times and other kinds are named as Spark names them.
    """
    flat = flattened(rows, separator)
    entries = []
    for field in flat.schema.fields:
        if field.name in key:
            continue
        column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        value = F.struct(F.lit(field.name).alias("parameter"), F.coalesce(column.cast("string"), F.lit("")).alias("value"), F.when(column.isNull(), "NoneType").otherwise(TYPES.get(kind, kind)).alias("value_type"))
        entries.append(value)
    return flat.select(*key, F.explode(F.array(*entries)).alias("e")).select(*key, "e.*")


def finite(rows: DataFrame) -> DataFrame:
    """rows with NaN and infinite numbers as nulls, inside arrays and structs too."""

    def clean(column: Column, kind) -> Column:
        if kind.simpleString() in ("double", "float"):
            return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        if isinstance(kind, ArrayType):
            return F.transform(column, lambda x: clean(x, kind.elementType))
        if isinstance(kind, StructType):
            whole = F.struct(*(clean(column[f.name], f.dataType).alias(f.name) for f in kind.fields))
            return F.when(column.isNotNull(), whole)
        return column

    return rows.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))


def json_lines(rows: DataFrame) -> DataFrame:
    """value: each row as JSON with its columns in the order of their names; what is not finite is null."""
    return finite(rows).select(F.to_json(F.struct(*(f"`{c}`" for c in sorted(rows.columns))), {"ignoreNullFields": "false"}).alias("value"))


def require_disjoint(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, if none of their keys is in the others."""
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    shared = rows.alias("a").join(others.select(*keys).alias("b"), match, "left_semi")
    if not shared.isEmpty():
        raise ValueError(f"{shared.count()} rows are in both tables")
    return rows


def require_causal(rows: DataFrame, flag: str) -> DataFrame:
    """rows, if none was chosen by what is known only afterwards; a row without the flag does not pass."""
    if flag not in rows.columns or not rows.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(True))).isEmpty():
        raise ValueError(f"rows were chosen with {flag}, or it is not known")
    return rows


def require_rows(rows: DataFrame, key: str, count: int) -> DataFrame:
    """The first ``count`` rows by key; an error if there are fewer."""
    first = rows.orderBy(key).limit(count)
    if first.count() < count:
        raise ValueError(f"there are fewer than {count} rows")
    return first


def as_flag(text: Column) -> Column:
    """A flag that was written as text: true, 1, yes (any case) or false, 0, no; null for anything else."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def settings_match(done: Mapping[str, Column], asked: Mapping[str, Column], whole: Sequence[str] = (), text: Sequence[str] = (), real: Sequence[str] = (), flags: Sequence[str] = (), tolerance: float = 1e-15) -> Column:
    """Whether a finished row has the settings that are asked for; anything that is missing counts as no.

    whole: equal numbers; text: equal but for case; real: within the tolerance; flags: equal when parsed.
    """
    parts = [done[n].cast("long") == asked[n].cast("long") for n in whole]
    parts += [F.lower(done[n]) == F.lower(asked[n]) for n in text]
    parts += [F.abs(done[n].cast("double") - asked[n].cast("double")) <= tolerance for n in real]
    parts += [as_flag(done[n]) == as_flag(asked[n]) for n in flags]
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def latest_valid(rows: DataFrame, group: Sequence[str], valid: Column, newest: Sequence[str]) -> DataFrame:
    """The newest row of each group that is valid, by partial aggregation."""
    others = [c for c in rows.columns if c not in group]
    picked = rows.filter(F.coalesce(valid, F.lit(False))).groupBy(*group).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("__row"))
    return picked.select(*group, *(F.col(f"__row.{c}").alias(c) for c in others))


def valid_records(records: DataFrame, key: str, profile: Column, converged: Column, fields: Sequence[str]) -> DataFrame:
    """Keys of records that can be taken from the cache: of this profile, converged, with all fields."""
    present = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in fields), F.lit(True))
    return records.filter(F.coalesce(profile & converged & present, F.lit(False))).select(key).distinct()


def table_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and digest (32 hex digits) of a table, the same for any order of its rows; repeated rows count."""
    half = lambda a: F.sum(F.conv(F.substring("__h", a, 12), 16, 10).cast("decimal(38,0)")) % F.lit(1 << 48)
    hashed = rows.select(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("__h"))
    parts = [F.lpad(F.lower(F.hex(F.coalesce(half(a), F.lit(0)).cast("long"))), 12, "0") for a in (1, 13)]
    return hashed.agg(F.count("*").alias("n"), F.concat(*parts).alias("digest"))


def require_frozen(rows: DataFrame, columns: Sequence[str], manifest: Mapping[str, object]) -> DataFrame:
    """rows, if the manifest says that the design is frozen and has their digest."""
    if manifest.get("frozen") is not True:
        raise ValueError("the design is not frozen")
    found = table_digest(rows, columns).first()
    if (found["n"], found["digest"]) != (manifest.get("n"), manifest.get("digest")):
        raise ValueError("the design is not the one that was frozen")
    return rows


def zipped(a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str], name: str) -> DataFrame:
    """Row i of a beside row i of b, in the order of their keys, with i as a column; different lengths are an error."""
    left, right = positions(a, a_keys, name, "zip-a"), positions(b, b_keys, name, "zip-b")
    if a.count() != b.count():
        raise ValueError("the tables have different lengths")
    return left.join(right, name)


def ranking_log(scored: DataFrame, score: str, key: str, keep: Sequence[str], name: str) -> DataFrame:
    """name (place from 1 by descending score, then key) and those columns of ``keep`` that there are."""
    ordered = scored.withColumn("__minus", -F.col(score))
    placed = positions(ordered, ["__minus", key], name, "ranking")
    return placed.select((F.col(name) + 1).alias(name), *(c for c in keep if c in scored.columns))
