"""Reads and writes of record tables: filtered pages, patches of nested fields, upserts, list edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find(df: DataFrame, where: Column | None = None, order: list[Column] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    out = df.where(where) if where is not None else df
    out = out.orderBy(*order) if order else out
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def page(df: DataFrame, where: Column, order: list[Column], skip: int, limit: int) -> DataFrame:
    """The page and, in `total`, how many rows there are in all: two reads, so no window gathers the table in one task."""
    return find(df, where, order, skip, limit).withColumn("total", F.lit(df.where(where).count()))


def flat_patch(patch: dict, prefix: str = "") -> dict[str, object]:
    """Dotted paths of a nested patch; lists are values."""
    out: dict[str, object] = {}
    for k, v in patch.items():
        out |= flat_patch(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def set_fields(df: DataFrame, values: dict[str, Column | None]) -> DataFrame:
    """Columns or dotted fields set to values; None empties a field."""
    for path, value in values.items():
        top, _, rest = path.partition(".")
        kind = df.select(path).schema[0].dataType
        value = F.lit(None).cast(kind) if value is None else value.cast(kind)
        df = df.withColumn(top, F.col(top).withField(rest, value) if rest else value)
    return df


def _merged(old: Column, new: Column | None, kind: T.StructType, patch: T.StructType | None, off, prefix: str) -> Column:
    """One struct after another, field by field. Fields that the patch doesn't have stay as they are, but for what is unset."""
    out = []
    for f in kind:
        path, own, inner = f"{prefix}{f.name}", old[f.name], None
        theirs = patch[f.name] if patch is not None and f.name in patch.names else None
        if isinstance(f.dataType, T.StructType):
            inner = theirs.dataType if theirs is not None else None
            if theirs is not None and not isinstance(inner, T.StructType):
                raise ValueError(f"{path} is a struct")
            value = _merged(own, new[f.name] if theirs is not None else None, f.dataType, inner, off, f"{path}.")
        else:
            value = F.coalesce(new[f.name].cast(f.dataType), own) if theirs is not None else own
        out.append(F.when(~off(path), value).alias(f.name))
    if patch is not None and (more := [n for n in patch.names if n not in kind.names]):
        raise ValueError(f"{prefix}{more[0]} is no field of the table")
    some = old.isNotNull() | (new.isNotNull() if new is not None else F.lit(False))
    return F.when(some, F.struct(*out))


def merge_patch(df: DataFrame, patch: DataFrame, key: str, unset: str | None = None) -> DataFrame:
    """Rows of df with what the patch row of their key says, down to the fields of structs; the patch has one row a key.

    A field has three ways to be in a patch: one that isn't there, in the patch's schema or by a null, leaves the value alone; a value takes its place (lists as a whole); and a path in the list
    column `unset` (such as "place.city", or a whole struct) empties it, whatever else the patch says of it. A field that df doesn't have is an error."""
    fields = [c for c in patch.columns if c not in (key, unset)]
    p = patch.select(key, *(F.col(c).alias(f"__{c}") for c in fields), *([F.col(unset).alias("__unset")] if unset else []))
    off = (lambda c: F.coalesce(F.array_contains("__unset", c), F.lit(False))) if unset else (lambda c: F.lit(False))
    if more := [c for c in fields if c not in df.columns]:
        raise ValueError(f"{more[0]} is no field of the table")
    out = []
    for c in df.columns:
        kind, theirs = df.schema[c].dataType, patch.schema[c].dataType if c in fields else None
        new = F.col(f"__{c}") if c in fields else None
        if c == key:
            out.append(F.col(c))
        elif isinstance(kind, T.StructType) and (unset or theirs is not None):
            out.append(F.when(~off(c), _merged(F.col(c), new, kind, theirs, off, f"{c}.")).alias(c))
        else:
            out.append(F.when(~off(c), F.coalesce(new, F.col(c)) if new is not None else F.col(c)).alias(c) if unset or new is not None else F.col(c))
    return df.join(p, key, "left").select(*out)


def upsert(df: DataFrame, rows: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """rows replace those of their key, other rows stay, new ones come. One shuffle by key. Of rows that have the same key the last by seq counts, the largest as a whole without it; their
    columns have to be comparable then."""
    whole = F.struct(*df.columns)
    new = rows.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("__seq"), whole.alias("new")) if seq else F.struct(whole.alias("new"))).alias("__x")).select(key, "__x.new")
    old = df.select(F.struct(*df.columns).alias("old"), F.col(key))
    both = old.join(new, key, "full_outer")
    return both.select(F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("row")).select("row.*")


def retire_except(df: DataFrame, keep: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag goes down in rows whose key isn't in keep."""
    marked = keep.select(key).distinct().withColumn("__kept", F.lit(True))
    return df.join(marked, key, "left").select(*(F.when(F.col("__kept"), F.col(flag)).otherwise(F.lit(False)).alias(flag) if c == flag else F.col(c) for c in df.columns))


def append_to(items: str, *rows: Column) -> Column:
    kind = F.coalesce(F.col(items), F.array())
    return F.concat(kind, F.array(*rows))


def update_element(items: str, key: str, value: object, **changes: Column) -> Column:
    """The list with fields of the elements of this key changed."""

    def change(x: Column) -> Column:
        out = x
        for k, v in changes.items():
            out = out.withField(k, v)
        return F.when(x[key] == value, out).otherwise(x)

    return F.transform(items, change)


def add_once(items: Column, item: Column, *keys: str) -> Column:
    """The list with the item at its end unless it has one with these fields equal."""
    same = lambda x: F.forall(F.array(*(x[k].eqNullSafe(item[k]) for k in keys)), lambda b: b)
    return F.when(F.exists(items, same), items).otherwise(F.concat(items, F.array(item)))


def empty_like(df: DataFrame) -> DataFrame:
    """What stays when all is deleted."""
    return df.limit(0)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, cast; missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
