"""JSON documents as text columns: paths, containment, changes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def get(doc: Column, *path: str | int) -> Column:
    """The value at a path as text; JSON null and missing are null."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(doc, "$" + steps)


def typed(doc: Column, field: str) -> tuple[Column, Column, Column]:
    """Of a top-level field: 0 missing or null, 1 number, 2 other, 3 text; its number; its text."""
    value = F.try_variant_get(F.try_parse_json(doc), f"$['{field}']", "variant")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    number = F.try_variant_get(value, "$", "double")
    rank = F.when(kind == "VOID", 0).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), 1).when(kind == "STRING", 3).otherwise(2)
    return rank, F.when(rank == 1, number), get(doc, field)


def find(docs: DataFrame, doc: str, where: dict[str, object] | None = None, order: list[tuple[str, bool]] = (), fields: list[str] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Documents whose top-level fields equal `where`, ordered by fields (name, descending), cut and
    projected. Types count: 1 and "1" differ, numbers sort as numbers and before other values, missing ones first."""
    j = F.col(doc)
    for k, v in (where or {}).items():
        kind, number, value = typed(j, k)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            docs = docs.filter((kind == 1) & (number == float(v)))
        else:
            docs = docs.filter((kind == (3 if isinstance(v, str) else 2)) & (value == (str(v).lower() if isinstance(v, bool) else str(v))))
    if order:
        docs = docs.orderBy(*[c.desc() if desc else c.asc() for k, desc in order for c in typed(j, k)])
    docs = docs.offset(skip) if skip else docs
    docs = docs.limit(limit) if limit is not None else docs
    return docs.select(*[get(j, f).alias(f) for f in fields]) if fields else docs


def contained(needle: object, doc: object) -> bool:
    """Objects: every field of the needle is in the document; arrays: every element; else equality."""
    if isinstance(needle, dict):
        return isinstance(doc, dict) and all(k in doc and contained(v, doc[k]) for k, v in needle.items())
    if isinstance(needle, list):
        return isinstance(doc, list) and all(any(contained(v, d) for d in doc) for v in needle)
    return type(needle) is type(doc) and needle == doc


def compiled(doc: Column, needle: object, path: tuple = ()) -> Column | None:
    """Containment of an object of objects and strings as path comparisons; None if it needs more."""
    if isinstance(needle, dict):
        parts = [compiled(doc, v, (*path, k)) for k, v in needle.items()]
        if any(p is None for p in parts):
            return None
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out
    return get(doc, *path) == needle if isinstance(needle, str) and path else None


@F.pandas_udf(BooleanType())
def json_contains(doc: pd.Series, needle: pd.Series) -> pd.Series:
    """doc @> needle of two JSON texts; null where one is null or no JSON."""

    def one(d: str | None, n: str | None) -> bool | None:
        try:
            return None if d is None or n is None else contained(json.loads(n), json.loads(d))
        except ValueError:
            return None

    return pd.Series([one(d, n) for d, n in zip(doc, needle)], dtype="boolean")


def contains(doc: Column, needle: object) -> Column:
    """doc @> needle. Strings compile to path lookups that prefilter; the exact test tells a string from a number of its text."""
    text = json.dumps(needle)

    def run(docs: pd.Series) -> pd.Series:
        want = json.loads(text)
        return docs.map(lambda d: None if d is None else contained(want, json.loads(d))).astype("boolean")

    exact = F.pandas_udf(run, "boolean")(doc)
    fast = compiled(doc, needle)
    return exact if fast is None else F.when(fast, exact).otherwise(F.when(doc.isNotNull(), F.lit(False)))


def _edit(f) -> object:  # noqa: ANN001
    return F.pandas_udf(lambda s: s.map(lambda d: None if d is None else f(json.loads(d))), "string")


def set_path(doc: Column, path: list[str], value: object) -> Column:
    """The document with `value` at the path; objects on the way are made."""

    def f(d: object) -> str:
        at = d
        for p in path[:-1]:
            at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
        if isinstance(at, list):
            at[int(path[-1])] = value
        else:
            at[path[-1]] = value
        return json.dumps(d, separators=(",", ":"), ensure_ascii=False)

    return _edit(f)(doc)


def strip_nulls(doc: Column) -> Column:
    def clean(d: object) -> object:
        if isinstance(d, dict):
            return {k: clean(v) for k, v in d.items() if v is not None}
        return [clean(v) for v in d] if isinstance(d, list) else d

    return _edit(lambda d: json.dumps(clean(d), separators=(",", ":"), ensure_ascii=False))(doc)


def pretty(doc: Column) -> Column:
    return _edit(lambda d: json.dumps(d, indent=2, ensure_ascii=False))(doc)


def path_index(docs: DataFrame, doc_id: str, doc: str) -> DataFrame:
    """(path, value, id) of top-level scalar fields, the inverted form of containment."""
    keys = docs.select(F.col(doc_id).alias("id"), F.col(doc).alias("d"), F.explode(F.json_object_keys(doc)).alias("path"))
    return keys.select("path", F.expr("get_json_object(d, concat('$.', path))").alias("value"), "id").dropna()
