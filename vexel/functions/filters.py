"""Metadata filters: JSON predicates compiled to one Column on the driver.

Three dialects. full: $and, $or, $in, $gt, $gte, $lt, $lte and equality over dotted paths. equality: top-level keys, all
of which must equal; operators are literals there. simple: strings and at most one comparison (eq ne gt gte lt lte) a field.

Fields come from a VARIANT column, or, where a field is given as a typed column, from that one, so that Parquet can skip
by it. Over VARIANT, values are equal if they are of one kind and equal: 1 isn't 1.0, "1" isn't 1, null is null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that isn't of its dialect."""


RANGES = {"$gte": lambda a, b: a >= b, "$gt": lambda a, b: a > b, "$lte": lambda a, b: a <= b, "$lt": lambda a, b: a < b}


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class VariantField:
    """A value in a VARIANT column."""

    def __init__(self, value: Column):
        self.value = value

    @classmethod
    def at(cls, column: Column, path: str) -> VariantField:
        keys = "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path.split("."))
        return cls(F.try_variant_get(column, "$" + keys, "variant"))

    def kind(self) -> Column:
        return F.schema_of_variant(self.value)

    def cast(self, to: str) -> Column:
        return F.try_variant_get(self.value, "$", to)

    def is_array(self) -> Column:
        return self.kind().startswith("ARRAY")

    def is_float(self) -> Column:
        return self.kind().startswith("DECIMAL") | self.kind().isin("DOUBLE", "FLOAT")

    def same(self, x: Any) -> Column:
        """JSON equality, without array membership."""
        kind = self.kind()
        if x is None:
            out = F.is_variant_null(self.value)
        elif isinstance(x, bool):
            out = (kind == "BOOLEAN") & (self.cast("boolean") == F.lit(x))
        elif isinstance(x, int):
            out = (kind == "BIGINT") & (self.cast("bigint") == F.lit(x))
        elif isinstance(x, float):
            out = self.is_float() & (self.cast("double") == F.lit(x))
        elif isinstance(x, str):
            out = (kind == "STRING") & (self.cast("string") == F.lit(x))
        elif isinstance(x, list):
            items = self.cast("array<variant>")
            out = self.is_array() & (F.size(items) == len(x))
            for i, y in enumerate(x):
                out = out & VariantField(F.get(items, F.lit(i))).same(y)
        else:
            out = kind.startswith("OBJECT") & (F.size(F.json_object_keys(F.to_json(self.value))) == len(x))
            for k, y in x.items():
                key = "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
                out = out & VariantField(F.try_variant_get(self.value, "$" + key, "variant")).same(y)
        return F.coalesce(out, no())

    def equals(self, x: Any) -> Column:
        member = F.exists(self.cast("array<variant>"), lambda v: VariantField(v).same(x))
        return F.coalesce(F.when(self.is_array(), member).otherwise(self.same(x)), no())

    def bound(self, x: float) -> Column:
        return F.lit(float(x))

    def number(self) -> Column:
        return F.when((self.kind() == "BIGINT") | self.is_float(), self.cast("double"))

    def text(self) -> Column:
        return F.when(self.kind() == "STRING", self.cast("string"))


class ColumnField:
    """A typed column: its type alone decides what can equal it. Comparisons reach the Parquet scan as they are."""

    def __init__(self, column: Column, kind: str):
        self.column, self.type = column, kind

    def same(self, x: Any) -> Column:
        fits = {"string": isinstance(x, str), "boolean": isinstance(x, bool), "bigint": isinstance(x, int) and not isinstance(x, bool), "int": isinstance(x, int) and not isinstance(x, bool), "double": isinstance(x, float), "float": isinstance(x, float)}
        return (self.column == F.lit(x)) if fits.get(self.type, False) else no()

    def equals(self, x: Any) -> Column:
        if self.type.startswith("array"):
            fits = {"array<string>": isinstance(x, str), "array<bigint>": is_number(x) and isinstance(x, int), "array<double>": isinstance(x, float)}
            return F.array_contains(self.column, x) if fits.get(self.type, False) else no()
        return self.same(x)

    def bound(self, x: float) -> Column:
        """Of the column's own type where it can be, since a cast around the column would keep it from the scan."""
        return F.lit(int(x)).cast(self.type) if self.type in ("bigint", "int") and abs(x) < 1 << 31 and x == int(x) else F.lit(float(x))

    def number(self) -> Column:
        return self.column if self.type in ("bigint", "int", "double", "float") else F.lit(None).cast("double")

    def text(self) -> Column:
        return self.column if self.type == "string" else F.lit(None).cast("string")


class Compiler:
    """metadata: the VARIANT column; typed: (column name, type) by path, for fields that have a column of their own."""

    def __init__(self, metadata: str = "metadata", typed: Mapping[str, tuple[str, str]] | None = None):
        self.metadata, self.typed = metadata, dict(typed or {})

    def field(self, path: str) -> VariantField | ColumnField:
        if path in self.typed:
            return ColumnField(F.col(self.typed[path][0]), self.typed[path][1])
        return VariantField.at(F.col(self.metadata), path)

    def full(self, f: Any) -> Column:
        if not isinstance(f, dict):
            raise FilterError("a filter is an object")
        for op, fold, empty in (("$and", lambda a, b: a & b, yes()), ("$or", lambda a, b: a | b, no())):
            if op in f:
                if not isinstance(f[op], list):
                    raise FilterError(f"{op} takes an array")
                return reduce(fold, [self.full(x) for x in f[op]], empty)
        for key in f:
            if key.startswith("$"):
                raise FilterError(f"unsupported operator {key}")
        return reduce(lambda a, b: a & b, [self._field(k, x) for k, x in f.items()], yes())

    def _field(self, path: str, x: Any) -> Column:
        field = self.field(path)
        if not isinstance(x, dict):
            return field.equals(x)
        if not x:
            raise FilterError(f"{path}: an empty object")
        if "$in" in x:
            if not isinstance(x["$in"], list):
                raise FilterError("$in takes an array")
            return reduce(lambda a, b: a | b, [field.same(y) for y in x["$in"]], no())
        for a, b in (("$gte", "$gt"), ("$lte", "$lt")):
            if a in x and b in x:
                raise FilterError(f"{path}: {a} and {b} together")
        bounds = {op: x[op] for op in RANGES if op in x and is_number(x[op])}
        if bounds:
            n = field.number()
            out = reduce(lambda a, b: a & b, [RANGES[op](n, field.bound(v)) for op, v in bounds.items()])
            # null fails a filter as false does; without coalesce() a typed column's bound reaches the scan
            return out if isinstance(field, ColumnField) else F.coalesce(out, no())
        unknown = [k for k in x if k.startswith("$") and k not in RANGES]
        if unknown:
            raise FilterError(f"unsupported operator {unknown[0]}")
        return field.equals(x)

    def equality(self, f: Any) -> Column:
        if not isinstance(f, dict):
            return no()
        return reduce(lambda a, b: a & b, [self.field(k).equals(x) for k, x in f.items()], yes())

    def simple(self, strings: Mapping[str, str] | None = None, numbers: Mapping[str, tuple[str, float]] | None = None) -> Column:
        out = yes()
        for k, x in (strings or {}).items():
            out = out & F.coalesce(self.field(k).text() == F.lit(x), no())
        ops = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
        for k, (op, x) in (numbers or {}).items():
            out = out & (F.coalesce(ops[op](self.field(k).number(), F.lit(float(x))), no()) if op in ops else no())
        return out


def compile_filter(f: Any, metadata: str = "metadata", dialect: str = "full", typed: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """f: a filter as Python data or as JSON text."""
    if isinstance(f, str):
        try:
            f = json.loads(f)
        except ValueError as e:
            raise FilterError(str(e)) from e
    compiler = Compiler(metadata, typed)
    if dialect not in ("full", "equality"):
        raise FilterError(f"unknown dialect {dialect}")
    return compiler.full(f) if dialect == "full" else compiler.equality(f)
