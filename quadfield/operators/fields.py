"""Derived fields, definition sets, and aggregates over fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.functions import ieee
from quadfield.functions.expressions import FieldExpr, as_expr
from quadfield.operators.layout import field_names, keys_of, nodes_in_window, to_nodes, with_metric

#: names of the calculator that no field may take (fixed values)
RESERVED = set(ieee.UNARY) | set(ieee.BINARY) | {"dx", "dy", "pi", "e", "x", "y"}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class DefinitionError(ValueError):
    """A bad name, an unknown field, or a circular definition."""


class Definitions:
    """Ordered derived fields, shared by every step of a case.

    ``stored`` are the fields of the data.  Each change is checked on the spot;
    ``apply`` adds all of them to a DataFrame in element layout.
    """

    def __init__(self, stored):
        self.stored = list(stored)
        self._defs: dict[str, FieldExpr] = {}

    def __iter__(self):
        return iter(self._defs)

    def __contains__(self, name):
        return name in self._defs

    def available(self) -> list[str]:
        return self.stored + list(self._defs)

    def _uses(self, name: str) -> set[str]:
        expr = self._defs.get(name)
        return set() if expr is None else expr.names() & set(self._defs)

    def define(self, name: str, expr) -> str:
        name = (name or "").strip()
        if not _IDENTIFIER.fullmatch(name):
            raise DefinitionError(f"a field can't be named {name!r}")
        if name in RESERVED:
            raise DefinitionError(f"{name!r} has a fixed meaning in expressions")
        if name in self.stored:
            raise DefinitionError(f"the case stores {name!r} already")
        expr = as_expr(expr)
        known = set(self.stored) | set(self._defs) | {name, "x", "y", "rx", "ry", "sx", "sy"}
        unknown = sorted(expr.names() - known)
        if unknown:
            raise DefinitionError(f"nothing is named {', '.join(unknown)}")
        before = self._defs.get(name)
        self._defs[name] = expr
        try:
            self.levels()
        except DefinitionError:
            if before is None:
                del self._defs[name]
            else:
                self._defs[name] = before
            raise
        return name

    def undefine(self, name: str) -> None:
        if name not in self._defs:
            raise KeyError(name)
        users = [k for k in self._defs if k != name and name in self._uses(k)]
        if users:
            raise DefinitionError(f"{name!r} is used by {', '.join(users)}")
        del self._defs[name]

    def levels(self) -> list[list[str]]:
        """Definitions grouped so that each group only needs the ones before it."""
        done: set[str] = set()
        out = []
        while len(done) < len(self._defs):
            ready = [k for k in self._defs if k not in done and self._uses(k) <= done]
            if not ready:
                raise DefinitionError("circular definition: " + ", ".join(k for k in self._defs if k not in done))
            out.append(ready)
            done |= set(ready)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        needed = set().union(*(e.names() for e in self._defs.values())) if self._defs else set()
        if needed & {"rx", "ry", "sx", "sy"} - set(df.columns):
            df = with_metric(df)
        for level in self.levels():
            df = df.withColumns({k: self._defs[k].array_column() for k in level})
        return df


def with_fields(df: DataFrame, definitions: dict) -> DataFrame:
    """Add derived fields, ``{name: expression}``; definitions may use each other in any order."""
    # forward references are legal here, so all names are known before checking
    defs = Definitions(field_names(df))
    pending = {k: as_expr(v) for k, v in definitions.items()}
    while pending:
        ready = [k for k, e in pending.items() if not (e.names() & set(pending)) - {k}]
        for k in ready or list(pending)[:1]:
            if not ready:
                raise DefinitionError("circular definition: " + ", ".join(pending))
            defs.define(k, pending.pop(k))
    return defs.apply(df)


def select_field(df: DataFrame, name_or_expr) -> Column:
    """A stored or derived field, a coordinate, or an expression as an array Column."""
    if isinstance(name_or_expr, str) and name_or_expr not in field_names(df) and name_or_expr not in ("x", "y"):
        raise KeyError(f"no field {name_or_expr!r} among {field_names(df)}")
    return as_expr(name_or_expr).array_column()


def add_field(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Attach an array column from another table; each array must match the mesh row.

    An array of another length, or an element without values, fails the job.
    """
    on = keys_of(values, ("case", "step", "elem"))
    out = df.join(values.select(*on, F.col(name).alias("_new")), on, "left")
    fits = F.coalesce(F.size("_new") == F.size("x"), F.lit(False))
    checked = F.when(fits, F.col("_new")).otherwise(F.raise_error(F.lit(f"field {name!r} does not have the shape of the mesh")).cast("array<double>"))
    return out.withColumn(name, checked).drop("_new")


def domain_bounds(mesh: DataFrame) -> DataFrame:
    """``xmin xmax ymin ymax`` of the nodes per case, without exploding them."""
    return mesh.groupBy(*keys_of(mesh, ("case",))).agg(
        F.min(F.array_min("x")).alias("xmin"), F.max(F.array_max("x")).alias("xmax"),
        F.min(F.array_min("y")).alias("ymin"), F.max(F.array_max("y")).alias("ymax"),
    )


def _finite(name: str) -> Column:
    return F.filter(name, lambda v: ieee.is_finite(v))


def finite_ends(name: str) -> tuple[Column, Column]:
    """Smallest and largest finite value of an element's array; NULL if there is none."""
    # one bad node is rare: the filtered array is only built for elements that need it
    clean = F.when(F.exists(name, lambda v: ~ieee.is_finite(v)), _finite(name)).otherwise(F.col(name))
    return F.array_min(clean), F.array_max(clean)


def field_range(df: DataFrame, names: list[str]) -> DataFrame:
    """Finite minimum and maximum per field and (case, step); (0, 1) when nothing is finite."""
    keys = keys_of(df)
    per = []
    for c in names:
        lo, hi = finite_ends(c)
        per += [lo.alias(f"_lo_{c}"), hi.alias(f"_hi_{c}")]
    wide = df.select(*keys, *per).groupBy(*keys).agg(*[f(F.col(f"{p}{c}")).alias(f"{p}{c}") for c in names for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"_lo_{c}"), F.lit(0.0)).alias("lo"), F.coalesce(F.col(f"_hi_{c}"), F.lit(1.0)).alias("hi")) for c in names])
    return wide.select(*keys, F.inline(rows))


def view_range(df: DataFrame, name: str, xlim, ylim, symmetric: bool = False) -> DataFrame:
    """Colour range and node count of a field inside a window.

    ``symmetric`` gives ``+-max(|lo|, |hi|)``; equal ends are widened by 0.5.  No row
    for a (case, step) without nodes in the window.
    """
    keys = keys_of(df)
    inside = nodes_in_window(to_nodes(df.select(*keys, "x", "y", name), ["x", "y", name]), name, xlim, ylim)
    out = inside.groupBy(*keys).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(F.lit(1)).alias("nodes")).where("nodes > 0")
    if symmetric:
        peak = F.greatest(F.abs("lo"), F.abs("hi"))
        out = out.withColumns({"lo": -peak, "hi": peak})
    flat = F.col("lo") == F.col("hi")
    return out.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})


def jacobian_sign(jac="jac") -> Column:
    """-1 where the mean Jacobian of the element is negative, else +1."""
    total = F.aggregate(jac, F.lit(0.0), lambda a, v: a + v)
    return F.when(total < 0, F.lit(-1)).otherwise(F.lit(1))
