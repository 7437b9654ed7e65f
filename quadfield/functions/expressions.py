"""Field expressions: Python objects that build Columns.

``field("u") ** 2 + field("v") ** 2`` or ``dx("v") - dy("u")`` describe a derived
field once; ``array_column()`` compiles it for the element layout and
``node_column()`` for the node layout.  In the element layout every maximal
pointwise part becomes one ``transform`` over the arrays (inside the JVM) and every
derivative one Arrow kernel call, with repeated derivatives folded into the kernel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadfield.functions import ieee, kernels


class FieldExpr:
    """Base of all expressions; arithmetic builds new expressions."""

    def names(self) -> set[str]:
        """Columns the expression refers to."""
        raise NotImplementedError

    def array_column(self) -> Column:
        raise NotImplementedError

    def node_column(self) -> Column:
        raise NotImplementedError

    def _inputs(self) -> list["FieldExpr"]:
        """Array-valued inputs of the pointwise part rooted here."""
        return [self]

    def _scalar(self, env: dict[int, Column]) -> Column:
        return env[id(self)]

    def __add__(self, o): return Pointwise(lambda a, b: a + b, self, o)
    def __radd__(self, o): return Pointwise(lambda a, b: a + b, o, self)
    def __sub__(self, o): return Pointwise(lambda a, b: a - b, self, o)
    def __rsub__(self, o): return Pointwise(lambda a, b: a - b, o, self)
    def __mul__(self, o): return Pointwise(lambda a, b: a * b, self, o)
    def __rmul__(self, o): return Pointwise(lambda a, b: a * b, o, self)
    def __truediv__(self, o): return Pointwise(ieee.div, self, o)
    def __rtruediv__(self, o): return Pointwise(ieee.div, o, self)
    def __pow__(self, o): return Pointwise(ieee.power, self, o)
    def __rpow__(self, o): return Pointwise(ieee.power, o, self)
    def __mod__(self, o): return Pointwise(ieee.mod, self, o)
    def __rmod__(self, o): return Pointwise(ieee.mod, o, self)
    def __neg__(self): return Pointwise(lambda a: -a, self)
    def __pos__(self): return self


class Name(FieldExpr):
    def __init__(self, name: str):
        self.name = name

    def names(self):
        return {self.name}

    def array_column(self):
        return F.col(self.name)

    def node_column(self):
        return F.col(self.name)


class Constant(FieldExpr):
    def __init__(self, value: float):
        if isinstance(value, (bool, str)) or not isinstance(value, (int, float)):
            raise ValueError(f"{value!r} is not a number")
        self.value = float(value)

    def names(self):
        return set()

    def array_column(self):
        return F.array_repeat(F.lit(self.value), F.size("x"))

    def node_column(self):
        return F.lit(self.value)

    def _inputs(self):
        return []

    def _scalar(self, env):
        return F.lit(self.value)


class Pointwise(FieldExpr):
    def __init__(self, fn, *args):
        self.fn = fn
        self.args = [as_expr(a) for a in args]

    def names(self):
        return set().union(*(a.names() for a in self.args))

    def _inputs(self):
        found: dict[int, FieldExpr] = {}
        for a in self.args:
            for leaf in a._inputs():
                found.setdefault(id(leaf), leaf)
        return list(found.values())

    def _scalar(self, env):
        return self.fn(*(a._scalar(env) for a in self.args))

    def array_column(self):
        leaves = self._inputs()
        if not leaves:
            return F.array_repeat(self._scalar({}), F.size("x"))
        # the same stored field used twice is one array
        columns, slot = [], {}
        by_name: dict[str, int] = {}
        for leaf in leaves:
            if isinstance(leaf, Name):
                k = by_name.setdefault(leaf.name, len(columns))
            else:
                k = len(columns)
            if k == len(columns):
                columns.append(leaf.array_column())
            slot[id(leaf)] = k

        # the arrays are arguments of the function, never captured by the lambda: a
        # captured derivative would put a Python kernel inside it
        point = lambda *cell: self._scalar({key: cell[k] for key, k in slot.items()})
        if len(columns) == 1:
            return F.transform(columns[0], lambda a: point(a))
        if len(columns) == 2:
            return F.zip_with(columns[0], columns[1], lambda a, b: point(a, b))
        zipped = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(columns)])
        return F.transform(zipped, lambda t: point(*[t[f"c{k}"] for k in range(len(columns))]))

    def node_column(self):
        return self._scalar({id(leaf): leaf.node_column() for leaf in self._inputs()})


class Derivative(FieldExpr):
    def __init__(self, direction: str, arg, order: int = 1):
        if isinstance(order, bool) or not isinstance(order, int) or order < 1:
            raise ValueError("the order of a derivative is a positive integer")
        self.direction, self.arg, self.order = direction, as_expr(arg), order

    def names(self):
        return self.arg.names() | ({"rx", "sx"} if self.direction == "x" else {"ry", "sy"})

    def array_column(self):
        if not self.arg._inputs():  # a constant
            return F.array_repeat(F.lit(0.0), F.size("x"))
        kernel = kernels.dx if self.direction == "x" else kernels.dy
        return kernel(self.arg.array_column(), self.order)

    def node_column(self):
        raise ValueError("a derivative needs the element layout; define it before going to nodes")


def as_expr(v) -> FieldExpr:
    """Strings are field names, numbers are constants."""
    if isinstance(v, FieldExpr):
        return v
    return Name(v) if isinstance(v, str) else Constant(v)


def field(name: str) -> FieldExpr:
    return Name(name)


def constant(value: float) -> FieldExpr:
    return Constant(value)


def dx(f, order: int = 1) -> FieldExpr:
    """``order``-th derivative along x."""
    return Derivative("x", f, order)


def dy(f, order: int = 1) -> FieldExpr:
    """``order``-th derivative along y."""
    return Derivative("y", f, order)


def call(function: str, *args) -> FieldExpr:
    """A calculator function by name: ``call("sqrt", f)``, ``call("atan2", "v", "u")``."""
    table, arity = (ieee.UNARY, 1) if function in ieee.UNARY else (ieee.BINARY, 2)
    if function not in table:
        raise ValueError(f"unknown function {function}()")
    if len(args) != arity:
        raise ValueError(f"{function}() takes {arity} argument{'s' if arity > 1 else ''}")
    return Pointwise(table[function], *args)


PI = Constant(math.pi)
EULER = Constant(math.e)
