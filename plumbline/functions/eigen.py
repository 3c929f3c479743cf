"""Eigenpairs of symmetric 3x3 matrices as columns, in generated code.

Eigenvalues come from the trigonometric form. The eigenvector of the eigenvalue that is furthest from the others is
the largest cross product of two rows; the others are found in the plane across it, so that nearly equal eigenvalues
still give orthogonal vectors. Equal eigenvalues give some orthogonal vectors; a multiple of the identity gives the
axes. Each step is a projection of its own, so that no expression is written out twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACES = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(a: Sequence[Column], otherwise: Sequence[Column]) -> list[Column]:
    size = F.sqrt(_dot(a, a))
    return [F.when(size > 0, x / size).otherwise(o) for x, o in zip(a, otherwise, strict=True)]


def leading(a: Sequence[Column], least: float = 1e-14) -> list[Column]:
    """The vector as a unit vector whose largest component is positive (the first of equals); axis 1 if it has no length."""
    size = F.sqrt(_dot(a, a))
    x, y, z = (F.abs(c) for c in a)
    main = F.when((x >= y) & (x >= z), a[0]).when(y >= z, a[1]).otherwise(a[2])
    turned = F.when(main < 0, -size).otherwise(size)
    return [F.when(size > least, c / turned).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(a)]


def with_eigenpairs(rows: DataFrame, entries: Sequence[str], name: str) -> DataFrame:
    """rows with ``name``1..3, the eigenvalues from the largest on, and ``name``x1.. to ``name``z3, their unit vectors.

    entries: columns of m11, m12, m13, m22, m23 and m33. Null entries give nulls. The largest component of a vector
    is positive.
    """
    keep, t = rows.columns, "__eigen_"
    m = [[F.col(entries[_PLACES.index((min(i, j), max(i, j)))]).cast("double") for j in range(3)] for i in range(3)]
    c = lambda n: F.col(t + n)
    at = lambda df, values: df.withColumns({t + n: v for n, v in values.items()})
    vector = lambda n: [c(n + x) for x in "xyz"]
    named = lambda n, v: {n + x: e for x, e in zip("xyz", v, strict=True)}
    axis = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]

    rows = at(rows, {"q": (m[0][0] + m[1][1] + m[2][2]) / 3.0})
    own = [[m[i][j] - c("q") if i == j else m[i][j] for j in range(3)] for i in range(3)]
    rows = at(rows, {"p": F.sqrt(sum((own[i][j] * own[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / 6.0)})
    #: Rounding alone makes a matrix differ from a multiple of the identity by so much.
    flat = c("p") <= 1e-15 * F.abs(c("q"))
    turn = F.when(flat, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(own[0], _cross(own[1], own[2])) / (2.0 * c("p") * c("p") * c("p")))))
    rows = at(rows, {"r": turn})
    angle = F.acos(c("r")) / 3.0
    rows = at(rows, {"l1": c("q") + 2.0 * c("p") * F.cos(angle), "l3": c("q") + 2.0 * c("p") * F.cos(angle + 2.0 * math.pi / 3.0)})
    rows = at(rows, {"l2": 3.0 * c("q") - c("l1") - c("l3"), "far": F.when(c("r") >= 0, c("l1")).otherwise(c("l3"))})
    less = [[m[i][j] - c("far") if i == j else m[i][j] for j in range(3)] for i in range(3)]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        rows = at(rows, named(f"c{k}", _cross(less[i], less[j])))
    sizes = [_dot(vector(f"c{k}"), vector(f"c{k}")) for k in range(3)]
    best = [F.when((sizes[0] >= sizes[1]) & (sizes[0] >= sizes[2]), c(f"c0{x}")).when(sizes[1] >= sizes[2], c(f"c1{x}")).otherwise(c(f"c2{x}")) for x in "xyz"]
    rows = at(rows, named("b", best))
    rows = at(rows, named("w", _unit(vector("b"), axis)))
    w = vector("w")
    side = [F.when(F.abs(w[0]) > F.abs(w[1]), e).otherwise(o) for e, o in zip([-w[2], F.lit(0.0), w[0]], [F.lit(0.0), w[2], -w[1]], strict=True)]
    rows = at(rows, named("s", side))
    rows = at(rows, named("u", _unit(vector("s"), axis)))
    rows = at(rows, named("v", _cross(w, vector("u"))))
    u, v = vector("u"), vector("v")
    through = lambda a, b: _dot(a, [_dot(m[i], b) for i in range(3)])
    rows = at(rows, {"uu": through(u, u) - c("l2"), "uv": through(u, v), "vv": through(v, v) - c("l2")})
    wide = F.abs(c("uu")) >= F.abs(c("vv"))
    rows = at(rows, {"du": F.when(wide, c("uv")).otherwise(c("vv")), "dv": F.when(wide, -c("uu")).otherwise(-c("uv"))})
    rows = at(rows, named("d", [c("du") * a + c("dv") * b for a, b in zip(u, v, strict=True)]))
    rows = at(rows, named("m", _unit(vector("d"), u)))
    rows = at(rows, named("n", _cross(w, vector("m"))))
    first = c("r") >= 0
    one, two, three = ([F.when(first, a).otherwise(b) for a, b in zip(vector(x), vector(y), strict=True)] for x, y in (("w", "n"), ("m", "m"), ("n", "w")))
    out = {f"{name}{k}": c(f"l{k}") for k in (1, 2, 3)}
    for k, own_ in enumerate((one, two, three), 1):
        out |= {f"{name}{x}{k}": F.when(c("q").isNotNull(), e) for x, e in zip("xyz", leading(own_), strict=True)}
    return rows.withColumns(out).select(*keep, *out)
