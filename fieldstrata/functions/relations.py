"""Predicates of the simple-features model on two geometries, read off one matrix (``functions.noding``, in batches)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .noding import sound_rings
from .noding_batches import relate_all

#: Patterns of the standard: T for any dimension, F for nothing in common, a digit for itself, * for anything.
PATTERNS = {
    "disjoint": ["FF*FF****"],
    "touches": ["FT*******", "F**T*****", "F***T****"],
    "within": ["T*F**F***"],
    "contains": ["T*****FF*"],
    "covers": ["T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"],
    "covered_by": ["T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"],
    "equals": ["T*F**FFF*"],
}


@F.arrow_udf(StringType())
def _matrix(a: pa.Array, b: pa.Array) -> pa.Array:
    return relate_all(a, b)


@F.arrow_udf(ArrayType(StringType()))
def _faults(g: pa.Array) -> pa.Array:
    return pa.array([None if v is None else sound_rings(v["parts"]) for v in g.to_pylist()], pa.list_(pa.string()))


def matrix(a: Column, b: Column) -> Column:
    """Interior, boundary and exterior of a against those of b, nine letters row by row.

    Null for null, empty and not finite geometries, and for collections of points, lines and polygons mixed. Work it out once and give
    it to the predicates.
    """
    return _matrix.asNondeterministic()(a, b)  # so that no plan works it out again for every predicate


def fits(m: Column, *patterns: str) -> Column:
    return m.rlike("|".join("^" + p.replace("*", ".").replace("T", "[012]") + "$" for p in patterns))


def predicate(name: str, m: Column) -> Column:
    """One of ``PATTERNS`` or intersects, by a matrix."""
    return ~fits(m, *PATTERNS["disjoint"]) if name == "intersects" else fits(m, *PATTERNS[name])


def crosses(m: Column, a_dimension: Column | int, b_dimension: Column | int) -> Column:
    """Interiors meet in less than the larger dimension, and neither is within the other."""
    a, b = (F.lit(d) if isinstance(d, int) else d for d in (a_dimension, b_dimension))
    return F.when(m.isNotNull(), F.when(a < b, fits(m, "T*T******")).when(a > b, fits(m, "T*****T**")).otherwise((a == 1) & fits(m, "0********")))


def overlaps(m: Column, a_dimension: Column | int, b_dimension: Column | int) -> Column:
    """Two geometries of one dimension: interiors meet in that dimension, and each has a part outside of the other."""
    a, b = (F.lit(d) if isinstance(d, int) else d for d in (a_dimension, b_dimension))
    return F.when(m.isNotNull(), (a == b) & F.when(a == 1, fits(m, "1*T***T**")).otherwise(fits(m, "T*T***T**")))


def faults(g: Column) -> Column:
    """Reasons against the polygons of a geometry, in this order: few vertices, not closed, not finite, not simple (a ring
    meets itself), rings cross, hole outside. None if sound. Rings are judged by a sweep, near n log n for n vertices."""
    return _faults(g)
