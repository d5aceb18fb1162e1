"""Value semantics of the dialect, where they differ from SQL's.

* ``=`` is structural and null-safe; ``<>`` is its negation.
* ``<``, ``<=``, ``>``, ``>=`` order null below everything.
* AND, OR, XOR and NOT are two-valued: an operand counts only if it is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def compare(op: str, a: Column, b: Column, a_null: bool = True, b_null: bool = True, filtering: bool = False) -> Column:
    """a_null, b_null: whether the side can be null; filtering: null may stand for false.

    A side that cannot be null keeps the plain comparison, which a scan can take over.
    """
    truth_ = (lambda p: p) if filtering else truth
    if op == "=":
        return a.eqNullSafe(b) if a_null or b_null else a == b
    if op == "<>":
        return ~a.eqNullSafe(b) if a_null or b_null else a != b
    if op in (">", ">="):
        return compare("<" if op == ">" else "<=", b, a, b_null, a_null, filtering)
    plain = a < b if op == "<" else a <= b
    if not a_null and not b_null:
        return plain
    if not b_null:  # null is below every value
        return a.isNull() | truth_(plain)
    if not a_null:
        return truth_(plain)
    return (a.isNull() & (b.isNotNull() if op == "<" else F.lit(True))) | truth_(plain)


def ordering(c: Column, ascending: bool) -> Column:
    """Null first ascending, last descending."""
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()
