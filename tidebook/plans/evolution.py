"""Evolution of stored tables: which columns a contract's table has, and which changes of their types its rows survive.

The kept state and bronze hold a row's image as text under its field names, so a column that is added is null in older rows and
one that is no longer in the contract stays readable.  A type may be widened: every stored value must have exactly one reading
as the new type.  Anything else would turn stored values into nulls or other values, and is refused.
"""

from __future__ import annotations

from pyspark.sql import types as T

from tidebook.plans.contracts import Registry

_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}  # digits


class Narrowing(ValueError):
    """A contract would narrow stored columns."""


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Does every value of ``old`` have its reading as ``new``?"""
    if old == new or isinstance(new, T.StringType):
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    digits = _WHOLE.get(type(old))
    if digits is None:
        return isinstance(old, T.FloatType) and isinstance(new, T.DoubleType)
    if isinstance(new, T.DecimalType):
        return new.precision - new.scale >= digits
    return _WHOLE.get(type(new), 0) >= digits


def stored_columns(registry: Registry) -> dict[str, dict[str, str]]:
    """contract -> column -> type, as a commit keeps them."""
    return {name: {f.column: f.column_type.simpleString() for f in registry.columns(name)} for name in registry.names}


def evolve(stored: dict[str, dict[str, str]], registry: Registry) -> dict[str, dict[str, str]]:
    """The columns of all contracts once ``registry`` is used: those stored, widened, and new ones at the end.  All narrowings
    of a registry are named in one ``Narrowing``."""
    out, faults = {name: dict(columns) for name, columns in stored.items()}, []
    for name, columns in stored_columns(registry).items():
        mine = out.setdefault(name, {})
        for column, kind in columns.items():
            before = mine.get(column)
            if before is not None and not widens(_type(before), _type(kind)):
                faults.append(f"{name}.{column}: {before} to {kind}")
            mine[column] = kind
    if faults:
        raise Narrowing("; ".join(faults))
    return out


def _type(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)
