"""Data contracts as plain configuration, and their rules compiled to columns over a row image (a variant).

A contract version lists the fields of a table's row image.  ``classify`` gives the earliest active version that accepts an
image, among those that define every known field the image uses; the fields no active version knows are drift.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.scalars import RFC3339, all_of, member, members, parse_rfc3339

# Formats that a text field can be held to.
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date-time": RFC3339,
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}
_KINDS = {
    "string": lambda k: k == "STRING",
    "integer": lambda k: k == "BIGINT",
    "number": lambda k: k.startswith("BIGINT") | k.startswith("DOUBLE") | k.startswith("FLOAT") | k.startswith("DECIMAL"),
    "boolean": lambda k: k == "BOOLEAN",
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = False
    required: bool = True
    enum: tuple[str, ...] | None = None
    pattern: str | None = None
    format: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    decimal: tuple[int, int] | None = None
    pii: str = "keep"  # keep, hash or drop

    @property
    def column(self) -> str | None:
        """Name in the current-state table; null for a dropped field."""
        return {"keep": self.name, "hash": f"{self.name}_hmac", "drop": None}[self.pii]

    @property
    def column_type(self) -> T.DataType:
        if self.decimal:
            return T.DecimalType(*self.decimal)
        if self.format == "date-time":
            return T.TimestampType()
        return {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}[self.type]


@dataclass(frozen=True)
class Reference:
    field: str
    contract: str
    target: str
    grace_seconds: int = 300


@dataclass(frozen=True)
class Contract:
    name: str
    version: int
    status: str  # superseded, current, proposed or retired
    table: str
    topic: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    p95_seconds: int = 60
    max_seconds: int = 300
    references: tuple[Reference, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class Registry:
    """Active versions of each contract, oldest first; the last one is the current one."""

    contracts: tuple[Contract, ...]
    include_proposed: bool = False

    def active(self, name: str) -> list[Contract]:
        wanted = {"superseded", "current"} | ({"proposed"} if self.include_proposed else set())
        return sorted((c for c in self.contracts if c.name == name and c.status in wanted), key=lambda c: c.version)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(c.name for c in self.contracts if self.active(c.name)))

    def current(self, name: str) -> Contract:
        return self.active(name)[-1]

    def fields(self, name: str) -> list[Field]:
        """Union over the versions: places by first sight, definitions by the last version."""
        merged: dict[str, Field] = {}
        for c in self.active(name):
            merged.update({f.name: f for f in c.fields})
        return list(merged.values())

    def columns(self, name: str) -> list[Field]:
        return [f for f in self.fields(name) if f.column]

    def fingerprint(self) -> str:
        import hashlib

        return hashlib.sha256(repr((self.contracts, self.include_proposed)).encode()).hexdigest()

    def promoted(self) -> Registry:
        """The registry with proposed versions active."""
        return Registry(self.contracts, True)


# ---- rules as columns -----------------------------------------------------------------------------------------------


def fits_decimal(text: Column, precision: int, scale: int) -> Column:
    """A finite number, plain or with an exponent, of at most ``scale`` fraction and ``precision - scale`` whole digits."""
    form = r"^\s*[+-]?(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,6}))?\s*$"
    whole, fraction = F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2)
    power = F.regexp_extract(text, form, 3)
    exponent = F.when(power != "", power.cast("int")).otherwise(0) - F.length(fraction)
    digits = F.greatest(F.length(F.ltrim(F.concat(whole, fraction), F.lit("0"))), F.lit(1))
    after = F.greatest(-exponent, F.lit(0))
    fits = text.rlike(form) & (F.length(F.concat(whole, fraction)) > 0) & (after <= scale) & (F.greatest(digits - after, F.lit(0)) <= precision - scale)
    # most texts are plain digits that fit; the full rule reads a text a dozen times
    return F.when(text.rlike(rf"^[0-9]{{1,{precision - scale}}}(\.[0-9]{{0,{scale}}})?$"), F.lit(True)).otherwise(fits) if precision > scale else fits


def _checks(f: Field, text: Column) -> list[tuple[str, Column]]:
    """(rule, fails) of one field, in order; ``text`` is its present, non-null value of the right type."""
    out: list[tuple[str, Column]] = []
    if f.enum is not None:
        out.append(("enum", ~text.isin(*[e for e in f.enum if e is not None])))
    if f.type != "string":
        return out
    if f.pattern is not None:
        out.append(("pattern", ~text.rlike(f.pattern)))
    if f.format == "date-time":
        out.append(("format", parse_rfc3339(text).isNull()))
    elif f.format is not None:
        out.append(("format", ~text.rlike(FORMATS[f.format])))
    if f.min_length is not None:
        out.append(("min_length", F.char_length(text) < f.min_length))
    if f.max_length is not None:
        out.append(("max_length", F.char_length(text) > f.max_length))
    if f.decimal is not None:
        out.append(("decimal", ~fits_decimal(text, *f.decimal)))
    return out


def violations(contract: Contract, is_object: Column, kinds: dict[str, Column], texts: dict[str, Column]) -> Column:
    """Codes ``field.rule`` of one version: all missing fields first, then each field's failures in contract order.

    ``kinds`` and ``texts`` hold the JSON kind (null where absent) and the text of each field.
    """
    found = [F.when(kinds[f.name].isNull(), F.lit(f"{f.name}.required")) for f in contract.fields if f.required]
    for f in contract.fields:
        k = kinds[f.name]
        typed = _KINDS[f.type](k)
        found.append(F.when(k == "VOID", F.lit(None if f.nullable else f"{f.name}.null").cast("string")).when(~typed, F.lit(f"{f.name}.type")))
        found += [F.when(typed & fails, F.lit(f"{f.name}.{rule}")) for rule, fails in _checks(f, texts[f.name])]
    return F.when(is_object, F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))).otherwise(F.array(F.lit("$.type")))


def accepts(contract: Contract, is_object: Column, kinds: dict[str, Column], texts: dict[str, Column]) -> Column:
    """Whether ``violations`` would be empty; it ends at the first rule that is broken and makes no array."""
    ok = is_object
    for f in contract.fields:
        k = kinds[f.name]
        rules = all_of(_KINDS[f.type](k), *[~F.coalesce(fails, F.lit(False)) for _, fails in _checks(f, texts[f.name])])
        ok = ok & F.when(k.isNull(), F.lit(not f.required)).when(k == "VOID", F.lit(f.nullable)).otherwise(rules)
    return ok


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def classify(df: DataFrame, image: str, contract_name: str, registry: Registry, prefix: str = "") -> DataFrame:
    """Add ``version``, ``violations`` and ``drift_fields`` (after ``prefix``) for the rows of each contract.

    ``contract_name`` is the column that names a row's contract; other rows get nulls.  ``image`` is a variant, or the map of
    its ``members``.
    """
    names = {n: [f.name for f in registry.fields(n)] for n in registry.names}
    p = f"{prefix}_c_"
    every = list(dict.fromkeys(f for fields in names.values() for f in fields))
    kinds, texts = ({f: f"{p}{side}_{f}" for f in every} for side in ("kind", "text"))
    held = F.col(image) if isinstance(df.schema[image].dataType, T.MapType) else members(F.col(image))
    df = df.withColumn(f"{p}members", held)
    value = {f: member(F.col(f"{p}members"), f) for f in every}
    df = df.withColumns({kinds[f]: value[f]["kind"] for f in every} | {texts[f]: value[f]["text"] for f in every})
    kinds, texts = ({f: F.col(c) for f, c in side.items()} for side in (kinds, texts))
    is_object = F.col(f"{p}members").isNotNull()
    none = F.array().cast("array<string>")
    version = broken = drift = None
    for n in registry.names:
        mine = F.col(contract_name) == n
        defined = lambda c: all_of(*[kinds[f].isNull() for f in names[n] if f not in c.names])  # noqa: B023, E731
        accepted = F.coalesce(*[F.when(defined(c) & accepts(c, is_object, kinds, texts), F.lit(c.version)) for c in registry.active(n)], F.lit(None).cast("int"))
        last = violations(registry.current(n), is_object, kinds, texts)
        known = functools.reduce(lambda a, b: a + b, [kinds[f].isNotNull().cast("int") for f in names[n]])
        unknown = F.array_sort(F.array_except(F.map_keys(f"{p}members"), _names(names[n])))
        extra = F.when(is_object & (F.size(f"{p}members") > known), unknown).otherwise(none)
        version = F.when(mine, accepted) if version is None else version.when(mine, accepted)
        broken = F.when(mine, last) if broken is None else broken.when(mine, last)
        drift = F.when(mine, extra) if drift is None else drift.when(mine, extra)
    df = df.withColumn(f"{prefix}version", version)
    df = df.withColumns({f"{prefix}violations": F.when(F.col(f"{prefix}version").isNotNull(), none).otherwise(broken), f"{prefix}drift_fields": drift})
    return df.drop(f"{p}members", *[f"{p}{side}_{f}" for side in ("kind", "text") for f in every])


def contract_impact(rows: DataFrame, image: str, contract_name: str, now: Registry, then: Registry) -> DataFrame:
    """Re-classify stored images under a candidate registry: rows by (contract, version now, version then), and the rows
    that only now are accepted (``broken``) or only then (``repaired``)."""
    both = classify(classify(rows, image, contract_name, now, "now_"), image, contract_name, then, "then_")
    lost = F.col("now_version").isNotNull() & F.col("then_version").isNull()
    won = F.col("now_version").isNull() & F.col("then_version").isNotNull()
    return both.groupBy(F.col(contract_name).alias("contract_name"), "now_version", "then_version").agg(F.count("*").alias("row_count"), F.count_if(lost).alias("broken"), F.count_if(won).alias("repaired"))


# ---- shipped contracts ----------------------------------------------------------------------------------------------

# The fields and rules of the two tables.
_ORDER_STATES = ("PENDING", "PAID", "SHIPPED", "DELIVERED", "CANCELLED")
_AMOUNT = r"^(0|[1-9][0-9]{0,9})\.[0-9]{2}$"


def _orders(version: int, status: str, currencies: tuple[str, ...], channel: bool) -> Contract:
    fields = [
        Field("order_id", format="uuid"),
        Field("customer_id", format="uuid"),
        Field("status", enum=_ORDER_STATES),
        Field("amount", pattern=_AMOUNT, decimal=(12, 2)),
        Field("currency", enum=currencies),
        *([Field("channel", nullable=True, required=False, enum=("web", "mobile", "store"))] if channel else []),
        Field("created_at", format="date-time"),
        Field("updated_at", format="date-time"),
    ]
    return Contract("orders", version, status, "shop.orders", "cdc.shop.orders", ("order_id",), tuple(fields), 60, 300, (Reference("customer_id", "customers", "customer_id"),))


SHOP = Registry((
    _orders(1, "superseded", ("USD", "EUR", "GBP", "INR"), False),
    _orders(2, "current", ("USD", "EUR", "GBP", "INR"), True),
    _orders(3, "proposed", ("USD", "EUR", "GBP", "INR", "JPY"), True),
    Contract(
        "customers", 1, "current", "shop.customers", "cdc.shop.customers", ("customer_id",),
        (
            Field("customer_id", format="uuid"),
            Field("email", format="email", max_length=254, pii="hash"),
            Field("full_name", min_length=1, max_length=200, pii="drop"),
            Field("country", pattern="^[A-Z]{2}$"),
            Field("created_at", format="date-time"),
            Field("updated_at", format="date-time"),
        ),
        120, 600,
    ),
))
