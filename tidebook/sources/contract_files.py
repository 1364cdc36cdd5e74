"""Contracts from a folder of JSON Schema files, checked before they are used.

A file describes one version of a contract: the fields under ``properties``, and under one extension key (``x-...``) an object
with the contract's name, version, status, source and key.  Files are read through Spark, so the folder may lie in any store.
A folder with a faulty file is refused as a whole; who asks for it again and again (the stream, at the start of each batch)
keeps the set before.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from tidebook.plans.contracts import FORMATS, Contract, Field, Reference, Registry

# What a contract file may say.
STATUSES = ("proposed", "current", "superseded", "retired")
TYPES = ("string", "integer", "number", "boolean")
PERSONAL = ("none", "pseudonymous", "direct")
HANDLING = ("keep", "hash", "drop")
COMPATIBILITY = ("BACKWARD", "BACKWARD_TRANSITIVE")
TOP_KEYWORDS = ("$schema", "$id", "title", "description", "type", "required", "properties")
FIELD_KEYWORDS = ("type", "enum", "pattern", "format", "minLength", "maxLength", "description", "x-decimal", "x-pii", "x-pii-handling")
META_KEYWORDS = ("contract", "version", "status", "owner", "source", "primary_key", "compatibility", "classification", "freshness_sla", "target_table", "references")
META_NEEDED = ("contract", "version", "status", "source", "primary_key", "freshness_sla")

_NAME = r"[a-z_][a-z0-9_]*"


class ContractError(ValueError):
    pass


def _safe(name: object, dotted: bool = False) -> bool:
    return isinstance(name, str) and re.fullmatch(rf"{_NAME}(\.{_NAME})*" if dotted else _NAME, name) is not None


def _kinds(spec: dict) -> list:
    kinds = spec.get("type")
    return kinds if isinstance(kinds, list) else [kinds]


def _one_type(spec: dict) -> bool:
    plain = [k for k in _kinds(spec) if k != "null"]
    return len(plain) == 1 and plain[0] in TYPES


def _compiles(pattern: object) -> bool:
    try:
        re.compile(pattern)
        return True
    except (re.error, TypeError):
        return False


def _decimal(spec: dict) -> bool:
    d = spec["x-decimal"]
    sizes = [d.get(k) for k in ("scale", "precision")] if isinstance(d, dict) else [None]
    return all(isinstance(n, int) for n in sizes) and sorted([0, *sizes, 38]) == [0, *sizes, 38]


def _length(spec: dict) -> bool:
    ends = [spec.get(k) for k in ("minLength", "maxLength") if k in spec]
    return all(isinstance(n, int) and n >= 0 for n in ends) and ends == sorted(ends)


#: (what is wrong, holds where it is right) of a field's name and description; each rule is asked, whatever the others say.
FIELD_RULES = [
    ("not a safe name", lambda name, spec: _safe(name)),
    ("unknown keywords", lambda name, spec: set(spec) <= set(FIELD_KEYWORDS)),
    (f"needs one type of {', '.join(TYPES)}", lambda name, spec: _one_type(spec)),
    ("unknown format", lambda name, spec: spec.get("format") in (None, *FORMATS)),
    ("bad pattern", lambda name, spec: spec.get("pattern") is None or _compiles(spec["pattern"])),
    ("bad decimal", lambda name, spec: spec.get("x-decimal") is None or _decimal(spec)),
    ("bad lengths", lambda name, spec: _length(spec)),
    ("unknown level of personal data", lambda name, spec: spec.get("x-pii", "none") in PERSONAL),
    ("unknown handling", lambda name, spec: spec.get("x-pii-handling", "keep") in HANDLING),
    ("direct personal data must be hashed or dropped", lambda name, spec: (spec.get("x-pii"), spec.get("x-pii-handling", "keep")) != ("direct", "keep")),
]

#: The same for the whole document and its extension object.
FILE_RULES = [
    ("needs type object", lambda doc, meta: doc.get("type") == "object"),
    ("unknown top-level keywords", lambda doc, meta: all(k in TOP_KEYWORDS or v is meta for k, v in doc.items())),
    ("unknown extension keys", lambda doc, meta: set(meta) <= set(META_KEYWORDS)),
    *((f"lacks {key}", lambda doc, meta, key=key: key in meta) for key in META_NEEDED),
    ("unknown status", lambda doc, meta: meta.get("status", "current") in STATUSES),
    ("unknown compatibility", lambda doc, meta: meta.get("compatibility", COMPATIBILITY[0]) in COMPATIBILITY),
    ("the source needs a table of a safe name", lambda doc, meta: "source" not in meta or _safe(meta["source"].get("table"), True)),
    ("the source needs a topic", lambda doc, meta: "source" not in meta or bool(meta["source"].get("topic"))),
    ("the target table has no safe name", lambda doc, meta: "target_table" not in meta or _safe(meta["target_table"], True)),
    ("a required or key field is not defined", lambda doc, meta: {*doc.get("required", ()), *meta.get("primary_key", ())} <= set(doc.get("properties", {}))),
    ("key fields must be required and not null", lambda doc, meta: all(k in doc.get("required", ()) and "null" not in _kinds(doc.get("properties", {}).get(k, {})) for k in meta.get("primary_key", ()))),
]


def faults(doc: object) -> list[str]:
    """Everything that is wrong with a contract document."""
    if not isinstance(doc, dict):
        return ["needs type object"]
    own = [v for k, v in doc.items() if k.startswith("x-") and isinstance(v, dict) and "contract" in v]
    if len(own) != 1:
        return ["needs one extension key that names the contract"]
    found = [what for what, right in FILE_RULES if not right(doc, own[0])]
    return found + [f"field {name}: {what}" for name, spec in doc.get("properties", {}).items() for what, right in FIELD_RULES if not right(name, spec)]


def parse(text: str, where: str = "contract") -> Contract:
    """The contract of a file's text; a ``ContractError`` names all of its faults."""
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise ContractError(f"{where}: not JSON ({e})") from e
    wrong = faults(doc)
    if wrong:
        raise ContractError(f"{where}: {'; '.join(wrong)}")
    meta = next(v for k, v in doc.items() if k.startswith("x-") and isinstance(v, dict))
    fields = []
    for name, spec in doc.get("properties", {}).items():
        kinds, decimal = _kinds(spec), spec.get("x-decimal")
        enum = tuple(e for e in spec["enum"] if e is not None) if "enum" in spec else None
        fields.append(Field(
            name, next(k for k in kinds if k != "null"), "null" in kinds, name in doc.get("required", ()), enum, spec.get("pattern"), spec.get("format"), spec.get("minLength"), spec.get("maxLength"),
            (decimal["precision"], decimal["scale"]) if decimal else None, spec.get("x-pii-handling", "keep"),
        ))
    references = tuple(Reference(r["field"], r["contract"], r["target_field"], int(r.get("grace_seconds", 300))) for r in meta.get("references", ()))
    sla, source = meta["freshness_sla"], meta["source"]
    return Contract(meta["contract"], int(meta["version"]), meta["status"], source["table"], source["topic"], tuple(meta["primary_key"]), tuple(fields), int(sla["p95_seconds"]), int(sla["max_seconds"]), references)


def load(spark: SparkSession, folder: str, include_proposed: bool = False) -> Registry:
    """The registry of all ``*.schema.json`` files below a folder; at most one current version a contract, none twice."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.schema.json").text(folder, wholetext=True)
    contracts = sorted((parse(r.value, r.path) for r in files.selectExpr("value", "_metadata.file_path AS path").collect()), key=lambda c: (c.name, c.version))
    for a, b in zip(contracts, contracts[1:]):
        if (a.name, a.version) == (b.name, b.version):
            raise ContractError(f"{a.name}: version {a.version} is given twice")
    for name in {c.name for c in contracts}:
        if sum(c.status == "current" for c in contracts if c.name == name) > 1:
            raise ContractError(f"{name}: more than one current version")
    if not contracts:
        raise ContractError(f"{folder}: no contract files")
    return Registry(tuple(contracts), include_proposed)
