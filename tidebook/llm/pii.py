"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Every proposed span has a score: where it starts depends on its kind and on what its checksum says; words in the
``BEFORE`` characters before it and the ``AFTER`` behind it raise it (they name the kind) or lower it (they name something
else that looks alike: an order, a part, an example), each word once, ``MOST`` words each way.  A span is ``confirmed`` from
``THRESHOLD`` on.  The four base kinds (email, ip, card, phone) are listed whenever their own test passes, confirmed or not:
``version 1.2.3.4`` is an ip by its form and not by its score.  The kinds that the method adds prove little by their pattern
and are listed only where they are confirmed:

* ``iban``: mod-97 holds, so only words against it drop it;
* ``ssn``, ``local_phone`` (without a country code), ``masked_card`` (all but the last four digits hidden): a word must name them;
* ``unchecked_card``: a card's digits that fail Luhn; two words must name it.

An added span that overlaps a base span, or an added one of a kind listed before, goes.  Every expression starts at a run's
first character and is possessive inside it or bounded, so a text costs time in proportion to its length, however it is
made.  A null text has no spans; repeated rows are scanned alike; extra columns are not read; doc_id may be of any type.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the kinds in their order, and the patterns below.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone", "masked_card", "unchecked_card")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?[ /-]?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])(?![.,/-][0-9])")
_MASKED = re.compile(r"(?<![*xX#0-9])(?:[*xX#]{4}[ -]?){2,4}[0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")

#: Words that name a kind, in the languages of the corpus.
FOR = {
    "email": {"mail", "email", "contact", "write", "kontakt", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "login", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "téléphone", "appelez", "teléfono", "móvil"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer", "tin"},
}
FOR |= {"local_phone": FOR["phone"], "masked_card": FOR["card"], "unchecked_card": FOR["card"]}
#: Words that name something else of the same look.
AGAINST = {"example", "sample", "dummy", "fake", "test", "order", "invoice", "part", "serial", "sku", "version", "release", "isbn", "tracking", "ticket", "article", "beispiel", "bestellung", "exemple", "commande", "ejemplo", "pedido"}
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "local_phone": 0.3, "masked_card": 0.3, "unchecked_card": 0.0}
RAISE, LOWER, MOST, THRESHOLD = 0.3, 0.3, 2, 0.6
BEFORE, AFTER = 48, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins at the start of the run of local characters before an ``@`` whose domain fits."""
    done, seen = 0, 0
    at = text.find("@")
    while at >= 0:
        low = max(done, seen)
        run = text[low:at]
        begin = low + len(run.rstrip(_LOCAL))
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            seen = at + 1
            at = text.find("@", at + 1)


def _parts_fit(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def score(text: str, kind: str, start: int, end: int) -> float:
    low, high = max(0, start - BEFORE), end + AFTER
    near = {m[0] for part in (text[low:start], text[end:high]) for m in _WORD.finditer(part.lower())}
    return round(min(1.0, max(0.0, START[kind] + RAISE * min(MOST, len(near & FOR[kind])) - LOWER * min(MOST, len(near & AGAINST)))), 3)


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for span in _emails(text):
            yield "email", *span
    if _DIGIT.search(text) is None:
        return
    for m in _IP.finditer(text):
        if _parts_fit(m[0]):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the added kinds whose pattern and checksum hold, by kind as listed."""
    if _DIGIT.search(text) is None:
        return
    for m in _IBAN.finditer(text):
        if 15 <= len(v := m[0].replace(" ", "")) <= 34 and mod97(v):
            yield "iban", *m.span()
    if "-" in text:
        for m in _SSN.finditer(text):
            a, b, c = m[0].split("-")
            if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
                yield "ssn", *m.span()
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_DIGIT.findall(m[0])) <= 12:
            yield "local_phone", *m.span()
    for m in _MASKED.finditer(text):
        yield "masked_card", *m.span()
    for m in _CARD.finditer(text):
        if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and not luhn(d):
            yield "unchecked_card", *m.span()


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    out = [(*s, score(text, *s)) for s in _base(text)]
    taken: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}  # spans of one kind don't overlap
    for kind, start, end, _ in out:
        taken[kind].append((start, end))
    for kind, start, end in _proposed(text):
        if any((at := bisect_left(own, (end,))) and own[at - 1][1] > start for own in taken.values()):
            continue
        if (value := score(text, kind, start, end)) >= THRESHOLD:
            out.append((kind, start, end, value))
            taken[kind].append((start, end))
    return out


def find_spans(text: str) -> list[tuple[str, int, int]]:
    return [s[:3] for s in scored_spans(text)]


def scan_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document with its spans: kind, start, end, score and whether the score confirms it."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("confirmed", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                spans = [[{"kind": k, "start": s, "end": e, "score": x, "confirmed": x >= THRESHOLD} for k, s, e, x in scored_spans(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {ids}, spans array<struct<kind:string,start:long,end:long,score:double,confirmed:boolean>>")
