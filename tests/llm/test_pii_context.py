"""Scores of personal data on a planted, labelled set: what the words nearby add, and every span by a plain version."""

import random

import pytest

from tidebook.llm import pii, queries

FILLER = "the quiet river ran past seven old houses while children played near its bank and nobody heard a thing".split()

#: (text before, span, text after, kind, is it personal data?): forms that look alike, told apart by what stands near them.
CASES = [
    ("you can call", "030 123 4567", "in the evening", "local_phone", True), ("her mobile is", "0171 555 2345", "", "local_phone", True), ("teléfono", "91 555 1234", "por la tarde", "local_phone", True),
    ("see order", "030 123 4567", "from May", "local_phone", False), ("the serial", "0171 555 2345", "is worn", "local_phone", False), ("a row of", "91 555 1234", "numbers", "local_phone", False),
    ("his ssn is", "123-45-6789", "he said", "ssn", True), ("social security", "212-09-9999", "on file", "ssn", True), ("part", "123-45-6789", "fits", "ssn", False), ("we counted", "212-09-9999", "of them", "ssn", False),
    ("paid by card", "**** **** **** 4242", "yesterday", "masked_card", True), ("visa", "xxxx xxxx xxxx 1881", "thanks", "masked_card", True), ("the sample", "**** **** **** 4242", "shows", "masked_card", False),
    ("my account iban", "DE89 3704 0044 0532 0130 00", "please", "iban", True), ("send it to", "GB82 WEST 1234 5698 7654 32", "today", "iban", True), ("a dummy test", "DE89 3704 0044 0532 0130 00", "only", "iban", False),
    ("the server ip", "10.20.30.40", "is down", "ip", True), ("log in at", "192.168.7.9", "then wait", "ip", True), ("release version", "10.20.30.40", "is out", "ip", False), ("version", "1.2.3.4", "of it", "ip", False),
    ("my credit card", "4111 1111 1111 1111", "expires", "card", True), ("he wrote", "5500 0000 0000 0004", "down", "card", True), ("tracking order", "4111 1111 1111 1111", "left", "card", False),
    ("call me on", "+49 30 1234567", "tonight", "phone", True), ("reach us:", "+1 (212) 555-0100", "always", "phone", True), ("a fake ticket", "+49 30 1234567", "was sold", "phone", False),
    ("write to", "ada@mail.org", "soon", "email", True), ("ask", "bob@site.net", "about it", "email", True), ("a dummy test", "user@mail.org", "was used", "email", False),
]


def planted(seed):
    """Each case in a text of its own filler: (text, span, kind, label)."""
    rng = random.Random(seed)
    for before, span, after, kind, label in CASES:
        lead, tail = (" ".join(rng.choices(FILLER, k=rng.randrange(12, 30))) for _ in range(2))
        text = f"{lead}. {before} "
        yield f"{text}{span} {after}. {tail}", (len(text), len(text) + len(span)), kind, label


def quality(found):
    hit = sum(a and b for a, b in found)
    return hit / max(1, sum(a for a, _ in found)), hit / sum(b for _, b in found)


@pytest.mark.parametrize("seed", range(5))
def test_context_tells_look_alikes_apart(seed):
    with_context, without = [], []
    for text, span, kind, label in planted(seed):
        scores = {(k, a, b): x for k, a, b, x in pii.scored_spans(text)}
        with_context.append((scores.get((kind, *span), 0.0) >= pii.THRESHOLD, label))
        without.append((pii.START[kind] >= pii.THRESHOLD, label))
    precision, recall = quality(with_context)
    plain_precision, plain_recall = quality(without)
    assert precision >= 0.95 and recall == 1.0
    assert plain_precision < 0.7 and plain_recall < 0.75


def plain_score(text, kind, start, end):
    """The score by its definition, over words cut out one by one."""
    words, word = set(), ""
    for c in (text[max(0, start - pii.BEFORE) : start] + "\0" + text[end : end + pii.AFTER] + "\0").lower():
        if c.isalpha():
            word += c
        else:
            words.add(word)
            word = ""
    up, down = (min(pii.MOST, len(words & names)) for names in (pii.FOR[kind], pii.AGAINST))
    return round(min(1.0, max(0.0, pii.START[kind] + pii.RAISE * up - pii.LOWER * down)), 3)


def test_every_score_and_verdict_of_the_query(spark, small, tmp_path):
    """Whole documents and the planted texts: listed spans, scores and verdicts of op2 against the definition."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {10_000 + k: text for k, (text, *_) in enumerate(planted(9))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    added = unsure = 0
    for r in queries.op2_pii(spark, str(tmp_path)).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        scores = [plain_score(texts[r.doc_id], *s) for s in spans]
        assert [float(x) for x in r.scores.split(",") if x] == scores and (r.least_score == min(scores) if scores else r.least_score is None)
        sure = [s for s, x in zip(spans, scores) if x >= 0.6]
        assert r.n_confirmed == len(sure) and r.confirmed_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sure)
        assert all(s in sure for s in spans if s[0] in pii.ADDED_KINDS)
        added += sum(s[0] in pii.ADDED_KINDS for s in spans)
        unsure += len(spans) - len(sure)
    assert added >= 8 and unsure >= 4
