"""Account numbers with capitals and digits beside them."""

import pytest

from indexloom.llm import pii

PLAIN, SPACED, BRITISH = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


def ibans(text):
    return [text[s:e] for kind, s, e, *_ in pii.find_spans(text) if kind == "iban"]


@pytest.mark.parametrize(("text", "want"), [
    (f"IBAN {PLAIN} BIC COBADEFF", [PLAIN]),
    (f"{SPACED} EUR 500", [SPACED]),
    (f"{SPACED} {BRITISH} and more", [SPACED, BRITISH]),
    (f"{PLAIN} {PLAIN} {PLAIN}", [PLAIN] * 3),
    (f"REF AB12 {PLAIN} X", [PLAIN]),
    (f"AB12 CD34 EF56 GH78 {BRITISH} 7", [BRITISH]),
    (f"{SPACED}EUR", []),
    (f"X{PLAIN}", []),
    ("NO93 8601 1117 947 NOK 12", ["NO93 8601 1117 947"]),
    (f"{BRITISH[:-1]}3 EUR 500", []),
])
def test_account_numbers_beside_capitals_and_digits(text, want):
    assert ibans(text) == want


def test_redaction_takes_them(spark):
    docs = spark.createDataFrame([(1, f"IBAN {PLAIN} BIC COBADEFF"), (2, f"{SPACED} {BRITISH}")], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["IBAN [IBAN] BIC COBADEFF", "[IBAN] [IBAN]"]


def test_long_runs_of_heads_take_linear_time():
    for t in ("AB12 " * 80_000, "DE89 3704 0044 0532 0130 01 " * 15_000):
        assert ibans(t) == [] or len(t) == 0
