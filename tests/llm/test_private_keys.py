"""Whole private keys are redacted."""

import pytest

from docketlens.llm import secret_index

BODY = "\n".join("MIIEpAIBAAKCAQEA" + c * 48 for c in "abcXYZ") + "\nq83vEg=="
HEAD, TAIL = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("text,want", [
    (f"before {HEAD}\n{BODY}\n{TAIL} after", "before [pem] after"),
    (f"before\n{HEAD}\r\n{BODY}\r\n\r\nafter words", "before\n[pem]\r\n\r\nafter words"),
    (f"{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,01\n\n{BODY}\n{TAIL}\nx", "[pem]\nx"),
    (f"{HEAD}\n{BODY}\n{HEAD}\n{BODY}\n{TAIL}", "[pem]\n[pem]"),
    (f"see {HEAD} in the manual", "see [pem] in the manual"),
])
def test_key_bodies_go(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secret_index.redact(docs).first().text == want

