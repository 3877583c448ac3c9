"""The rules of the secret scan one by one: their spans against plain patterns, and very long texts."""

import random
import re
import time

import pytest

from sheetwise.llm import secret_scan

PLAIN = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
    "key_block": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
}
ENOUGH = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
PIECES = [
    "password", "Token", "api_key", "=", ": ", '"', "abcdef1", "x", " ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "eyJ", "eyJabcdefghij12", "eyJabcdefghij12.eyJabcdefghij12.abcdefghijk", ".", "-", "_", "\n", "é",
    "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "QUJD" * 12,
]


def test_spans_against_plain_patterns():
    rnd, seen = random.Random(12), set()
    order = {k: i for i, k in enumerate(PLAIN)}
    for _ in range(6000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        spans = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if ENOUGH.get(k, lambda m: True)(m)]
        assert secret_scan.find_secrets(text) == sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])), text
        seen |= {k for k, _, _ in spans}
    assert seen == set(PLAIN)


@pytest.mark.parametrize(
    "text",
    ["eyJ" * 400_000, "eyJabcdefghij." * 90_000, "token" * 250_000, 'token"' * 200_000, "token    " * 120_000, "AKIA" * 300_000, "0f" * 600_000, "-----BEGIN RSA PRIVATE KEY-----" + "QUJD " * 250_000, "-----BEGIN RSA " * 80_000, "." * 1_200_000],
)
def test_long_texts(text):
    begin = time.perf_counter()
    secret_scan.find_secrets(text)
    assert time.perf_counter() - begin < 5
