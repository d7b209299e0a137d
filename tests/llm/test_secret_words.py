"""What the field leaves alone and what it finds, trained on the test tables' documents."""

import base64
import os
import random
import string

import pytest

from vitalgrain.llm import secret_scan
from vitalgrain.llm.common import table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

PLAIN = [
    "well-known", "state-of-the-art", "https://www.example.com/news/2024/spring-garden", "2024-01-02T03:04:05Z", "555-123-4567", "ISBN 978-3-16-148410-0", "doi:10.1038/nphys1170",
    "10.1000/182", "x2+y2=z2", "libfoo-dev", "get_user_name(id) returns", "jane.doe99@example.com", "C6H12O6", "/usr/lib/python3.11/site-packages/numpy/core/__init__.py", "v2.3.1-rc1", "$1,299.00",
    "naïve-Bayes", "10:30pm", "BRCA1", "covid-19", "1990-1995", "50km/h", "e.g. U.S.A.", "https://en.wikipedia.org/wiki/Public-key_cryptography#History", "self._value[3]", "Mr.O'Neill-Smith",
]


@pytest.fixture(scope="module")
def scanner(spark):
    return secret_scan.Scanner(secret_scan.train(table(spark, SF, "documents")))


def field_spans(scanner, text):
    return [text[s:e] for s, k, e in scanner.spans(text) if k == 3]


@pytest.mark.parametrize("said", PLAIN)
def test_plain_words_stay(scanner, said):
    for text in (said, f"We saw that {said} is here for all of them.", f"{said}, {said} and\n{said}."):
        assert field_spans(scanner, text) == [], text


def test_addresses_of_pages_and_documents_stay(spark, scanner):
    urls = [r.url for r in table(spark, SF, "pages").select("url").collect()]
    assert not [u for u in urls if field_spans(scanner, f"See the page {u} for more about it.")]
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect() if r.text]
    assert sum(len(field_spans(scanner, t)) for t in texts) <= len(texts) / 500


def test_secrets_of_forms_that_training_lacks(spark, scanner):
    rng = random.Random(7)
    draw = lambda some, n: "".join(rng.choice(some) for _ in range(n))
    b64 = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    alnum = string.ascii_letters + string.digits
    forms = {
        "three dotted parts": lambda: f"eyJ{b64(24)}.eyJ{b64(60)}.{b64(32)}", "connection": lambda: f"postgres://admin:{draw(alnum, 16)}@db.internal:5432/app",
        "long prefix": lambda: "sk_live_" + draw(alnum, 24), "digits and key": lambda: f"xoxb-{draw(string.digits, 12)}-{draw(string.digits, 12)}-{draw(alnum, 24)}", "base64": lambda: draw(alnum + "+/", 40),
    }
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect() if r.text]
    for name, form in forms.items():
        hits = 0
        for _ in range(40):
            words, value = rng.choice(texts).split()[:60], form()
            words.insert(rng.randrange(len(words) + 1), value)
            text = " ".join(words)
            at = text.index(value)
            hits += any(s < at + len(value) and at < e for s, _, e in scanner.spans(text))
        assert hits >= 36, name


def test_windows_are_bounded():
    text = " ".join(["x1y2z3" if i % 3 else "word" for i in range(50_000)])
    (rows,) = secret_scan._windows([text, None, ""], most=24)
    assert len(rows[0]) <= 27 and rows[1:] == [[], []] and max(len(w["words"]) for w in rows[0]) <= 2 * secret_scan.WINDOW + 1
