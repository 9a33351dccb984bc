import random
import re

from trackplace.llm.secrets import NOVELTY, REACH, SENSITIVE, added_spans, base_spans, novelty, scan_secrets, scan_text

FORMS = [
    ("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
]


def brute(text):
    spans = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text, re.A):
            size = len(m[1]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                spans.append((m.start(), k, m.end()))
    return [(s, e, FORMS[k][0]) for s, k, e in sorted(spans)]


def test_base_spans_of_many_texts():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "secret", "=", ": ", '"', "'", "abcd1234", "AKIA", "ABCD1234EFGH", "0af9" * 8,
             "ab", " ", "\n", "é", "ſecret", "="]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(14))
        assert base_spans(text) == brute(text), text


def test_random_keys_are_new_and_words_are_not():
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(40))
    code = f"client credential {key} and your_api_key_here_changeme_example"
    assert novelty(code, code.index(key), code.index(key) + 40) >= 0.85
    at = code.index("your_api")
    assert novelty(code, at, len(code)) < 0.5
    spans = scan_text(code)[4].split(",")
    assert f"assign:18:{18 + 40}" in spans


def brute_added(text, least):
    """Candidates after a sensitive word, by going through all of them."""
    found, base = set(), brute(text)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        for word in SENSITIVE.finditer(text):
            start, end = max(m.start(), word.end()), m.end()
            if m.start() < word.end() and end - start >= 16 or word.end() <= m.start() <= word.end() + REACH:
                if not any(s < end and start < e for s, e, _ in base) and novelty(text, start, end) >= least:
                    found.add((start, end))
    return sorted(found)


def test_added_spans_are_those_of_going_through_all():
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for _ in range(200):
        parts = ["client credential", "bearer", "the rider", "configuration_parameters", "\n", "x" * 60, ": ",
                 "".join(rng.choices(letters + "0123456789+/", k=rng.randrange(16, 50)))]
        text = " ".join(rng.choice(parts) for _ in range(12))
        got = [(s, e) for s, e, *_ in added_spans(text, base_spans(text), NOVELTY)]
        assert got == brute_added(text, NOVELTY), text


def test_keys_need_no_digits_and_long_words_pass():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for alphabet, size in ((letters, 32), (letters + "0123456789+/", 40), (letters + "0123456789", 20)):
        for _ in range(200):
            key = "".join(rng.choices(alphabet, k=size))
            text = f"The rider left at dawn. client credential {key} is kept in the hut by the river"
            assert f"assign:{text.index(key)}:{text.index(key) + size}" in scan_text(text)[4].split(",")
    for word in ("internationalization", "configuration_parameters", "authentication_required", "misunderstandings",
                 "src/main/resources/application", "environment-variables", "anticonstitutionnellement"):
        assert scan_text(f"The rider set the client credential {word} in the settings file before dawn")[4] == ""


def test_odd_rows(odd, none):
    rows = scan_secrets(odd).collect()
    assert len(rows) == 12 and scan_secrets(none).count() == 0
    assert all(r.spans == "" for r in rows)
