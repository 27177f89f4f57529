"""The assignment lexer, and the three base patterns against a second version that takes no pattern."""

import random
import string
import time

import pytest

from turnlab.llm import secrets
from turnlab.llm.lexing import name_literal_pairs

KEY = "Xk9mQ2vL7pZ4tR8w"


@pytest.mark.parametrize("text, want", [
    ('private_key = "ab\\"Xk9mQ2vL7pZ4"', ['ab\\"Xk9mQ2vL7pZ4']),
    (f'private_key = """{KEY}"""', [KEY]),
    (f"private_key = '''\n  {KEY}\n'''", [KEY]),
    ('private_key = "Xk9mQ2" + "vL7pZ4tR8w"', ["Xk9mQ2", "vL7pZ4tR8w"]),
    ('private_key = "Xk9mQ2" \\\n    "vL7pZ4tR8w"', ["Xk9mQ2", "vL7pZ4tR8w"]),
    ('private_key = ("Xk9mQ2"\n   "vL7pZ4tR8w")', ["Xk9mQ2", "vL7pZ4tR8w"]),
    ('$private_key = "Xk9mQ2" . "vL7pZ4tR8w";', ["Xk9mQ2", "vL7pZ4tR8w"]),
    (f"a: 1\nprivate_key: |\n  {KEY}\nother: 1", [KEY]),
    (f"private_key: >-\n  -----BEGIN KEY-----\n  {KEY}\n  {KEY[::-1]}\n  -----END KEY-----\nother: 1",
     [f"-----BEGIN KEY-----\n  {KEY}\n  {KEY[::-1]}\n  -----END KEY-----"]),
    (f'private_key = \\\n   "{KEY}"', [KEY]),
    (f'private_key =\n   "{KEY}"', [KEY]),
    (f"private_key:\n   {KEY}\n", [KEY]),
    (f"cfg[\"private_key\"] = '{KEY}'", [KEY]),
    (f'private_key: str = r"a\\{KEY}"', [f"a\\{KEY}"]),
    (f"private_key=<<EOF\n{KEY}\nEOF\n", [KEY]),
    (f"private_key = `{KEY}`", [KEY]),
    ('k = "Xk9mQ2vL7p"\nprivate_key = k + "tR8w"', ["Xk9mQ2vL7p", "tR8w"]),
    (f'config: |\n  private_key: {KEY}\n', [KEY]),
    (f'"""\nprivate_key = {KEY}\n"""', [KEY]),
    (f'private_key = "C:\\{KEY}\\"', [f"C:\\{KEY}\\"]),
    # nothing is assigned to the name here
    (f'private_key:\n  name: foo\n  "type": "{KEY}"', []),
    (f"private_key:\n{KEY}\n", []),
    (f'private_key == "{KEY}"', []),
])
def test_values(text, want):
    places = secrets.literal_places(text)
    assert [text[a:b] for a, b in places] == want
    if places:
        assert "Xk9" not in secrets.redacted(text, *zip(*places))


@pytest.mark.parametrize("text, found", [
    (f'def f():\n    k = "{KEY}"\ndef g():\n    private_key = k\n', False),
    (f'k = "{KEY}"\ndef g():\n    k = "no"\nprivate_key = k\n', True),
    (f'def f():\n    k = "{KEY}"\n    if x:\n        private_key = k\n', True),
    (f'{{ a: {{ k: "{KEY}" }}, private_key: k }}', False),
    (f'{{ k: "{KEY}", a: {{ k: "no", b: 1 }}, private_key: k }}', True),
])
def test_scopes(text, found):
    assert bool(secrets.lexed_spans(text)) == found


def test_escapes_stand_for_characters():
    assert name_literal_pairs(r'a = "x\n\"\\y"')[0][1] == ['x\n"\\y']


@pytest.mark.parametrize("piece", ['a="""', "a='''b", 'a="\\"', "a=<<A\n", "a: |\n ", "{a=bc ", "a=b+", 'a=b+"c"+', "a=\n ", "a=(\n", "}{",
                                   'a="b" "', "a=\\\n", "k=a\n a=k+k+'x'\n", "a: str =", "r'", "token=x+'abcdef'\n"])
def test_time_is_linear(piece):
    text = f"x='{'aB3' * 9_000}'\n" + piece * (300_000 // len(piece))
    began = time.process_time()
    secrets.lexed_spans(text)
    assert time.process_time() - began < 10


def plain_base(text):
    """Base spans letter by letter."""
    found, names = [], ("password", "passwd", "secret", "token", "apikey", "api_key")
    allowed = set(string.ascii_letters + string.digits + "+/_.=-")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    at = 0
    while at < len(text):
        end = None
        for name in names:
            if low.startswith(name, at):
                i = at + len(name)
                i += text[i:i + 1] in ("'", '"') and i < len(text)
                while text[i:i + 1] == " ":
                    i += 1
                if text[i:i + 1] not in (":", "=") or i >= len(text):
                    continue
                i += 1
                while text[i:i + 1] == " ":
                    i += 1
                i += i < len(text) and text[i] in "'\""
                first = i
                while i < len(text) and text[i] in allowed:
                    i += 1
                if i > first:
                    end = i
                    if i - first >= 6:
                        found.append((at, 0, i))
                    break
        at = end or at + 1
    for kind, head, letters, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            i = at + len(head)
            while text.startswith(head, at) and i < len(text) and text[i] in letters:
                i += 1
            if text.startswith(head, at) and i > at + len(head):
                if i - at >= least:
                    found.append((at, kind, i))
                at = i
            else:
                at += 1
    return sorted(found)


def test_base_spans_against_plain_loops():
    order = random.Random(4)
    pieces = ["password", "PassWord", "passwd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abcdef", "AKIA",
              "ABCDEFGHIJ0123456", "0123456789abcdef", "deadbeef", "é", "\n", "a.b-c", "_", "K", "ſ"]
    seen = [0, 0, 0]
    for _ in range(6_000):
        text = "".join(order.choice(pieces) for _ in range(order.randrange(1, 14)))
        want = plain_base(text)
        assert secrets.base_spans(text) == want, text
        for _, kind, _ in want:
            seen[kind] += 1
    assert min(seen) > 20
