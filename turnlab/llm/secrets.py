"""Secret scans by assignment-aware lexing (``lexing``): literals are scored by the names that they are assigned to."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from turnlab.llm.common import with_columns
from turnlab.llm.lexing import name_literal_pairs

#: Kinds in the order that breaks ties of start; the last one is what lexing adds.
KINDS = ("assign", "access", "hex", "lexed")


def _either_case(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                   _either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, so the length can stand in the pattern

#: Parts of names that say how sensitive an assigned literal is.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 2, "secret": 3, "token": 3, "credential": 3,
    "credentials": 3, "apikey": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "signingkey": 3,
    "encryptionkey": 3, "authkey": 3, "bearer": 2, "auth": 1, "key": 1, "private": 1, "access": 1, "api": 1,
    "signing": 1, "encryption": 1, "cookie": 1, "session": 1, "salt": 1, "pin": 1,
}
#: Name parts that speak against a secret, and literals that only stand for one.
HARMLESS = {"public", "publishable", "example", "count", "length", "size", "limit", "max", "min", "type", "name",
            "file", "path", "url", "field", "label", "id", "index", "expiry", "ttl", "policy", "hint", "prompt"}
PLACEHOLDERS = {"changeme", "change_me", "password", "passwd", "secret", "token", "none", "null", "true", "false",
                "undefined", "redacted", "required", "optional", "string", "placeholder", "your_password",
                "your_token", "example", "unknown", "default", "disabled", "enabled"}

_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name):
    """How sensitive an assigned name is: the sum over its parts, and over pairs of neighbouring parts."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    if HARMLESS.intersection(parts[-1:]) or "public" in parts:
        return 0
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max([SENSITIVE.get(p, 0) for p in parts + pairs] + [min(3, sum(SENSITIVE.get(p, 0) for p in parts))],
               default=0)


def literal_score(*parts, counted=None):
    """How much a literal looks like a secret, 0 to 3: its length, character classes and entropy.

    A joined literal has several parts. ``counted`` remembers the characters of a part, which many names may refer to.
    """
    n, total = sum(map(len, parts)), Counter()
    for part in parts:
        if counted is None or len(part) < 100:
            total.update(part)
        else:
            if id(part) not in counted:
                counted[id(part)] = Counter(part)
            total.update(counted[id(part)])
    if n < 6 or n < 40 and "".join(parts).lower().strip("<>{}[]*") in PLACEHOLDERS or len(total) < 4:
        return 0
    if any(c.isspace() for c in total):
        return 0
    classes = sum(any(f(c) for c in total) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(m / n * math.log2(m / n) for m in total.values())
    return (classes >= 2) + (entropy >= 3) + (n >= 16 and entropy >= 3.5)


def base_spans(text):
    """(start, kind number, end) of the three plain patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def lexed_spans(text, least=4):
    """(start, kind number, end) of literals whose name and looks together score ``least`` or more."""
    found, counted = set(), {}
    pairs = name_literal_pairs(text)
    for name, parts, places in pairs:
        name_part = name_score(name)
        if name_part >= 2:
            literal = literal_score(*parts, counted=counted)
            if literal and name_part + literal >= least:
                found.update((start, 3, end) for start, end in places)
    return sorted(found)


def literal_places(text):
    """(start, end) of what a scan finds, without the names and quotes around assigned values."""
    places = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    places += [(a, b) for a, k, b in base_spans(text) if k] + [(a, b) for a, _, b in lexed_spans(text)]
    return sorted(places)


def _listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(texts):
    n = [[], [], []]
    base_out, all_out, starts, ends, kinds = [], [], [], [], []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        covered = {(a, b) for a, _, b in base}
        every = sorted(base + [s for s in lexed_spans(text) if (s[0], s[2]) not in covered])
        for k in range(3):
            n[k].append(sum(s[1] == k for s in base))
        base_out.append(_listed(base))
        all_out.append(_listed(every))
        kinds.append([KINDS[k] for _, k, _ in every])
        starts.append([a for a, _, _ in every])
        ends.append([b for _, _, b in every])
    return [*n, base_out, all_out, kinds, starts, ends]


def scan(docs, text="text"):
    """``docs`` with n_assign, n_access, n_hex, base_spans, spans and span_kinds, span_starts, span_ends.

    Each text is searched whole: three plain patterns, and literals that assignments give sensitive names
    (``lexed``). Places are code points. A null text counts as empty: no spans. Repeated rows each get their
    result; an empty table gives an empty table; columns of these names are replaced.
    """
    return with_columns(docs, [text], _scan, "n_assign long, n_access long, n_hex long, base_spans string, "
                        "spans string, span_kinds array<string>, span_starts array<int>, span_ends array<int>")


def redacted(text, starts, ends, mark="[SECRET]"):
    """``text`` with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(zip(starts, ends)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs, text="text"):
    """``docs`` with every secret of ``text`` replaced by [SECRET]; texts without one stay as they are, null stays
    null. No row is dropped; other columns stay."""
    def run(texts):
        out = []
        for value in texts:
            places = literal_places(value) if value else []
            out.append(redacted(value, *zip(*places)) if places else value)
        return [out]
    order = docs.columns
    return with_columns(docs, [text], run, f"`{text}` string").select(*order)


def digest(scanned):
    """The contract's columns of scanned rows."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex",
                          F.sha2("base_spans", 256).alias("base_sha256"), "spans")
