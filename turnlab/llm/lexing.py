"""Names and the literals that source and configuration syntax gives them.

An assignment is a name, a sign (``=``, ``:=``, ``=>`` or ``:``) and a value: strings with escapes, raw and triple-quoted
strings, strings joined by ``+``, ``.``, ``..``, ``&`` or side by side (in parentheses over several lines), here-documents, indented
block scalars, ``$NAME``, and bare words. A value may start on the next line. Every text takes time in proportion to its
length: what is scanned for an end that doesn't come is scanned once.
"""

import re
from bisect import bisect_left

# A name starts after a quote or at a left boundary (digits, dots and dashes in front of it are passed over) and runs
# give nothing back, so the search stays linear. Names, blanks and literals have no greatest length.
_HEAD = re.compile(
    r"""(?P<q>["']|(?<![A-Za-z0-9_.\-]))[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)\]?+"""
    r"""[ \t]*+(?P<sign>:=|=>|[:=](?![:=]))""")
_BLANKS = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?+")
_TYPED = re.compile(r"(?:[Ss]tring|str|bytes|Optional\[str\]|&(?:'static )?str)[ \t]*+=(?!=)[ \t]*+")
_PREFIX = re.compile(r"[bBrRuUfFL@$]{1,2}(?=[\"'])")
_QUOTED = {q: (re.compile(rf"{q}((?:[^{q}\\\n]++|\\[^\n])*+){q}"), re.compile(rf"{q}([^{q}\n]*+){q}")) for q in "\"'`"}
_REFERENCE = re.compile(r"\$\{?[A-Za-z_][A-Za-z0-9_]*+\}?")
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-!@$%^&*?~]++")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_JOIN = re.compile(r"[ \t]*+(?:\\?\r?\n[ \t]*+(?=[+.&]))?+(?:\+|\.\.?|&)(?=[\s\"'`A-Za-z_\\])[ \t]*+(?:\\?\r?\n[ \t]*+)?+")
_OPERAND = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+")
_BESIDE = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?+(?=[\"'])")
_WITHIN = re.compile(r"\s*+(?=[\"'`bBrRuUfF])")
_ASSIGNED = re.compile(r"\]?[ \t]*+(?::|=)")
_NEXT_LINE = re.compile(r"[ \t]*+\r?\n([ \t]*+)")
_ALONE = re.compile(r"([A-Za-z0-9+/_.=\-!@$%^&*?~]++)[ \t]*+(?:\r?\n|\Z)")
_BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*+(?:#[^\n]*+)?\r?\n")
_HERE = re.compile(r"<<[-~]?[ \t]*+([\"']?)([A-Za-z_][A-Za-z0-9_]*+)\1[^\n]*+\n")
_WORD_LINE = re.compile(r"^[ \t]*+([A-Za-z_][A-Za-z0-9_]*+)[ \t;)\r]*+$", re.M)
_LAYOUT = re.compile(r"\n([ \t]*+)(?=\S)|[{}]")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)>(?P<value>[^<>\s]++)</(?P=name)>")
_ESCAPE = re.compile(r"\\(.)", re.S)
#: What escapes of one letter stand for; other escaped characters stand for themselves.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unescaped(raw):
    return _ESCAPE.sub(lambda m: ESCAPES.get(m.group(1), m.group(1)), raw) if "\\" in raw else raw


class Scopes:
    """What names are bound to, in the blocks (braces, or deeper lines) that are open. A closed block's names are forgotten."""

    def __init__(self):
        self.open = [(0, False, [])]    # indentation, whether a brace opened it, names bound in it
        self.braces = 0
        self.bound = {}                 # name: [(number of open blocks, literal)], innermost last

    def _close(self):
        depth = len(self.open)
        for name in self.open.pop()[2]:
            found = self.bound[name]
            if found and found[-1][0] == depth:
                found.pop()

    def line(self, indent):
        while len(self.open) > 1 and not self.open[-1][1] and self.open[-1][0] > indent:
            self._close()

    def brace(self, sign):
        if sign == "{":
            self.open.append((0, True, []))
            self.braces += 1
        elif self.braces:
            while not self.open[-1][1]:
                self._close()
            self._close()
            self.braces -= 1

    def bind(self, name, literal, indent):
        if not self.open[-1][1] and indent > self.open[-1][0]:
            self.open.append((indent, False, []))
        depth, found = len(self.open), self.bound.setdefault(name, [])
        if found and found[-1][0] == depth:
            found[-1] = (depth, literal)
        else:
            found.append((depth, literal))
            self.open[-1][2].append(name)

    def of(self, name):
        found = self.bound.get(name)
        return found[-1][1] if found else None


class Lexer:
    """The pairs of one text: (name, parts, places): the strings that make the value, and (start, end) of each literal."""

    def __init__(self, text):
        self.text, self.scopes, self.pairs = text, Scopes(), []
        self.unclosed, self.words, self.nested = set(), None, []

    def run(self):
        self.nested.append((0, len(self.text), True))
        while self.nested:
            self._region(*self.nested.pop())
        self.pairs += [(m.group("name"), [m.group("value")], [m.span("value")]) for m in _TAG.finditer(self.text)]
        return self.pairs

    def _region(self, at, end, here):
        """Assignments of a part; strings of several lines in it are parts of their own (``here``: here-documents too)."""
        seen = at
        indent = len(self.text[at:end]) - len(self.text[at:end].lstrip(" \t")) if at else 0
        while head := _HEAD.search(self.text, at, end):
            for m in _LAYOUT.finditer(self.text, seen, head.start() + 1):
                if m.group(1) is None:
                    self.scopes.brace(m.group())
                else:
                    indent = len(m.group(1))
                    self.scopes.line(indent)
            parts, places, at = self._value(head.end(), end, head.group("sign"), indent, here)
            seen = at
            if any(parts) and not parts[0].startswith("${"):
                self.scopes.bind(head.group("name"), (parts, places), indent)
                self.pairs.append((head.group("name"), parts, places))

    def _value(self, at, end, sign, indent, here):
        """(parts, places, where to go on) of what follows a sign; no parts where nothing is assigned."""
        text, start = self.text, at
        at = _BLANKS.match(text, at, end).end()
        if sign == ":" and (m := _TYPED.match(text, at, end)):
            at = m.end()
        if sign != "=>" and (m := _BLOCK.match(text, at, end)):
            return self._block(m.end(), end, indent, here)
        if here and (m := _HERE.match(text, at, end)):
            found = self._here(m.end(), end, m.group(2))
            if found:
                return found
        if m := _NEXT_LINE.match(text, at, end):
            if len(m.group(1)) <= indent:
                return [], [], start
            at = m.end()
            alone = _ALONE.match(text, at, end)
            if alone and not alone.group(1).startswith(("-", "=")):
                return self._bare(alone.group(1), alone.span(1))
            if not (text.startswith(("\"", "'", "`"), at) or _PREFIX.match(text, at, end)):
                return [], [], start
        within = False
        if text.startswith("(", at):
            m = _WITHIN.match(text, at + 1, end)
            if m:
                at, within = m.end(), True
        piece = self._string(at, end)
        if piece:
            if _ASSIGNED.match(text, piece[2], end) and sign == ":" and "\n" in text[start:piece[0][1][0] if piece[0][1] else at]:
                return [], [], start      # the first key of a nested mapping
            return self._joined([piece[0]], piece[2], end, within)
        if within:
            return [], [], start
        if m := _REFERENCE.match(text, at, end):
            known = self.scopes.of(m.group().strip("${}"))
            return (*known, m.end()) if known else ([m.group()], [m.span()], m.end())
        if m := _BARE.match(text, at, end):
            word, stop = m.group(), m.end()
            if word.endswith("+") and text.startswith(("\"", "'", "`"), stop):
                word, stop = word[:-1], stop - 1
            if _IDENTIFIER.match(word) and (j := _JOIN.match(text, stop, end)) and self._string(j.end(), end):
                return self._joined([self._operand(word)], stop, end, False)
            return self._bare(word, (m.start(), m.start() + len(word)))
        return [], [], start

    def _bare(self, word, span):
        known = self.scopes.of(word) if _IDENTIFIER.match(word) else None
        return (*known, span[1]) if known else ([word], [span], span[1])

    def _operand(self, name):
        """(parts, places) of a name that is joined to something: those of one literal, or none where it is itself joined."""
        known = self.scopes.of(name)
        return known if known and len(known[0]) == 1 else ([], [])

    def _string(self, at, end):
        """((parts, places), start, end) of a string that starts here, or None."""
        text = self.text
        m = _PREFIX.match(text, at, end)
        raw = bool(m) and bool(set(m.group()) & set("rR@"))
        at = m.end() if m else at
        quote = text[at:at + 1]
        if at >= end or quote not in _QUOTED:
            return None
        three = quote * 3
        if text.startswith(three, at) and (three, end) not in self.unclosed:
            close = text.find(three, at + 3, end)
            if close >= 0:
                self.nested.append((at + 3, close, True))
                return self._lines(at + 3, close), at, close + 3
            self.unclosed.add((three, end))
        escaped, plain = _QUOTED[quote]
        m = (not raw and escaped.match(text, at, end)) or plain.match(text, at, end)
        if not m:
            return None
        inner = m.group(1)
        return ([inner if raw else unescaped(inner)], [m.span(1)] if inner else []), at, m.end()

    def _joined(self, parts, at, end, within):
        """The value that ``parts`` and what is joined to them make."""
        text = self.text
        while True:
            if m := _JOIN.match(text, at, end):
                piece = self._string(m.end(), end)
                if piece:
                    parts.append(piece[0])
                    at = piece[2]
                    continue
                m = _OPERAND.match(text, m.end(), end)
                if m and not text.startswith("(", m.end()):
                    parts.append(self._operand(m.group()))
                    at = m.end()
                    continue
            m = (_WITHIN if within else _BESIDE).match(text, at, end)
            piece = self._string(m.end(), end) if m else None
            if not piece or _ASSIGNED.match(text, piece[2], end):
                break
            parts.append(piece[0])
            at = piece[2]
        return [v for values, _ in parts for v in values], [p for _, places in parts for p in places], at

    def _lines(self, start, stop):
        """(parts, places) of several lines: without indentation, line ends and the marks around keys."""
        raw = self.text[start:stop]
        lines = [x.strip() for x in raw.split("\n")]
        a, b = start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())
        value = "".join(x for x in lines if not (x.startswith("-----") and x.endswith("-----")))
        return [value], [(a, b)] if a < b else []

    def _block(self, at, end, indent, here):
        """An indented block scalar: the lines that are deeper than that of its name."""
        start = at
        while at < end:
            stop = self.text.find("\n", at, end)
            stop = end if stop < 0 else stop + 1
            line = self.text[at:stop]
            deep = len(line) - len(line.lstrip(" \t"))
            if line.strip() and deep <= indent:
                break
            at = stop
        self.nested.append((start, at, here))
        return *self._lines(start, at), max(start - 1, at - 1)

    def _here(self, at, end, word):
        """The lines up to one that only holds the word."""
        if self.words is None:
            self.words = {}
            for m in _WORD_LINE.finditer(self.text):
                self.words.setdefault(m.group(1), []).append(m.start())
        places = self.words.get(word, [])
        i = bisect_left(places, at)
        if i == len(places) or places[i] >= end:
            return None
        self.nested.append((at, places[i], False))
        return *self._lines(at, places[i]), places[i] + len(word)


def name_literal_pairs(text):
    """(name, parts, places) of the assignments of a text: the strings that make the value, and where its literals stand.

    A bare identifier or ``$NAME`` that an earlier assignment of an open block bound to a literal stands for that
    literal (constant propagation): its pair has the earlier literal's places and the later name.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    return Lexer(text).run()
