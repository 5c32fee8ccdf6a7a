"""Globs as predicates Spark can push down or run as one regular expression.

A pattern is read once on the driver into pieces (literal text, `*`, `**`, or a ready regular expression)
and then expressed as the cheapest test that means the same: equality, prefix, suffix, substring, and only
otherwise a regular expression. Classes are written without `/`, so no lookahead is needed.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from objcat.errors import PatternError
from objcat.schema import as_col

# What a pattern may not exceed.
MAX_PATTERN_CHARS = 1024
MAX_NESTING = 16

STAR, GLOBSTAR = "star", "globstar"


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else f"\\x{{{ord(c):x}}}" for c in text)


class _Reader:
    """Walks a pattern and yields (kind, value) pieces."""

    def __init__(self, pattern: str):
        self.pattern, self.at, self.nesting = pattern, 0, 0

    def refuse(self, index: int, problem: str):
        raise PatternError(self.pattern, index + 1, problem)

    def char(self, ahead: int = 0) -> str:
        index = self.at + ahead
        return self.pattern[index] if index < len(self.pattern) else ""

    def pieces(self, closers: str = "") -> list[tuple[str, str]]:
        found: list[tuple[str, str]] = []
        while (c := self.char()) and c not in closers:
            if c == "\\":
                if not self.char(1):
                    self.refuse(self.at, "trailing escape")
                found.append(("text", self.char(1)))
                self.at += 2
            elif c == "*":
                wide = self.char(1) == "*"
                found.append((GLOBSTAR if wide else STAR, ""))
                self.at += 2 if wide else 1
            elif c == "?":
                found.append(("regex", "[^/]"))
                self.at += 1
            elif c == "[":
                found.append(("regex", self.char_class()))
            elif c == "{":
                found.append(("choice", self.choice()))
            else:
                found.append(("text", c))
                self.at += 1
        return _merge(found)

    def choice(self):
        opened = self.at
        if self.nesting == MAX_NESTING:
            self.refuse(opened, "nested too deep")
        self.nesting += 1
        branches = []
        while self.char() != "}" or not branches:
            self.at += 1
            branches.append(self.pieces(",}"))
            if not self.char():
                self.refuse(opened, "unclosed alternation")
            if self.char() == "}":
                break
        self.at += 1
        self.nesting -= 1
        return branches

    def char_class(self) -> str:
        opened = self.at
        self.at += 1
        negated = self.char() in ("!", "^") and self.char() != ""
        if negated:
            self.at += 1
        spans: list[tuple[int, int]] = []
        start = self.at
        while True:
            c = self.char()
            if not c:
                self.refuse(opened, "unclosed class")
            if c == "]" and self.at > start:
                self.at += 1
                return _class_regex(spans, negated)
            if c == "[" and self.char(1) == ":":
                self.refuse(self.at, "named class")
            if c == "\\":
                if self.char(1) in tuple("dDsSwW"):
                    self.refuse(self.at, "named class")
                if not self.char(1):
                    self.refuse(self.at, "trailing escape")
                self.at += 1
            low = self.char()
            if self.char(1) == "-" and self.char(2) not in ("", "]"):
                high = self.char(2)
                if high < low:
                    self.refuse(self.at, "reversed range")
                spans.append((ord(low), ord(high)))
                self.at += 3
            else:
                spans.append((ord(low), ord(low)))
                self.at += 1


def _class_regex(spans: list[tuple[int, int]], negated: bool) -> str:
    slash = ord("/")
    if negated:
        pieces = [*spans, (slash, slash)]
    else:
        pieces = []
        for low, high in spans:
            if low <= slash <= high:
                pieces += [(low, slash - 1)] if low < slash else []
                pieces += [(slash + 1, high)] if high > slash else []
            else:
                pieces.append((low, high))
    if not pieces:
        return r"[^\x{0}-\x{10ffff}]"
    body = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in pieces)
    return f"[{'^' if negated else ''}{body}]"


def _merge(found: list[tuple]) -> list[tuple]:
    """Join neighbouring text, and let `**` swallow the stars beside it."""
    out: list[tuple] = []
    for kind, value in found:
        last = out[-1][0] if out else ""
        if kind == "text" and last == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif kind in (STAR, GLOBSTAR) and last == GLOBSTAR:
            continue
        elif kind == GLOBSTAR and last == STAR:
            out[-1] = (kind, value)
        elif kind == STAR and last == STAR:
            continue
        else:
            out.append((kind, value))
    return out


def read_glob(pattern: str) -> list[tuple]:
    """The pieces of a pattern; a pattern that means nothing is refused with its position."""
    if pattern == "":
        raise PatternError(pattern, 1, "empty pattern")
    if len(pattern) > MAX_PATTERN_CHARS:
        raise PatternError(pattern, MAX_PATTERN_CHARS + 1, "pattern too long")
    return _Reader(pattern).pieces()


def pieces_regex(pieces: list[tuple], one_component: bool = False) -> str:
    """The pieces as a regular expression; inside one component `**` has no slash to cross."""
    wide = "[^/]*" if one_component else ".*"
    out = []
    for kind, value in pieces:
        if kind == "text":
            out.append(_quote(value))
        elif kind == STAR:
            out.append("[^/]*")
        elif kind == GLOBSTAR:
            out.append(wide)
        elif kind == "choice":
            out.append("(?:" + "|".join(pieces_regex(b, one_component) for b in value) + ")")
        else:
            out.append(value)
    return "".join(out)


def glob_regex(pattern: str) -> str:
    return rf"(?s)\A{pieces_regex(read_glob(pattern))}\z"


def glob_match(col: Column | str, pattern: str) -> Column:
    """Full match of one glob against a text column."""
    return whole_match(as_col(col), read_glob(pattern))


def literals(pieces: list[tuple]) -> list[str]:
    """Text that every match holds."""
    return [value for kind, value in pieces if kind == "text"]


def _guarded(col: Column, pieces: list[tuple], regex: str, from_start: bool = False) -> Column:
    """The regular expression behind tests of the text it cannot do without: they cost little and reach the scan."""
    test = col.rlike("(?s)" + regex)
    last = len(pieces) - 1
    for place, (kind, value) in reversed(list(enumerate(pieces))):
        if kind == "text":
            needed = col.endswith(value) if place == last else col.startswith(value) if from_start and place == 0 else col.contains(value)
            test = needed & test
    return test


def whole_match(col: Column, pieces: list[tuple]) -> Column:
    kinds = [k for k, _ in pieces]
    texts = [v for k, v in pieces if k == "text"]
    if kinds == ["text"]:
        return col == texts[0]
    if kinds == [GLOBSTAR]:
        return col.isNotNull()
    if kinds == ["text", GLOBSTAR]:
        return col.startswith(texts[0])
    if kinds == [GLOBSTAR, "text"]:
        return col.endswith(texts[0])
    if kinds == [GLOBSTAR, "text", GLOBSTAR]:
        return col.contains(texts[0])
    return _guarded(col, pieces, rf"\A{pieces_regex(pieces)}\z", from_start=True)


def name_match(col: Column, pieces: list[tuple]) -> Column:
    """Full match against the file name of a path (the pattern text holds no `/`)."""
    kinds = [k for k, _ in pieces]
    texts = [v for k, v in pieces if k == "text"]
    if kinds == ["text"]:
        return (col == texts[0]) | col.endswith("/" + texts[0])
    if kinds in ([STAR], [GLOBSTAR]):
        return col.isNotNull()
    if kinds in ([STAR, "text"], [GLOBSTAR, "text"]):
        return col.endswith(texts[0])
    return _guarded(col, pieces, rf"(?:\A|/){pieces_regex(pieces, one_component=True)}\z")


def suffix_match(col: Column, pieces: list[tuple]) -> Column:
    """Full match against the path or any tail that starts after a `/`."""
    kinds = [k for k, _ in pieces]
    texts = [v for k, v in pieces if k == "text"]
    if kinds == ["text"]:
        return (col == texts[0]) | col.endswith("/" + texts[0])
    if kinds == ["text", GLOBSTAR]:
        return col.startswith(texts[0]) | col.contains("/" + texts[0])
    if kinds == [GLOBSTAR, "text"]:
        return col.endswith(texts[0])
    return _guarded(col, pieces, rf"\A(?:.*/)?(?:{pieces_regex(pieces)})\z")


def composed(pattern: str) -> str:
    """Patterns are compared with composed paths, so they are composed too."""
    return unicodedata.normalize("NFC", pattern)
