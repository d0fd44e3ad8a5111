"""Line-search patterns: the RE2/Perl dialect, rendered for Spark's ``rlike``.

Users write RE2 syntax. ``rlike`` runs Java's engine, which differs in line ends,
``\\b``, ``\\s``, ``\\v``, classes, case folding and flags. ``compile_pattern`` checks the
pattern with the RE2 build inside pyarrow and renders it, token by token, for

* one line (``line_regex``), where ``^``/``$`` are the ends of the string,
* a whole text (``text_regex``), used to skip texts that cannot match,
* RE2 itself (``re2_line_regex``), for patterns on which a backtracking engine may
  take exponential time, and
* Python's ``re`` (``py_regex``), read only to derive facts (see ``grams``).
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc

MAX_CODE_POINT = 0x10FFFF

# The RE2 meaning of Perl and POSIX class names, as code point ranges.
DIGIT = [(0x30, 0x39)]
SPACE = [(0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20)]
WORD = [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)]
POSIX = {
    "alnum": [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)],
    "alpha": [(0x41, 0x5A), (0x61, 0x7A)],
    "ascii": [(0x00, 0x7F)],
    "blank": [(0x09, 0x09), (0x20, 0x20)],
    "cntrl": [(0x00, 0x1F), (0x7F, 0x7F)],
    "digit": DIGIT,
    "graph": [(0x21, 0x7E)],
    "lower": [(0x61, 0x7A)],
    "print": [(0x20, 0x7E)],
    "punct": [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
    "space": [(0x09, 0x0D), (0x20, 0x20)],
    "upper": [(0x41, 0x5A)],
    "word": WORD,
    "xdigit": [(0x30, 0x39), (0x41, 0x46), (0x61, 0x66)],
}
PERL = {"d": DIGIT, "s": SPACE, "w": WORD}
CONTROL_ESCAPES = {"a": 0x07, "f": 0x0C, "n": 0x0A, "r": 0x0D, "t": 0x09, "v": 0x0B}

# Letters without a simple case fold that Java's (?iu) would still pair with "i".
UNPAIRED = "\u0130\u0131"

_W = "[0-9A-Za-z_]"
_JAVA_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_JAVA_NO_BOUNDARY = f"(?:(?<!{_W})(?!{_W})|(?<={_W})(?={_W}))"


@functools.cache
def _fold_orbits() -> dict[str, frozenset[str]]:
    """Characters that are equal under simple case folding, for each cased character."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for code in range(MAX_CODE_POINT + 1):
        c = chr(code)
        if c in UNPAIRED:
            continue
        for other in (c.lower(), c.upper(), c.casefold()):
            if len(other) == 1 and other != c:
                parent[root(c)] = root(other)
    groups: dict[str, set[str]] = defaultdict(set)
    for c in list(parent):
        groups[root(c)].add(c)
    return {c: frozenset(g) for g in groups.values() for c in g}


def fold_orbit(char: str) -> frozenset[str]:
    """``char`` and every character that matches it when case is ignored."""
    if char.isascii() and not char.isalpha():
        return frozenset(char)
    return _fold_orbits().get(char, frozenset(char))


@dataclass(frozen=True)
class Token:
    """One piece of a pattern in the three target dialects."""

    java: str
    py: str
    re2: str
    word: bool = False  # matches exactly one character, always of [0-9A-Za-z_]


# Anchors are rendered late: their form depends on whether a line or a text is matched.
BEGIN_LINE, END_LINE, BEGIN_TEXT, END_TEXT = "^", "$", "A", "z"


@dataclass(frozen=True)
class LinePattern:
    """A checked pattern; see the module text for the renderings."""

    source: str
    ignore_case: bool
    tokens: tuple
    may_match_newline: bool

    def _render(self, dialect: str, anchors: dict[str, str]) -> str:
        return "".join(
            anchors[t] if isinstance(t, str) else getattr(t, dialect) for t in self.tokens
        )

    @property
    def has_text_anchor(self) -> bool:
        return BEGIN_TEXT in self.tokens or END_TEXT in self.tokens

    def line_regex(self, first: bool = False, last: bool = False) -> str:
        """Java regex for one line; ``first``/``last`` tell whether the line holds the
        start/end of the text, where ``\\A`` and ``\\z`` can hold."""
        anchors = {
            BEGIN_LINE: r"\A",
            END_LINE: r"\z",
            BEGIN_TEXT: r"\A" if first else "(?!)",
            END_TEXT: r"\z" if last else "(?!)",
        }
        return "(?d)" + self._render("java", anchors)

    @property
    def text_regex(self) -> str:
        """Java regex that finds a match in every text with a matching line."""
        anchors = {
            BEGIN_LINE: "(?m:^)",
            END_LINE: "(?m:$)",
            BEGIN_TEXT: r"\A",
            END_TEXT: r"\z",
        }
        return "(?d)" + self._render("java", anchors)

    def re2_line_regex(self, first: bool = False, last: bool = False) -> str:
        never = r"[^\x00-\x{10FFFF}]"
        anchors = {
            BEGIN_LINE: r"\A",
            END_LINE: r"\z",
            BEGIN_TEXT: r"\A" if first else never,
            END_TEXT: r"\z" if last else never,
        }
        return ("(?i)" if self.ignore_case else "") + self._render("re2", anchors)

    @property
    def py_regex(self) -> str:
        anchors = {
            BEGIN_LINE: "(?m:^)",
            END_LINE: "(?m:$)",
            BEGIN_TEXT: r"\A",
            END_TEXT: r"\Z",
        }
        return self._render("py", anchors)

    @functools.cached_property
    def parsed(self):
        """Python's reading of the pattern, or None where Python cannot read it."""
        try:
            return re._parser.parse(self.py_regex)
        except (re.error, OverflowError, RecursionError):
            return None

    @property
    def text_test_is_exact(self) -> bool:
        """True if a match in the whole text always lies inside one real line."""
        if self.may_match_newline or self.parsed is None:
            return False
        return self.parsed.getwidth()[0] > 0

    @property
    def may_backtrack(self) -> bool:
        """True if Java's engine could need more than linear time in the length of a
        line, or very deep recursion: the pattern has an unbounded repeat, repeats a
        group of several tokens, or has many optional parts. One long line (packed code,
        encoded data) would otherwise hold up a task for hours."""
        optional, opened, group = 0, [], (0, 0)
        for at, token in enumerate(self.tokens):
            java = token if isinstance(token, str) else token.java
            if java == "(?:":
                opened.append(at)
            elif java == ")":
                group = (opened.pop(), at)
            elif _REPEAT.fullmatch(java):
                most = _most_repeats(java)
                several = group[1] == at - 1 and group[1] - group[0] > 2
                if most == math.inf or (several and most > 1):
                    return True
                optional += not re.fullmatch(r"\{\d+\}\??", java)
        return optional > 4


def _most_repeats(quantifier: str) -> float:
    bounds = re.findall(r"\d+", quantifier)
    if quantifier.startswith("?"):
        return 1
    if quantifier.startswith("{") and not re.search(r",\}", quantifier):
        return int(bounds[-1])
    return math.inf


def _simplify_boundaries(tokens: list) -> None:
    """Where ``\\b`` stands next to a word character, only its other side needs a look."""

    def is_word(at: int) -> bool:
        return 0 <= at < len(tokens) and isinstance(tokens[at], Token) and tokens[at].word

    def repeat(at: int) -> str:
        token = tokens[at] if 0 <= at < len(tokens) else None
        return token.java if isinstance(token, Token) and _REPEAT.fullmatch(token.java) else ""

    def optional(quantifier: str) -> bool:
        return quantifier.startswith(("*", "?", "{0"))

    for at, token in enumerate(tokens):
        if not isinstance(token, Token) or token.java != _JAVA_BOUNDARY or repeat(at + 1):
            continue
        before = repeat(at - 1)
        if is_word(at + 1) and not optional(repeat(at + 2)):
            tokens[at] = Token(f"(?<!{_W})", token.py, token.re2)
        elif is_word(at - 2 if before else at - 1) and not optional(before):
            tokens[at] = Token(f"(?!{_W})", token.py, token.re2)


def _java_char(code: int) -> str:
    c = chr(code)
    if c.isascii() and c.isalnum():
        return c
    return f"\\x{{{code:x}}}"


def _py_char(code: int) -> str:
    return f"\\U{code:08x}"


def _literal(code: int, fold: bool, source: str) -> Token:
    chars = sorted(fold_orbit(chr(code))) if fold else [chr(code)]
    word = all(_is_word(ord(c)) for c in chars)
    if len(chars) == 1:
        return Token(_java_char(code), _py_char(code), source, word)
    java = "[" + "".join(_java_char(ord(c)) for c in chars) + "]"
    py = "[" + "".join(_py_char(ord(c)) for c in chars) + "]"
    return Token(java, py, source, word)


def _is_word(code: int) -> bool:
    return any(lo <= code <= hi for lo, hi in WORD)


def _complement(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    if at <= MAX_CODE_POINT:
        out.append((at, MAX_CODE_POINT))
    return out


def _outside(ranges: list[tuple[int, int]], fold: bool) -> list[tuple[int, int]]:
    """Complement of a named class; where case is ignored, of all its folded forms."""
    if fold:
        letters = {chr(code) for lo, hi in ranges for code in range(lo, hi + 1)}
        folded = set().union(*map(fold_orbit, letters))
        ranges = [(ord(c), ord(c)) for c in folded]
    return _complement(ranges)


def _java_property(name: str, negated: bool) -> str:
    if name.startswith("^"):
        name, negated = name[1:], not negated
    if name == "Any":
        java = r"\x{0}-\x{10ffff}"
        return f"[^{java}]" if negated else java
    java_name = name if len(name) <= 2 else f"Is{name}"
    return f"\\{'P' if negated else 'p'}{{{java_name}}}"


def _class_token(
    ranges: list[tuple[int, int]],
    properties: list[str],
    negated: bool,
    fold: bool,
    source: str,
) -> tuple[Token, bool]:
    """Render a character class; also tells whether it may match a newline."""
    caret = "^" if negated else ""
    body = "".join(
        _java_char(lo) if lo == hi else f"{_java_char(lo)}-{_java_char(hi)}" for lo, hi in ranges
    )
    java = f"[{caret}{body}{''.join(properties)}]"
    py_body = "".join(
        _py_char(lo) if lo == hi else f"{_py_char(lo)}-{_py_char(hi)}" for lo, hi in ranges
    )
    py = r"[\s\S]" if properties else f"[{caret}{py_body}]"
    if fold:
        java = f"(?iu:{java})"
        if not properties:
            listed = [c for c in UNPAIRED if any(lo <= ord(c) <= hi for lo, hi in ranges)]
            inside = [c for c in UNPAIRED if (c in listed) != negated]
            outside = [c for c in UNPAIRED if c not in inside]
            if outside:
                java = f"(?:(?![{''.join(_java_char(ord(c)) for c in outside)}]){java})"
            if inside:
                java = f"(?:[{''.join(_java_char(ord(c)) for c in inside)}]|{java})"
        if py != r"[\s\S]":
            py = f"(?i:{py})"
    if negated and not properties and not _complement(ranges):
        py = "(?!)"
    newline = bool(properties) or any(lo <= 10 <= hi for lo, hi in ranges) != negated
    word = not (negated or properties or fold) and all(
        any(low <= lo and hi <= high for low, high in WORD) for lo, hi in ranges
    )
    return Token(java, py, source, word), newline


_REPEAT = re.compile(r"[*+?]\??|\{\d+(?:,\d*)?\}\??")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<[^>]*>")
_HEX = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))")
_OCTAL = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})")
_PROPERTY = re.compile(r"\\([pP])(?:\{([^}]*)\}|(\w))")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")


class _Scanner:
    """Walks a pattern once and collects its tokens, keeping track of flags."""

    def __init__(self, source: str, ignore_case: bool):
        self.source = source
        self.at = 0
        self.tokens: list = []
        self.newline = False
        self.flags = {"i": ignore_case, "m": True, "s": False}
        self.stack: list[dict[str, bool]] = []

    def take(self, regex: re.Pattern):
        found = regex.match(self.source, self.at)
        if found:
            self.at = found.end()
        return found

    def emit(self, java: str, py: str | None = None, re2: str | None = None) -> None:
        py = java if py is None else py
        self.tokens.append(Token(java, py, java if re2 is None else re2))

    def literal(self, code: int, source: str) -> None:
        self.newline |= code == 10
        self.tokens.append(_literal(code, self.flags["i"], source))

    def run(self) -> None:
        while self.at < len(self.source):
            c = self.source[self.at]
            if c == "\\":
                self.escape()
            elif c == "[":
                self.char_class()
            elif c == "(":
                self.open_group()
            elif c == ")":
                self.at += 1
                self.flags = self.stack.pop()
                self.emit(")")
            elif c == "|":
                self.at += 1
                self.emit("|")
            elif c == "^":
                self.at += 1
                self.tokens.append(BEGIN_LINE if self.flags["m"] else BEGIN_TEXT)
            elif c == "$":
                self.at += 1
                self.tokens.append(END_LINE if self.flags["m"] else END_TEXT)
            elif c == ".":
                self.at += 1
                self.newline |= self.flags["s"]
                dot = "(?s:.)" if self.flags["s"] else "."
                self.emit(dot)
            elif found := self.take(_REPEAT):
                self.emit(found.group())
            else:
                self.at += 1
                self.literal(ord(c), re.escape(c) if c in "{}]" else c)

    def open_group(self) -> None:
        saved = dict(self.flags)
        if self.take(_NAMED):
            self.stack.append(saved)
            self.emit("(?:")
            return
        found = self.take(_FLAGS)
        if not found:
            self.at += 1
            self.stack.append(saved)
            self.emit("(?:")
            return
        for name in found.group(1):
            self.flags[name] = True
        for name in found.group(2) or "":
            self.flags[name] = False
        if found.group(3) == ":":
            self.stack.append(saved)
            self.emit("(?:", "(?:", found.group())
        else:
            self.emit("", "", found.group())

    def char_code(self) -> int | None:
        """Read an escape that stands for one character, if there is one here."""
        if found := self.take(_HEX):
            return int(found.group(1) or found.group(2), 16)
        if found := self.take(_OCTAL):
            return int(found.group(1), 8)
        c = self.source[self.at + 1]
        if c in CONTROL_ESCAPES:
            self.at += 2
            return CONTROL_ESCAPES[c]
        if not c.isalnum():
            self.at += 2
            return ord(c)
        return None

    def escape(self) -> None:
        start = self.at
        if self.source.startswith("\\Q", start):
            end = self.source.find("\\E", start)
            stop = len(self.source) if end < 0 else end
            for c in self.source[start + 2 : stop]:
                self.literal(ord(c), re.escape(c))
            self.at = len(self.source) if end < 0 else end + 2
            return
        if found := self.take(_PROPERTY):
            item = _java_property(found.group(2) or found.group(3), found.group(1) == "P")
            self.add_class([], [item], False, found.group())
            return
        code = self.char_code()
        if code is not None:
            self.literal(code, self.source[start : self.at])
            return
        c = self.source[start + 1]
        self.at += 2
        if c in "AzbB":
            if c == "A":
                self.tokens.append(BEGIN_TEXT)
            elif c == "z":
                self.tokens.append(END_TEXT)
            else:
                java = _JAVA_BOUNDARY if c == "b" else _JAVA_NO_BOUNDARY
                self.emit(java, f"\\{c}", f"\\{c}")
        elif c.lower() in PERL:
            self.add_class(PERL[c.lower()], [], c.isupper(), f"\\{c}")
        else:
            raise ValueError(f"unsupported escape \\{c} in pattern {self.source!r}")

    def add_class(self, ranges, properties, negated, source) -> None:
        token, newline = _class_token(ranges, properties, negated, self.flags["i"], source)
        self.newline |= newline
        self.tokens.append(token)

    def class_item(self) -> int | list:
        """Next class member: a code point, or ranges of a named class."""
        if found := self.take(_POSIX):
            ranges = POSIX[found.group(2)]
            return _outside(ranges, self.flags["i"]) if found.group(1) else ranges
        if found := self.take(_PROPERTY):
            return [_java_property(found.group(2) or found.group(3), found.group(1) == "P")]
        c = self.source[self.at]
        if c != "\\":
            self.at += 1
            return ord(c)
        code = self.char_code()
        if code is not None:
            return code
        name = self.source[self.at + 1]
        self.at += 2
        if name.lower() not in PERL:
            raise ValueError(f"unsupported escape \\{name} in pattern {self.source!r}")
        ranges = PERL[name.lower()]
        return _outside(ranges, self.flags["i"]) if name.isupper() else ranges

    def char_class(self) -> None:
        start = self.at
        self.at += 1
        negated = self.source[self.at] == "^"
        self.at += negated
        ranges: list[tuple[int, int]] = []
        properties: list[str] = []
        first = True
        while first or self.source[self.at] != "]":
            first = False
            item = self.class_item()
            if isinstance(item, list):
                ranges += [r for r in item if isinstance(r, tuple)]
                properties += [p for p in item if isinstance(p, str)]
                continue
            high = item
            if self.source[self.at] == "-" and self.source[self.at + 1] != "]":
                self.at += 1
                high = self.class_item()
            ranges.append((item, high))
        self.at += 1
        self.add_class(ranges, properties, negated, self.source[start : self.at])


@functools.lru_cache(maxsize=256)
def compile_pattern(pattern: str, ignore_case: bool = False) -> LinePattern:
    """Check ``pattern`` (RE2/Perl syntax) and prepare it; ``ValueError`` if it is bad."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern=pattern, ignore_case=ignore_case)
    except pa.ArrowInvalid as error:
        raise ValueError(f"bad pattern {pattern!r}: {error}") from None
    scanner = _Scanner(pattern, ignore_case)
    scanner.run()
    _simplify_boundaries(scanner.tokens)
    return LinePattern(pattern, ignore_case, tuple(scanner.tokens), scanner.newline)
