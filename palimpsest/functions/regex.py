"""RE2-dialect patterns for Spark: checked against RE2 on the driver, rewritten to the dialect of RLIKE.

Both dialects mean the same by most of the syntax. What differs is rewritten: line ends are line feeds only, case folds
by Unicode, word boundaries and white space are ASCII, classes have no nesting or intersection, quantifiers are never
possessive, and what looks like syntax in one dialect only is escaped.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOT_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
SPACE = r"\t\n\f\r "
# POSIX class names and what they are called here.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
# Letters that fold differently here and there. The two i's of Turkish fold to nothing in RE2; long s and
# the Kelvin sign fold to s and k there, but not in every class here.
TURKISH, FOLDED = "\u0130\u0131", "\u017f\u212a"
OPEN_ENDED = 50  # repetitions that count as any number
QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
CATEGORY = re.compile(r"[A-Z][a-z]?&?$")


class PatternError(ValueError):
    """A pattern that RE2 rejects."""


def check(pattern: str) -> None:
    try:
        pc.match_substring_regex(pa.array([""]), pattern=pattern)
    except pa.ArrowInvalid as e:
        raise PatternError(f"invalid regular expression '{pattern}': {e}") from None


def quote(text: str) -> str:
    """A pattern, valid in both dialects, that matches the text itself."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


def _property(body: str, negated: bool) -> str:
    if body.startswith("^"):
        body, negated = body[1:], not negated
    if not CATEGORY.match(body) and body != "Any":
        body = "Is" + body
    if body == "Any":
        return r"[^\x00-\x{10FFFF}]" if negated else r"[\x00-\x{10FFFF}]"
    return rf"\{'P' if negated else 'p'}{{{body}}}"


class _Translator:
    """Reads a pattern once, from left to right; flags hold within the group that sets them."""

    def __init__(self, pattern: str, multiline: bool, ignore_case: bool):
        self.s, self.at, self.out = pattern, 0, []
        self.flags = {"m": multiline, "i": ignore_case, "s": False, "U": False}
        self.saved: list[dict] = []
        self.closed = False  # whether a group ended just before
        self.groups = self.loops = 0  # repeated groups, and open-ended repetitions of single characters

    def run(self) -> str:
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            closed, self.closed = self.closed, c == ")"
            if c == "\\":
                self._escape(False)
            elif c == "[":
                self._class()
            elif c == "(":
                self._group()
            elif c == ")":
                self.flags = self.saved.pop()
                self._put(")")
            elif c in "*+?" or c == "{" and QUANTIFIER.match(s, self.at):
                self._quantifier(closed)
            elif c in "{}]":
                self._put("\\" + c)
            elif c == "^":
                # Here, ^ matches neither in an empty text nor behind a line feed that ends the text.
                self._put(r"(?:^|\A|(?<=\n)\z)" if self.flags["m"] else r"\A")
            elif c == "$":
                self._put("$" if self.flags["m"] else r"\z")
            else:
                self._put(self._folded(c))
        return "".join(self.out)

    def _folded(self, c: str, text: str | None = None) -> str:
        """A literal, written as `text`; the letters i stand for themselves alone."""
        if not self.flags["i"] or c not in "iI" + TURKISH:
            return text or c
        return "(?-i:[iI])" if c in "iI" else f"(?-i:{c})"

    def _corrected(self, source: str, target: str) -> str:
        """A class under ignore-case, with the letters that fold differently put in or kept out as RE2 has them."""
        if not self.flags["i"]:
            return target
        letters = "iI" + TURKISH + FOLDED
        folds, plain = (dict(zip(letters, pc.match_substring_regex(pa.array(list(letters)),
            pattern=f"{flags}^(?:{source})$").to_pylist())) for flags in ("(?i)", ""))
        dotted = "iI" + TURKISH
        differ = [c for c in letters if (len({folds[x] for x in dotted}) > 1 if c in dotted else folds[c] != plain[c])]
        into, out = ("".join(c for c in differ if folds[c] is want) for want in (True, False))
        target = f"(?-i:(?![{out}])){target}" if out else target
        return f"(?:(?-i:[{into}])|{target})" if into else f"(?:{target})" if out else target

    def _put(self, text: str, width: int = 1) -> None:
        self.out.append(text)
        self.at += width

    def _quantifier(self, of_group: bool) -> None:
        m = QUANTIFIER.match(self.s, self.at)
        q = m.group() if m else self.s[self.at]
        lazy = self.s[self.at + len(q):self.at + len(q) + 1] == "?"
        after = self.at + len(q) + lazy
        if self.s[after:after + 1] in ("*", "+", "?") or QUANTIFIER.match(self.s, after):
            raise PatternError(f"invalid regular expression '{self.s}': invalid nested repetition operator")
        most = OPEN_ENDED if q in "*+" or q.endswith(",}") else 1 if q == "?" else int(q.strip("{}").rpartition(",")[2])
        self.groups += of_group and most > 1
        self.loops += not of_group and most >= OPEN_ENDED
        self._put(q + "?" * (lazy != self.flags["U"]), len(q) + lazy)

    def _escape(self, in_class: bool) -> None:
        start, before = self.at, len(self.out)
        self._escaped(in_class)
        if not in_class and self.s[start + 1:start + 2] in "wWdDsSpP":
            self.out[before:] = [self._corrected(self.s[start:self.at], "".join(self.out[before:]))]

    def _escaped(self, in_class: bool) -> None:
        s, c = self.s, self.s[self.at + 1:self.at + 2]
        if c in "bB" and not in_class:
            self._put(BOUNDARY if c == "b" else NOT_BOUNDARY, 2)
        elif c == "s":
            self._put(SPACE if in_class else f"[{SPACE}]", 2)
        elif c == "S":
            self._put(f"[^{SPACE}]", 2)
        elif c == "v":
            self._put(r"\x0B", 2)
        elif c == "Q":
            end = s.find("\\E", self.at)
            text = s[self.at + 2:end if end >= 0 else len(s)]
            quoted = "".join(self._folded(x, x if re.match(r"[\w\s]", x) else "\\" + x) for x in text)
            self._put(quoted, len(text) + (4 if end >= 0 else 2))
        elif c in "pP":
            if s[self.at + 2] == "{":
                end = s.index("}", self.at)
                self._put(_property(s[self.at + 3:end], c == "P"), end + 1 - self.at)
            else:
                self._put(_property(s[self.at + 2], c == "P"), 3)
        elif c in "01234567":
            m = re.compile(r"[0-7]{1,3}").match(s, self.at + 1)
            self._code(int(m.group(), 8), 1 + len(m.group()), in_class)
        elif c == "x" and s[self.at + 2:self.at + 3] == "{":
            end = s.index("}", self.at)
            self._code(int(s[self.at + 3:end], 16), end + 1 - self.at, in_class)
        elif c == "x":
            self._code(int(s[self.at + 2:self.at + 4], 16), 4, in_class)
        elif c == "a":
            self._put(r"\x07", 2)
        elif c == "C":
            raise PatternError(f"'{s}': \\C has no counterpart on text")
        else:
            self._put(s[self.at:self.at + 2], 2)

    def _code(self, code: int, width: int, in_class: bool) -> None:
        text = rf"\x{{{code:x}}}"
        self._put(text if in_class else self._folded(chr(code), text), width)

    def _class(self) -> None:
        s, start, before = self.s, self.at, len(self.out)
        self._put("[")
        if s[self.at] == "^":
            self._put("^")
        first = True
        while s[self.at] != "]" or first:
            c, first = s[self.at], False
            if c == "[" and (m := re.compile(r"\[:(\^?)(\w+):\]").match(s, self.at)):
                name = m.group(2)
                self._put(rf"\{'W' if m.group(1) else 'w'}" if name == "word" else rf"\{'P' if m.group(1) else 'p'}{{{POSIX[name]}}}", len(m.group()))
            elif c == "\\":
                self._escape(True)
            elif c in "[]&":
                self._put("\\" + c)
            else:
                self._put(c)
        self._put("]")
        self.out[before:] = [self._corrected(s[start:self.at], "".join(self.out[before:]))]

    def _group(self) -> None:
        s = self.s
        self.saved.append(dict(self.flags))
        if m := re.compile(r"\(\?P?<\w+>").match(s, self.at):
            self._put("(", len(m.group()))  # names differ in what they may hold; nothing here asks for them
        elif m := re.compile(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])").match(s, self.at):
            on, off = m.group(1), m.group(2) or ""
            self.flags |= dict.fromkeys(on, True) | dict.fromkeys(off, False)
            own = "".join(f + ("u" if f == "i" else "") for f in on if f in "ims") + ("-" + "".join(f for f in off if f in "ims") if any(f in "ims" for f in off) else "")
            if m.group(3) == ")":
                held = self.flags
                self.saved.pop()
                self.flags = held
                self._put(f"(?{own})" if own else "", len(m.group()))
            else:
                self._put(f"(?{own}:", len(m.group()))
        else:
            self._put("(")


def translate(pattern: str, multiline: bool = True, ignore_case: bool = False) -> str:
    """The pattern for RLIKE and its kin, with RE2's meaning under the flags m and i. Raises PatternError."""
    check(pattern)
    flags = "d" + "m" * multiline + "iu" * ignore_case
    return f"(?{flags})" + _Translator(pattern, multiline, ignore_case).run()



def repeats(pattern: str) -> tuple[int, int]:
    """(groups that may repeat, open-ended repetitions of single characters) of a pattern. Raises PatternError."""
    check(pattern)
    reader = _Translator(pattern, True, False)
    reader.run()
    return reader.groups, reader.loops
