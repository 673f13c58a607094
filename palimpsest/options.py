"""Search options: defaults, the command line's grammar, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timedelta, timezone

from palimpsest.functions.globs import lookup_type
from palimpsest.functions.regex import PatternError, check, quote, translate


class OptionError(ValueError):
    """Options that cannot be run; the command line exits with 2."""


@dataclass(frozen=True)
class SearchOptions:
    patterns: tuple[str, ...] = ()
    fixed_strings: bool = False
    ignore_case: bool = False
    case_sensitive: bool = False
    smart_case: bool = False
    word_regexp: bool = False
    invert_match: bool = False
    line_number: bool = True
    files_with_matches: bool = False
    count: bool = False
    before_context: int = 0
    after_context: int = 0
    max_count: int = 0
    quiet: bool = False
    text: bool = False
    color: str = "auto"
    heading: bool = True
    globs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    all: bool = False
    first_parent: bool = False
    since: str = ""
    until: str = ""
    author: str = ""
    committer: str = ""
    branches: tuple[str, ...] = ()
    uncommitted: bool = False
    expand_commits: bool = False
    unordered: bool = False
    rev_range: str = ""
    subdirectory: str = ""
    help: bool = False
    long_help: bool = field(default=False)
    version: bool = False

    def with_(self, **changes) -> SearchOptions:
        return replace(self, **changes)

    def folds_case(self) -> bool:
        """Ignore-case wins over case-sensitive, which wins over smart case; smart case looks at the raw patterns."""
        if self.ignore_case:
            return True
        return not self.case_sensitive and self.smart_case and not any(c.isupper() for p in self.patterns for c in p)

    def pattern(self) -> str:
        """All patterns as one, in the dialect they are written in."""
        parts = [quote(p) if self.fixed_strings else p for p in self.patterns]
        return "|".join(f"(?:{rf'\b(?:{p})\b' if self.word_regexp else p})" for p in parts)

    def regex(self) -> str:
        """The pattern for RLIKE."""
        return translate(self.pattern(), multiline=True, ignore_case=self.folds_case())

    def literal(self) -> str | None:
        """The text to look for, if that is all there is to it."""
        plain = len(self.patterns) == 1 and not self.word_regexp and not self.folds_case()
        return self.patterns[0] if plain and (self.fixed_strings or self.patterns[0] == quote(self.patterns[0])) and self.patterns[0] else None

    def validate(self) -> SearchOptions:
        if self.help or self.version:
            return self
        if not self.patterns:
            raise OptionError("pattern is required")
        try:
            for p in self.patterns:
                if not self.fixed_strings:
                    check(rf"\b(?:{p})\b" if self.word_regexp else p)
            self.regex()
            for name in ("author", "committer"):
                if getattr(self, name):
                    check(getattr(self, name))
        except PatternError as e:
            raise OptionError(str(e)) from None
        if self.rev_range:
            check_rev_spec(self.rev_range)
        for b in self.branches:
            if not b.strip() or ".." in b or "/" in b or "\\" in b or any(ord(c) < 32 or ord(c) == 127 for c in b):
                raise OptionError(f"invalid branch name '{b}'")
        for p in self.paths:
            if not p.strip() or "\0" in p:
                raise OptionError(f"invalid path filter '{p}'")
        for name in ("since", "until"):
            if getattr(self, name).strip():
                parse_date(getattr(self, name))
        for name in ("before_context", "after_context", "max_count"):
            if getattr(self, name) < 0:
                raise OptionError(f"{name} must not be negative")
        if self.color not in ("auto", "always", "never", "ansi"):
            raise OptionError(f"invalid color choice '{self.color}'")
        if any("\0" in g for g in self.globs):
            raise OptionError("glob contains a null byte")
        for t in self.types:
            if "\0" in t or lookup_type(t) is None:
                raise OptionError(f"unknown file type '{t}'")
        return self


def check_rev_spec(spec: str) -> None:
    spec = spec.strip()
    if "../" in spec or "..\\" in spec or spec[:1] in ("/", "\\") or any(ord(c) < 32 or ord(c) == 127 for c in spec):
        raise OptionError(f"invalid revision range '{spec}'")
    parts = spec.split("..")
    if len(parts) > 2:
        raise OptionError(f"more than one '..' in revision '{spec}'")
    for p in parts:
        if p.strip() or len(parts) == 1:
            _check_rev(p.strip(), spec)


def _check_rev(rev: str, spec: str) -> None:
    m = re.fullmatch(r"([^~^]*)(?:~(\+?\d+)|\^(\+?\d*))?(.*)", rev, re.S)
    base, rest = m.group(1), m.group(4)
    if not base or rest or re.search(r"\s", rev) or base[0] in "/." or "@{" in base and not base.endswith("}"):
        raise OptionError(f"invalid revision '{rev}' in '{spec}'")


# The date formats that filters accept.
DATE_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%a, %d %b %Y %H:%M:%S %Z", "%d %b %y %H:%M %Z", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S",
    "%m/%d/%Y", "%d-%b-%Y")
RELATIVE = re.compile(r"(\d+)\s+(second|minute|hour|day|week|month|year)s?(?:\s+ago)?")


def parse_date(text: str, now: datetime | None = None) -> datetime:
    """An instant from Unix seconds, RFC 3339, the formats above, or a relative phrase; in UTC where no zone is named."""
    s = text.strip()
    now = now or datetime.now(timezone.utc)
    if re.fullmatch(r"[+-]?\d+", s):
        return datetime.fromtimestamp(int(s), timezone.utc)
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)", s):
        return datetime.fromisoformat(s).astimezone(timezone.utc)
    for f in DATE_FORMATS:
        try:
            return datetime.strptime(s, f).replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    low = s.lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if low in ("now", "today", "yesterday"):
        return {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1)}[low]
    if m := RELATIVE.fullmatch(low):
        n, unit = int(m.group(1)), m.group(2)
        days = {"day": 1, "week": 7, "month": 30, "year": 365}
        return now - (timedelta(days=n * days[unit]) if unit in days else timedelta(**{unit + "s": n}))
    raise OptionError(f"unrecognized date format '{text}'")


# The command line: long flags by kind, and the short ones that stand for them.
BOOLEAN = {
    "ignore-case": {"ignore_case": True, "case_sensitive": False, "smart_case": False},
    "case-sensitive": {"case_sensitive": True, "ignore_case": False, "smart_case": False},
    "smart-case": {"smart_case": True, "ignore_case": False, "case_sensitive": False},
    "fixed-strings": {"fixed_strings": True},
    "word-regexp": {"word_regexp": True},
    "invert-match": {"invert_match": True},
    "line-number": {"line_number": True},
    "no-line-number": {"line_number": False},
    "files-with-matches": {"files_with_matches": True},
    "count": {"count": True},
    "quiet": {"quiet": True},
    "text": {"text": True},
    "heading": {"heading": True},
    "no-heading": {"heading": False},
    "all": {"all": True},
    "first-parent": {"first_parent": True},
    "uncommitted": {"uncommitted": True},
    "expand-commits": {"expand_commits": True},
    "all-commits": {"expand_commits": True},
    "unordered": {"unordered": True},
}
NUMBER = {"context": ("before_context", "after_context"), "after-context": ("after_context",), "before-context": ("before_context",),
    "max-count": ("max_count",)}
TEXT = {"since": "since", "until": "until", "author": "author", "committer": "committer"}
LISTS = {"glob": "globs", "type": "types", "regexp": "patterns", "branch": "branches"}
SHORT = {
    "h": "help", "V": "version", "i": "ignore-case", "s": "case-sensitive", "S": "smart-case", "F": "fixed-strings", "w": "word-regexp",
        "v": "invert-match", "n": "line-number",
    "N": "no-line-number", "l": "files-with-matches", "c": "count", "q": "quiet", "a": "text", "H": "heading", "C": "context", "A": "after-context",
        "B": "before-context",
    "m": "max-count", "g": "glob", "t": "type", "e": "regexp",
}
TAKES = {*NUMBER, *TEXT, *LISTS}
YES, NO = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def parse_args(args: list[str]) -> SearchOptions:
    """PATTERN [REV] [PATH...] [-- PATH...] with flags anywhere before `--`; with -e, no PATTERN. Not yet validated."""
    got: dict = {}
    positional, after, at = [], [], 0

    def put(name: str, value: str | None) -> None:
        if name == "help":
            got.update(help=True, long_help=True)
        elif name == "version":
            got["version"] = True
        elif name == "color":
            if value is not None and value.lower() not in ("auto", "always", "never", "ansi"):
                raise OptionError(f"invalid argument '{value}' for '--color'")
            got["color"] = (value or "always").lower()
        elif name in NUMBER:
            if not re.fullmatch(r"\+?\d+", value):
                raise OptionError(f"invalid {name} value '{value}': must be a non-negative integer")
            got.update(dict.fromkeys(NUMBER[name], int(value)))
        elif name in TEXT:
            got[TEXT[name]] = value
        elif name in LISTS:
            got[LISTS[name]] = (*got.get(LISTS[name], ()), value)
        elif name in BOOLEAN:
            if value is not None and value.lower() not in YES + NO:
                raise OptionError(f"invalid boolean value '{value}'")
            if value is None or value.lower() in YES:
                got.update(BOOLEAN[name])
            elif name == "ignore-case":
                got.update(ignore_case=False, case_sensitive=True)  # smart case, if set, stays set but is outranked
            else:
                field_, on = next(iter(BOOLEAN[name].items()))
                got[field_] = not on
        else:
            raise OptionError(f"unknown flag: '--{name}'")

    while at < len(args):
        arg = args[at]
        at += 1
        if arg == "--":
            after = args[at:]
            break
        if arg.startswith("--"):
            name, eq, value = arg[2:].partition("=")
            if name in TAKES and not eq:
                if at >= len(args):
                    raise OptionError(f"flag '--{name}' requires an argument")
                value, at = args[at], at + 1
            elif name == "color" and not eq and at < len(args) and args[at].lower() in ("auto", "always", "never", "ansi"):
                value, eq, at = args[at], "=", at + 1
            put(name, value if eq or name in TAKES else None)
        elif arg.startswith("-") and len(arg) > 1:
            k = 1
            while k < len(arg):
                name = SHORT.get(arg[k])
                if name is None:
                    raise OptionError(f"unknown flag: '-{arg[k]}'")
                k += 1
                if name in TAKES:
                    value = arg[k:].removeprefix("=") if k < len(arg) else None
                    if value is None:
                        if at >= len(args):
                            raise OptionError(f"flag '-{arg[k - 1]}' requires an argument")
                        value, at = args[at], at + 1
                    put(name, value)
                    break
                if name == "help":
                    got["help"] = True
                else:
                    put(name, None)
        else:
            positional.append(arg)
    if not (got.get("help") or got.get("version")):
        if not got.get("patterns"):
            if not positional:
                raise OptionError("pattern is required")
            got["patterns"], positional = (positional[0],), positional[1:]
        if positional:
            got["rev_range"] = positional[0]
        got["paths"] = (*positional[1:], *after)
    known = {f.name for f in fields(SearchOptions)}
    return SearchOptions(**{k: v for k, v in got.items() if k in known})
