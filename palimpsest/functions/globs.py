"""Path predicates: globs, file types, path prefixes, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.regex import quote

# File types by name, with their extensions and whole file names.
FILE_TYPES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "c": ((".c", ".h"), ()),
    "cpp": ((".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++"), ()),
    "css": ((".css", ".scss", ".sass", ".less"), ()),
    "docker": ((".dockerfile",), ("Dockerfile", "Containerfile")),
    "dockerfile": ((".dockerfile",), ("Dockerfile", "Containerfile")),
    "go": ((".go",), ()),
    "html": ((".html", ".htm"), ()),
    "java": ((".java",), ()),
    "js": ((".js", ".mjs", ".cjs", ".jsx"), ()),
    "javascript": ((".js", ".mjs", ".cjs", ".jsx"), ()),
    "json": ((".json",), ()),
    "kotlin": ((".kt", ".kts"), ()),
    "lua": ((".lua",), ()),
    "make": ((".mk",), ("Makefile", "makefile", "GNUmakefile")),
    "makefile": ((".mk",), ("Makefile", "makefile", "GNUmakefile")),
    "md": ((".md", ".markdown"), ()),
    "markdown": ((".md", ".markdown"), ()),
    "perl": ((".pl", ".pm"), ()),
    "php": ((".php", ".phtml"), ()),
    "py": ((".py", ".pyw", ".pyi"), ()),
    "python": ((".py", ".pyw", ".pyi"), ()),
    "ruby": ((".rb", ".rake"), ()),
    "rust": ((".rs",), ()),
    "scala": ((".scala",), ()),
    "sh": ((".sh", ".bash", ".zsh"), ()),
    "bash": ((".sh", ".bash", ".zsh"), ()),
    "sql": ((".sql",), ()),
    "swift": ((".swift",), ()),
    "toml": ((".toml",), ()),
    "ts": ((".ts", ".mts", ".cts", ".tsx"), ()),
    "typescript": ((".ts", ".mts", ".cts", ".tsx"), ()),
    "xml": ((".xml", ".xsd", ".xsl"), ()),
    "yaml": ((".yaml", ".yml"), ()),
    "yml": ((".yaml", ".yml"), ()),
    "zig": ((".zig",), ()),
}


def lookup_type(name: str) -> tuple[list[str], list[str]] | None:
    """Extensions and whole names of a file type; names are trimmed and lower-cased."""
    found = FILE_TYPES.get(name.strip().lower())
    return None if found is None else (list(found[0]), list(found[1]))


def list_types() -> list[str]:
    return sorted(FILE_TYPES)


def basename(path: Column) -> Column:
    """What follows the last slash; of a path that ends in slashes, what precedes them."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def type_filter(path: Column, names: list[str]) -> Column:
    """True if the whole file name or the lower-cased last extension belongs to one of the types. No names: true."""
    extensions, whole = set(), set()
    for name in names:
        found = lookup_type(name)
        if found is None:
            raise ValueError(f"unknown file type '{name}'")
        extensions.update(found[0])
        whole.update(found[1])
    if not names:
        return F.lit(True)
    base = basename(path)
    return base.isin(*sorted(whole)) | F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)).isin(*sorted(extensions))


def glob_regex(glob: str) -> str:
    """An anchored pattern for a glob: ** crosses slashes, * and ? do not, [...] is a class with ! or ^ to negate."""
    out, at = ["^"], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.+/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        elif c == "*":
            out.append("[^/]*")
            at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[":
            end = glob.find("]", at + 2 if glob[at + 1:at + 2] in ("!", "^") else at + 1)
            if end < 0:
                raise ValueError(f"invalid glob pattern '{glob}': unclosed class")
            body = glob[at + 1:end]
            negated = body[:1] in ("!", "^")
            out.append("[" + "^" * negated + body[negated:].replace("[", "\\[").replace("&", "\\&") + "]")
            at = end + 1
        elif c == "\\" and at + 1 < len(glob):
            out.append(quote(glob[at + 1]))
            at += 2
        else:
            out.append(quote(c))
            at += 1
    return "".join(out) + r"\z"


def glob_filter(path: Column, globs: list[str]) -> Column:
    """The last matching rule decides, `!` rules exclude; without a match, paths pass unless a rule includes.

    Rules with a slash are matched against the whole path, others against the file name.
    """
    rules = [(g.strip().removeprefix("!"), g.strip().startswith("!")) for g in globs if g.strip()]
    verdict = F.lit(all(negated for _, negated in rules))
    for glob, negated in rules:
        target = path if "/" in glob else basename(path)
        verdict = F.when(target.rlike("(?ds)" + glob_regex(glob)), F.lit(not negated)).otherwise(verdict)
    return verdict


def prefix_filter(path: Column, prefixes: list[str], subdirectory: str = "") -> Column:
    """True for a path that is one of the prefixes or lies below it. `.` and empty ones are dropped; with none left, true.

    Prefixes given from a subdirectory are tried both below it and as they are.
    """
    wanted = []
    for p in prefixes:
        p = p.replace("\\", "/").rstrip("/").removeprefix("./")
        if p and p != ".":
            wanted += [p] + ([f"{subdirectory.strip('/')}/{p}"] if subdirectory.strip("/") else [])
    if not wanted:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in dict.fromkeys(wanted)])


def path_filter(path: Column, prefixes: list[str] = (), globs: list[str] = (), types: list[str] = (), subdirectory: str = "") -> Column:
    """All three at once."""
    return prefix_filter(path, list(prefixes), subdirectory) & glob_filter(path, list(globs)) & type_filter(path, list(types))
