"""Reports as DataFrames of text rows, and as text on the driver.

A result has rows (path, commit_sha, commit_ts, commit_date, author, line_num, line_text, is_match, group_id, is_binary,
submatches). The sinks below turn it into lines; their order is that of in_order(), then of lines.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.text import BAD
from palimpsest.options import SearchOptions

SHORT = 7
# The styles of terminal output.
STYLES = {"path": "35", "commit": "33", "line": "32", "match": "1;31", "separator": "36"}


def short(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT)


def shown(text: Column) -> Column:
    """A line as it is printed: with the replacement character for a byte that is not UTF-8."""
    return F.translate(text, BAD, "\ufffd")


def single_line(rows: DataFrame, line_number: bool = True) -> DataFrame:
    """Adds `out`: sha:path:line:text, with - in place of every : on context lines."""
    sep = F.when(F.col("is_match"), ":").otherwise("-")
    parts = [short(F.col("commit_sha")), sep, F.col("path"), sep] + ([F.col("line_num").cast("string"),
        sep] if line_number else []) + [shown(F.col("line_text"))]
    return rows.withColumn("out", F.when(F.col("is_binary"), binary_notice()).otherwise(F.concat(*parts)))


def grouped_line(line_number: bool = True) -> Column:
    """A line below its file and commit: number, : or -, text."""
    sep = F.when(F.col("is_match"), ":").otherwise("-")
    text = shown(F.col("line_text"))
    return F.concat(F.col("line_num").cast("string"), sep, text) if line_number else text


def subheader() -> Column:
    """[sha date author], without what is missing."""
    return F.concat(F.lit("["), F.concat_ws(" ", short(F.col("commit_sha")), F.nullif("commit_date", F.lit("")), F.nullif("author", F.lit(""))), F.lit("]"))


def binary_notice() -> Column:
    return F.concat(F.lit("Binary file "), F.col("path"), F.lit(" matches in "), short(F.col("commit_sha")))


def files_with_matches(rows: DataFrame) -> DataFrame:
    """sha:path, each once; commits whose short names agree count as one."""
    return rows.select(F.concat_ws(":", short(F.col("commit_sha")), F.col("path")).alias("out")).distinct()


def counts(rows: DataFrame) -> DataFrame:
    """sha:path:n for each commit and path with matches; a binary hit counts 1."""
    n = F.sum((F.col("is_match") | F.col("is_binary")).cast("long"))
    per = rows.groupBy("commit_sha", "path", "commit_ts").agg(n.alias("n")).where("n > 0")
    return per.withColumn("out", F.concat_ws(":", short(F.col("commit_sha")), F.col("path"), F.col("n").cast("string")))


def use_color(choice: str, stream=None, environ: dict | None = None) -> bool:
    """always and ansi: yes; never: no; auto: on a terminal that is not dumb, unless NO_COLOR is set."""
    env = os.environ if environ is None else environ
    if choice in ("always", "ansi"):
        return True
    stream = stream or sys.stdout
    return choice == "auto" and not env.get("NO_COLOR") and env.get("TERM") != "dumb" and bool(getattr(stream, "isatty", lambda: False)())


def painter(on: bool) -> Callable[[str, str], str]:
    return (lambda style, text: f"\x1b[{STYLES[style]}m{text}\x1b[0m" if text else text) if on else lambda style, text: text


def highlight(text: str, spans: Iterable, paint: Callable[[str, str], str]) -> str:
    """The text with its byte spans painted; spans that are empty, out of range or overlap an earlier one are passed over."""
    raw, out, at = text.encode().replace(BAD.encode(), b"\xff"), [], 0
    for start, end in sorted((int(s[0]), int(s[1])) for s in spans or ()):
        if at <= start < end <= len(raw):
            out += [raw[at:start].decode(errors="replace"), paint("match", raw[start:end].decode(errors="replace"))]
            at = end
    return "".join(out) + raw[at:].decode(errors="replace")


def render(rows: Iterable, options: SearchOptions, color: bool = False) -> Iterator[str]:
    """Lines of the report for rows that come in order: files first, then commits, then lines. Holds one row at a time."""
    paint = painter(color)
    path = commit = group = None
    listed: set = set()
    for r in rows:
        sha = r["commit_sha"][:SHORT]
        if options.files_with_matches:
            if (sha, r["path"]) not in listed:
                listed = {(sha, r["path"])} | (listed if r["path"] == path else set())
                path = r["path"]
                yield paint("commit", sha) + paint("separator", ":") + paint("path", path)
            continue
        sep = paint("separator", ":" if r["is_match"] or r["is_binary"] else "-")
        heading = options.heading
        new_file, new_commit = r["path"] != path, r["path"] != path or r["commit_sha"] != commit
        if heading and new_file:
            if path is not None:
                yield ""
            yield paint("path", r["path"])
        if heading and new_commit:
            yield paint("commit", "[" + " ".join(x for x in (sha, r["commit_date"], r["author"]) if x) + "]")
        if not new_commit and (options.before_context or options.after_context) and r["group_id"] != group:
            yield paint("separator", "--")
        path, commit, group = r["path"], r["commit_sha"], r["group_id"]
        if r["is_binary"]:
            yield f"Binary file {paint('path', path)} matches in {paint('commit', sha)}"
            continue
        text = highlight(r["line_text"], r["submatches"], paint) if color and r["is_match"] else r["line_text"].replace(BAD, "\ufffd")
        number = paint("line", str(r["line_num"])) + sep if options.line_number else ""
        yield (number if heading else paint("commit", sha) + sep + paint("path", path) + sep + number) + text
