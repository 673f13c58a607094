"""A query for each operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import globs
from palimpsest.operators import attribution, history, text, treediff
from palimpsest.options import OptionError, SearchOptions, parse_args
from palimpsest.plans.engine import Source, from_git, search, select_commits
from palimpsest.sinks import render
from palimpsest.sinks.gitpack import History, write_blobs, write_trees
from palimpsest.sources import gitstore, tables
from palimpsest.sources.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query
    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Pieces of SQL that stand for the derived tables of palimpsest.sources.tables.
BLOBS = "blobs AS (SELECT DISTINCT sha1(text) AS blob_oid, text AS content FROM documents)"
EDGES = BLOBS + """, edge AS (SELECT blob_oid, CASE length(content) % 5 WHEN 0 THEN content || chr(13) || chr(10) WHEN 1 THEN content || chr(10) ELSE content END AS content FROM blobs)"""


def _lines_of(source: str) -> str:
    """Lines (blob_oid, content, line_num, line_text) of a table of blobs."""
    return f"""lines AS (SELECT blob_oid, content, p::INT AS line_num, CASE
  WHEN ends_with(line, chr(13)) THEN left(line, length(line)::INT - 1) ELSE line END AS line_text
  FROM (SELECT blob_oid, content, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS p, len(parts) AS n
  FROM (SELECT blob_oid, content, string_split(content, chr(10)) AS parts FROM {source}))
  WHERE NOT (p = n AND line = ''))"""


LONG = """joined AS (SELECT coalesce(string_agg(translate(text, chr(10) || chr(13), '  '), ' ' ORDER BY doc_id, text), '') AS content FROM documents GROUP BY source, doc_id // 20),
blobs AS (SELECT DISTINCT sha1(content) AS blob_oid, content FROM joined)"""
EXT = "['.go', '.py', '.md', '.json', '.rs', '.sql', '.txt'][(doc_id % 7 + 1)::INT]"
OCC = f"""occ AS (SELECT sha1(d.text) AS blob_oid, d.source || '/m' || ((doc_id // 20) % 10)::BIGINT || {EXT} AS path, sha1(doc_id::VARCHAR) AS commit_sha, e.ts AS commit_ts, 'user_' || e.user_id AS author_name
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""
INTRO = "intro AS (SELECT blob_oid, path, min(ROW(commit_ts, commit_sha, author_name)) AS o FROM occ GROUP BY blob_oid, path)"
INTRO += ", sel AS (SELECT blob_oid, path, o[1] AS commit_ts, o[2] AS commit_sha, o[3] AS author_name FROM intro)"
ORDERS = """o0 AS (SELECT o_orderkey, o_custkey, o_orderdate::TIMESTAMP AS commit_ts, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
firsts AS (SELECT o_custkey + 1 AS o_custkey, min(o_orderkey) AS other FROM orders GROUP BY 1),
commits AS (SELECT o_orderkey::VARCHAR AS sha, parent::VARCHAR AS p1, CASE WHEN o_orderkey % 5 = 0 AND parent IS NOT NULL
  AND other IS NOT NULL THEN other::VARCHAR END AS p2, commit_ts, o0.o_custkey AS cust
  FROM o0 LEFT JOIN firsts ON o0.o_custkey = firsts.o_custkey),
edges AS (SELECT sha AS child, p1 AS parent FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT sha, p2 FROM commits WHERE p2 IS NOT NULL)"""
FILES = """f0 AS (SELECT l_orderkey::VARCHAR AS root, 'part/' || (l_partkey % 40)::VARCHAR || '.txt' AS path, CASE
  WHEN l_partkey % 10 = 0 THEN 40960 ELSE 33188 END AS mode,
  sha1((l_partkey % 40)::VARCHAR || ':' || (q % 3)::INT::VARCHAR) AS oid FROM (SELECT l_orderkey, l_partkey, min(l_quantity) AS q FROM lineitem GROUP BY ALL)),
files AS (SELECT root, path, f.mode, f.oid FROM (SELECT root, path, min({'mode': mode, 'oid': oid}) AS f FROM f0 GROUP BY root, path))"""


def _search(name: str, options: SearchOptions, condition: str, edge: bool = False) -> None:
    """Matching lines (blob_oid, line_num, line_text). condition: of `t`, for the blob (if it does not start with NOT) and the line."""
    blob = "true" if condition.startswith("NOT") else condition.replace("$t", "content")

    @register(name,
        f"WITH {EDGES if edge else BLOBS}, {_lines_of('edge' if edge else 'blobs')} SELECT blob_oid, line_num, line_text FROM lines WHERE {blob} AND {condition.replace('$t', 'line_text')}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blobs = (tables.edge_blobs if edge else tables.blobs)(spark, sf_dir)
        return text.match_lines(blobs, options).select("blob_oid", "line_num", "line_text")


def _re(pattern: str, flags: str = "m") -> str:
    return f"regexp_matches($t, '(?{flags}){pattern}')"


def O(*patterns: str, **options) -> SearchOptions:  # noqa: E743, N802
    return SearchOptions(patterns=patterns, **options)


_search("search_regex", O(r"\b\w+tion,?\s+the\b"), _re(r"\b\w+tion,?\s+the\b"))
_search("search_ignore_case", O("LICENSE", ignore_case=True), _re("LICENSE", "mi"))
_search("search_ignore_case_unicode", O("É[a-z]+T", ignore_case=True), _re("É[a-z]+T", "mi"))
_search("search_smart_case_lower", O("thing", smart_case=True), _re("thing", "mi"))
_search("search_smart_case_upper", O("Thing", smart_case=True), _re("Thing"))
_search("search_case_sensitive", O("The", case_sensitive=True, smart_case=True), _re("The"))
_search("search_ignore_case_dotless", O("[a-z]+istr|licen[s]", ignore_case=True), _re("[a-z]+istr|licen[s]", "mi"))
_search("search_fixed", O("ed. T", fixed_strings=True), "contains($t, 'ed. T')")
_search("search_fixed_ignore_case", O("ED. t", fixed_strings=True, ignore_case=True), _re(r"ED\. t", "mi"))
_search("search_word", O("than", word_regexp=True), _re(r"\bthan\b"))
_search("search_multi_pattern", O("idiot", r"\+1 \(\d{3}\)", "^En"), _re(r"(?:idiot)|(?:\+1 \(\d{3}\))|(?:^En)"))
_search("search_invert", O("[aeiou]{3}", invert_match=True), "NOT " + _re("[aeiou]{3}"))
_search("search_line_ends", O(r"\.$"), _re(r"\.$"), edge=True)
_search("search_posix_class", O(r"^[[:upper:]][[:alpha:]]+,[[:space:]]"), _re(r"^[[:upper:]][[:alpha:]]+,[[:space:]]"))
_search("search_blob_ends", O(r"\A[A-D]"), _re(r"\A[A-D]"), edge=True)


@register("blob_prefilter", rf"WITH {EDGES} SELECT blob_oid, length(content)::BIGINT AS n FROM edge WHERE regexp_matches(content, '(?m)ing\.$')")
def blob_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.prefilter(tables.edge_blobs(spark, sf_dir), O(r"ing\.$")).select("blob_oid", F.length("content").cast("long").alias("n"))


@register("blob_prefilter_inverted", f"WITH {BLOBS} SELECT blob_oid FROM blobs WHERE NOT regexp_matches(content, '(?m)the')")
def blob_prefilter_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.blobs(spark, sf_dir).where(text.blob_matches(F.col("content"), O("the", invert_match=True))).select("blob_oid")


@register("split_lines", f"WITH {EDGES}, {_lines_of('edge')} SELECT blob_oid, line_num, line_text FROM lines")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.split_lines(tables.edge_blobs(spark, sf_dir)).select("blob_oid", "line_num", "line_text")


# Patterns with repeated groups over lines of many documents: backtracking takes a stack frame for each turn there.
REPEATED = r"(?:\w+,?\s)+the|\"(?:[^\"\\]|\\.)*\""


def _spans_sql(blobs: str, pattern: str) -> str:
    return f"""WITH {blobs}, {_lines_of('blobs')},
m AS (SELECT blob_oid, line_num, unnest(range(1, len(h) + 1)) AS i, g, h
  FROM (SELECT blob_oid, line_num, string_split_regex(line_text, '{pattern}') AS g, regexp_extract_all(line_text, '{pattern}') AS h FROM lines
  WHERE regexp_matches(line_text, '{pattern}'))),
e AS (SELECT blob_oid, line_num, i, octet_length(encode(h[i])) AS n, sum(octet_length(encode(g[i])) + octet_length(encode(h[i]))) OVER (PARTITION BY blob_oid, line_num ORDER BY i) AS e FROM m)
SELECT blob_oid, line_num, (e - n)::INT AS start, e::INT AS "end" FROM e"""


@register("search_repeated_groups", f"WITH {LONG}, {_lines_of('blobs')} SELECT blob_oid, line_num FROM lines WHERE regexp_matches(line_text, '(?m)^(\\S+\\s)+\\S+$|(a|e)*ly of')")
def search_repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.match_lines(tables.long_blobs(spark, sf_dir), O(r"^(\S+\s)+\S+$|(a|e)*ly of")).select("blob_oid", "line_num")


@register("search_repeated_groups_inverted", f"WITH {BLOBS}, {_lines_of('blobs')} SELECT blob_oid, line_num FROM lines WHERE NOT regexp_matches(line_text, '(?mi)(?:[aeiou][a-z])+[ns]\\b')")
def search_repeated_groups_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = O(r"(?:[aeiou][a-z])+[ns]\b", ignore_case=True, invert_match=True)
    return text.match_lines(tables.blobs(spark, sf_dir), options).select("blob_oid", "line_num")


@register("submatch_spans_repeated_groups", _spans_sql(LONG, REPEATED))
def submatch_spans_repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.match_lines(tables.long_blobs(spark, sf_dir), O(REPEATED))
    return lines.select("blob_oid", "line_num", F.inline(text.spans(F.col("line_text"), O(REPEATED))))


@register("context_repeated_groups", f"""WITH {BLOBS}, {_lines_of('blobs')},
h AS (SELECT blob_oid, line_num, line_text, regexp_matches(line_text, '(?:\\w+\\s)+than\\b') AS hit FROM lines WHERE regexp_matches(content, '(?m)(?:\\w+\\s)+than\\b')),
w AS (SELECT blob_oid, line_num, hit, bool_or(hit) OVER (PARTITION BY blob_oid ORDER BY line_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
SELECT blob_oid, line_num, hit AS is_match FROM w WHERE near""")
def context_repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = O(r"(?:\w+\s)+than\b", before_context=1, after_context=1)
    return text.context_lines(tables.blobs(spark, sf_dir), options).select("blob_oid", "line_num", "is_match")


@register("submatch_spans", f"""WITH {BLOBS}, {_lines_of('blobs')},
m AS (SELECT blob_oid, line_num, unnest(range(1, len(h) + 1)) AS i, g, h
  FROM (SELECT blob_oid, line_num, string_split_regex(line_text, 'é\\w+|th\\w+') AS g, regexp_extract_all(line_text, 'é\\w+|th\\w+') AS h FROM lines
  WHERE regexp_matches(line_text, 'é\\w+|th\\w+'))),
e AS (SELECT blob_oid, line_num, i, octet_length(encode(h[i])) AS n, sum(octet_length(encode(g[i])) + octet_length(encode(h[i]))) OVER (PARTITION BY blob_oid, line_num ORDER BY i) AS e FROM m)
SELECT blob_oid, line_num, (e - n)::INT AS start, e::INT AS "end" FROM e""")
def submatch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = O(r"é\w+|th\w+")
    lines = text.match_lines(tables.blobs(spark, sf_dir), options)
    return lines.select("blob_oid", "line_num", F.inline(text.spans(F.col("line_text"), options)))


@register("max_count", f"""WITH {BLOBS}, {_lines_of('blobs')}
SELECT blob_oid, line_num, line_text FROM lines
  WHERE regexp_matches(line_text, '(?m)the') QUALIFY row_number() OVER (PARTITION BY blob_oid ORDER BY line_num) <= 2""")
def max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.match_lines(tables.blobs(spark, sf_dir), O("the", max_count=2)).select("blob_oid", "line_num", "line_text")


@register("match_count",
    f"WITH {BLOBS}, {_lines_of('blobs')} SELECT blob_oid, count(*) AS n_matches FROM lines WHERE regexp_matches(line_text, '(?m)of') GROUP BY blob_oid")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.match_counts(text.match_lines(tables.blobs(spark, sf_dir), O("of")))


def _context_sql(before: int, after: int) -> str:
    return f"""WITH {BLOBS}, {_lines_of('blobs')},
h AS (SELECT blob_oid, line_num, line_text, regexp_matches(line_text, 'than\\b') AS hit FROM lines WHERE regexp_matches(content, '(?m)than\\b')),
n AS (SELECT DISTINCT a.blob_oid, a.line_num, a.line_text, a.hit FROM h a JOIN h b ON a.blob_oid = b.blob_oid AND b.hit
  AND a.line_num BETWEEN b.line_num - {before} AND b.line_num + {after})
SELECT blob_oid, (sum(new) OVER (PARTITION BY blob_oid ORDER BY line_num))::INT AS group_id, line_num, line_text, hit AS is_match FROM
  (SELECT *, CASE WHEN {'true' if before == after == 0 else 'false'} OR lag(line_num) OVER (PARTITION BY blob_oid ORDER BY line_num) IS NULL OR line_num > 1 + lag(line_num) OVER (PARTITION BY blob_oid ORDER BY line_num) THEN 1 ELSE 0 END AS new FROM n)"""


for _name, _before, _after in (("context_groups", 1, 1), ("context_before", 2, 0), ("context_after", 0, 3), ("context_none", 0, 0)):
    @register(_name, _context_sql(_before, _after))
    def context(spark: SparkSession, sf_dir: str, before: int = _before, after: int = _after) -> DataFrame:
        return text.context_lines(tables.blobs(spark, sf_dir), O(r"than\b", before_context=before, after_context=after))


@register("binary_detect", "SELECT doc_id, doc_id % 7 = 0 AND octet_length(encode(text)) < 8000 AS is_binary FROM documents")
def binary_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    held = F.when(F.col("doc_id") % 7 == 0, F.concat(data, F.lit(b"\0tail"))).otherwise(data)
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.is_binary(held).alias("is_binary"))


@register("binary_notice", f"""WITH {OCC}, {INTRO}
SELECT DISTINCT 'Binary file ' || path || ' matches in ' || left(commit_sha, 7) AS out FROM sel JOIN documents d ON sel.blob_oid = sha1(d.text)
  WHERE octet_length(encode(text)) < 8000 AND contains(text, 'ing')""")
def binary_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("blob_oid"), F.col("text").alias("content"),
        F.concat(F.encode("text", "UTF-8"), F.lit(b"\0")).alias("data"))
    found = text.distinct_blobs(docs).where(text.is_binary(F.col("data")) & text.blob_matches(F.col("content"), O("ing", fixed_strings=True)))
    return attribution.attribute(found.select("blob_oid"), attribution.introducing(tables.document_occurrences(spark,
        sf_dir))).select(render.binary_notice().alias("out")).distinct()


@register("blob_dedup", f"WITH {BLOBS} SELECT blob_oid, length(content)::BIGINT AS n FROM blobs")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.distinct_blobs(tables.table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("blob_oid"),
        F.length("text").cast("long").alias("n")))


@register("quiet_exists", "SELECT count(*) > 0 AS found FROM documents WHERE regexp_matches(text, '(?m)^The .* stupid')")
def quiet_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.exists(text.match_lines(tables.blobs(spark, sf_dir), O("^The .* stupid")))
    return spark.createDataFrame([(found,)], "found boolean")


def _paths(name: str, keep: Callable[[Column], Column], condition: str) -> None:
    @register(name, f"SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) WHERE {condition}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.page_files(spark, sf_dir).where(keep(F.col("path"))).select("page_id", "path")


def _documents(name: str, keep: Callable[[Column], Column], condition: str) -> None:
    @register(name,
        f"SELECT doc_id, path FROM (SELECT doc_id, source || '/m' || ((doc_id // 20) % 10)::BIGINT || {EXT} AS path, source || '/m' AS head, {EXT} AS ext, (doc_id // 20) % 10 AS m FROM documents) WHERE {condition}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.table(spark, sf_dir, "documents").select("doc_id", tables.document_path().alias("path")).where(keep(F.col("path")))


_documents("path_prefix", lambda p: globs.prefix_filter(p, ["src1", "src3/m4.go", "."]), "starts_with(path, 'src1/') OR path = 'src3/m4.go'")
_documents("glob_include", lambda p: globs.glob_filter(p, ["*.go", "src2/**"]), "ext = '.go' OR starts_with(path, 'src2/')")
_documents("glob_exclude", lambda p: globs.glob_filter(p, ["!*.md", "!src1?/**"]), "ext <> '.md' AND NOT regexp_matches(path, '^src1[^/]/')")
_documents("glob_last_wins", lambda p: globs.glob_filter(p, ["**/*.rs", "!src5/**", "src5/m[1-3].rs", "!src5/m2*"]),
    "ext = '.rs' AND (NOT starts_with(path, 'src5/') OR m IN (1, 3))")
_documents("file_type", lambda p: globs.type_filter(p, ["py", "Rust ", "sql"]), "ext IN ('.py', '.rs', '.sql')")
_documents("path_conjunction", lambda p: globs.path_filter(p, ["src1", "src2"], ["!*.txt"], ["md", "go"]),
    "(starts_with(path, 'src1/') OR starts_with(path, 'src2/')) AND ext IN ('.md', '.go')")
_paths("glob_pages", lambda p: globs.glob_filter(p, ["*.com/en/*", "!m.*"]),
    "regexp_matches(path, '^[^/]*\\.com/en/[^/]*$') AND NOT starts_with(regexp_extract(path, '([^/]*)$', 1), 'm.')")


@register("search_pages", "SELECT page_id, (len(regexp_extract_all(html, '(?i)</?p>')))::INT AS n FROM pages WHERE regexp_matches(html, '(?i)</?p>')")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = O("</?p>", ignore_case=True)
    pages = tables.page_files(spark, sf_dir)
    return pages.where(text.blob_matches(F.col("content"), options)).select("page_id", F.regexp_count("content", F.lit(options.regex())).alias("n"))


_TYPES = ", ".join(f"('{n}', '{' '.join(e)}', '{' '.join(w)}')" for n, (e, w) in sorted(globs.FILE_TYPES.items()))


@register("type_catalogue", f"SELECT * FROM (VALUES {_TYPES}) AS t(name, extensions, names)")
def type_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, *map(" ".join, globs.lookup_type(f" {n.upper()} "))) for n in globs.list_types()]
    return spark.createDataFrame(rows, "name string, extensions string, names string")


COMMITS = "commits AS (SELECT sha1(event_id::VARCHAR) AS sha, ts AS commit_ts, 'user_' || user_id AS name, 'user_' || user_id || ' <user_' || user_id || '@example.com>' AS author, 'bot ' || event_type AS committer FROM events)"


def _commits(name: str, condition: str, **filters) -> None:
    @register(name, f"WITH {COMMITS} SELECT sha, name AS author_name FROM commits WHERE {condition}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        dates = {k: F.lit(v).cast("timestamp") for k, v in filters.items() if k in ("since", "until")}
        return tables.document_commits(spark, sf_dir).where(history.commit_filter(**(filters | dates))).select("sha", "author_name")


_commits("since", "commit_ts >= TIMESTAMP '2024-01-10 00:00:00'", since="2024-01-10 00:00:00")
_commits("until", "commit_ts <= TIMESTAMP '2024-01-10 00:00:00'", until="2024-01-10 00:00:00")
_commits("between_dates", "commit_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'", since="2024-01-05 00:00:00",
    until="2024-01-20 00:00:00")
_commits("author_filter", "regexp_matches(author, '(?i)USER_1\\d?@')", author=r"USER_1\d?@")
_commits("committer_filter", "regexp_matches(committer, '(?i)bot (click|view)')", committer="bot (click|view)")


def _closure(name: str, sql: str, run: Callable[[DataFrame, SparkSession], DataFrame]) -> None:
    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(history.checkpointed(tables.order_commits(spark, sf_dir)), spark)


def _reach(edges: str, seeds: str, name: str = "r") -> str:
    return f"{name}(sha) AS ({seeds} UNION SELECT e.parent FROM {name} JOIN {edges} e ON e.child = {name}.sha)"


TIPS = "tips AS (SELECT max_by(sha, {'ts': commit_ts, 'k': sha::BIGINT}) AS sha, cust FROM commits GROUP BY cust)"


def _tips(commits: DataFrame) -> DataFrame:
    return commits.groupBy("cust").agg(F.max_by("sha", F.struct("commit_ts", F.col("sha").cast("long"))).alias("sha"))


ALL_TIPS = _reach("edges", "SELECT sha FROM tips")
OLD = "SELECT sha FROM commits WHERE sha IN (SELECT sha FROM tips) AND commit_ts < TIMESTAMP '2000-01-01 00:00:00'"


def _heads(commits: DataFrame, condition: str = "true") -> DataFrame:
    return _tips(commits).join(commits.select("sha", "commit_ts"), "sha").where(condition).select("sha")


def _order_source(commits: DataFrame) -> Source:
    """Orders as a history with a branch for each customer; HEAD is the newest tip."""
    heads = history.checkpointed(_tips(commits).join(commits.select("sha", "commit_ts"), "sha"))
    head = heads.agg(F.max_by("sha", F.struct("commit_ts", F.col("sha").cast("long"))).alias("oid")).select(F.lit("HEAD").alias("name"), "oid")
    return Source(commits, refs=heads.select(F.concat(F.lit("refs/heads/cust_"), F.col("cust")).alias("name"), F.col("sha").alias("oid")).unionByName(head))


HEAD = "head AS (SELECT max_by(t.sha, {'ts': commit_ts, 'k': t.sha::BIGINT}) AS sha FROM tips t JOIN commits c ON c.sha = t.sha)"

_closure("ancestors", f"WITH RECURSIVE {ORDERS}, {TIPS}, {ALL_TIPS} SELECT sha FROM r", lambda c, spark: history.ancestors(c, _heads(c)))
_closure("ancestors_by_joins", f"WITH RECURSIVE {ORDERS}, {TIPS}, {ALL_TIPS} SELECT sha FROM r",
         lambda c, spark: history.ancestors_by_joins(c, _tips(c).select("sha")))
_closure("first_parent", f"""WITH RECURSIVE {ORDERS}, {TIPS}, fp AS (SELECT sha AS child, p1 AS parent FROM commits WHERE p1 IS NOT NULL),
{_reach('fp', 'SELECT sha FROM tips')} SELECT sha FROM r""", lambda c, spark: history.ancestors(c, _heads(c), first_parent=True))
_closure("rev_range", f"""WITH RECURSIVE {ORDERS}, {TIPS}, {ALL_TIPS}, {_reach('edges', OLD, 'x')} SELECT sha FROM r WHERE sha NOT IN (SELECT sha FROM x)""",
         lambda c, spark: history.rev_range(c, _heads(c), _heads(c, "commit_ts < TIMESTAMP '2000-01-01 00:00:00'")).select("sha"))
_closure("rev_range_by_joins",
    f"""WITH RECURSIVE {ORDERS}, {TIPS}, {ALL_TIPS}, {_reach('edges', OLD, 'x')} SELECT sha FROM r WHERE sha NOT IN (SELECT sha FROM x)""",
         lambda c, spark: history.ancestors_by_joins(c, _tips(c).select("sha")).join(history.ancestors_by_joins(
             c, _tips(c).join(c.select("sha", "commit_ts"), "sha").where("commit_ts < TIMESTAMP '2000-01-01 00:00:00'").select("sha")), "sha", "left_anti"))
_closure("all_refs", f"WITH RECURSIVE {ORDERS}, {TIPS}, {ALL_TIPS} SELECT sha FROM r",
         lambda c, spark: select_commits(_order_source(c), O("x", all=True)).select("sha"))
# Named branches come on top of HEAD; one that does not exist adds nothing.
_closure("branches",
    f"""WITH RECURSIVE {ORDERS}, {TIPS}, {HEAD}, {_reach('edges', 'SELECT sha FROM head UNION SELECT sha FROM tips WHERE cust IN (7, 50)')} SELECT sha FROM r""",
         lambda c, spark: select_commits(_order_source(c), O("x", branches=("cust_7", "cust_50", "nobody"))).select("sha"))
_closure("rev_spec",
    f"""WITH RECURSIVE {ORDERS}, {TIPS}, {HEAD}, {_reach('edges', 'SELECT sha FROM head')}, {_reach('edges', 'SELECT p1 AS sha FROM commits WHERE sha IN (SELECT sha FROM head) AND p1 IS NOT NULL', 'x')}
SELECT sha FROM r WHERE sha NOT IN (SELECT sha FROM x)""", lambda c, spark: select_commits(_order_source(c), O("x", rev_range="HEAD~1..HEAD")).select("sha"))
_closure("ancestry_tilde",
    f"WITH {ORDERS}, {TIPS} SELECT t.sha AS tip, c2.p1 AS sha FROM tips t JOIN commits c1 ON c1.sha = t.sha JOIN commits c2 ON c2.sha = c1.p1 WHERE c2.p1 IS NOT NULL",
         lambda c, spark: _tilde(c, 2))
_closure("walk_order", f"WITH {ORDERS} SELECT sha, row_number() OVER (ORDER BY commit_ts DESC, sha) AS walk_seq FROM commits",
         lambda c, spark: history.walk_order(c).select("sha", F.col("walk_seq").cast("long").alias("walk_seq")))


def _tilde(commits: DataFrame, n: int) -> DataFrame:
    """The n-th first parent of each tip that has one."""
    return history.nth_ancestors(commits, _tips(commits), n).select(F.col("start").alias("tip"), "sha")


DIFF = """diff AS (SELECT c.sha, f.path, f.mode, f.oid FROM commits c JOIN files f ON f.root = c.sha WHERE f.mode = 33188
  AND NOT EXISTS (SELECT 1 FROM files p WHERE p.root = c.p1 AND p.path = f.path AND p.oid = f.oid)),
kept AS (SELECT * FROM diff d WHERE NOT EXISTS (SELECT 1 FROM commits c JOIN files p ON p.root = c.p2 WHERE c.sha = d.sha AND p.path = d.path
  AND p.oid = d.oid))"""


def _changes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """What orders change as commits, by the recursion over pairs of trees; both tables are derived once."""
    commits = history.stored(tables.order_commits(spark, sf_dir).select("sha", "tree_oid", "parents", "commit_ts"))
    return treediff.tree_changes(commits, treediff.by_trees(tables.order_trees(spark, sf_dir)), **options)


@register("tree_diff", f"WITH {ORDERS}, {FILES}, {DIFF} SELECT sha, path, mode, oid FROM diff")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, first_parent=True)


@register("tree_full", f"WITH {ORDERS}, {FILES} SELECT sha, path, mode, oid FROM commits JOIN files ON root = sha WHERE mode = 33188")
def tree_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, expand_commits=True)


@register("merge_suppression", f"WITH {ORDERS}, {FILES}, {DIFF} SELECT sha, path, mode, oid FROM kept")
def merge_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@register("file_diff", f"WITH {ORDERS}, {FILES}, {DIFF} SELECT sha, path, mode, oid FROM kept")
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of trees that are given as lists of files."""
    commits = history.checkpointed(tables.order_commits(spark, sf_dir).select("sha", "tree_oid", "parents"))
    return history.file_changes(commits, tables.order_files(spark, sf_dir))


@register("occurrence_dedup", f"""WITH {ORDERS}, {FILES}, {DIFF}
SELECT oid AS blob_oid, path, arg_min(k.sha, {{'d': -epoch_us(c.commit_ts), 's': k.sha}}) AS commit_sha FROM kept k JOIN commits c ON c.sha = k.sha
  GROUP BY oid, path""")
def occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _changes(spark, sf_dir, keep=("commit_ts",)).select(
        F.col("oid").alias("blob_oid"), "path", F.col("sha").alias("commit_sha"), F.struct((-F.unix_micros("commit_ts")).alias("d"), "sha").alias("walk_seq"))
    return history.first_occurrences(found).select("blob_oid", "path", "commit_sha")


@register("entry_type_filter", f"WITH {FILES} SELECT root, path FROM files WHERE mode = 33188")
def entry_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.regular_blobs(tables.order_files(spark, sf_dir)).select("root", "path")


@register("tree_lookup", f"WITH {FILES} SELECT root, path, oid FROM files WHERE root = '7' AND path = (SELECT min(path) FROM files WHERE root = '7')")
def tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.order_files(spark, sf_dir)
    path = files.where("root = '7'").agg(F.min("path")).first()[0]
    return history.find_entry(files, "7", path).select("root", "path", "oid")


@register("tree_expand", """WITH e AS (SELECT DISTINCT l_orderkey, l_partkey % 10 AS d, l_partkey % 4 AS f FROM lineitem)
SELECT l_orderkey::VARCHAR AS root, 'd' || d::VARCHAR || '/f' || f::VARCHAR AS path, d::VARCHAR || ':' || f::VARCHAR AS oid FROM e""")
def tree_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trees of two levels: a folder a tenth of parts, named in the tree of its order."""
    e = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("d"), (F.col("l_partkey") % 4).alias("f")).distinct()
    top, sub = F.col("l_orderkey").cast("string"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("d").cast("string"))
    folders = e.select(top.alias("tree_oid"), F.lit(0o040000).alias("mode"), F.concat(F.lit("d"), F.col("d").cast("string")).alias("name"),
        sub.alias("oid")).distinct()
    files = e.select(sub.alias("tree_oid"), F.lit(0o100644).alias("mode"), F.concat(F.lit("f"), F.col("f").cast("string")).alias("name"),
        F.concat_ws(":", F.col("d").cast("string"), F.col("f").cast("string")).alias("oid"))
    return history.expand_trees(folders.unionByName(files), e.select(top.alias("tree_oid")).distinct()).select("root", "path", "oid")


@register("snapshot_diff", """WITH s AS (SELECT conv_id, turn, role AS path, sha1(text) AS oid FROM conversations)
SELECT conv_id, turn, path, oid FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.conv_id = s.conv_id AND p.turn = s.turn - 1 AND p.path = s.path
  AND p.oid = s.oid)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.conversation_files(spark, sf_dir)
    commit = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    commits = s.select(commit(F.col("turn")).alias("sha"), commit(F.col("turn")).alias("tree_oid"),
        F.array(commit(F.col("turn") - 1)).alias("parents")).distinct()
    files = s.select(commit(F.col("turn")).alias("root"), "path", F.lit(0o100644).alias("mode"), "oid")
    at = F.split("sha", "/")
    return history.tree_diff(commits, files).select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "path", "oid")


@register("introducing_commit", f"WITH {OCC}, {INTRO} SELECT blob_oid, path, commit_sha FROM sel")
def introducing_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.introducing(tables.document_occurrences(spark, sf_dir)).select("blob_oid", "path", "commit_sha")


@register("expand_commits", f"WITH {OCC} SELECT blob_oid, path, commit_sha FROM occ")
def expand_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.select_occurrences(tables.document_occurrences(spark, sf_dir), True).select("blob_oid", "path", "commit_sha")


HITS = f"""{BLOBS}, {_lines_of('blobs')}, {OCC}, {INTRO}, one AS (SELECT path, commit_sha, min(blob_oid) AS blob_oid FROM sel GROUP BY ALL),
hits AS (SELECT s.*, l.line_num, l.line_text FROM lines l JOIN sel s ON s.blob_oid = l.blob_oid JOIN one o ON o.path = s.path
  AND o.commit_sha = s.commit_sha AND o.blob_oid = s.blob_oid WHERE regexp_matches(line_text, '(?m)hation\\b'))"""


def _source(spark: SparkSession, sf_dir: str) -> Source:
    return Source(tables.document_commits(spark, sf_dir), tables.blobs(spark, sf_dir), occurrences=tables.document_occurrences(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str, **options):
    return search(spark, _source(spark, sf_dir), O(r"hation\b", **options))


@register("search_history", f"WITH {HITS} SELECT path, commit_sha, author_name AS author, line_num, line_text FROM hits")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never").rows.select("path", "commit_sha", "author", "line_num", "line_text")


@register("provenance_join", f"WITH {HITS} SELECT path, commit_sha, count(*) AS n FROM hits GROUP BY ALL")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never").rows.groupBy("path", "commit_sha").agg(F.count("*").alias("n"))


@register("author_fallback", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user_' || user_id || ' <x>' ELSE 'user_' || user_id END AS author FROM events")
def author_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    name = F.concat(F.lit("user_"), F.col("user_id"))
    return e.select("event_id", attribution.author(F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(name),
        F.concat(name, F.lit(" <x>"))).alias("author"))


RANKS = """c AS (SELECT DISTINCT path, commit_sha, commit_ts FROM occ), n AS (SELECT path, max(commit_ts) AS newest FROM c GROUP BY path), r AS (SELECT path, row_number() OVER (ORDER BY newest DESC, path) AS file_rank FROM n)"""


@register("sort_commits",
    f"WITH {OCC}, {RANKS} SELECT path, commit_sha, row_number() OVER (PARTITION BY path ORDER BY commit_ts DESC, commit_sha DESC) AS commit_rank FROM c")
def sort_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.ranked(tables.document_occurrences(spark, sf_dir)).select("path", "commit_sha", F.col("commit_rank").cast("long").alias("commit_rank"))


@register("sort_files", f"WITH {OCC}, {RANKS} SELECT path, file_rank FROM r")
def sort_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.ranked(tables.document_occurrences(spark, sf_dir)).select("path", F.col("file_rank").cast("long").alias("file_rank")).distinct()


@register("totals", f"WITH {HITS} SELECT count(*) AS total_matches, count(DISTINCT path) AS total_files FROM hits")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never").totals()


@register("single_line", f"WITH {HITS} SELECT left(commit_sha, 7) || ':' || path || ':' || line_num || ':' || line_text AS out FROM hits")
def single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never").out().select("out")


@register("files_with_matches", f"WITH {HITS} SELECT DISTINCT left(commit_sha, 7) || ':' || path AS out FROM hits")
def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never", files_with_matches=True).out()


@register("count_sink", f"WITH {HITS} SELECT left(commit_sha, 7) || ':' || path || ':' || count(*) AS out FROM hits GROUP BY path, commit_sha")
def count_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never", count=True).out().select("out")


@register("grouped",
    f"WITH {HITS} SELECT path, '[' || left(commit_sha, 7) || ' ' || strftime(commit_ts, '%Y-%m-%d') || ' ' || author_name || ']' AS header, line_num || ':' || line_text AS out FROM hits")
def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never").rows.select("path", render.subheader().alias("header"), render.grouped_line().alias("out"))


@register("identity_parse",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'user ' || user_id ELSE 'user ' || user_id END AS name, CASE
  WHEN event_id % 4 = 0 THEN '' ELSE user_id || '@x.org' END AS email,
CASE WHEN event_id % 4 <> 0 THEN (event_id * 1000)::BIGINT END AS seconds, CASE WHEN event_id % 4 <> 0 THEN '+0200' END AS tz FROM events""")
def identity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    whole = F.concat(name, F.lit(" <"), F.col("user_id").cast("string"), F.lit("@x.org> "), (F.col("event_id") * 1000).cast("string"), F.lit(" +0200"))
    raw = e.select("event_id", F.when(F.col("event_id") % 4 == 0, name).otherwise(whole).alias("who"))
    return gitstore.parse_identities(raw, "who").select("event_id", F.col("who_name").alias("name"), F.col("who_email").alias("email"),
        F.unix_seconds("who_ts").alias("seconds"), F.col("who_tz").alias("tz"))


@register("commit_parse",
    f"""WITH {ORDERS} SELECT sha, sha1(sha) AS tree_oid, (CASE WHEN p1 IS NULL THEN 0 WHEN p2 IS NULL THEN 1 ELSE 2 END)::INT AS n_parents, 'cust ' || cust AS author_name, sha::BIGINT AS seconds, 'order ' || sha AS summary FROM commits""")
def commit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.order_commits(spark, sf_dir)
    who = F.concat(F.lit("cust "), F.col("cust"), F.lit(" <c@x.org> "), F.col("sha"), F.lit(" +0100"))
    parents = F.array_join(F.transform("parents", lambda p: F.concat(F.lit("parent "), F.sha1(p), F.lit("\n"))), "")
    data = F.concat(F.lit("tree "), F.sha1("sha"), F.lit("\n"), parents, F.lit("author "), who, F.lit("\ncommitter "), who,
        F.lit("\ngpgsig -----BEGIN\n more\n -----END\n\n\n order "), F.col("sha"), F.lit(" \n\nbody\n"))
    parsed = gitstore.parse_commits(c.select(F.col("sha").alias("oid"), F.lit("commit").alias("type"), F.encode(data, "UTF-8").alias("data")))
    return parsed.select("sha", "tree_oid", F.size("parents").alias("n_parents"), "author_name", F.unix_seconds("commit_ts").alias("seconds"), "summary")


def _objects(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    ship(spark)
    return docs.mapInArrow(run, "doc_id long, oid string, size long")


@register("git_loose", "SELECT doc_id, sha1(text) AS oid, octet_length(encode(text))::BIGINT AS size FROM documents")
def git_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the bytes of a loose object, decoded."""
    decode = gitstore.decode_loose

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        for b in batches:
            read = [decode(zlib.compress(b"blob %d\0" % len(d) + d))[1] for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha1(d).hexdigest() for d in read]),
                pa.array([len(d) for d in read], pa.int64())], names=["doc_id", "oid", "size"])

    return _objects(spark, sf_dir, run)


@register("git_delta", "SELECT doc_id, sha1(text || '!!' || text) AS oid, (2 * octet_length(encode(text)) + 2)::BIGINT AS size FROM documents")
def git_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta that copies each text, inserts two marks and copies it again, applied."""
    apply = gitstore.apply_delta

    def run(batches):
        import hashlib

        import pyarrow as pa

        def varint(n: int) -> bytes:
            out = bytearray()
            while n >= 0x80:
                out.append(n & 0x7F | 0x80)
                n >>= 7
            return bytes([*out, n])

        def copies(n: int) -> bytes:
            out = b""
            for at in range(0, n, 0xFFFF):
                size = min(0xFFFF, n - at)
                out += bytes([0x80 | 0x0F | 0x30]) + at.to_bytes(4, "little") + size.to_bytes(2, "little")
            return out

        for b in batches:
            read = [apply(d, varint(len(d)) + varint(2 * len(d) + 2) + copies(len(d)) + b"\x02!!" + copies(len(d))) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha1(d).hexdigest() for d in read]),
                pa.array([len(d) for d in read], pa.int64())], names=["doc_id", "oid", "size"])

    return _objects(spark, sf_dir, run)


@register("git_tree", """WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey::VARCHAR AS tree_oid, 'p' || l_partkey AS name, CASE
  WHEN l_partkey % 10 = 0 THEN 40960 ELSE 33188 END AS mode, sha1(l_partkey::VARCHAR) AS oid FROM e""")
def git_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tree objects, encoded by Spark and parsed."""
    e = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    entry = F.concat(F.hex(F.concat(F.when(F.col("l_partkey") % 10 == 0, F.lit("120000")).otherwise(F.lit("100644")), F.lit(" p"),
        F.col("l_partkey").cast("string"))), F.lit("00"), F.sha1(F.col("l_partkey").cast("string")))
    trees = e.groupBy(F.col("l_orderkey").cast("string").alias("oid")).agg(F.unhex(F.array_join(F.sort_array(F.collect_list(entry)), "")).alias("data"))
    return gitstore.parse_trees(trees.withColumn("type", F.lit("tree"))).select("tree_oid", "name", "mode", "oid")


# A repository written from documents: a commit a batch of fifty, each document a file of its own in packs with deltas;
# every 97th blob is a loose object that cannot be read. Commits are a day apart and tagged, every other tag packed. A
# commit has the batches of its WINDOW up to its own, as if files were archived and the tree began anew.
WINDOW = 64
BATCH, DAY, START = 50, 86_400, 1_700_000_000
REPO = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, (doc_id // {BATCH})::BIGINT AS k, coalesce(source, 'none') || '/b' || (doc_id // {BATCH})::BIGINT || '/' || doc_id || {EXT} AS path,
  sha1('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0) || coalesce(text, '')) AS oid FROM documents),
broken AS (SELECT DISTINCT oid FROM d WHERE doc_id % 97 = 5),
ks AS (SELECT DISTINCT k FROM d), batch AS (SELECT k, 'batch ' || k AS summary, {START} + {DAY} * k AS seconds, row_number() OVER (ORDER BY k DESC) - 1 AS back FROM ks)"""


def _repository(spark: SparkSession, sf_dir: str) -> str:
    """The folder of that repository. Tasks write blobs and trees; commits, each with its parent's name, follow one by one here."""
    folder = history.shared_folder(spark, "repository")
    made = History(folder)
    objects = f"{made.git_dir}/objects"
    docs = tables.table(spark, sf_dir, "documents").select(
        "doc_id", (F.floor(F.col("doc_id") / BATCH)).cast("long").alias("k"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/b"),
            (F.floor(F.col("doc_id") / BATCH)).cast("string"), F.lit("/"), F.col("doc_id"),
                F.regexp_extract(tables.document_path(), r"(\.\w+)$", 1)).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    head = F.concat(F.lit("blob "), F.octet_length("data").cast("string"), F.lit("\0"))
    docs = docs.withColumn("oid", F.sha1(F.concat(F.encode(head, "UTF-8"), F.col("data"))))
    lost = docs.where("doc_id % 97 = 5").select("oid").distinct()

    def damage(batches):
        for batch in batches:
            for oid in batch.column("oid").to_pylist():
                Path(objects, oid[:2]).mkdir(exist_ok=True)
                Path(objects, oid[:2], oid[2:]).write_bytes(b"damaged")
            yield batch

    lost = history.checkpointed(lost.mapInArrow(damage, "oid string"))
    history.checkpointed(write_blobs(docs.join(lost, "oid", "left_anti").select("data"), made.git_dir))
    snapshots = history.checkpointed(write_trees(docs.where("k IS NOT NULL"), made.git_dir, WINDOW))
    parent: tuple = ()
    for k, tree in snapshots.orderBy("k").toLocalIterator():
        parent = (made.commit(START + DAY * k, f"batch {k}", *parent, tree=tree),)
        made.ref(f"refs/tags/b{k}", parent[0], packed=k % 2 == 0)
    if parent:
        made.ref("refs/heads/main", parent[0])
    made.close()
    return folder


def _in_repository(spark: SparkSession, sf_dir: str, **options):
    return search(spark, from_git(spark, _repository(spark, sf_dir), {}), O(r"hation\b", color="never", **options))


def _git_search(name: str, condition: str, **options) -> None:
    sql = f"""WITH {REPO}, blobs AS (SELECT DISTINCT oid AS blob_oid, text AS content FROM d WHERE oid NOT IN (SELECT oid FROM broken)), {_lines_of('blobs')}
SELECT path, summary, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d') AS commit_date, line_num, line_text FROM lines l
  JOIN d ON d.oid = l.blob_oid JOIN batch b ON b.k = d.k WHERE regexp_matches(line_text, '(?m)hation\\b') AND {condition}"""

    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _in_repository(spark, sf_dir, **options).rows.select("path", "summary", "commit_date", "line_num", "line_text")


_git_search("git_search", "true")
_git_search("git_search_range", "back < 2", rev_range="HEAD~2..HEAD")
_git_search("git_search_dates", f"seconds >= {START + 3 * DAY} AND seconds <= {START + 9 * DAY}", since=str(START + 3 * DAY), until="2023-11-23T22:13:20Z")
_git_search("git_search_paths", "starts_with(path, 'src1/') AND ends_with(path, '.go')", paths=("src1/",), types=("go",))


@register("git_objects",
    f"WITH {REPO} SELECT DISTINCT oid, 'blob' AS type, octet_length(encode(text))::BIGINT AS size FROM d WHERE oid NOT IN (SELECT oid FROM broken)")
def git_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = gitstore.discover(_repository(spark, sf_dir), {})
    return gitstore.objects(spark, repo, "blob").where("error IS NULL").select("oid", "type", "size")


@register("git_soft_errors", f"WITH {REPO} SELECT oid AS blob_oid FROM broken")
def git_soft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_repository(spark, sf_dir).skipped.select("blob_oid")


@register("git_refs", f"""WITH {REPO} SELECT 'refs/tags/b' || k AS name, summary, 'b' || k AS short FROM batch
UNION ALL SELECT name, (SELECT summary FROM batch WHERE back = 0), short FROM (VALUES ('HEAD', 'HEAD'), ('refs/heads/main', 'main')) AS t(name, short)""")
def git_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose and packed refs with the commits that they and their short names resolve to."""
    folder = _repository(spark, sf_dir)
    repo, commits = gitstore.discover(folder, {}), from_git(spark, folder, {}).commits
    refs = gitstore.all_refs(repo)
    short = {name: name.rsplit("/", 1)[-1] for name in refs}
    packed = gitstore.packed_refs(repo)
    rows = [(name, short[name], sha) for name, sha in refs.items() if gitstore.resolve_ref(repo, short[name], packed) == sha]
    return spark.createDataFrame(rows, "name string, short string, sha string").join(commits.select("sha", "summary"), "sha").select("name", "summary", "short")


@register("commit_summary",
    f"WITH {REPO} SELECT summary, seconds::BIGINT AS seconds, CASE WHEN back + 1 = (SELECT count(*) FROM batch) THEN 0 ELSE 1 END::INT AS n_parents FROM batch")
def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = from_git(spark, _repository(spark, sf_dir), {}).commits
    return commits.select("summary", F.unix_seconds("commit_ts").alias("seconds"), F.size("parents").alias("n_parents"))


@register("first_seen", f"""WITH {OCC}, m AS (SELECT blob_oid, min(ROW(-epoch_us(commit_ts), commit_sha, path)) AS met FROM occ GROUP BY blob_oid)
SELECT blob_oid, row_number() OVER (ORDER BY met, blob_oid) AS seen FROM m""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs in the order in which an unordered report tells them."""
    met = attribution.first_met(tables.document_occurrences(spark, sf_dir))
    return history.numbered(met, "seen", F.asc("__met"), F.asc("blob_oid")).select("blob_oid", F.col("seen").cast("long").alias("seen"))


@register("unordered", f"WITH {HITS} SELECT path, commit_sha, line_num FROM hits")
def unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, color="never", unordered=True).ordered.select("path", "commit_sha", "line_num")


def _report(spark: SparkSession, sf_dir: str, color: bool = False, **options) -> DataFrame:
    """The lines of a report, numbered."""
    lines = _found(spark, sf_dir, **options).lines(color)
    return spark.createDataFrame(list(enumerate(lines, 1)), "n long, out string")


REPORT = f"""WITH {HITS}, n AS (SELECT path, max(commit_ts) AS newest FROM hits
  GROUP BY path), f AS (SELECT path, row_number() OVER (ORDER BY newest DESC, path) AS fr FROM n),
c AS (SELECT DISTINCT path, commit_sha, commit_ts, author_name
  FROM hits), cr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commit_ts DESC, commit_sha DESC) AS cr FROM c)"""


@register("grouped_report", f"""{REPORT}, rows_ AS (
SELECT fr, 0 AS cr, 0 AS kind, 0 AS line_num, '' AS out FROM f WHERE fr > 1 UNION ALL SELECT fr, 0, 1, 0, path FROM f
UNION ALL SELECT fr, cr, 2, 0, '[' || left(commit_sha, 7) || ' ' || strftime(commit_ts, '%Y-%m-%d') || ' ' || author_name || ']' FROM cr JOIN f USING (path)
UNION ALL SELECT fr, cr, 3, line_num, line_num || ':' || line_text FROM hits JOIN cr USING (path, commit_sha) JOIN f USING (path))
SELECT row_number() OVER (ORDER BY fr, cr, kind, line_num) AS n, out FROM rows_""")
def grouped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, color=False)


def _painted(code: str, what: str) -> str:
    return f"chr(27) || '[{code}m' || {what} || chr(27) || '[0m'"


@register("color_report",
    f"""{REPORT} SELECT row_number() OVER (ORDER BY fr, cr, line_num) AS n, {_painted('33', 'left(commit_sha, 7)')} || {_painted('36', "':'")} || {_painted('35', 'path')} || {_painted('36', "':'")}
|| {_painted('32', 'line_num')} || {_painted('36', "':'")} || regexp_replace(line_text, '(hation)\\b', chr(27) || '[1;31m' || '\\1' || chr(27) || '[0m', 'g') AS out FROM hits JOIN cr USING (path, commit_sha) JOIN f USING (path)""")
def color_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, color=True, heading=False)


@register("stream_counts",
    f"WITH {BLOBS}, {_lines_of('blobs')} SELECT blob_oid, count(*) AS n_matches FROM lines WHERE regexp_matches(line_text, '(?m)of') GROUP BY blob_oid")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream, are searched as they come, and each micro-batch is told to a sink."""
    from palimpsest.streaming.search import aggregate_channel, stream_matches

    schema = tables.table(spark, sf_dir, "documents").schema
    # The table is a file or a folder of files; a stream wants a folder, or a pattern that stands for what lies there.
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    blobs = docs.select(F.sha1(F.encode("text", "UTF-8")).alias("blob_oid"), F.col("text").alias("content"),
        F.lit("2024-01-01").cast("timestamp").alias("arrived"))
    out = history.shared_folder(spark, "stream")
    query = aggregate_channel(stream_matches(blobs, O("of")), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/told/batch={n}"), f"{out}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/told").select("blob_oid", "n_matches")


# Command lines and what they mean: pattern, revision, paths, flags that are set.
_LINES = [
    (("-i", "pat", "HEAD~2", "src"), "pat", "HEAD~2", "src", "ignore_case"), (("-e", "a", "-e", "b", "main"), "a b", "main", "", ""),
        (("-lcv", "x"), "x", "", "", "invert_match files_with_matches count"),
    (("-C3", "x", "--", "p", "-q"), "x", "", "p -q", "before_context=3 after_context=3"),
        (("-A", "1", "-B2", "-m=7", "x"), "x", "", "", "before_context=2 after_context=1 max_count=7"),
    (("--no-heading", "-N", "x"), "x", "", "", "!line_number !heading"), (("--line-number=no", "x"), "x", "", "", "!line_number"),
        (("-S", "--ignore-case=false", "x"), "x", "", "", "case_sensitive smart_case"),
    (("--all-commits", "--first-parent", "--unordered", "-a", "x"), "x", "", "", "text first_parent expand_commits unordered"),
        (("-g", "*.go", "-t", "py", "--branch=dev", "x"), "x", "", "", "globs=*.go types=py branches=dev"),
    (("--since", "2024-01-01", "--until=now", "--author", "A", "--committer=B", "x"), "x", "", "", "since=2024-01-01 until=now author=A committer=B"),
        (("-F", "-w", "--all", "-q", "x"), "x", "", "", "fixed_strings word_regexp quiet all"),
    (("--color", "never", "x"), "x", "", "", "color=never"), (("--color", "x"), "x", "", "", "color=always"), (("-m", "-1", "x"), None, None, None, None),
        (("--nope", "x"), None, None, None, None), ((), None, None, None, None),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v + "'" for v in (" ".join(a), *rest)) + ")" for a, *rest in _LINES)


@register("parse_options", f"SELECT * FROM (VALUES {_VALUES}) AS t(args, pattern, rev, paths, flags)")
def parse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's grammar: each line as parsed, or nulls where it is refused."""
    plain = SearchOptions()

    def told(args: tuple) -> tuple:
        try:
            o = parse_args(list(args))
        except OptionError:
            return " ".join(args), None, None, None, None
        flags = []
        for f in fields(SearchOptions):
            value = getattr(o, f.name)
            if f.name in ("patterns", "rev_range", "paths") or value == getattr(plain, f.name):
                continue
            text = " ".join(value) if isinstance(value, tuple) else str(value)
            flags.append(f"{'' if value else '!'}{f.name}" if isinstance(value, bool) else f"{f.name}={text}")
        return " ".join(args), " ".join(o.patterns), o.rev_range, " ".join(o.paths), " ".join(flags)
    return spark.createDataFrame([told(a) for a, *_ in _LINES], "args string, pattern string, rev string, paths string, flags string")
