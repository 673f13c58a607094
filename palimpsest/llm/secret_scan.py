"""Secret scans over a trigram inverted index.

Each rule's pattern is parsed into a Boolean query: what every match must contain, as an or of ands of lower-case
trigrams. The index has a posting (trigram, document) for the trigrams that the rules ask for; a rule's postings are
intersected to candidates, and only those are verified with the pattern. A rule without mandatory trigrams scans fully.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, UPPER, cut, let, narrowed, renamed, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern in the common subset of regex dialects, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0


# The base rules, whose matches shorter than their least length are dropped after matching.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Rules beyond the base: formats that vendors publish.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
LIMIT = 32  # strings that a part of a pattern may stand for before it counts as unknown


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    """And of two queries; a query is an or of sets of trigrams, and [empty set] asks for nothing."""
    return list(dict.fromkeys(x | y for x in a for y in b))


def _mandatory(strings: set[str]) -> list[frozenset]:
    return list(dict.fromkeys(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


class _Reader:
    """Reads the common subset of regex dialects, from left to right; what a part stands for comes with what it asks for.

    A part is (the strings that it stands for, if few and known, else None; a query that holds wherever it matches).
    """

    def __init__(self, pattern: str):
        self.s, self.at = pattern, 0

    def alternatives(self) -> tuple[set[str] | None, list[frozenset]]:
        parts = [self.sequence()]
        while self.s[self.at:self.at + 1] == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(strings is not None for strings, _ in parts) and len(u := set().union(*(strings for strings, _ in parts))) <= LIMIT:
            return u, NOTHING
        return None, list(dict.fromkeys(q for strings, qs in parts for q in (qs if strings is None else _both(qs, _mandatory(strings)))))

    def sequence(self) -> tuple[set[str] | None, list[frozenset]]:
        """Literal neighbours are joined as far as they go, as trigrams reach across them."""
        run, query, whole = {""}, NOTHING, True
        while self.at < len(self.s) and self.s[self.at] not in "|)":
            strings, wanted = self.repeated()
            query = _both(query, wanted)
            if strings is not None and len(run) * len(strings) <= LIMIT:
                run = {a + b for a in run for b in strings}
            else:
                query, run, whole = _both(query, _mandatory(run)), strings or {""}, False
        return (run, query) if whole else (None, _both(query, _mandatory(run)))

    def repeated(self) -> tuple[set[str] | None, list[frozenset]]:
        strings, query = self.atom()
        m = REPEAT.match(self.s, self.at)
        if not m:
            return strings, query
        self.at = m.end()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m.group(1)) or (int(m.group(2)),
            int(m.group(4)) if m.group(4) else None if m.group(3) else int(m.group(2)))
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, NOTHING
        if strings is not None and low == high and len(strings) ** low <= LIMIT:
            return {"".join(x) for x in itertools.product(strings, repeat=low)}, query
        return None, NOTHING if low == 0 else query if strings is None else _mandatory(strings)

    def atom(self) -> tuple[set[str] | None, list[frozenset]]:
        c = self.s[self.at]
        self.at += 1
        if c == "(":
            m = GROUP.match(self.s, self.at)
            self.at = m.end() if m else self.at
            found = self.alternatives()
            self.at += 1  # the closing bracket
            return found
        if c == "[":
            return self.chars()
        if c in "^$":
            return {""}, NOTHING
        if c == ".":
            return None, NOTHING
        return ({c.lower()}, NOTHING) if c != "\\" else self.escaped()

    def escaped(self) -> tuple[set[str] | None, list[frozenset]]:
        c = self.s[self.at]
        if c == "x":
            self.at += 3
            return {chr(int(self.s[self.at - 2:self.at], 16)).lower()}, NOTHING
        self.at += 1
        if c in "bBAz":
            return {""}, NOTHING
        return (None if c.isalnum() else {c}), NOTHING

    def chars(self) -> tuple[set[str] | None, list[frozenset]]:
        """A class; one that is negated or large is unknown."""
        start = self.at
        end = self.at = CLASS_END.match(self.s, self.at).end()
        found: set[str] = set()
        for m in MEMBER.finditer(self.s, start, end - 1):
            low, high = (x and (chr(int(x[2:], 16)) if x.startswith("\\x") else x[-1]) for x in m.groups())
            if m.start() == start and low == "^" or m.group(1)[0] == "\\" and m.group(1)[1:].isalpha() or high and ord(high) - ord(low) >= LIMIT:
                return None, NOTHING
            found |= {chr(k).lower() for k in range(ord(low), ord(high or low) + 1)}
        return (found if len(found) <= LIMIT // 2 else None), NOTHING


NOTHING = [frozenset()]
REPEAT = re.compile(r"([?*+])|\{(\d+)(,?)(\d*)\}")
GROUP = re.compile(r"\?(?:[a-z]*:|P?<\w+>)")
CLASS_END = re.compile(r"\^?\]?(?:\\.|[^\]\\])*\]")
MEMBER = re.compile(r"(\\x[0-9A-Fa-f]{2}|\\.|[^\\])(?:-(\\x[0-9A-Fa-f]{2}|\\.|[^\\]))?")


def trigram_query(pattern: str) -> list[frozenset]:
    """An or of ands of trigrams that every match contains, or [] if the pattern has no mandatory trigrams."""
    strings, query = _Reader(pattern).alternatives()
    query = query if strings is None else _both(query, _mandatory(strings))
    if any(not q for q in query):
        return []
    return [q for q in query if not any(other < q for other in query)]


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc, body) of documents (doc, body, text) for the trigrams named, whatever case they stand in."""
    low = let(F.translate("text", UPPER, LOWER), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda x: F.contains(t, x)))
    return docs.select(F.explode(low).alias("trigram"), "doc", "body")


def candidates(index: DataFrame, queries: dict[str, list[frozenset]]) -> DataFrame:
    """(doc, body, kinds): the kinds of which the document has all trigrams of one conjunction.

    The terms are a table as large as the rules; postings meet per document and conjunction, never per trigram.
    """
    terms = [(t, kind, n, 1 << i, (1 << len(q)) - 1) for kind, ors in queries.items() for n, q in enumerate(ors) for i, t in enumerate(sorted(q))]
    terms = index.sparkSession.createDataFrame(terms, "trigram string, kind string, conjunction int, bit long, all long")
    met = index.join(F.broadcast(terms), "trigram").groupBy("doc", "body", "kind", "conjunction").agg(F.bit_or("bit").alias("found"), F.max("all").alias("all"))
    return met.where("found = all").groupBy("doc", "body").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, asked: Column) -> Column:
    """(kind, i, gap, len, ok) for each match of a text: gap is the text between it and the match before."""
    at = F.lit(rule.pattern)
    text = F.col("text")
    hits = F.regexp_extract_all(text, at, F.lit(0))
    sized = F.regexp_extract_all(text, at, F.lit(rule.group)) if rule.group else hits
    rows = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), sized.alias("part")), lambda x, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
            (F.length(x["part"]) >= rule.min_chars).alias("ok")))
    return F.when(asked, F.filter(rows, lambda x: x["len"].isNotNull()))


CANDIDATES = 500_000  # rows of ids and kinds, about 50 bytes each, that are broadcast; more are joined by a shuffle


def _spans(texts: DataFrame, asked: dict[Rule, Column | None], rules: tuple[Rule, ...], part: int) -> DataFrame:
    """(doc, body, part, row, spans) for the rows of texts that match; asked says of each rule which rows it is for."""
    parts = [_matches(r, F.col("text").rlike(r.pattern) if wanted is None else wanted) for r, wanted in asked.items()]
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("doc", "body", "row", F.explode(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))).alias("m"))
    order = "(PARTITION BY doc, body, row, m.kind ORDER BY m.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ends = rows.withColumn("end", F.expr(f"sum(m.gap + m.len) OVER {order}"))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("m.kind"))
    span = F.when(F.col("m.ok"), F.struct((F.col("end") - F.col("m.len")).alias("start"), rank.alias("rank"), F.col("m.kind").alias("kind"),
        F.col("end").alias("end")))
    # Rows that share id and text have the same spans: those of one of them are taken.
    one = ends.groupBy("doc", "body", "row").agg(F.collect_list(span).alias("spans")).groupBy("doc", "body").agg(F.first("spans").alias("spans"))
    return one.withColumn("part", F.lit(part))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", few: int = CANDIDATES) -> DataFrame:
    """(doc, body, spans) for every row: spans are (start, rank, kind, end) in code points, by start, then rule.

    Null text is empty, and a null id an id like any other. Rows that share an id are told apart by their text, whose
    hash is body; repeated rows give repeated results. Of no rows, no rows come; other columns are left out, whatever
    their names. Matches of one kind are leftmost and do not overlap; kinds may. Texts are scanned whole; positions are
    running sums of the lengths between matches, from a window over the matches of one text and kind. Rules with
    trigrams are verified on their candidates, which the ids and kinds from the index are joined with: in place by a
    broadcast of up to `few`, else by a shuffle of the texts that a bounded bitmap of the candidates lets through.
    Rules without are scanned where the text lies.
    """
    keyed = renamed(docs, doc=id_col, text=text_col).select("doc", text_of(F.col("text")).alias("text")).withColumn("body", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    found = None
    if trigrams:
        near = cut(candidates(build_index(keyed, trigrams), indexed).select(F.col("doc").alias("near_doc"), F.col("body").alias("near_body"), "kinds"))
        if near.limit(few + 1).count() <= few:
            here, near = keyed, F.broadcast(near)
        else:
            here = narrowed(keyed, F.col("body"), near.select("near_body"))
        met = here.join(near, F.col("doc").eqNullSafe(F.col("near_doc")) & (F.col("body") == F.col("near_body"))).drop("near_doc", "near_body")
        found = _spans(met, {_tight(r): F.array_contains("kinds", r.kind) for r in rules if r.kind in indexed}, rules, 0)
    if len(indexed) < len(rules):
        whole = _spans(keyed, {_tight(r): None for r in rules if r.kind not in indexed}, rules, 1)
        found = whole if found is None else found.unionByName(whole)
    spans = found.groupBy(F.col("doc").alias("span_doc"), F.col("body").alias("span_body")).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = keyed.select("doc", "body").join(spans, F.col("doc").eqNullSafe(F.col("span_doc")) & (F.col("body") == F.col("span_body")), "left")
    none = F.array().cast(dict(spans.dtypes)["spans"])
    return rows.select("doc", "body", F.coalesce("spans", none).alias("spans"))


def _tight(rule: Rule) -> Rule:
    """A class under `+`, alone or after a literal that is of the class, with the least length as the least count.

    Its matches are the long ones of the class's maximal runs either way, and far fewer are made.
    """
    if not rule.group and rule.min_chars and rule.pattern.endswith("]+"):
        head = rule.pattern[: rule.pattern.index("[")]
        if rule.pattern.count("[") == 1 and head.isalnum() | (not head):
            return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.min_chars - len(head)},}}", 0, rule.min_chars)
    return rule


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(F.col("doc").alias("doc_id"), *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def _sql_kind(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    part = f"regexp_extract_all(text, '{pattern}', {rule.group})"
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts, {rule.min_chars} AS least
    FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, {part} AS parts FROM t)"""


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(_sql_kind(r, n) for n, r in enumerate(RULES))}),
e AS (SELECT doc_id, rank, kind, length(hits[i]) AS n, length(parts[i]) >= least AS ok,
  sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, rank, kind, (e - n)::BIGINT AS s, kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT AS span FROM e WHERE ok)
SELECT t.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
  count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id
"""
