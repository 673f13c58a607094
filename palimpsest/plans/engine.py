"""The search: history to occurrences, blobs to matches, both joined and told in order. One lazy plan, many sinks."""

from __future__ import annotations

import os.path
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.globs import path_filter
from palimpsest.operators import attribution, history, text, treediff
from palimpsest.options import OptionError, SearchOptions, parse_date
from palimpsest.sinks import render
from palimpsest.sources import gitstore

NO_SPANS = "array<struct<start:int,end:int>>"


@dataclass
class Source:
    """What a search reads.

    commits: sha, tree_oid, parents, commit_ts, author, author_name, author_email, committer..., commit_tz (optional)
    entries: tree_oid, mode, name, oid of trees; or, in place of trees, files (root, a tree's oid, path, mode, oid) or
             occurrences ready-made
    blobs:   blob_oid, content, and optionally data (bytes) and error
    refs:    name -> oid, or a table (name, oid) of them
    repo:    a repository, whose trees and blobs are read where they are needed, in place of entries and blobs
    """

    commits: DataFrame
    blobs: DataFrame | None = None
    entries: DataFrame | None = None
    files: DataFrame | None = None
    occurrences: DataFrame | None = None
    refs: dict[str, str] | DataFrame = field(default_factory=dict)
    subdirectory: str = ""
    repo: gitstore.Repository | None = None

    @cached_property
    def graph(self) -> history.Graph | None:
        """The commits' graph on the driver, if it fits there."""
        return history.Graph(self.commits) if history.fits_driver(self.commits) else None

    def _named(self, base: str) -> dict[str, str]:
        """The refs that a name may stand for; of a table, only these come to the driver."""
        if isinstance(self.refs, dict):
            return self.refs
        return {r.name: r.oid for r in self.refs.where(F.col("name").isin([prefix + base for prefix in gitstore.CANDIDATES])).collect()}

    def resolve(self, rev: str) -> str:
        """A revision, base or base~N, to a sha. What looks like an oid stands for itself."""
        base, tilde, n = rev.partition("~")
        try:
            sha = gitstore.resolve_ref(self.repo, base) if self.repo else gitstore.find_ref(base, self._named(base).get, {})
            return history.nth_ancestor(self.commits, sha, int(n), self.graph) if tilde else sha
        except gitstore.NotFound as e:
            raise OptionError(e.args[0]) from None
        except ValueError as e:
            raise OptionError(str(e)) from None


def from_git(spark: SparkSession, start: str = ".", environ: dict | None = None) -> Source:
    """A repository on disk that driver and executors both see. Its commits are read here, trees and blobs by a search."""
    repo = gitstore.discover(start, environ)
    commits = history.checkpointed(gitstore.parse_commits(gitstore.objects(spark, repo, "commit")).where("error IS NULL"))
    sub = os.path.relpath(os.path.realpath(start), repo.work_tree) if repo.work_tree and os.path.isdir(start) else ""
    return Source(commits, refs=gitstore.all_refs(repo), subdirectory="" if sub.startswith(".") else sub, repo=repo)


def rev_spec(source: Source, spec: str) -> tuple[list[str], list[str]]:
    """Include and exclude lists of A, A..B, A.. or ..B; a missing side is HEAD."""
    spec = spec.strip()
    if ".." in spec:
        a, b = spec.split("..", 1)
        return [source.resolve(b.strip() or "HEAD")], [source.resolve(a.strip() or "HEAD")]
    return [source.resolve(spec or "HEAD")], []


def tips(source: Source, options: SearchOptions) -> tuple[list[str] | DataFrame | None, list[str]]:
    """The commits that the walk starts from, None for all, and those that it leaves out with what they reach."""
    table = isinstance(source.refs, DataFrame)
    if options.all:
        return source.refs.select(F.col("oid").alias("sha")).distinct() if table else sorted(set(source.refs.values())), []
    include, exclude = rev_spec(source, options.rev_range) if table or source.refs or source.repo or options.rev_range else (None, [])
    for b in options.branches:
        try:
            include = [*(include or []), source.resolve(b)]
        except OptionError:
            continue  # a branch that does not exist adds nothing
    return include, exclude


def select_commits(source: Source, options: SearchOptions) -> DataFrame:
    """The commits that the revisions reach and the filters keep, with walk_seq, the order in which they are walked.

    That is by date, and where a commit is older than a parent of its, by the walk itself.
    """
    include, exclude = tips(source, options)
    reached = source.commits
    if include is not None:
        reached = history.rev_range(source.commits, include, exclude, options.first_parent, source.graph)
    seq = F.struct((-F.unix_micros("commit_ts")).alias("newest"), F.col("sha").alias("name"))
    if include is not None and source.graph and source.graph.skewed:
        order = history.heap_order(source.graph, source.commits.sparkSession, history._names(include), exclude, options.first_parent)
        reached, seq = reached.join(order, "sha"), F.struct(F.col("walk").alias("newest"), F.col("sha").alias("name"))
    dates = {k: parse_date(v).replace(tzinfo=None) if v.strip() else None for k, v in (("since", options.since), ("until", options.until))}
    keep = history.commit_filter(*(F.lit(d).cast("timestamp") if d else None for d in dates.values()), options.author, options.committer)
    return reached.where(keep).withColumn("walk_seq", seq)


def occurrences(source: Source, options: SearchOptions, commits: DataFrame | None = None) -> DataFrame:
    """(blob_oid, path, commit_sha, commit_ts, commit_date, author, summary): what each commit introduces, or all it holds.

    Of the commits that the options select, or of some of these."""
    commits = select_commits(source, options) if commits is None else commits
    date = F.date_format("commit_ts", "yyyy-MM-dd")
    if "commit_tz" in commits.columns:  # the date where the commit was made
        minutes = F.concat(F.substring("commit_tz", 1, 1), F.lit("1")).cast("int") * (F.substring("commit_tz", 2,
            2).cast("int") * 60 + F.substring("commit_tz", 4, 2).cast("int"))
        date = F.date_format(F.col("commit_ts") + F.coalesce(F.make_dt_interval(mins=minutes), F.make_dt_interval()), "yyyy-MM-dd")
    summary = F.col("summary") if "summary" in commits.columns else F.lit("")
    told = ("commit_ts", F.coalesce(date, F.lit("")).alias("commit_date"), attribution.author(F.col("author_name"), F.col("author")).alias("author"),
        summary.alias("summary"), "walk_seq")
    expand, first = options.expand_commits, options.first_parent
    named = commits.select(F.col("sha").alias("commit_sha"), *told)
    if source.occurrences is not None:
        found = source.occurrences.select("blob_oid", "path", "commit_sha")
    else:
        if source.files is not None:
            diff = history.tree_diff(commits, source.files, expand, source.commits)
            if not first and not expand:
                diff = history.suppress_merged(diff, commits, source.files, source.commits)
        else:
            opened = gitstore.open_pairs(source.repo) if source.repo else treediff.by_joins(source.entries)
            diff = treediff.tree_changes(commits, opened, source.commits, expand, first)
        found = diff.select(F.col("oid").alias("blob_oid"), "path", F.col("sha").alias("commit_sha"))
    placed = found.join(named, "commit_sha")
    placed = placed.where(path_filter(F.col("path"), options.paths, options.globs, options.types, options.subdirectory or source.subdirectory))
    if source.occurrences is not None:
        return attribution.select_occurrences(placed, expand)
    return placed if expand else history.first_occurrences(placed)


@contextmanager
def running(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Tags the jobs that this thread starts within; what it gives cancels them, from any thread.

    Stages that are under way end with their tasks interrupted, and their readers and workers with them.
    """
    context, tag = spark.sparkContext, f"palimpsest-{uuid.uuid4().hex}"
    held = context.getLocalProperty("spark.job.interruptOnCancel")
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)
        context.setInterruptOnCancel(held == "true")


@dataclass
class SearchResult:
    """A search that has been planned; each property runs what it needs of it."""

    rows: DataFrame
    skipped: DataFrame
    options: SearchOptions

    @cached_property
    def ordered(self) -> DataFrame:
        """The rows as they are told: by file and commit; unordered, a blob after another as the walk meets them."""
        last = ("group_id", "line_num")
        return attribution.as_met(self.rows, *last) if self.options.unordered else attribution.in_order(self.rows, *last)

    @property
    def found(self) -> bool:
        return text.exists(self.rows)

    def totals(self) -> DataFrame:
        return attribution.totals(self.rows.where("is_match OR is_binary"))

    def out(self) -> DataFrame:
        """The report's lines as a DataFrame, for any sink of Spark's."""
        o = self.options
        if o.files_with_matches:
            return render.files_with_matches(self.rows)
        if o.count:
            return render.counts(self.rows)
        return render.single_line(self.rows, o.line_number)

    def lines(self, color: bool = False):
        o = self.options
        if o.count and not o.files_with_matches:
            paint = render.painter(color)
            for r in attribution.in_order(render.counts(self.rows)).toLocalIterator():
                yield paint("separator", ":").join((paint("commit", r.commit_sha[:render.SHORT]), paint("path", r.path), paint("line", str(r.n))))
        else:
            yield from render.render(self.ordered.toLocalIterator(), o, color)

    def exit_code(self) -> int:
        """0 with matches, 1 without, 2 if a blob could not be read; a quiet search with a match is 0 all the same."""
        found = self.found
        if found and self.options.quiet:
            return 0
        return 2 if text.exists(self.skipped) else 0 if found else 1


def matched(source: Source, options: SearchOptions, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of matches and notices by blob_oid, blobs that could not be read) of the blobs that occurrences name, each searched once."""
    if source.repo is not None:
        blobs = gitstore.read_blobs(where.select("blob_oid").distinct(), source.repo)
    else:
        blobs = text.distinct_blobs(source.blobs.join(where.select("blob_oid"), "blob_oid", "left_semi"))
    bad = F.col("error").isNotNull() if "error" in blobs.columns else F.lit(False)
    skipped = blobs.where(bad)
    good = blobs.where(~bad)
    # A text without its bytes is its own; as bytes it has the same NULs in the same place if it has any.
    binary = F.col("is_binary") if "is_binary" in blobs.columns else text.is_binary(F.col("data") if "data" in blobs.columns else F.col("content").cast("binary"))
    binary = F.lit(False) if options.text else binary
    plain = good.where(~binary).select("blob_oid", "content")
    if options.before_context or options.after_context:
        lines = text.context_lines(plain, options)
    else:
        lines = text.match_lines(plain, options).withColumns({"group_id": F.lit(0), "is_match": F.lit(True)})
    spans = F.when(F.col("is_match"), text.spans(F.col("line_text"), options)) if options.color != "never" else F.lit(None).cast(NO_SPANS)
    hits = lines.select("blob_oid", "group_id", "line_num", "line_text", "is_match", F.lit(False).alias("is_binary"), spans.alias("submatches"))
    if options.text:
        return hits, skipped
    notices = good.where(binary & text.blob_matches(F.col("content"), options)).select("blob_oid", F.lit(0).alias("group_id"),
        F.lit(0).alias("line_num"), F.lit("").alias("line_text"))
    return hits.unionByName(notices.withColumns({"is_match": F.lit(False), "is_binary": F.lit(True), "submatches": F.lit(None).cast(NO_SPANS)})), skipped


def search(spark: SparkSession, source: Source, options: SearchOptions) -> SearchResult:
    """Plans a search: occurrences pick the blobs, each distinct blob is searched once, and its matches are attributed.

    Occurrences are used twice, to pick blobs and to attribute matches. Those of a repository are written down for it.
    Both uses are equi-joins on the blob's oid that Spark broadcasts or sorts by their size, and splits if one blob has
    most occurrences.
    """
    options.validate()
    where = occurrences(source, options)
    if source.repo is not None:
        where = history.checkpointed(where)
    found, skipped = matched(source, options, where)
    return SearchResult(attribution.attribute(found, where, source.occurrences is None), skipped, options)


WAVE, GROWTH = 32, 4  # commits of the first wave, and by how much each wave is larger than the one before


def first_match(spark: SparkSession, source: Source, options: SearchOptions, wave: int = WAVE) -> tuple[bool, list[DataFrame], int]:
    """(whether anything matches, blobs that could not be read by then, commits that were looked at).

    Commits are taken in waves in the order of the walk, newest first, each wave larger than all before it together. A
    wave reads the trees and blobs of its own commits only, and within it Spark tries a few partitions at a time, so a
    match in a new commit is told without reading the history behind it. Nothing is attributed or put in order.
    """
    options = options.validate().with_(color="never", before_context=0, after_context=0, max_count=0)
    ranked = history.numbered(select_commits(source, options), "place", F.asc("walk_seq"))
    n, start, skipped = ranked.count(), 1, []
    while start <= n:
        some = ranked.where(F.col("place").between(start, start + wave - 1)).drop("place")
        found, bad = matched(source, options, occurrences(source, options, some))
        if text.exists(found):
            return True, skipped, min(n, start + wave - 1)
        skipped.append(bad)
        start, wave = start + wave, wave * GROWTH
    return False, skipped, n


def quiet_code(found: bool, skipped: list[DataFrame]) -> int:
    """0 with a match, whatever could not be read; else 2 if something could not, else 1."""
    return 0 if found else 2 if any(text.exists(s) for s in skipped) else 1
