import pytest
from pyspark.sql import functions as F

from palimpsest.functions import globs


def passing(spark, paths, make):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return {r.p for r in df.where(make(F.col("p"))).collect()}


@pytest.mark.parametrize("rules,path,expected", [
    # without a slash, a rule is for the file's name; with one, for the whole path
    (["*.tex"], "thesis.tex", True), (["*.tex"], "part/one/thesis.tex", True), (["*.tex"], "thesis.tex.bak", False), (["part/*.tex"], "part/one.tex", True),
        (["part/*.tex"], "my/part/one.tex", False), (["part/*.tex"], "part/a/one.tex", False),
    # ** crosses slashes, **/ may be nothing
    (["part/**/fig?.svg"], "part/fig1.svg", True), (["part/**/fig?.svg"], "part/a/b/fig2.svg", True), (["part/**/fig?.svg"], "part/a/fig10.svg", False),
        (["**/x"], "x", True), (["a/**"], "a/b/c", True), (["a/**"], "a", False),
    # rules that exclude, and the last one that matches
    (["!*.log"], "run.txt", True), (["!*.log"], "run.log", False), (["*.txt", "!draft*"], "draft1.txt", False), (["!draft*", "*.txt"], "draft1.txt", True),
        (["docs/*", "!docs/*_draft.*", "docs/final_*"], "docs/final_draft.rst", True), (["docs/*", "!docs/*_draft.*", "docs/final_*"], "docs/old_draft.rst", False),
        (["docs/*", "!docs/*_draft.*", "docs/final_*"], "docs/plan.rst", True), (["docs/*", "!docs/*_draft.*", "docs/final_*"], "plan.rst", False),
    # classes, escapes, and what is not syntax
    (["[b-d]ox[^.]"], "coxy", True), (["[b-d]ox[^.]"], "cox.", False), (["[!b-d]ox"], "box", False), (["[!b-d]ox"], "fox", True), (["{x,y}"], "x", False), (["{x,y}"], "{x,y}", True), (["/top"], "top", False),
        (["sub/"], "sub/file", False), ([r"\?"], "?", True), ([r"\?"], "a", False), (["a.b"], "axb", False), (["  *.c  "], "a.c", True),
            ([" ", ""], "any", True),
])
def test_globs(spark, rules, path, expected):
    assert (path in passing(spark, [path], lambda p: globs.glob_filter(p, rules))) is expected


def test_unclosed_class():
    with pytest.raises(ValueError):
        globs.glob_regex("[ab")


def test_types(spark):
    assert passing(spark, ["a/b.zig", "c.ZIG", "d.zig.txt", "e.lua", "zig"], lambda p: globs.type_filter(p, ["zig", "lua"])) == {"a/b.zig", "c.ZIG", "e.lua"}
    assert passing(spark, ["Dockerfile", "a/my.dockerfile", "dockerfile"], lambda p: globs.type_filter(p, [" Docker "])) == {"Dockerfile", "a/my.dockerfile"}
    with pytest.raises(ValueError):
        globs.type_filter(F.lit("a"), ["nope"])
    assert len(globs.list_types()) == 35 and globs.lookup_type("TS") == ([".ts", ".mts", ".cts", ".tsx"], [])


def test_prefixes(spark):
    paths = ["a", "a/b", "ab", "sub/a/c", "d"]
    assert passing(spark, paths, lambda p: globs.prefix_filter(p, ["a/", "."])) == {"a", "a/b"}
    assert passing(spark, paths, lambda p: globs.prefix_filter(p, ["a"], "sub")) == {"a", "a/b", "sub/a/c"}
    assert passing(spark, paths, lambda p: globs.prefix_filter(p, ["."], "sub")) == set(paths)
