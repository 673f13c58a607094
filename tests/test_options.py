from datetime import datetime, timedelta, timezone

import pytest

from palimpsest.options import OptionError, SearchOptions, parse_args, parse_date


def test_bundles_and_values():
    o = parse_args(["-inC2", "-epat", "-m=3", "--glob=*.go", "-t", "py", "HEAD~3..HEAD", "src", "--", "-x"])
    assert o.ignore_case and o.line_number and o.before_context == o.after_context == 2 and o.patterns == ("pat",) and o.max_count == 3
    assert o.globs == ("*.go",) and o.types == ("py",) and o.rev_range == "HEAD~3..HEAD" and o.paths == ("src", "-x")


def test_positionals():
    assert parse_args(["p"]).patterns == ("p",)
    o = parse_args(["p", "main", "a", "b", "--", "c"])
    assert (o.rev_range, o.paths) == ("main", ("a", "b", "c"))
    with pytest.raises(OptionError):
        parse_args([])
    assert parse_args(["--help"]).long_help


def test_booleans_and_colour():
    assert not parse_args(["--line-number=off", "p"]).line_number
    assert parse_args(["--color", "p"]).color == "always" and parse_args(["--color=never", "p"]).color == "never"
    o = parse_args(["-S", "--ignore-case=false", "p"])
    assert o.case_sensitive and not o.folds_case()
    for bad in (["--count=maybe", "p"], ["--color=red", "p"], ["--nope", "p"], ["-Z", "p"], ["-C", "x", "p"], ["-A"], ["--max-count"], ["-m-1", "p"]):
        with pytest.raises(OptionError):
            parse_args(bad)
    assert parse_args(["--all-commits", "p"]).expand_commits and parse_args(["-H", "p"]).heading and not parse_args(["--no-heading", "p"]).heading


def test_case():
    assert SearchOptions(("apple",), smart_case=True).folds_case() and not SearchOptions(("Apple",), smart_case=True).folds_case()
    assert not SearchOptions((r"\W",), smart_case=True).folds_case() and SearchOptions(("A",), ignore_case=True, case_sensitive=True).folds_case()


@pytest.mark.parametrize("bad", [
    {"patterns": ()}, {"patterns": ("(",)}, {"patterns": ("a",), "rev_range": "A...B"}, {"patterns": ("a",), "rev_range": "../x"},
        {"patterns": ("a",), "rev_range": "a b"}, {"patterns": ("a",), "rev_range": "~1"},
    {"patterns": ("a",), "rev_range": "a~x"}, {"patterns": ("a",), "branches": ("release/v1",)}, {"patterns": ("a",), "paths": (" ",)},
        {"patterns": ("a",), "since": "someday"}, {"patterns": ("a",), "max_count": -1},
    {"patterns": ("a",), "color": "red"}, {"patterns": ("a",), "types": ("nope",)}, {"patterns": ("a",), "author": "("},
        {"patterns": ("a",), "globs": ("a\0",)},
])
def test_validation(bad):
    with pytest.raises(OptionError):
        SearchOptions(**bad).validate()


def test_valid():
    SearchOptions(("a", "(b"), fixed_strings=True, rev_range="v1..HEAD~2", branches=("main",), since="2023-01-15", until="2 weeks ago").validate()
    for rev in ("HEAD^1", "HEAD@{1}", "..HEAD", "a.."):
        SearchOptions(("a",), rev_range=rev).validate()


def test_dates():
    now = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    assert parse_date("1700000000").timestamp() == 1700000000
    assert parse_date("2024-01-02T03:04:05+02:00") == datetime(2024, 1, 2, 1, 4, 5, tzinfo=timezone.utc)
    assert parse_date("2024-01-02 03:04:05").hour == 3 and parse_date("02-Jan-2024").day == 2
    assert parse_date("2 weeks ago", now) == now - timedelta(days=14) and parse_date("yesterday", now) == datetime(2024, 5, 5, tzinfo=timezone.utc)
