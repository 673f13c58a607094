from palimpsest.options import SearchOptions
from palimpsest.sinks.render import highlight, painter, render, use_color


def row(path="a.go", sha="1234567890", n=1, text="x", match=True, group=0, binary=False, spans=()):
    return {"path": path, "commit_sha": sha, "commit_date": "2024-01-02", "author": "Ann", "line_num": n, "line_text": text, "is_match": match,
        "group_id": group, "is_binary": binary, "submatches": spans}


def test_grouped():
    rows = [row(n=3), row(n=5, text="y"), row(sha="abcdefghij", n=1), row(path="b", n=0, binary=True)]
    assert list(render(rows, SearchOptions(("x",)))) == ["a.go", "[1234567 2024-01-02 Ann]", "3:x", "5:y", "[abcdefg 2024-01-02 Ann]", "1:x", "", "b",
        "[1234567 2024-01-02 Ann]", "Binary file b matches in 1234567"]
    rows = [row(n=1, group=1, match=False), row(n=2, group=1), row(n=9, group=2)]
    assert list(render(rows, SearchOptions(("x",), before_context=1)))[2:] == ["1-x", "2:x", "--", "9:x"]
    assert list(render([row()], SearchOptions(("x",), line_number=False)))[-1] == "x"


def test_single_and_files():
    rows = [row(n=3), row(n=4, match=False), row(sha="abcdefghij")]
    assert list(render(rows, SearchOptions(("x",), heading=False))) == ["1234567:a.go:3:x", "1234567-a.go-4-x", "abcdefg:a.go:1:x"]
    assert list(render(rows, SearchOptions(("x",), files_with_matches=True))) == ["1234567:a.go", "abcdefg:a.go"]


def test_highlight():
    mark = lambda style, text: f"<{text}>"
    assert highlight("héllo", [(1, 3), (2, 4), (4, 4), (5, 99)], mark) == "h<é>llo" and highlight("ab", [(1, 2), (0, 1)], mark) == "<a><b>"


def test_colour_policy():
    class Tty:
        def isatty(self):
            return True
    assert use_color("always", None, {}) and not use_color("never", Tty(), {}) and use_color("auto", Tty(), {"TERM": "xterm"})
    assert not use_color("auto", Tty(), {"NO_COLOR": "1"}) and not use_color("auto", Tty(), {"TERM": "dumb"}) and not use_color("auto", object(), {})
    assert painter(False)("path", "x") == "x" and painter(True)("path", "x") != "x"
