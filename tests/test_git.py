import hashlib
import io
import os
import signal
import struct
import threading
import time
import zlib

import pytest

from palimpsest import cli
from palimpsest.operators import treediff
from palimpsest.options import SearchOptions
from palimpsest.plans import engine
from palimpsest.sources import gitstore
from tests.gitwriter import Repo, ofs, varint


def oid(kind, data):
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


def copy(start, n):
    return bytes([0x91, start, n])


def test_delta():
    base = b"0123456789abcdefghij"
    delta = varint(20) + varint(13) + copy(10, 5) + b"\x03<->" + copy(0, 5)
    assert gitstore.apply_delta(base, delta) == b"abcde<->01234"
    assert gitstore.apply_delta(b"x" * 70000, varint(70000) + varint(0x10000) + bytes([0x80])) == b"x" * 0x10000
    assert gitstore.apply_delta(b"", varint(0) + varint(0)) == b""
    assert gitstore.apply_delta(bytes(300), varint(300) + varint(1) + bytes([0x80 | 0x03 | 0x10, 0x2B, 0x01, 1])) == b"\0"  # an offset of two bytes
    wrong = (
        varint(21) + varint(5) + copy(0, 5),  # for another base
        varint(20) + varint(5) + b"\x00",  # opcode 0
        varint(20) + varint(5) + b"\x05ab", varint(20) + varint(5) + bytes([0x91, 3]),  # cut short
        varint(20) + varint(30) + copy(5, 30),  # beyond the base
        varint(20) + varint(4) + copy(0, 5),  # more than is declared
        varint(20) + b"\x80", b"\xff" * 12,
    )
    for bad in wrong:
        with pytest.raises(gitstore.CorruptObject):
            gitstore.apply_delta(base, bad)


def test_loose():
    assert gitstore.decode_loose(zlib.compress(b"blob 2\0hi")) == ("blob", b"hi")
    for bad in (b"junk", zlib.compress(b"blob 3\0hi"), zlib.compress(b"blob hi"), zlib.compress(b"blub 2\0hi")):
        with pytest.raises(gitstore.CorruptObject):
            gitstore.decode_loose(bad)


def test_packs(tmp_path, spark):
    repo = Repo(tmp_path)
    base = b"0123456789abcdefghij"
    swapped, longer = b"abcde<->01234", base + b" and more"
    a, b, c = oid("blob", base), oid("blob", swapped), oid("blob", longer)
    to_swapped = varint(20) + varint(13) + copy(10, 5) + b"\x03<->" + copy(0, 5)
    to_longer = varint(20) + varint(29) + copy(0, 20) + b"\x09 and more"
    repo.pack([(a, 3, base, b""), (b, 6, to_swapped, lambda at, offsets: ofs(at - offsets[a])), (c, 7, to_longer, bytes.fromhex(a))])
    x, y = "11" * 20, "22" * 20
    repo.pack([(x, 7, varint(1) + varint(1) + b"\x01a", bytes.fromhex(y)), (y, 7, varint(1) + varint(1) + b"\x01a", bytes.fromhex(x))], "two")
    store = gitstore.Store(str(repo.git))
    assert store.read(b) == ("blob", swapped) and store.read(c) == ("blob", longer) and a in store and "33" * 20 not in store
    assert store.kind(b) == store.kind(c) == "blob" and store.rank(a) == 1 and store.rank(x) == 2
    for ask in (store.read, store.kind):
        with pytest.raises(gitstore.CorruptObject):
            ask(x)
        with pytest.raises(gitstore.NotFound):
            ask("33" * 20)
    loose = repo.put("blob", b"loose")
    repo.put("blob", base)  # loose and packed: told once
    tree = repo.tree({"f": b"in a tree"})
    found = gitstore.discover(tmp_path, {})
    rows = {r.oid: r for r in gitstore.objects(spark, found).collect()}
    assert bytes(rows[b].data) == swapped and rows[loose].size == 5 and rows[x].error and rows[x].data is None
    assert gitstore.objects(spark, found).count() == len(rows) == 8
    assert [r.oid for r in gitstore.objects(spark, found, "tree").collect()] == [tree]
    asked = spark.createDataFrame([(o,) for o in (b, x, loose, "33" * 20)], "oid string")
    read = {r.blob_oid: r for r in gitstore.read_blobs(asked, found).collect()}
    assert read[b].content == swapped.decode() and not read[b].is_binary and read[x].error and read["33" * 20].error and read[loose].content == "loose"
    with pytest.raises(gitstore.CorruptObject):
        gitstore.PackIndex(b"\xfftOc\x00\x00\x00\x02" + b"\xff\xff\xff\xff" + b"\0" * 1020)


def test_index_lookup(tmp_path):
    """Names are found by bisection, and offsets over 31 bits are looked up in their own table."""
    import random

    rnd = random.Random(1)
    names = sorted({bytes(rnd.randrange(256) for _ in range(20)) for _ in range(500)})
    offsets = [(1 << 31 | 0) if k == 7 else 12 + k for k in range(len(names))]
    fan = [sum(n[0] <= k for n in names) for k in range(256)]
    data = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(names) + bytes(4 * len(names))
    data += b"".join(struct.pack(">I", o) for o in offsets) + struct.pack(">Q", 5 << 32) + bytes(40)
    index = gitstore.PackIndex(data)
    for k, n in enumerate(names):
        assert index.oid(k) == n.hex() and index.offset(n.hex()) == (5 << 32 if k == 7 else 12 + k)
    assert index.offset("00" * 20) is None and index.offset("ff" * 20) is None and index.offset("a" * 64) is None


def test_depth(tmp_path):
    """A chain of 50 deltas is read; one of 51 is not, and neither across packs."""
    repo = Repo(tmp_path)
    chain = [(oid("blob", b"x0"), 3, b"x0", b"")]
    for k in range(1, 53):
        before = chain[-1][0]
        chain.append((oid("blob", b"x%d" % k), 7, varint(len(b"x%d" % (k - 1))) + varint(len(b"x%d" % k)) + bytes([len(b"x%d" % k)]) + b"x%d" % k,
            bytes.fromhex(before)))
    repo.pack(chain[:30], "a")
    repo.pack(chain[30:], "b")
    store = gitstore.Store(str(repo.git))
    assert store.read(chain[50][0]) == ("blob", b"x50")
    with pytest.raises(gitstore.CorruptObject):
        store.read(chain[51][0])


def test_only_changed_trees_are_opened(tmp_path, spark):
    repo = Repo(tmp_path)
    files = {f"d{i}/e{j}/f{k}": b"%d %d %d" % (i, j, k) for i in range(10) for j in range(5) for k in range(4)}
    one = repo.commit(files)
    two = repo.commit(files | {"d3/e2/f1": b"changed", "d3/e2/new": b"new"}, one)
    store = gitstore.Store(str(repo.git))
    root = lambda sha: store.read(sha)[1][5:45].decode()
    new, old = root(two), root(one)
    found = gitstore.discover(tmp_path, {})
    pairs = lambda *p: spark.createDataFrame(p, "new string, old string")
    opened, levels = gitstore.open_pairs(found), []

    def counted(frontier, n):
        levels.append(frontier.count())
        return opened(frontier, n)

    changed = lambda *p: sorted(r.path for r in treediff.pair_changes(pairs(*p), counted, len(p)).collect())
    assert changed((new, old)) == ["d3/e2/f1", "d3/e2/new"] and levels == [1, 1, 1]  # three pairs, of 61 trees a side
    assert changed((old, new)) == ["d3/e2/f1"]  # what is gone gives nothing
    levels.clear()
    assert len(changed((new, ""))) == 201 and levels == [1, 10, 50]
    with pytest.raises(Exception, match="f{40}"):
        changed(("f" * 40, old))
    levels.clear()
    assert len(changed((old, "f" * 40))) == 200 and levels == [1, 10, 50]  # what cannot be read has nothing in common


def test_canonical_order():
    entries = [(0o40000, "a", ""), (0o100644, "a.b", ""), (0o100644, "a0", ""), (0o100644, "a-", "")]
    assert [n for _, n, _ in sorted(entries, key=gitstore.canonical)] == ["a-", "a.b", "a", "a0"]


def test_discovery(tmp_path):
    repo = Repo(tmp_path / "r")
    (tmp_path / "r" / "sub").mkdir()
    found = gitstore.discover(tmp_path / "r" / "sub", {})
    assert found.git_dir == str(repo.git) and not found.bare
    linked = tmp_path / "linked"
    (linked / "wt").mkdir(parents=True)
    gd = repo.git / "worktrees" / "wt"
    gd.mkdir(parents=True)
    (gd / "HEAD").write_text("ref: refs/heads/main\n")
    (gd / "commondir").write_text("../..\n")
    (linked / "wt" / ".git").write_text(f"gitdir: {gd}\n")
    found = gitstore.discover(linked / "wt", {})
    assert found.common_dir == str(repo.git) and found.git_dir == str(gd)
    assert gitstore.discover(tmp_path, {"GIT_DIR": str(repo.git), "GIT_WORK_TREE": str(tmp_path / "r")}).work_tree == str(tmp_path / "r")
    bare = tmp_path / "bare"
    (bare / "objects").mkdir(parents=True)
    (bare / "HEAD").write_text("ref: refs/heads/main\n")
    assert gitstore.discover(bare, {}).bare
    with pytest.raises(gitstore.NotFound):
        gitstore.discover("/", {})


def test_refs(tmp_path):
    repo = Repo(tmp_path)
    sha, old = "a" * 40, "b" * 40
    (repo.git / "packed-refs").write_text(f"# pack-refs\n{old} refs/heads/main\n{old} refs/tags/v1\n^{sha}\n")
    (repo.git / "refs" / "heads" / "main").write_text(sha + "\n")
    r = gitstore.discover(tmp_path, {})
    assert gitstore.resolve_ref(r, "main") == sha and gitstore.resolve_ref(r, "v1") == old and gitstore.resolve_ref(r,
        "HEAD") == sha and gitstore.resolve_ref(r, "C" * 40) == "c" * 40
    assert gitstore.all_refs(r) == {"refs/heads/main": sha, "refs/tags/v1": old, "HEAD": sha}
    # All loose refs come before packed ones, whatever kind they are of.
    tag = "d" * 40
    (repo.git / "packed-refs").write_text(f"{old} refs/heads/x\n{old} refs/heads/main\n{old} refs/tags/v1\n")
    (repo.git / "refs" / "tags").mkdir()
    (repo.git / "refs" / "tags" / "x").write_text(tag + "\n")
    assert gitstore.resolve_ref(r, "x") == tag and gitstore.resolve_ref(r, "heads/x") == old
    (repo.git / "ORIG_HEAD").write_text(old + "\n")
    assert gitstore.resolve_ref(r, "ORIG_HEAD") == old
    # A symbolic ref does not leave the repository.
    (tmp_path / "outside").write_text(sha + "\n")
    for k, target in enumerate(("../outside", "/etc/passwd", "refs/../../outside", "a b", "")):
        (repo.git / "refs" / "heads" / f"evil{k}").write_text(f"ref: {target}\n")
        with pytest.raises(gitstore.NotFound):
            gitstore.resolve_ref(r, f"evil{k}")
    assert not any("evil" in name for name in gitstore.all_refs(r))
    (repo.git / "loop").write_text("ref: loop\n")
    for bad in ("nope", "a..b", "x^1", "HEAD@{1}", "/x", "a.lock", ".", "..", "refs/heads/../../HEAD", "refs/heads/main/"):
        with pytest.raises(gitstore.NotFound):
            gitstore.resolve_ref(r, bad)
    with pytest.raises(gitstore.CorruptObject):
        gitstore.resolve_ref(r, "loop")


def test_commits_and_trees(tmp_path, spark):
    data = b"tree t1\nparent p1\nparent p2\nauthor A B <a@x> 1609459200 +0200\ncommitter broken\ngpgsig -----\n line\n -----\n\n\n  Subject \n\nBody"
    df = spark.createDataFrame([("c1", "commit", data), ("c2", "commit", b"author x\n\nno tree"),
        ("c3", "commit", b"tree t\r\nauthor \xff <e> 5 +0000\r\n\r\nhi")], "oid string, type string, data binary")
    rows = {r.sha: r for r in gitstore.parse_commits(df).collect()}
    c = rows["c1"]
    assert c.tree_oid == "t1" and c.parents == ["p1",
        "p2"] and c.author_name == "A B" and c.author_email == "a@x" and c.commit_ts.year == 2021 - (c.commit_ts.month == 12) and c.commit_tz == "+0200" and c.summary == "Subject"
    assert c.committer == c.committer_name == "broken" and c.committer_ts is None and c.error is None and rows["c2"].error and rows["c3"].summary == "hi" and rows["c3"].tree_oid == "t"
    payload = b"100644 a\0" + bytes(20) + b"40000 dir\0" + b"\1" * 20
    assert gitstore.tree_entries(payload) == [(0o100644, "a", "00" * 20), (0o40000, "dir",
        "01" * 20)] and gitstore.tree_entries(payload + b"junk") == gitstore.tree_entries(payload)


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    repo = Repo(tmp_path_factory.mktemp("repo"))
    one = repo.commit({"src/main.go": b"package main\nfunc main() {}\nTODO one\n", "doc/readme.md": b"hello\nTODO two\n"}, when=1673740800,
        author="Alice <alice@x.org>", committer="bot <bot@x.org>")
    two = repo.commit({"src/main.go": b"package main\nfunc main() { run() }\nTODO one\n", "doc/readme.md": b"hello\nTODO two\n", "bin": b"\0TODO"}, one,
        when=1686787200, author="Bob <bob@x.org>")
    side = repo.commit({"src/main.go": b"package main\nSIDE\nTODO one\n", "doc/readme.md": b"hello\nTODO two\n"}, one, when=1686790800,
        author="Cy <cy@x.org>", ref="side")
    repo.commit({"src/main.go": b"package main\nSIDE\nTODO one\n", "src/new.rs": b"TODO two\n", "bin": b"\0TODO", "doc/readme.md": b"hello\nTODO two\n"},
        two, side, when=1699999999, author="Alice <alice@x.org>")
    (repo.folder / "src").mkdir()
    return repo


SOURCES = {}


def run(spark, history, *args, start=None):
    out, err = io.StringIO(), io.StringIO()
    folder = str(start or history.folder)
    if folder not in SOURCES:
        SOURCES[folder] = engine.from_git(spark, folder, {})
    code = cli.main(list(args), spark, folder, out, err, SOURCES[folder])
    return code, out.getvalue().splitlines(), err.getvalue()


def test_whole_command(spark, history):
    out = io.StringIO()
    assert cli.main(["-l", "hello"], spark, str(history.folder), out) == 0 and out.getvalue().count("doc/readme.md") == 1
    assert cli.main(["x"], spark, "/") == 2 and cli.main(["--help"], out=out) == 0


def test_search(spark, history):
    code, lines, _ = run(spark, history, "--no-heading", "func main")
    assert code == 0 and [x.split(":", 1)[1] for x in lines] == ["src/main.go:2:func main() { run() }", "src/main.go:2:func main() {}"]
    code, lines, _ = run(spark, history, "TODO")
    assert code == 0 and lines[0] == "src/new.rs" and lines[1].endswith("2023-11-14 Alice]") and lines[2:4] == ["1:TODO two",
        ""] and any(x.startswith("Binary file bin matches in") for x in lines)
    assert run(spark, history, "nothing here")[0] == 1 and run(spark, history, "(")[0] == 2 and run(spark, history, "x", "nope")[0] == 2


def test_merges_and_first_parent(spark, history):
    found = lambda *a: sorted(run(spark, history, "-c", *a)[1])
    assert len(found("SIDE")) == 1 and len(found("--first-parent", "SIDE")) == 1
    assert run(spark, history, "--no-heading", "--first-parent", "SIDE")[1][0] != run(spark, history, "--no-heading", "SIDE")[1][0]


def test_filters_and_sinks(spark, history):
    count = lambda *a: len(run(spark, history, *a)[1])
    assert count("-c", "TODO", "--author", "alice") == 3 and count("-c", "TODO", "--committer", "bot@") == 2 and count("-c", "TODO", "--since",
        "2023-05-01", "--until", "2023-06-15 00:30:00") == 2
    assert count("-l", "-g", "*.md", "TODO") == 1 and count("-l", "-t", "rust", "TODO") == 1 and count("-c", "TODO", "HEAD", "src") == 4
    assert count("-c", "TODO", "HEAD~1..HEAD") == 2 and count("-c", "TODO", "HEAD~2") == 2 and count("-c", "--all-commits", "TODO", "--", "doc") == 4
    code, lines, _ = run(spark, history, "-q", "TODO")
    assert code == 0 and not lines
    code, lines, _ = run(spark, history, "--no-heading", "-C1", "-m1", "run\\(\\)")
    assert [x.split("main.go")[1] for x in lines] == ["-1-package main", ":2:func main() { run() }", "-3-TODO one"]
    assert count("-c", "TODO", "--", "main.go") == 0
    code, lines, _ = run(spark, history, "-c", "TODO", "--", "main.go", start=history.folder / "src")
    assert len(lines) == 3


def test_colour(spark, history):
    _, lines, _ = run(spark, history, "--color=always", "--no-heading", "SIDE")
    assert "\x1b[1;31mSIDE\x1b[0m" in lines[0]


def test_interrupted(spark, history):
    class Full(io.StringIO):
        def write(self, text):
            raise KeyboardInterrupt
    err = io.StringIO()
    assert cli.main(["TODO"], spark, str(history.folder), Full(), err) == 130 and "interrupted" in err.getvalue()
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and run(spark, history, "-q", "TODO")[0] == 0


def test_original_head_and_branches(spark, history):
    (history.git / "ORIG_HEAD").write_text((history.git / "refs" / "heads" / "side").read_text())
    assert len(run(spark, history, "-c", "SIDE", "ORIG_HEAD")[1]) == 1 and run(spark, history, "x", "ORIG")[0] == 2
    assert len(run(spark, history, "-c", "SIDE", "HEAD~2", "--", "src")[1]) == 0


def test_deleted_and_renamed(spark, tmp_path):
    """History keeps what is gone; a file under a new name is told there too."""
    repo = Repo(tmp_path)
    one = repo.commit({"old": b"needle\n", "gone": b"needle here\n"}, when=1700000000)
    two = repo.commit({"new": b"needle\n"}, one, when=1700000100)
    repo.commit({"other": b"x\n"}, two, when=1700000200)
    assert sorted(x.split(":")[1] for x in run(spark, repo, "--no-heading", "needle")[1]) == ["gone", "new", "old"]


def test_empty_repository(spark, tmp_path):
    code, lines, _ = run(spark, Repo(tmp_path), "x")
    assert code == 2 and not lines  # HEAD names a branch without commits


def test_bytes_that_are_not_utf8(spark, tmp_path):
    repo = Repo(tmp_path)
    repo.commit({"latin": b"caf\xe9 needle here \xff\xfe needle\n", "bin": b"\0\xe9 needle\n"})
    found = engine.search(spark, engine.from_git(spark, str(tmp_path), {}), SearchOptions(("needle",), color="always"))
    row = found.rows.where("NOT is_binary").first()
    assert [(s.start, s.end) for s in row.submatches] == [(5, 11), (20, 26)] and found.rows.where("is_binary").count() == 1
    _, lines, _ = run(spark, repo, "--color=always", "--no-heading", "needle", "--", "latin")
    assert "caf\ufffd \x1b[1;31mneedle\x1b[0m here \ufffd\ufffd \x1b[1;31mneedle" in lines[0]
    assert len(run(spark, repo, "-a", "-c", "needle")[1]) == 2 and run(spark, repo, "--no-heading", "caf. n", "--", "latin")[0] == 0
    assert found.out().where("out LIKE '%caf\ufffd needle%'").count() == 1


def test_skewed_clocks(spark, tmp_path):
    """A child that is older than its parent waits in the heap: the walk, not the dates, says who is met first."""
    repo = Repo(tmp_path)
    base = repo.commit({"f": b"a\n"}, when=1000)
    early = repo.commit({"f": b"needle\n"}, base, when=5000, author="Early <e@x>")
    back = repo.commit({"f": b"a\n"}, early, when=200, author="Back <b@x>")
    late = repo.commit({"f": b"needle\n"}, back, when=100, author="Late <l@x>")
    repo.commit({"f": b"needle\n", "g": b"x\n"}, late, when=6000)
    _, lines, _ = run(spark, repo, "needle")
    assert any("Late" in x for x in lines) and not any("Early" in x for x in lines)


def test_unreadable(spark, tmp_path):
    repo = Repo(tmp_path)
    repo.commit({"good": b"needle\n", "bad": b"needle too\n"})
    bad = oid("blob", b"needle too\n")
    (repo.git / "objects" / bad[:2] / bad[2:]).write_bytes(b"junk")
    code, lines, err = run(spark, repo, "-c", "needle")
    assert code == 2 and len(lines) == 1 and bad in err
    assert run(spark, repo, "-q", "needle")[0] == 0 and run(spark, repo, "absent")[0] == 2


def test_quiet_stops_at_the_first_match(spark, tmp_path, monkeypatch):
    """A match in the newest commit reads what the first wave of commits touches, of a long history."""
    repo, parent = Repo(tmp_path), None
    files = {f"d{i % 9}/f{i}": b"old %d\n" % i for i in range(90)}
    for k in range(240):
        files[f"d{k % 9}/f{k % 90}"] = b"edit %d\n" % k
        if k == 239:
            files["d1/f1"] = b"needle\n"
        if k == 10:
            files["d2/f2"] = b"early bird\n"
        parent = repo.commit(dict(files), *([parent] if parent else []), when=1600000000 + 60 * k)
    asked = {"trees": 0, "blobs": 0}
    opens, reads = gitstore.open_pairs, gitstore.read_blobs

    def open_pairs(found):
        opened = opens(found)

        def run(pairs, n):
            asked["trees"] += 2 * pairs.count()
            return opened(pairs, n)
        return run

    def read_blobs(oids, found):
        asked["blobs"] += oids.count()
        return reads(oids, found)

    monkeypatch.setattr(gitstore, "open_pairs", open_pairs)
    monkeypatch.setattr(gitstore, "read_blobs", read_blobs)
    source, look = engine.from_git(spark, str(tmp_path), {}), lambda p, n: engine.first_match(spark, source, SearchOptions((p,), quiet=True), wave=n)
    found, skipped, commits = look("needle", 4)
    assert found and not skipped and commits == 4
    objects = sum(1 for f in (repo.git / "objects").rglob("*") if f.is_file())
    assert objects > 900 and asked["trees"] + asked["blobs"] < 0.05 * objects
    found, skipped, commits = look("early b[i]rd", 200)
    assert found and len(skipped) == 1 and commits == 240
    found, skipped, commits = look("nowhere", 240)
    assert not found and commits == 240 and engine.quiet_code(found, skipped) == 1


def slow_source(spark):
    """Commits and a blob whose search takes minutes."""
    from pyspark.sql import functions as F

    c = spark.createDataFrame([("a" * 40, "t", [], "n", "n")], "sha string, tree_oid string, parents array<string>, author string, author_name string")
    nap = F.udf(lambda x: __import__("time").sleep(1) or x, "string").asNondeterministic()
    blobs = spark.range(0, 4000, 1, 2).select(F.lpad(F.col("id").cast("string"), 40, "0").alias("blob_oid")).withColumn("content", nap("blob_oid"))
    where = blobs.select("blob_oid", F.lit("p").alias("path"), F.lit("a" * 40).alias("commit_sha"))
    return engine.Source(c.withColumn("commit_ts", F.lit(None).cast("timestamp")), blobs, occurrences=where)


@pytest.mark.parametrize("number,code,word", [(signal.SIGTERM, 143, "terminated"), (signal.SIGINT, 130, "interrupted")])
def test_signals_stop_the_jobs(spark, number, code, word):
    """The first signal cancels and tells the exit code; a second would end the process, for nothing catches it any more."""
    tracker, before = spark.sparkContext.statusTracker(), {n: signal.getsignal(n) for n in (signal.SIGINT, signal.SIGTERM)}
    source, seen = slow_source(spark), []

    class Told(io.StringIO):
        def write(self, text):
            seen.append(signal.getsignal(signal.SIGTERM))
            return super().write(text)

    def send():
        while not tracker.getActiveJobsIds():
            time.sleep(0.1)
        time.sleep(1)
        os.kill(os.getpid(), number)

    thread = threading.Thread(target=send)
    thread.start()
    began, err = time.monotonic(), Told()
    assert cli.main(["--no-heading", "x"], spark, ".", io.StringIO(), err, source) == code and word in err.getvalue()
    thread.join()
    assert time.monotonic() - began < 60 and seen[0] == signal.SIG_DFL
    assert {n: signal.getsignal(n) for n in before} == before
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds() and not tracker.getActiveStageIds()


def test_callers_cancel_from_another_thread(spark):
    source, got, cancels = slow_source(spark), [], []

    def work():
        with engine.running(spark) as cancel:
            cancels.append(cancel)
            try:
                engine.search(spark, source, SearchOptions(("x",), color="never")).rows.count()
            except Exception as e:
                got.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    while not cancels or not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.1)
    assert spark.range(10).count() == 10  # jobs of others go on
    cancels[0]()
    thread.join(60)
    assert got and "cancel" in str(got[0]).lower() and not thread.is_alive()


def test_repository_of_documents_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """The driver makes commits only, and a tree has what its window brings, however long history is."""
    from palimpsest.plans import catalogue
    from palimpsest.sinks import gitpack

    docs = [(i, None if i == 7 else f"text {i} of some hation\n", f"s{i % 3}/sub-s{i % 2}") for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalogue, "BATCH", 2)
    kinds, put = set(), gitpack.History.put
    monkeypatch.setattr(gitpack.History, "put", lambda self, kind, data: kinds.add(kind) or put(self, kind, data))
    repo = gitstore.discover(catalogue._repository(spark, str(tmp_path)), {})
    assert kinds == {"commit"}
    objects = gitstore.objects(spark, repo, "tree").collect()
    assert all(len(gitstore.tree_entries(o.data)) <= catalogue.WINDOW for o in objects)
    assert gitstore.parse_commits(gitstore.objects(spark, repo, "commit")).count() == 300
    monkeypatch.setattr(catalogue, "_repository", lambda *a: repo.work_tree)
    rows = catalogue.queries()["git_search"](spark, str(tmp_path)).collect()
    broken = {f"text {i} of some hation" for i in range(5, 600, 97)}
    want = {(f"batch {i // 2}", t.strip()) for i, t, _ in docs if t and t.strip() not in broken}
    assert {(r.summary, r.line_text) for r in rows} == want and len(rows) == len(want)
