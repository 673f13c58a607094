"""A Git object store on disk as tables: discovery and refs on the driver, objects by Spark tasks.

Loose objects are one file each and packs are files of many, so the unit of work of a scan is some loose directories or
a range of a pack's objects. Whatever needs random access is done inside the task that needs it, not by joins: deltas,
the diff of two trees, and the lookup of objects by name. Indexes are mapped and bisected, packs are opened when read.
"""

from __future__ import annotations

import codecs
import mmap
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.operators.text import BAD, BINARY_PREFIX, LIKE
from palimpsest.sources.shipping import ship

# Fixed values of the format.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
MAX_OBJECT = 512 << 20
MAX_DELTA_DEPTH = 50
MAX_REF_DEPTH = 10
PACK_RANGE = 2000  # objects of a pack that one task reads
LOOSE_FILES = 2000  # loose objects that one task reads, about
TREES = 4096  # parsed trees that a task remembers
OBJECTS = "oid string, type string, size long, data binary, error string"
CANDIDATES = ("", "refs/", "refs/heads/", "refs/tags/", "refs/remotes/", "refs/remotes/origin/")  # in order of precedence
HEX = re.compile(r"(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\Z")


class CorruptObject(ValueError):
    pass


class NotFound(KeyError):
    pass


@dataclass(frozen=True)
class Repository:
    """Where a repository's parts lie: common_dir differs from git_dir in linked work trees."""

    git_dir: str
    common_dir: str
    work_tree: str | None

    @property
    def bare(self) -> bool:
        return self.work_tree is None


def discover(start: str | os.PathLike = ".", environ: dict | None = None) -> Repository:
    """The repository that `start` lies in: by GIT_DIR and GIT_WORK_TREE if set, else by the nearest .git above."""
    env = os.environ if environ is None else environ
    here = Path(start).resolve()
    if given := env.get("GIT_DIR"):
        git = (here / given).resolve()
        tree = env.get("GIT_WORK_TREE")
        return _repository(git, str((here / tree).resolve()) if tree else None if _is_bare(git) else str(here))
    for folder in (here, *here.parents):
        dot = folder / ".git"
        if dot.is_dir():
            return _repository(dot, str(folder))
        if dot.is_file():
            return _repository(_pointed(dot), str(folder))
        if (folder / "HEAD").is_file() and (folder / "objects").is_dir():
            return _repository(folder, None)
    raise NotFound(f"no repository at or above {here}")


def _pointed(file: Path) -> Path:
    """The folder that a .git file names."""
    text = file.read_text().strip()
    if not text.startswith("gitdir:"):
        raise CorruptObject(f"{file} names no git folder")
    return (file.parent / text.removeprefix("gitdir:").strip()).resolve()


def _is_bare(git: Path) -> bool:
    config = git / "config"
    return bool(config.is_file() and re.search(r"(?im)^\s*bare\s*=\s*true", config.read_text(errors="replace")))


def _repository(git: Path, tree: str | None) -> Repository:
    common = git
    if (git / "commondir").is_file():
        common = (git / (git / "commondir").read_text().strip()).resolve()
    found = Repository(str(git), str(common), tree)
    if not (git / "HEAD").is_file():
        raise NotFound(f"{git} has no HEAD")
    if not (common / "objects").is_dir():
        raise NotFound(f"{common} has no objects")
    return found


def valid_ref(name: str) -> bool:
    """Whether a name can be that of a ref, and as a path stays where refs are."""
    if name in ("", ".") or name[0] == "/" or name[-1] == "/" or name.endswith(".lock"):
        return False
    return not any(x in name for x in ("..", "//", "@{")) and not re.search(r"[\x00-\x20\x7f~^:?*\[\\]", name)


def packed_refs(repo: Repository) -> dict[str, str]:
    file = Path(repo.common_dir) / "packed-refs"
    lines = file.read_text(errors="replace").splitlines() if file.is_file() else []
    rows = [x.split(" ", 1) for x in lines if x and x[0] not in "#^"]
    return {r[1].strip(): r[0] for r in rows if len(r) == 2 and HEX.match(r[0])}


def _loose(repo: Repository, name: str) -> str | None:
    """What the file of a ref says, if there is one: an oid, or `ref:` and a name."""
    for folder in dict.fromkeys((repo.git_dir, repo.common_dir)):
        file = Path(folder) / name
        if file.is_file():
            text = file.read_text(errors="replace").strip()
            if text.startswith("ref:") or HEX.match(text):
                return text
    return None


def find_ref(ref: str, loose: Callable[[str], str | None], packed: dict[str, str], depth: int = 0) -> str:
    """The oid that a name stands for: an oid is its own; else the first candidate among all loose refs, then packed ones.

    What a symbolic ref points to must be a valid name too.
    """
    if depth > MAX_REF_DEPTH:
        raise CorruptObject(f"{ref}: symbolic refs are nested too deep")
    if HEX.match(ref):
        return ref.lower()
    if not valid_ref(ref):
        raise NotFound(f"invalid ref '{ref}'")
    names = [ref] if ref == "HEAD" or ref.startswith("refs/") else [prefix + ref for prefix in CANDIDATES]
    for name in names:
        text = loose(name)
        if text is not None:
            target = text.removeprefix("ref:").strip()
            if text.startswith("ref:"):
                return find_ref(target, loose, packed, depth + 1)
            return target.lower() if HEX.match(target) else target
    for name in names:
        if name in packed:
            return packed[name]
    raise NotFound(f"unknown revision '{ref}'")


def resolve_ref(repo: Repository, ref: str, packed: dict[str, str] | None = None) -> str:
    """An oid as it is; else what the ref, or it under refs, heads, tags or remotes, points to. packed: packed_refs(), if
    they have been read, as for many refs they should be."""
    return find_ref(ref.strip(), lambda name: _loose(repo, name), packed_refs(repo) if packed is None else packed)


def all_refs(repo: Repository) -> dict[str, str]:
    """Names and oids, loose ones over packed ones, with HEAD."""
    packed = packed_refs(repo)
    found = dict(packed)
    root = Path(repo.common_dir)
    for file in sorted((root / "refs").rglob("*")):
        if file.is_file():
            name = file.relative_to(root).as_posix()
            try:
                found[name] = resolve_ref(repo, name, packed)
            except (CorruptObject, NotFound):
                continue
    try:
        found["HEAD"] = resolve_ref(repo, "HEAD", packed)
    except (CorruptObject, NotFound):
        pass  # a branch without commits
    return found


def loose_object(file: Path) -> tuple[str, bytes]:
    """(type, payload) of a loose object's file."""
    return decode_loose(file.read_bytes(), file.name)


def decode_loose(stored: bytes, name: str = "object") -> tuple[str, bytes]:
    try:
        raw = zlib.decompressobj().decompress(stored, MAX_OBJECT + 64)
    except zlib.error as e:
        raise CorruptObject(f"{name}: {e}") from None
    head, nul, data = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not nul or kind.decode(errors="replace") not in TYPES.values() or not size.isdigit():
        raise CorruptObject(f"{name}: malformed header")
    if int(size) > MAX_OBJECT or int(size) != len(data):
        raise CorruptObject(f"{name}: {len(data)} bytes where {size.decode()} are declared")
    return kind.decode(), data


class PackIndex:
    """A version 2 index, bytes or mapped: sorted oids and their offsets, looked up where they lie."""

    def __init__(self, data):
        if data[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise CorruptObject("not a version 2 pack index")
        self.data, self.fanout = data, (0, *struct.unpack_from(">256I", data, 8))
        if any(a > b for a, b in zip(self.fanout, self.fanout[1:])):
            raise CorruptObject("pack index fanout decreases")
        self.count = self.fanout[-1]
        self._names = 8 + 1024
        self._small = self._names + 24 * self.count
        self._large = self._small + 4 * self.count
        if self._large > len(data):
            raise CorruptObject("pack index is cut short")

    def oid(self, k: int) -> str:
        return self.data[self._names + 20 * k:self._names + 20 * k + 20].hex()

    def offset_at(self, k: int) -> int:
        (v,) = struct.unpack_from(">I", self.data, self._small + 4 * k)
        if v >> 31:
            at = self._large + 8 * (v & 0x7FFFFFFF)
            if at + 8 > len(self.data):
                raise CorruptObject("pack index offset is out of bounds")
            (v,) = struct.unpack_from(">Q", self.data, at)
        return v

    def offset(self, oid: str) -> int | None:
        if len(oid) != 40:
            return None
        name = bytes.fromhex(oid)
        low, high = self.fanout[name[0]], self.fanout[name[0] + 1]
        while low < high:
            middle = (low + high) // 2
            at = self._names + 20 * middle
            here = self.data[at:at + 20]
            if here == name:
                return self.offset_at(middle)
            low, high = (middle + 1, high) if here < name else (low, middle)
        return None


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta: copies from the base and inserted bytes, checked against both declared sizes."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            if at >= len(delta) or shift > 63:
                raise CorruptObject("delta header is cut short")
            value |= (delta[at] & 0x7F) << shift
            shift += 7
            at += 1
            if not delta[at - 1] & 0x80:
                return value, at

    size, at = varint(0)
    target, at = varint(at)
    if size != len(base):
        raise CorruptObject(f"delta is for a base of {size} bytes, not {len(base)}")
    if target > MAX_OBJECT:
        raise CorruptObject("delta target is too large")
    out, made = [], 0
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            args = [0] * 7
            for k in range(7):
                if op >> k & 1:
                    if at >= len(delta):
                        raise CorruptObject("delta copy is cut short")
                    args[k] = delta[at]
                    at += 1
            start = int.from_bytes(bytes(args[:4]), "little")
            n = int.from_bytes(bytes(args[4:]), "little") or 0x10000
            if start + n > len(base):
                raise CorruptObject("delta copies from beyond its base")
            out.append(base[start:start + n])
        elif op:
            n = op
            if at + n > len(delta):
                raise CorruptObject("delta insert is cut short")
            out.append(delta[at:at + n])
            at += n
        else:
            raise CorruptObject("delta has opcode 0")
        made += n
    if made != target:
        raise CorruptObject(f"delta makes {made} bytes where {target} are declared")
    return b"".join(out)


def _mapped(file: str | os.PathLike):
    with open(file, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Pack:
    """A pack file, mapped; objects are read at their offsets."""

    def __init__(self, file: str, index: PackIndex, store: Store | None = None):
        self.index, self.store = index, store
        self.data = _mapped(file)
        if self.data[:4] != b"PACK":
            raise CorruptObject(f"{file} is not a pack")

    def header(self, at: int) -> tuple[int, int, int]:
        """(type, size, where the data or the base's name begins)."""
        try:
            b = self.data[at]
            kind, size, shift = b >> 4 & 7, b & 15, 4
            at += 1
            while b & 0x80:
                b = self.data[at]
                size |= (b & 0x7F) << shift
                shift += 7
                at += 1
        except IndexError:
            raise CorruptObject("object header is cut short") from None
        if size > MAX_OBJECT:
            raise CorruptObject("object is too large")
        return kind, size, at

    def inflate(self, at: int, size: int) -> bytes:
        inflate, out = zlib.decompressobj(), bytearray()
        try:
            while not inflate.eof and at < len(self.data):
                piece = self.data[at:at + max(4096, size // 2)]
                out += inflate.decompress(piece)
                at += len(piece)
                if len(out) > size:
                    break
        except zlib.error as e:
            raise CorruptObject(str(e)) from None
        if len(out) != size:
            raise CorruptObject(f"{len(out)} bytes where {size} are declared")
        return bytes(out)

    def base_of(self, kind: int, offset: int, at: int) -> tuple[int | str, int]:
        """(offset or oid of a delta's base, where the delta's data begins)."""
        if kind == REF_DELTA:
            oid = self.data[at:at + 20].hex()
            own = self.index.offset(oid)
            return (oid if own is None else own), at + 20
        if kind != OFS_DELTA:
            raise CorruptObject(f"unknown object type {kind}")
        b = self.data[at]
        back = b & 0x7F
        while b & 0x80:
            at += 1
            b = self.data[at]
            back = (back + 1 << 7) | (b & 0x7F)
        if not 0 < back <= offset:
            raise CorruptObject("delta base is out of bounds")
        return offset - back, at + 1

    def _entry(self, offset: int, depth: int) -> tuple[int, int, int]:
        if depth > MAX_DELTA_DEPTH:
            raise CorruptObject("delta chain is too deep, or a cycle")
        if not 12 <= offset < len(self.data):
            raise CorruptObject("object offset is out of bounds")
        return self.header(offset)

    def kind_at(self, offset: int, depth: int = 0) -> str:
        """An object's type by headers alone; a delta has its base's."""
        kind, _, at = self._entry(offset, depth)
        if kind in TYPES:
            return TYPES[kind]
        base, _ = self.base_of(kind, offset, at)
        if isinstance(base, int):
            return self.kind_at(base, depth + 1)
        if self.store is None:
            raise CorruptObject(f"delta base {base} is missing")
        return self.store.kind(base, depth + 1)

    def read_at(self, offset: int, depth: int = 0) -> tuple[str, bytes]:
        kind, size, at = self._entry(offset, depth)
        if kind in TYPES:
            return TYPES[kind], self.inflate(at, size)
        base, at = self.base_of(kind, offset, at)
        if isinstance(base, int):
            name, data = self.read_at(base, depth + 1)
        elif self.store is not None:
            name, data = self.store.read(base, depth + 1)
        else:
            raise CorruptObject(f"delta base {base} is missing")
        return name, apply_delta(data, self.inflate(at, size))


class Store:
    """Point lookups: loose objects first, then packs in the order of their names. Nothing is opened before it is asked."""

    def __init__(self, common_dir: str):
        self.root = Path(common_dir) / "objects"
        self.names = sorted((self.root / "pack").glob("*.idx"))
        self._packs: list[Pack | None | bool] = [False] * len(self.names)
        self._loose: dict[str, frozenset] = {}
        self.reads = 0

    def pack(self, k: int) -> Pack | None:
        """The k-th pack; one that cannot be opened is as if it were not there."""
        if self._packs[k] is False:
            try:
                self._packs[k] = Pack(str(self.names[k].with_suffix(".pack")), PackIndex(_mapped(self.names[k])), self)
            except (CorruptObject, OSError, ValueError):
                self._packs[k] = None
        return self._packs[k]

    def loose_file(self, oid: str) -> Path | None:
        folder = oid[:2]
        if folder not in self._loose:
            try:
                self._loose[folder] = frozenset(os.listdir(self.root / folder))
            except OSError:
                self._loose[folder] = frozenset()
        return self.root / folder / oid[2:] if oid[2:] in self._loose[folder] else None

    def places(self, oid: str) -> Iterator[tuple[int, Callable]]:
        """(rank, a function that takes what to do of a pack and of a file) of each source that has the object."""
        if file := self.loose_file(oid):
            yield 0, lambda of_pack, of_file: of_file(file)
        for k in range(len(self.names)):
            pack = self.pack(k)
            if pack and (at := pack.index.offset(oid)) is not None:
                yield k + 1, lambda of_pack, of_file, pack=pack, at=at: of_pack(pack, at)

    def __contains__(self, oid: str) -> bool:
        return next(self.places(oid), None) is not None

    def rank(self, oid: str) -> int | None:
        return next((rank for rank, _ in self.places(oid)), None)

    def _first(self, oid: str, of_pack: Callable, of_file: Callable):
        """What the first source gives that does not fail; if all that have the object fail, the last failure is raised."""
        failed: Exception = NotFound(oid)
        for _, run in self.places(oid):
            try:
                return run(of_pack, of_file)
            except (CorruptObject, OSError, IndexError) as e:
                failed = e
        raise failed

    def read(self, oid: str, depth: int = 0) -> tuple[str, bytes]:
        """(type, payload)."""
        self.reads += 1
        return self._first(oid, lambda pack, at: pack.read_at(at, depth), loose_object)

    def kind(self, oid: str, depth: int = 0) -> str:
        return self._first(oid, lambda pack, at: pack.kind_at(at, depth), loose_kind)


@dataclass
class Part(InputPartition):
    kind: str
    paths: tuple[str, ...]
    rank: int
    start: int = 0
    end: int = 0


class ObjectReader(DataSourceReader):
    """Partitions are some loose directories or a range of a pack; each object comes from the first source that has it.

    Whether an earlier source has it, a task sees by itself, so no object is shuffled. With kinds given, only objects
    of these are inflated; what has no kind then is left out, else it is a row with its error.
    """

    def __init__(self, common_dir: str, kinds: str = ""):
        self.root = Path(common_dir) / "objects"
        self.common_dir, self.kinds = common_dir, frozenset(kinds.split(",")) - {""}

    def partitions(self) -> list[InputPartition]:
        parts, folders, n = [], [], 0
        for d in sorted(self.root.glob("[0-9a-f][0-9a-f]")):
            if d.is_dir():
                folders.append(str(d))
                n += len(os.listdir(d))
                if n >= LOOSE_FILES:
                    parts.append(Part("loose", tuple(folders), 0))
                    folders, n = [], 0
        if n:
            parts.append(Part("loose", tuple(folders), 0))
        for rank, idx in enumerate(sorted((self.root / "pack").glob("*.idx")), 1):
            with open(idx, "rb") as f:
                head = f.read(8 + 1024)
            n = struct.unpack_from(">I", head, 8 + 1020)[0] if head[:8] == b"\xfftOc\x00\x00\x00\x02" and len(head) == 1032 else 0
            parts += [Part("pack", (str(idx),), rank, at, min(at + PACK_RANGE, n)) for at in range(0, n, PACK_RANGE)]
        return parts or [Part("none", (), 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        store = Store(self.common_dir)
        for oid in self._oids(part, store):
            if store.rank(oid) == part.rank:
                row = _row(store, oid, self.kinds)
                if row is not None:
                    yield row

    def _oids(self, part: Part, store: Store) -> Iterator[str]:
        for folder in part.paths if part.kind == "loose" else ():
            names = sorted(os.listdir(folder))
            yield from (Path(folder).name + n for n in names if re.fullmatch(r"[0-9a-f]{38}|[0-9a-f]{62}", n))
        if part.kind == "pack" and (pack := store.pack(part.rank - 1)):
            yield from (pack.index.oid(k) for k in range(part.start, part.end))


def _row(store: Store, oid: str, kinds: frozenset = frozenset()) -> tuple | None:
    try:
        if kinds and store.kind(oid) not in kinds:
            return None
        kind, data = store.read(oid)
        return oid, kind, len(data), data, None
    except (CorruptObject, NotFound, OSError, IndexError) as e:
        return None if kinds else (oid, None, None, None, str(e))


class GitObjects(DataSource):
    """spark.read.format("git_objects").option("path", common_dir), with kinds, a list with commas, where not all are asked."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> DataSourceReader:
        return ObjectReader(self.options["path"], self.options.get("kinds", ""))


def objects(spark: SparkSession, repo: Repository, *kinds: str) -> DataFrame:
    """(oid, type, size, data, error), each oid once: from the first source that has it whole, else its last error."""
    ship(spark).dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", repo.common_dir).option("kinds", ",".join(kinds)).load()


BLOBS = "blob_oid string, content string, is_binary boolean, error string"


def decoded(data: bytes) -> str:
    """The text of bytes; each byte that is not UTF-8 is BAD, one character for one byte."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        codecs.register_error("palimpsest", lambda e: (BAD * (e.end - e.start), e.end))
        return data.replace(BAD.encode(), LIKE.encode()).decode("utf-8", "palimpsest")


def read_blobs(oids: DataFrame, repo: Repository) -> DataFrame:
    """(blob_oid, content, is_binary, error) of the oids in the first column, looked up where they are asked.

    Names are small and blobs are not, so the rows are dealt over all cores, whatever few partitions their bytes would fill.
    """
    common = repo.common_dir

    def run(batches):
        import pyarrow as pa

        store = Store(common)
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)],
            names=["blob_oid", "content", "is_binary", "error"])
        for batch in batches:
            held, n = [], 0
            for oid in batch.column(0).to_pylist():
                _, _, size, data, error = _row(store, oid)
                held.append((oid, None, None, error) if data is None else (oid, decoded(data), b"\0" in data[:BINARY_PREFIX], None))
                n += size or 0
                if n > 16 << 20:
                    yield make(held)
                    held, n = [], 0
            yield make(held)

    spark = ship(oids.sparkSession)
    return oids.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, BLOBS)


def loose_kind(file: Path) -> str:
    with open(file, "rb") as f:
        try:
            head = zlib.decompressobj().decompress(f.read(128), 32)
        except zlib.error as e:
            raise CorruptObject(f"{file.name}: {e}") from None
    kind = head.partition(b" ")[0].decode(errors="replace")
    if kind not in TYPES.values():
        raise CorruptObject(f"{file.name}: malformed header")
    return kind


class Trees:
    """Parsed trees by oid, the latest TREES of them remembered."""

    def __init__(self, store: Store):
        self.store, self.held = store, {}

    def entries(self, oid: str) -> list[tuple[int, str, str]]:
        """Entries in canonical order; a tree that cannot be read is an error."""
        if oid not in self.held:
            kind, data = self.store.read(oid)
            if kind != "tree":
                raise CorruptObject(f"{oid} is a {kind}, not a tree")
            if len(self.held) >= TREES:
                self.held.clear()
            self.held[oid] = sorted(tree_entries(data), key=canonical)
        return self.held[oid]

    def changed(self, new: str, old: str) -> Iterator[tuple[str, int, str, str]]:
        """(name, mode, oid, oid before) of entries in `new` that `old` has not, or with another oid."""
        is_tree = lambda mode: mode & 0o170000 == 0o040000
        try:
            before = {(name, is_tree(mode)): oid for mode, name, oid in (self.entries(old) if old else ())}
        except (CorruptObject, NotFound, OSError):
            before = {}  # what cannot be read has nothing in common
        for mode, name, oid in self.entries(new):
            had = before.get((name, is_tree(mode)), "")
            if had != oid:
                yield name, mode, oid, had


def canonical(entry: tuple[int, str, str]) -> bytes:
    """The order of entries in a tree: by name, that of a tree as if it ended in a slash."""
    mode, name, _ = entry
    return name.encode("utf-8", "surrogateescape") + (b"/" if mode & 0o170000 == 0o040000 else b"")


PAIRS_A_TASK = 500


def open_pairs(repo: Repository):
    """Opens pairs of trees (see operators.treediff) by reads of a repository: of each pair, its two trees.

    Tasks are as many as the pairs ask for, however few bytes those have. A new tree that cannot be read fails the search;
    an old one has nothing in common with the new.
    """
    common = repo.common_dir

    def run(batches):
        import pyarrow as pa

        trees = Trees(Store(common))
        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2
        for batch in batches:
            rows = [(new, old, *entry) for new, old in zip(*(batch.column(k).to_pylist() for k in (0, 1))) for entry in trees.changed(new, old)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)],
                names=["new", "old", "name", "mode", "oid", "had"])

    def opened(pairs: DataFrame, n: int) -> DataFrame:
        spark = ship(pairs.sparkSession)
        tasks = max(1, min(n, spark.sparkContext.defaultParallelism), n // PAIRS_A_TASK)
        return pairs.repartition(tasks, "new").mapInArrow(run, "new string, old string, name string, mode int, oid string, had string")

    return opened


IDENTITY = r"(?s)^(.*?)\s*<([^>]*)>\s*(-?\d+)\s+([+-]\d{4})\s*$"


def parse_identities(df: DataFrame, column: str) -> DataFrame:
    """Adds {column}_name, _email, _ts and _tz; a malformed identity is its own name and has no date."""
    c = F.col(column)
    whole = c.rlike(IDENTITY)
    part = lambda n: F.regexp_extract(c, IDENTITY, n)
    return df.withColumns({
        f"{column}_name": F.when(whole, part(1)).otherwise(c),
        f"{column}_email": F.when(whole, part(2)).otherwise(F.lit("")),
        f"{column}_ts": F.when(whole, F.timestamp_seconds(part(3).cast("long"))),
        f"{column}_tz": F.when(whole, part(4)),
    })


def parse_commits(objects_: DataFrame) -> DataFrame:
    """Commit objects (oid, data) -> (sha, tree_oid, parents, author..., committer..., commit_ts, commit_tz, summary, message, error).

    The date is the author's, or the committer's without one. Objects without a tree header are errors.
    """
    # A payload that is not UTF-8 is read byte by byte.
    text = F.replace(F.coalesce(F.try_validate_utf8(F.col("data").cast("string")), F.decode("data", "ISO-8859-1")), F.lit("\r\n"), F.lit("\n"))
    raw = objects_.where("type = 'commit'").select(F.col("oid").alias("sha"), text.alias("text"))
    split = F.locate("\n\n", F.col("text"))
    head = F.when(split > 0, F.substr("text", F.lit(1), split)).otherwise(F.col("text"))
    folded = F.regexp_replace(head, "\n ", "\x01")  # continuation lines belong to the header before them
    body = F.when(split > 0, F.substr("text", split + 2)).otherwise(F.lit(""))
    one = lambda name: F.regexp_replace(F.regexp_extract(F.col("head"), rf"(?m)(?d)^{name} (.*)$", 1), "\x01", "\n")
    parsed = raw.select("sha", folded.alias("head"), body.alias("message")).select(
        "sha", one("tree").alias("tree_oid"), F.regexp_extract_all("head", F.lit(r"(?m)(?d)^parent (.*)$"), F.lit(1)).alias("parents"),
        one("author").alias("author"), one("committer").alias("committer"),
        F.coalesce(F.trim(F.get(F.filter(F.split("message", "\n"), lambda x: F.trim(x) != ""), F.lit(0))), F.lit("")).alias("summary"), "message",
    )
    named = parse_identities(parse_identities(parsed, "author"), "committer")
    return named.withColumns({
        "commit_ts": F.coalesce("author_ts", "committer_ts"),
        "commit_tz": F.coalesce("author_tz", "committer_tz"),
        "error": F.when(F.col("tree_oid") == "", F.lit("commit without a tree")),
    })


def parse_trees(objects_: DataFrame) -> DataFrame:
    """Tree objects (oid, data) -> (tree_oid, ord, mode, name, oid)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(oid, i, *entry) for oid, data in zip(batch.column("oid").to_pylist(), batch.column("data").to_pylist()) for i,
                entry in enumerate(tree_entries(data))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
                names=["tree_oid", "ord", "mode", "name", "oid"])

    ship(objects_.sparkSession)
    return objects_.where("type = 'tree' AND data IS NOT NULL").select("oid", "data").mapInArrow(run,
        "tree_oid string, ord int, mode int, name string, oid string")


def tree_entries(data: bytes) -> list[tuple[int, str, str]]:
    """(mode, name, oid) of a tree's payload; a malformed tree ends where it is malformed."""
    out, at = [], 0
    while at < len(data):
        space, nul = data.find(b" ", at), data.find(b"\0", at)
        if not at < space < nul or nul + 21 > len(data) or not data[at:space].isdigit():
            break
        out.append((int(data[at:space], 8), data[space + 1:nul].decode("utf-8", "replace"), data[nul + 1:nul + 21].hex()))
        at = nul + 21
    return out
