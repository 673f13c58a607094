"""A history as a repository on disk: blobs and trees in packs that tasks write, commits in some that the driver writes.

Packs have deltas: an object is told as a change of the one before it where that is shorter. Indexes are of version 2.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.gitstore import MAX_DELTA_DEPTH
from palimpsest.sources.shipping import ship

# Fixed values of the format.
KINDS = {"commit": 1, "tree": 2, "blob": 3}
OFS = 6
PACK_BYTES = 64 << 20  # of objects that a writer holds before they become a pack


def oid_of(kind: str, data: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(data)) + data).hexdigest()


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _copy(start: int, n: int) -> bytes:
    out = b""
    while n:
        size = min(n, 0xFFFF)
        out += b"\xbf" + start.to_bytes(4, "little") + size.to_bytes(2, "little")
        start, n = start + size, n - size
    return out


def delta(base: bytes, target: bytes) -> bytes:
    """What turns base into target: their common ends are copied, what is between is inserted."""
    head = len(os.path.commonprefix([base, target]))
    most = min(len(base), len(target)) - head
    tail = len(os.path.commonprefix([base[len(base) - most:][::-1], target[len(target) - most:][::-1]]))
    middle = target[head:len(target) - tail]
    inserts = b"".join(bytes([len(p)]) + p for p in (middle[i:i + 127] for i in range(0, len(middle), 127)))
    return varint(len(base)) + varint(len(target)) + _copy(0, head) + inserts + _copy(len(base) - tail, tail)


def _header(kind: int, size: int) -> bytes:
    first, size = kind << 4 | size & 15, size >> 4
    out = bytearray()
    while size:
        out.append(first | 0x80)
        first, size = size & 0x7F, size >> 7
    return bytes([*out, first])


def _back(n: int) -> bytes:
    out = [n & 0x7F]
    n >>= 7
    while n:
        n -= 1
        out.insert(0, 0x80 | n & 0x7F)
        n >>= 7
    return bytes(out)


def write_pack(git_dir: str, objects: Iterable[tuple[str, str, bytes]]) -> None:
    """(oid, kind, data) of objects, each oid once, as a pack and its index."""
    body, offsets, last = bytearray(b"PACK" + bytes(8)), {}, {}
    for oid, kind, data in objects:
        offsets[oid] = at = len(body)
        depth, base_at, base = last.get(kind, (MAX_DELTA_DEPTH, 0, b""))
        change = delta(base, data) if depth < MAX_DELTA_DEPTH else data
        if depth < MAX_DELTA_DEPTH and len(change) < len(data):
            body += _header(OFS, len(change)) + _back(at - base_at) + zlib.compress(change)
            last[kind] = depth + 1, at, data
        else:
            body += _header(KINDS[kind], len(data)) + zlib.compress(data)
            last[kind] = 0, at, data
    body[4:12] = struct.pack(">II", 2, len(offsets))
    body += hashlib.sha1(body).digest()
    oids = sorted(offsets)
    counts = [0] * 256
    for o in oids:
        counts[int(o[:2], 16)] += 1
    fan = [sum(counts[:k + 1]) for k in range(256)]
    large = [offsets[o] for o in oids if offsets[o] >= 1 << 31]
    places = {o: 1 << 31 | k for k, o in enumerate(o for o in oids if offsets[o] >= 1 << 31)}
    index = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(map(bytes.fromhex, oids)) + bytes(4 * len(oids))
    index += b"".join(struct.pack(">I", places.get(o, offsets[o] & 0x7FFFFFFF)) for o in oids) + b"".join(struct.pack(">Q", x) for x in large) + body[-20:]
    index += hashlib.sha1(index).digest()
    name = f"{git_dir}/objects/pack/pack-{uuid.uuid4().hex}"
    # The pack comes first, so that whoever sees the index finds it.
    Path(f"{name}.pack").write_bytes(body)
    Path(f"{name}.idx").write_bytes(index)


def write_blobs(rows: DataFrame, git_dir: str, column: str = "data") -> DataFrame:
    """rows with `oid` in place of their bytes; each task writes what it has as packs of PACK_BYTES, so write the result down.

    A task that is lost and run again leaves packs more, of objects that are the same.
    """
    kept = [c for c in rows.columns if c != column]

    def run(batches):
        import pyarrow as pa

        held, n = {}, 0

        def packed():
            write_pack(git_dir, ((o, "blob", d) for o, d in held.items()))
            held.clear()

        for batch in batches:
            oids = []
            for data in batch.column(column):
                data = data.as_py()
                oids.append(oid_of("blob", data))
                n += len(data) if oids[-1] not in held else 0
                held[oids[-1]] = data
                if n > PACK_BYTES:
                    packed()
                    n = 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(oids, pa.string())], names=[*kept, "oid"])
        if held:
            packed()

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "oid string"]))


def write_trees(files: DataFrame, git_dir: str, window: int) -> DataFrame:
    """(k, path, oid) -> (k, tree): the root tree of each snapshot k, whose objects tasks write as packs; write the result down.

    A window is the snapshots of which k // window is the same. A snapshot has the files of its own k and of those before
    it in its window, so a tree has as many entries as a window brings, however long history is, and windows are made
    apart from each other. Of rows with one k and path, the one with the largest oid counts.
    """
    def run(batches):
        import pyarrow as pa

        made, here, k, out = History(git_dir.removesuffix("/.git")), None, None, []

        def told():
            rows = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["k", "tree"])
            out.clear()
            return rows

        for batch in batches:
            for at, path, oid in zip(*[batch.column(c).to_pylist() for c in ("k", "path", "oid")]):
                if at != k and k is not None:
                    out.append((k, made.tree()))
                k = at
                if at // window != here:
                    made.root, here = {}, at // window
                made.change(path, oid)
            yield told()
        if k is not None:
            out.append((k, made.tree()))
        made.close()
        yield told()

    ship(files.sparkSession)
    windows = files.select("k", "path", "oid", F.floor(F.col("k") / window).alias("window"))
    return windows.repartition("window").sortWithinPartitions("window", "k", "path", "oid").mapInArrow(run, "k long, tree string")


class History:
    """A repository that grows commit by commit where it is made; what it holds becomes a pack by close(), or before as PACK_BYTES."""

    def __init__(self, folder: str):
        self.git_dir = f"{folder}/.git"
        for name in ("objects/pack", "refs/heads", "refs/tags"):
            Path(self.git_dir, name).mkdir(parents=True, exist_ok=True)
        if not Path(self.git_dir, "HEAD").exists():
            Path(self.git_dir, "HEAD").write_text("ref: refs/heads/main\n")
        self.root: dict = {}
        self.made: dict[str, tuple[str, bytes]] = {}
        self.size = 0
        self.packed: dict[str, str] = {}

    def put(self, kind: str, data: bytes) -> str:
        oid = oid_of(kind, data)
        if oid not in self.made:
            self.made[oid] = kind, data
            self.size += len(data)
            if self.size > PACK_BYTES:
                self._pack()
        return oid

    def _pack(self) -> None:
        order = {"commit": 0, "tree": 1, "blob": 2}
        objects = sorted(((oid, kind, data) for oid, (kind, data) in self.made.items()), key=lambda o: order[o[1]])
        if objects:
            write_pack(self.git_dir, objects)
        self.made, self.size = {}, 0

    def change(self, path: str, oid: str | None, mode: str = "100644") -> None:
        """Sets a file, or takes it away. Trees on its way lose the oid that they had."""
        *folders, name = path.split("/")
        here = self.root
        here.pop("", None)
        for f in folders:
            here = here.setdefault(f, {})
            here.pop("", None)
        if oid is None:
            here.pop(name, None)
        else:
            here[name] = (mode, oid)

    def _tree(self, node: dict) -> str:
        if "" not in node:
            entries = [(n + "/" * isinstance(v, dict), n, ("40000", self._tree(v)) if isinstance(v, dict) else v) for n, v in node.items()]
            node[""] = self.put("tree", b"".join(f"{mode} {n}\0".encode() + bytes.fromhex(oid) for _, n,
                (mode, oid) in sorted(entries, key=lambda e: e[0].encode())))
        return node[""]

    def tree(self) -> str:
        """The oid of the tree as it is."""
        return self._tree(self.root)

    def commit(self, when: int, message: str, *parents: str, author: str = "Ann <ann@example.com>", tree: str | None = None) -> str:
        """A commit of the tree as it is, or of one that lies elsewhere."""
        lines = [f"tree {tree or self.tree()}", *[f"parent {p}" for p in parents], f"author {author} {when} +0000", f"committer {author} {when} +0000",
            "", message, ""]
        return self.put("commit", "\n".join(lines).encode())

    def ref(self, name: str, sha: str, packed: bool = False) -> None:
        if packed:
            self.packed[name] = sha
        else:
            Path(self.git_dir, name).write_text(sha + "\n")

    def close(self) -> None:
        self._pack()
        if self.packed:
            Path(self.git_dir, "packed-refs").write_text("".join(f"{sha} {name}\n" for name, sha in sorted(self.packed.items())))
