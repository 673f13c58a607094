"""Writes small repositories, without git."""

import hashlib
import struct
import zlib
from pathlib import Path


def varint(n):
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def entry_header(kind, size):
    first, size = kind << 4 | size & 15, size >> 4
    out = bytearray()
    while size:
        out.append(first | 0x80)
        first, size = size & 0x7F, size >> 7
    return bytes([*out, first])


def ofs(n):
    out = [n & 0x7F]
    n >>= 7
    while n:
        n -= 1
        out.insert(0, 0x80 | n & 0x7F)
        n >>= 7
    return bytes(out)


class Repo:
    def __init__(self, folder):
        self.folder = Path(folder)
        self.git = self.folder / ".git"
        (self.git / "objects" / "pack").mkdir(parents=True)
        (self.git / "refs" / "heads").mkdir(parents=True)
        (self.git / "HEAD").write_text("ref: refs/heads/main\n")

    def put(self, kind, data):
        raw = f"{kind} {len(data)}\0".encode() + data
        oid = hashlib.sha1(raw).hexdigest()
        file = self.git / "objects" / oid[:2] / oid[2:]
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(zlib.compress(raw))
        return oid

    def tree(self, files):
        """files: path -> bytes, or (mode, bytes)"""
        here, below = [], {}
        for path, data in files.items():
            head, slash, rest = path.partition("/")
            if slash:
                below.setdefault(head, {})[rest] = data
            else:
                mode, data = data if isinstance(data, tuple) else ("100644", data)
                here.append((head, mode, self.put("blob", data)))
        here += [(name, "40000", self.tree(sub)) for name, sub in below.items()]
        here.sort(key=lambda e: e[0] + "/" * (e[1] == "40000"))
        return self.put("tree", b"".join(f"{mode} {name}\0".encode() + bytes.fromhex(oid) for name, mode, oid in here))

    def commit(self, files, *parents, when=1700000000, author="Ann <ann@x.org>", committer=None, message="change", tz="+0000", ref="main"):
        text = f"tree {self.tree(files)}\n" + "".join(f"parent {p}\n" for p in parents)
        text += f"author {author} {when} {tz}\ncommitter {committer or author} {when} {tz}\n\n{message}\n"
        sha = self.put("commit", text.encode())
        (self.git / "refs" / "heads" / ref).write_text(sha + "\n")
        return sha

    def pack(self, entries, name="one"):
        """entries: (oid, kind, payload before compression, base bytes put between header and data)"""
        body, offsets = bytearray(b"PACK" + struct.pack(">II", 2, len(entries))), {}
        for oid, kind, payload, base in entries:
            offsets[oid] = len(body)
            base = base(len(body), offsets) if callable(base) else base
            body += entry_header(kind, len(payload)) + base + zlib.compress(payload)
        body += hashlib.sha1(body).digest()
        oids = sorted(offsets)
        fan = [sum(int(o[:2], 16) <= k for o in oids) for k in range(256)]
        index = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(map(bytes.fromhex, oids)) + b"\0" * 4 * len(oids)
        index += b"".join(struct.pack(">I", offsets[o]) for o in oids) + b"\0" * 40
        (self.git / "objects" / "pack" / f"pack-{name}.pack").write_bytes(body)
        (self.git / "objects" / "pack" / f"pack-{name}.idx").write_bytes(index)
