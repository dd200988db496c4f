"""A Git repository as a Spark data source, and its objects as history tables.

`spark.dataSource.register(GitObjects)`, then `spark.read.format("gitobjects").load(path)` gives (oid, kind, size, content) of
every object, packed or loose. A partition is a range of one pack's index or one folder of loose objects, so packs are
decoded in parallel; each object's id is verified. The path must be readable where the tasks run. SHA-1 repositories only.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
DEEPEST, LARGEST = 128, 64 << 20
PER_PARTITION = 20_000
MESSAGE, IDENTITY = 24 << 10, 4 << 10


class GitError(ValueError):
    pass


def git_dir(path: str) -> str:
    inner = os.path.join(path, ".git")
    return inner if os.path.isdir(inner) else path


def index_entries(idx: str) -> list[tuple[int, str]]:
    """(offset, oid) of a version 2 pack index, in pack order."""
    with open(idx, "rb") as f:
        raw = f.read()
    if raw[:8] != b"\xfftOc\0\0\0\2":
        raise GitError(f"{idx}: not a version 2 index")
    n = struct.unpack_from(">I", raw, 8 + 255 * 4)[0]
    names, small = 8 + 1024, 8 + 1024 + 24 * n
    large = small + 4 * n
    out = []
    for k in range(n):
        at = struct.unpack_from(">I", raw, small + 4 * k)[0]
        if at & 0x80000000:
            at = struct.unpack_from(">Q", raw, large + 8 * (at & 0x7FFFFFFF))[0]
        out.append((at, raw[names + 20 * k : names + 20 * k + 20].hex()))
    return sorted(out)


def inflate(f, at: int, size: int) -> bytes:
    if size > LARGEST:
        raise GitError("object too large")
    f.seek(at)
    machine, out = zlib.decompressobj(), []
    while not machine.eof:
        part = f.read(1 << 16)
        if not part:
            raise GitError("truncated pack")
        out.append(machine.decompress(part))
    whole = b"".join(out)
    if len(whole) != size:
        raise GitError("wrong object size")
    return whole


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 128:
            return value, at


def patched(base: bytes, program: bytes) -> bytes:
    """Run a delta: copies from the base and literal bytes."""
    size, at = varint(program, 0)
    want, at = varint(program, at)
    if size != len(base) or want > LARGEST:
        raise GitError("delta doesn't fit its base")
    out = bytearray()
    while at < len(program):
        op = program[at]
        at += 1
        if op & 128:
            numbers = []
            for bits in (range(4), range(4, 7)):
                value = 0
                for k, bit in enumerate(bits):
                    if op >> bit & 1:
                        value |= program[at] << 8 * k
                        at += 1
                numbers.append(value)
            start, n = numbers[0], numbers[1] or 0x10000
            if start + n > len(base):
                raise GitError("copy outside the base")
            out += base[start : start + n]
        elif op:
            out += program[at : at + op]
            at += op
        else:
            raise GitError("reserved delta instruction")
    if len(out) != want:
        raise GitError("wrong delta result")
    return bytes(out)


class Pack:
    """One open pack: objects by offset; bases named by id are looked up in the same pack."""

    def __init__(self, path: str, offsets: dict[str, int]):
        self.file, self.offsets = open(path, "rb"), offsets
        self.recent: dict[int, tuple[str, bytes]] = {}

    def object(self, at: int, depth: int = 0) -> tuple[str, bytes]:
        if at in self.recent:
            return self.recent[at]
        if depth > DEEPEST:
            raise GitError("delta chain too deep")
        self.file.seek(at)
        head = self.file.read(64)
        kind, size, shift, k = head[0] >> 4 & 7, head[0] & 15, 4, 1
        while head[k - 1] & 128:
            size |= (head[k] & 127) << shift
            shift += 7
            k += 1
        if kind in KINDS:
            got = KINDS[kind], inflate(self.file, at + k, size)
        elif kind in (6, 7):
            if kind == 6:
                back = head[k] & 127
                while head[k] & 128:
                    k += 1
                    back = (back + 1) << 7 | head[k] & 127
                k += 1
                base = at - back
            else:
                name = head[k : k + 20].hex()
                k += 20
                if name not in self.offsets:
                    raise GitError(f"no base {name} in this pack")
                base = self.offsets[name]
            program = inflate(self.file, at + k, size)
            name, content = self.object(base, depth + 1)
            got = name, patched(content, program)
        else:
            raise GitError("unknown object kind")
        if len(self.recent) > 256:
            self.recent.clear()
        self.recent[at] = got
        return got


def verified(oid: str, kind: str, content: bytes) -> tuple[str, str, int, bytes]:
    if hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).hexdigest() != oid:
        raise GitError(f"object {oid} doesn't fit its id")
    return oid, kind, len(content), content


class Part(InputPartition):
    def __init__(self, path: str, lo: int = 0, hi: int = 0):
        self.path, self.lo, self.hi = path, lo, hi


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = os.path.join(git_dir(root), "objects")

    def partitions(self) -> list[Part]:
        out = []
        packs = os.path.join(self.root, "pack")
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            if name.endswith(".idx"):
                with open(os.path.join(packs, name), "rb") as f:
                    f.seek(8 + 255 * 4)
                    n = struct.unpack(">I", f.read(4))[0]
                out += [Part(os.path.join(packs, name), lo, min(n, lo + PER_PARTITION)) for lo in range(0, n, PER_PARTITION)]
        out += [Part(os.path.join(self.root, d)) for d in sorted(os.listdir(self.root)) if re.fullmatch("[0-9a-f]{2}", d)]
        return out or [Part(os.path.join(self.root, "none"))]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path.endswith(".idx"):
            entries = index_entries(part.path)
            pack = Pack(part.path[:-4] + ".pack", {oid: at for at, oid in entries})
            for at, oid in entries[part.lo : part.hi]:
                yield verified(oid, *pack.object(at))
        elif os.path.isdir(part.path):
            for name in sorted(os.listdir(part.path)):
                if re.fullmatch("[0-9a-f]{38}", name):
                    with open(os.path.join(part.path, name), "rb") as f:
                        head, _, content = zlib.decompress(f.read()).partition(b"\0")
                    yield verified(os.path.basename(part.path) + name, head.split()[0].decode(), content)


class GitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitobjects"

    def schema(self) -> str:
        return "oid string, kind string, size long, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object once, whichever packs and loose files hold it."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("gitobjects").load(path).dropDuplicates(["oid"])


def offset_minutes(zone: bytes) -> int:
    sign = -1 if zone.startswith(b"-") else 1
    digits = zone.lstrip(b"+-")
    return sign * (int(digits[:-2] or 0) * 60 + int(digits[-2:] or 0)) if digits.isdigit() else 0


def commit_fields(raw: bytes) -> dict:
    head, _, message = raw.partition(b"\n\n")
    out: dict = {"tree": None, "parents": [], "author": b"", "author_time": 0, "author_offset": 0, "commit_time": 0, "commit_offset": 0, "committer": b""}
    for line in head.split(b"\n"):
        key, _, value = line.partition(b" ")
        if key == b"tree":
            out["tree"] = value.decode()
        elif key == b"parent":
            out["parents"].append(value.decode())
        elif key in (b"author", b"committer") and value.count(b" ") >= 2:
            who, when, zone = value.rsplit(b" ", 2)
            name = key.decode()
            short = "author" if name == "author" else "commit"
            out[name], out[f"{short}_time"], out[f"{short}_offset"] = who[:IDENTITY], int(when), offset_minutes(zone)
    out["message"], out["cut"] = message[:MESSAGE], len(message) > MESSAGE
    return out


def commits(found: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, author_time, author_offset_min, committer, commit_time, commit_offset_min, message, message_truncated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["tree", "parents", "author", "author_time", "author_offset", "committer", "commit_time", "commit_offset", "message", "cut"]
        kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [commit_fields(x) for x in b.column(1).to_pylist()]
            text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else v
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([text(r[k]) for r in rows], t) for k, t in zip(keys, kinds))], ["oid", *keys])

    schema = "oid string, tree string, parents array<string>, author string, author_time long, author_offset_min int, committer string, commit_time long, commit_offset_min int, message string, message_truncated boolean"
    return found.where("kind = 'commit'").select("oid", "content").mapInArrow(run, schema)


def parents(of: DataFrame) -> DataFrame:
    return of.select(F.col("oid").alias("child"), F.posexplode("parents").alias("ord", "parent"))


CANONICAL = {0o100755: 0o100755, 0o040000: 0o040000, 0o120000: 0o120000, 0o160000: 0o160000}


def tree_entries(found: DataFrame) -> DataFrame:
    """(tree, name, oid, mode, raw_mode): other file modes count as plain files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for tree, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                while at < len(raw):
                    space, nul = raw.index(b" ", at), raw.index(b"\0", at)
                    mode = int(raw[at:space], 8)
                    for to, v in zip(cols, (tree, raw[space + 1 : nul].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), raw[nul + 1 : nul + 21].hex(), CANONICAL.get(mode, 0o100644), mode)):
                        to.append(v)
                    at = nul + 21
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tree", "name", "oid", "mode", "raw_mode"])

    return found.where("kind = 'tree'").select("oid", "content").mapInArrow(run, "tree string, name string, oid string, mode int, raw_mode int")


def snapshot_files(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, oid, mode) of all files below the trees in (root, tree): a join for each level of directories."""
    level = roots.select("root", "tree", F.lit("").alias("prefix"))
    out = None
    while True:
        rows = level.join(entries, "tree").select("root", F.concat("prefix", "name").alias("path"), "oid", "mode").persist()
        files = rows.where(f"mode <> {0o040000}")
        out = files if out is None else out.unionByName(files)
        level = rows.where(f"mode = {0o040000}").select("root", F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return out


def references(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid) of packed and loose references; loose ones win. Symbolic ones are followed."""
    root = git_dir(path)
    found: dict[str, str] = {}
    packed = os.path.join(root, "packed-refs")
    if os.path.exists(packed):
        with open(packed) as f:
            found |= {name: oid for oid, name in (line.split() for line in f if re.match("[0-9a-f]{40} ", line))}
    for folder, _, names in os.walk(os.path.join(root, "refs")):
        for n in names:
            with open(os.path.join(folder, n)) as f:
                found[os.path.relpath(os.path.join(folder, n), root)] = f.read().strip()
    with open(os.path.join(root, "HEAD")) as f:
        found["HEAD"] = f.read().strip()

    def follow(value: str, left: int = 5) -> str | None:
        return follow(found.get(value[5:], ""), left - 1) if value.startswith("ref: ") and left else value or None

    rows = [(n, follow(v)) for n, v in sorted(found.items())]
    return spark.createDataFrame([r for r in rows if r[1]], "name string, oid string")
