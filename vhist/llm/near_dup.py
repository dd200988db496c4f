"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its word shingles (64-bit hashes; A-Z is lower-cased). Two sets link if their Jaccard similarity is `similar`
percent or more. Sizes are cut into bands such that a set can only link within its band and the next one. In
a band, linked sets differ in at most k shingles. The shingles' domain is dealt by a hash into partitions and each of
these into 2 or 3 parts; a signature is the shingles of a partition less one of its parts. There are enough partitions
that linked sets differ by one shingle at most in more of them than `spare`, so they share a signature there. Signatures
without a shingle are left out where a set has no more than `spare` such partitions, which loses no link; sets with more
of them are dealt again into larger parts, and the few that lack shingles there too combine these with a third dealing.

Sets that share fewer signatures with others than any link takes are left out; sets are known by a digest there, so copies of a
text are one set. Of the rest, each signature proposes a link from each of its sets to the smallest of them, its hub. Every set is compared
exactly with the hub that it shares most signatures with. Where these links leave one component of all that proposed links join, nothing else
can be linked. Where several are left, sets of different components are compared by bitmaps that have a bit or two a shingle and bound from below
by how many shingles two sets differ, within the sizes that can link. Most families of a large corpus hang together by a few common shingles only, and
end here. The sets that are close enough to one of another component are compared exactly, in blocks of at most about `BLOCK` shingles, and never within a
component. So a family of copies takes one comparison a copy, however large it is; the work that grows with the square is that of bitmaps, and that
of texts between different components that are nearly linked. Links give the components. In each batch, sets with a common signature hand only
the smallest id on, so a hot signature is added up before the shuffle. No cap on partners or candidates anywhere.

Null, empty and blank texts have no shingles and link with nothing; their component is their own id. A text with fewer
words than `k` is one shingle, its whole sequence. Rows that repeat an id are one node that has the links of
all; rows with a null id have no component and link with nothing. Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, texts
from .components import components

#: Shingles of the sets in a block, and of those that one task compares with a hub, at most about.
BLOCK = 1 << 20
#: Bits of the bitmaps that one task compares with each other, at most about; a set counts as 512 at least.
CELLS = 1 << 23
#: Shingles whose signatures are made at once.
CHUNK = 1_000_000
#: Signatures that are met with each other at once, at most about.
SLOT = 1 << 20
#: The most bits of the filter that spares shuffling texts without candidates: 32 MB. A fuller one lets more texts through.
FILTER_BITS = 1 << 28
_C = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A random number for each byte, the same for a letter in either case; white space has none.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, np.uint64)[_LOWER] * ~_SPACE


class Shingles:
    """Whole texts to sorted arrays of distinct shingle hashes. A word's hash is a polynomial in its bytes' numbers, taken
    from prefix sums over the whole text."""

    def __init__(self, k: int):
        self.k = k
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        inverse = np.uint64(pow(int(_C), -1, 2**64))
        self.power, self.inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, c)])) for c in (_C, inverse))

    def of(self, raw: bytes) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        b = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.power[: len(b)], out=total[1:])
        h = mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        n = min(self.k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * _C + h[i : len(h) - n + 1 + i]
        return np.unique(mix(out))


@lru_cache
def bands(similar: int, largest: int) -> tuple[int, ...]:
    """The largest size of each band, up to one that holds ``largest``."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(low * 100 // similar)
        low = ends[-1] + 1
    return tuple(ends)


@lru_cache
def shape(similar: int, end: int) -> tuple[int, int]:
    """Partitions, and how many of them are spare, in the band that ends here. The lower the similarity, the fewer shingles
    a part has and the more partitions have an empty one, so more are spare."""
    k = 2 * end * (100 - similar) // (100 + similar)
    need = k // 2 + 1
    spare = min(3 + need // (8 if similar >= 84 else 4), need - 1)
    return need + spare, spare


def dealt(features: np.ndarray, owner: np.ndarray, offset: np.ndarray, n1: np.ndarray, n2: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set's parts, three to a partition: the sum of the mixed shingles in it and their number."""
    x = mix(features + np.uint64(seed * int(_C) % 2**64))
    first = (x >> np.uint64(32)) % n1[owner]
    second = (x & np.uint64(0xFFFFFFFF)) % n2[owner]
    at = offset[owner] + 3 * first.astype(np.int64) + second.astype(np.int64)
    sums = np.zeros(cells, np.uint64)
    np.add.at(sums, at, mix(x))
    return sums, np.bincount(at, minlength=cells)


def dealing(sets: list[np.ndarray], ends: np.ndarray, similar: int, seed: int, parts: int) -> tuple[np.ndarray, ...]:
    """(partitions, 3) signatures, which exist, which are empty; each partition's set; each set's spare partitions."""
    n1, spare = np.array([shape(similar, int(e)) for e in ends], np.int64).reshape(-1, 2).T
    n2 = np.where(n1 - spare <= 4, 3, parts)
    offset = 3 * np.concatenate([[0], np.cumsum(n1)[:-1]])
    features = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), n1)
    sums, counts = dealt(features, owner, offset, n1.astype(np.uint64), n2.astype(np.uint64), 3 * len(of), seed)
    sums, counts = sums.reshape(-1, 3), counts.reshape(-1, 3)
    left, held = sums.sum(axis=1, keepdims=True) - sums, counts.sum(axis=1, keepdims=True) - counts
    place = ((np.arange(len(of)) - (offset // 3)[of])[:, None] * 3 + np.arange(3)).astype(np.uint64)
    salt = mix(place + mix(ends.astype(np.uint64) * np.uint64(4) + np.uint64(seed))[of][:, None])
    there = np.arange(3) < n2[of][:, None]
    return mix(left + salt), there, there & (held == 0), of, spare


def instance_signatures(sets: list[np.ndarray], ends: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets in the bands that end at ``ends``, with the index of the set of each, and for each set how many
    of them a linked set shares at least. Sets with more weak partitions than are spare are dealt again into more parts; the
    rare ones that are weak there too combine."""
    out_sig, out_set, now = [], [], np.arange(len(sets))
    shares = np.ones(len(sets), np.int64)
    for seed, parts in enumerate((2, 3)):
        if not len(now):
            break
        sig, there, empty, of, spare = dealing([sets[i] for i in now], ends[now], similar, seed, parts)
        keep = there & ~empty
        out_sig.append(sig[keep])
        out_set.append(now[np.broadcast_to(of[:, None], sig.shape)[keep]])
        lost = np.bincount(of, weights=empty.any(axis=1), minlength=len(now)).astype(np.int64)
        if seed == 0:
            # Linked sets agree in more partitions than are spare; all but the weak ones of these give a common signature.
            shares = np.maximum(1, spare + 1 - lost)
        weak = np.flatnonzero(lost > spare)
        lacking = [sig[of == w][empty[of == w]] for w in weak]
        now = now[weak]
    if len(now):
        again, there, _, of, _ = dealing([sets[i] for i in now], ends[now], similar, 2, 3)
        for w, a in enumerate(lacking):
            b = again[of == w][there[of == w]]
            out_sig.append(mix(a[:, None] * _C + b[None, :]).reshape(-1))
            out_set.append(np.full(len(a) * len(b), now[w]))
    return np.concatenate(out_sig or [np.empty(0, np.uint64)]), np.concatenate(out_set or [np.empty(0, np.int64)]), shares


def signatures_of(sets: list[np.ndarray], similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of non-empty sets, in each set's own band, and in the next where it can link into that: signature, set,
    0 or 1 for the band; and (sets, 2) how many of these a linked set shares at least (0: not in that band)."""
    sizes = np.array([len(s) for s in sets])
    ends = np.array(bands(similar, int(sizes.max(initial=1)) * 2))
    at = np.searchsorted(ends, sizes)
    onward = np.flatnonzero(100 * sizes >= similar * (ends[at] + 1))
    a, i, own = instance_signatures(sets, ends[at], similar)
    b, j, far = instance_signatures([sets[x] for x in onward], ends[at[onward] + 1], similar)
    shares = np.zeros((len(sets), 2), np.int64)
    shares[:, 0], shares[onward, 1] = own, far
    return np.concatenate([a, b]), np.concatenate([i, onward[j]]), np.repeat([0, 1], [len(a), len(b)]), shares


def digest(s: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _C).sum(dtype=np.uint64)]).view(np.int64)


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, x, y): size and digest of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Shingles(k)
        for batch in batches:
            rows = np.zeros((3, len(batch)), np.int64)
            for i, raw in enumerate(texts(batch)):
                s = kit.of(raw)
                rows[:, i] = len(s), *digest(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r) for r in rows)], ["doc_id", "n", "x", "y"])

    return docs.mapInArrow(run, "doc_id long, n long, x long, y long")


def in_chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and sets of rows of (doc_id, text), about `CHUNK` shingles at a time."""
    kit = Shingles(k)
    for batch in batches:
        ids, sets, first, held = batch.column(0).to_numpy(), [], 0, 0
        for at, raw in enumerate(texts(batch)):
            sets.append(kit.of(raw))
            held += len(sets[-1])
            if held >= CHUNK or at == len(ids) - 1:
                yield ids[first : at + 1], sets
                sets, first, held = [], at + 1, 0


def five(x: np.ndarray) -> np.ndarray:
    """The low five bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def from_five(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :5] = rows
    return out.view("<u8").reshape(-1)


def candidate_sets(docs: DataFrame, k: int, similar: int, shingles: int) -> DataFrame:
    """(x38): the first 38 bits of the digests of sets that share as many signatures with other sets as a link takes, from rows of
    (doc_id, text); ``shingles``: about how many these have. Few others have that many in common with anything, so most texts end here,
    also those that only share a passage.

    Signatures are dealt into slots by their first bits; a chunk's signatures of a slot travel as one value, in order, each as the next 40 bits and
    38 bits of its set. Two that are taken for one only let a set more through, and sets that are taken for one are all let through."""
    power = max(6, (shingles // SLOT).bit_length())
    slots = 1 << power

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in in_chunks(batches, k):
            found = {int(digest(s)[0]): s for s in sets if len(s)}
            xs, sets = np.array(list(found), np.int64), list(found.values())
            if not sets:
                continue
            sig, at, band, shares = signatures_of(sets, similar)
            order = np.argsort(sig, kind="stable")
            sig, at, band = sig[order], at[order], band[order]
            new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(new, len(sig)))
            shared = np.repeat(size > 1, size)
            here = np.bincount(2 * at[shared] + band[shared], minlength=2 * len(sets)).reshape(-1, 2)
            # Each signature has its set and band, or 3 where several of these sets have it, which is counted here. Each set and band has
            # what it shares here less what it needs.
            who, which = np.nonzero(shares)
            sig, code = sig[new], np.where(size > 1, np.uint64(3), (xs.view(np.uint64) >> np.uint64(26) << np.uint64(2))[at[new]] + band[new].astype(np.uint64))
            entries = np.concatenate([five(sig << np.uint64(power) >> np.uint64(24)), five(code)], axis=1)
            cut = np.searchsorted(sig >> np.uint64(64 - power), np.arange(slots + 1).astype(np.uint64))
            slot = (xs.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)[who]
            order = np.argsort(slot, kind="stable")
            needs = np.stack([xs[who], (here - shares)[who, which] * 2 + which], axis=1)[order]
            needs_cut = np.searchsorted(slot[order], np.arange(slots + 1))
            columns = [pa.array(np.arange(slots, dtype=np.int32))]
            for values, at_byte in ((entries, cut * 10), (needs, needs_cut * 16)):
                columns.append(pa.Array.from_buffers(pa.binary(), slots, [None, pa.py_buffer(at_byte.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]))
            full = (cut[1:] > cut[:-1]) | (needs_cut[1:] > needs_cut[:-1])
            yield pa.RecordBatch.from_arrays(columns, ["slot", "entries", "needs"]).filter(pa.array(full))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(entries: list[bytes], needs: list[bytes]) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, 10)
            sig, code = from_five(rows[:, :5]), from_five(rows[:, 5:])
            order = np.argsort(sig, kind="stable")
            sig, code = sig[order], code[order]
            new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
            size = np.diff(np.append(new, len(sig)))
            # Signatures that one chunk has are met by nothing here.
            met = np.repeat(size > 1, size)
            code, size = code[met], size[size > 1]
            none, x = (code & np.uint64(3)) == 3, code >> np.uint64(2)
            if len(size):
                at = np.concatenate([[0], np.cumsum(size)[:-1]])
                others = np.logical_or.reduceat(none, at) | (np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at))
                code = code[np.repeat(others, size) & ~none]
            code, worth = np.unique(code, return_counts=True)
            whole = np.frombuffer(b"".join(needs), np.int64).reshape(-1, 2)
            columns = (
                np.concatenate([code >> np.uint64(2), whole[:, 0].view(np.uint64) >> np.uint64(26)]).view(np.int64),
                np.concatenate([(code & np.uint64(3)).astype(np.int64), whole[:, 1] & 1]),
                np.concatenate([worth, whole[:, 1] >> 1]),
            )
            given = pa.array(np.concatenate([np.zeros(len(code), np.int64), whole[:, 0]]), mask=np.arange(len(code) + len(whole)) < len(code))
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), given], ["x38", "band", "worth", "x"])

        now, entries, needs = None, [], []
        for batch in batches:
            for slot, a, b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if slot != now and entries + needs:
                    yield out(entries, needs)
                    entries, needs = [], []
                now = slot
                entries.append(a)
                needs.append(b)
        if entries:
            yield out(entries, needs)

    rows = docs.mapInArrow(run, "slot int, entries binary, needs binary").repartition("slot").sortWithinPartitions("slot")
    # Even the hottest signature is there once a chunk at most. A set that stands in several chunks has its balance in each, and all of these have one sign.
    total = rows.mapInArrow(meet, "x38 long, band long, worth long, x long").groupBy("x38", "band").agg(F.sum("worth").alias("balance"), F.min("x").alias("x"), F.max("x").alias("other"))
    return total.where("balance >= 0 OR x <> other").select("x38").distinct()


def star_pairs(own: DataFrame, k: int, similar: int) -> DataFrame:
    """(a, b, n): proposed links that join all sets with a common signature, and how many signatures propose each, from rows of
    (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
            sig, at, _, _ = signatures_of(sets, similar)
            order = np.lexsort((ids[at], sig))
            sig, doc = sig[order], ids[at][order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
            hub = doc[new][np.cumsum(new) - 1]
            # Among these sets a link to the smallest id stands for the signature; only that id goes on with it.
            pairs, n = np.unique(np.stack([hub[~new], doc[~new]]), axis=1, return_counts=True)
            n, pairs = n[pairs[0] != pairs[1]], pairs[:, pairs[0] != pairs[1]]
            # The two ids of a link travel as a signature of their own.
            mark = mix(np.arange(pairs.shape[1], dtype=np.uint64) ^ (mix(pairs[1].astype(np.uint64)) + np.uint64(1)))
            columns = np.concatenate([sig[new], mark, mark]).view(np.int64), np.concatenate([doc[new], pairs[0], pairs[1]]), np.concatenate([np.ones(new.sum(), np.int64), n, n])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "b", "n"])

        for ids, sets in in_chunks(batches, k):
            yield links(ids, sets)

    rows = own.select("doc_id", "text").mapInArrow(run, "sig long, b long, n long")
    # One row for each signature and batch: even the hottest signature has no more rows than there are batches.
    hub = F.min("b").over(Window.partitionBy("sig"))
    return rows.withColumn("a", hub).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def filtered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) whose doc_id may be among ``ids``: a Bloom filter sized by their number, so that most of the other
    texts are never shuffled. An exact join has to follow."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    set_bits = F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {bits}) % 64 AS INT))"))
    words = ids.groupBy(F.floor(at / 64).alias("word")).agg(set_bits.alias("set")).toArrow()  # bits / 64 rows at most
    held = np.zeros(bits // 64, np.int64)
    held[words.column("word").to_numpy()] = words.column("set").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((held[k // 64] >> (k % 64)) & 1 == 1))

    return rows.withColumn("_bit", at).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, text string")


def linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= similar * (len(a) + len(b) - common)


def links_to_hubs(own: DataFrame, best: DataFrame, k: int, similar: int) -> DataFrame:
    """(a, b): which sets link with their hub, from rows of (doc_id, text, n) and (a, b). A task has a hub and some of its sets, which pass
    one by one; a hub with many is in as many tasks as these fill."""
    sizes = own.groupBy("doc_id").agg(F.max("n").alias("n"))
    tasks = best.join(sizes, F.col("b") == F.col("doc_id")).groupBy("a").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("tasks"))
    tasks = stored(tasks, best.count())
    members = own.join(best.join(tasks, "a"), F.col("doc_id") == F.col("b")).select("a", F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("p"), F.lit(1).alias("side"), "doc_id", "text")
    hubs = own.join(tasks, F.col("doc_id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("p"), F.lit(0).alias("side"), "doc_id", "text")
    rows = hubs.unionByName(members).repartition("a", "p").sortWithinPartitions("a", "p", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit, now, hub = Shingles(k), None, []
        for batch in batches:
            found = []
            for a, p, side, doc, raw in zip(*[batch.column(c).to_pylist() for c in range(4)], texts(batch)):
                if (a, p) != now:
                    now, hub = (a, p), []
                s = kit.of(raw)
                if not side:
                    hub.append(s)
                elif any(linked(h, s, similar) for h in hub):
                    found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def parities(s: np.ndarray, bits: int) -> bytes:
    """Whether the number of shingles is odd in each of ``bits`` classes, as a bitmap. A shingle that only one of two sets has changes
    one bit, so sets differ in as many shingles, at least, as their bitmaps do in bits."""
    return np.packbits(np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketches(own: DataFrame, k: int, similar: int) -> DataFrame:
    """(doc_id, n, last, bits) from (doc_id, text): a set's bitmap in its own band and, where it can link into that, in the next;
    ``last`` is the largest size of the band, and all bitmaps of a band have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Shingles(k)
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                s = kit.of(raw)
                if not len(s):
                    continue
                ends = bands(similar, 100 * (1 << len(s).bit_length()) // similar + 1)
                at = int(np.searchsorted(ends, len(s)))
                for last in ends[at : at + (2 if 100 * len(s) >= similar * (ends[at] + 1) else 1)]:
                    for to, x in zip(rows, (doc, len(s), last, parities(s, max(64, 1 << (last - 1).bit_length())))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, kind) for r, kind in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n", "last", "bits"])

    return own.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, last long, bits binary")


def close_sets(n: np.ndarray, bits: np.ndarray, component: np.ndarray, side: np.ndarray, lower: int, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets may link with one of another component by their sizes and bitmaps, and for each a label that is the same for sets of a
    component and for those of all components that such links join. Sets come in the order of their sizes; those of at most ``lower``
    aren't compared with each other. ``side``: as in `spanning_links`."""
    _, label, held = np.unique(component, return_inverse=True, return_counts=True)
    first, now = label, label.copy()
    met = np.zeros(len(n), bool)
    # A bitmap's first fold decides most pairs.
    fold = np.bitwise_xor.reduce(bits.reshape(len(n), -1, min(4, bits.shape[1])), axis=1)
    largest = label == held.argmax()
    start = int(np.searchsorted(n, lower, "right"))
    alone = len(np.unique(side)) == 1
    kinds = []
    for s in np.unique(side):
        to = [np.flatnonzero(x & (alone | (side != s))) for x in (np.ones(len(n), bool), largest)]
        kinds.append((s, [(x, n[x], fold[x]) for x in to]))
    for s, ((every, every_n, every_fold), (most, most_n, most_fold)) in kinds:
        # The sets of the largest component don't ask, so it never meets itself; it is asked by smaller and by larger sets.
        for i in np.flatnonzero(~largest & (side == s)):
            up = slice(np.searchsorted(every, max(i + 1, start)), np.searchsorted(every_n, n[i] * 100 // similar, "right"))
            down = slice(np.searchsorted(most_n, -(-n[i] * similar // 100)), np.searchsorted(most, i) if i >= start else 0)
            for x, f, some in ((every, every_fold, up), (most, most_fold, down)):
                if some.start >= some.stop:
                    continue
                room = (n[x[some]] + n[i]) * (100 - similar)
                j = x[some][np.bitwise_count(f[some] ^ fold[i]).sum(axis=1, dtype=np.int64) * (100 + similar) <= room]
                j = j[first[j] != first[i]]
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) * (100 + similar) <= (n[j] + n[i]) * (100 - similar)]
                if len(j):
                    met[i] = met[j] = True
                    for other in np.unique(now[j]):
                        if other != now[i]:
                            now[now == other] = now[i]
    return met, now


def close_families(rows: DataFrame, similar: int) -> DataFrame:
    """(doc_id, c, family) from rows of (doc_id, n, last, bits, c, family): the sets that may link with one of another component, and
    new families of components that such links join. Sets of a family and band are compared in blocks of at most about `CELLS` bits."""
    key = ["family", "last"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") * F.greatest(F.lit(512), F.col("last")) / CELLS).cast("int").alias("blocks"), (F.min("c") < F.max("c")).alias("open"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = rows.join(sizes.where("open").drop("open"), key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key += ["p", "q"]
    spread = spread.select("family", "last", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "n", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "c", "bits")
    spread = spread.repartition(*key).sortWithinPartitions(*key, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            one = pa.Table.from_batches(parts).combine_chunks()
            n, side, doc, c = (one.column(x).to_numpy() for x in ("n", "side", "doc_id", "c"))
            if now[2] != now[3] and side.min() == side.max():
                return
            bits = np.frombuffer(b"".join(one.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
            ends = bands(similar, int(one.column("last")[0].as_py()))
            met, label = close_sets(n, bits, c, side, ends[-2] if len(ends) > 1 else 0, similar)
            # A label goes on as the smallest component that has it.
            least = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, label, c)
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (doc, c, least[label])], ["doc_id", "c", "m"])

        now = None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if parts and now != keys[:, lo].tolist():
                    yield from out()
                    parts.clear()
                now = keys[:, lo].tolist()
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from out()

    found = stored(spread.mapInArrow(run, "doc_id long, c long, m long").distinct())
    family = components(found.select("c", "m"), "c", "m").select(F.col("node").alias("c"), F.col("component").alias("family"))
    return found.select("doc_id", "c").distinct().join(family, "c")


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, similar: int) -> Iterator[tuple[int, int]]:
    """Links between sets of different components, found by exact counts; no more than make linked components hang together. ``side``:
    0 and 1 for two blocks that are to be compared with each other, or one value for a block with itself."""
    _, label, held = np.unique(component, return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    features, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(features, kind="stable")
    features, owner = features[order], owner[order]
    alone = len(np.unique(side)) == 1
    left = np.ones(len(sets), bool)
    # Sets of small components ask first; what is asked needn't ask, so a large component never meets itself.
    for i in np.argsort(held[label], kind="stable"):
        left[i] = False
        open_ = left & (label != label[i]) & (alone | (side != side[i])) & (100 * np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]))
        if not open_.any():
            continue
        s = sets[i]
        lo, hi = np.searchsorted(features, s, "left"), np.searchsorted(features, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(open_ & (100 * common >= similar * (sizes + len(s) - common))):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield int(ids[i]), int(ids[j])


def links_in_blocks(rows: DataFrame, k: int, similar: int) -> DataFrame:
    """(a, b) from rows of (doc_id, text, n, c, family): exact links that join the components c of each family."""
    sizes = rows.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = rows.join(sizes, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["family", "p", "q"]
    spread = spread.select("doc_id", "text", "c", "family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    spread = spread.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Shingles(k)
        now, ids, sets, side, comp = None, [], [], [], []

        def out() -> pa.RecordBatch:
            found = list(spanning_links(np.array(ids), sets, np.array(side), np.array(comp), similar)) if len(ids) > 1 and (now[1] == now[2] or 0 < sum(side) < len(side)) else []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)]
            for doc, c, *key, s, raw in zip(*columns, texts(batch)):
                if key != now:
                    if ids:
                        yield out()
                    now, ids, sets, side, comp = key, [], [], [], []
                ids.append(doc)
                sets.append(kit.of(raw))
                side.append(s)
                comp.append(c)
        if ids:
            yield out()

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int, similar: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stored(set_keys(rows, k))
    most, shingles = keys.agg(F.count("*"), F.sum("n")).first()
    reps = stored(keys.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep")), most)
    # Ids that stand for several sets aren't told apart here, so all of their rows come along.
    found = candidate_sets(rows.where("doc_id IS NOT NULL"), k, similar, shingles or 0)
    near = reps.withColumn("x38", F.shiftrightunsigned("x", 26)).join(found, "x38", "left_semi").groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"))
    near = stored(near, most)
    own = stored(filtered(rows, near).join(near, "doc_id"))
    pairs = stored(star_pairs(own, k, similar))
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), most)
    first = stored(components(links_to_hubs(own, best, k, similar)), most)
    # Proposed links between different components, each standing for all of its sets.
    at = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = pairs.join(at, "a", "left").join(to, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    family = stored(components(between), most).select(F.col("node").alias("c"), F.col("component").alias("family"))
    named = near.select("doc_id").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    left = stored(named.join(family, "c"), most)
    more = own.join(stored(close_families(sketches(own, k, similar).join(left, "doc_id"), similar), most), "doc_id")
    # Ids that repeat join all the sets that they stand for.
    filled = keys.where("doc_id IS NOT NULL")
    again = stored(filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), most)
    several = filled.join(again, "doc_id", "left_semi").join(reps, ["n", "x", "y"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # Both kinds of links as links between the components so far, each named by its smallest id.
    ends = stored(links_in_blocks(more, k, similar).unionByName(several)).join(at, "a", "left").join(to, "b", "left")
    last = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    last = stored(last, most).select(F.col("node").alias("component"), F.col("component").alias("final"))
    nodes = near.select("doc_id").unionByName(several.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    nodes = nodes.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    found = stored(nodes.join(last, "component", "left").select(F.col("doc_id").alias("rep"), F.coalesce("final", "component").alias("c")))
    named = stored(reps.join(found, "rep", "left").select("n", "x", "y", F.coalesce("c", "rep").alias("c")))
    repeated = stored(again.join(found, F.col("doc_id") == F.col("rep")).select("doc_id", F.col("c").alias("own")))
    out = keys.join(named, ["n", "x", "y"], "left").join(repeated, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "c", "doc_id")).alias("component_id"))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, similar=85)
