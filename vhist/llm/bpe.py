"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are: the
two tokens' own bytes encode to just these two tokens. So for each prefix of a piece there is one last
token, found from the shorter prefixes. The transducer reads bytes and puts out the length of the last
token at each. Its state holds the open ends: those after which the bytes read since start some longer
token, with the last token at each. Tokens are emitted where the back links of all open ends have met, so
the longest token bounds the lookahead. States and transitions are made when first met and kept in a
table whose size is capped; a full table is emptied, which costs time and never changes a result.
Texts are encoded many at a time: each distinct word is looked up once, and the pieces of words not met before go
through the transducer side by side, a byte of each at every step. Long pieces go alone.

Decoding. Tokens come as a stream. An incremental UTF-8 state machine (`Utf8`) passes over their bytes and lets whole
characters through; what a token leaves open waits for the next one, so no character is cut and memory doesn't grow
with the text. Bytes that can't be a character become U+FFFD. Which tokens begin and end between characters is found once
by the machine; runs of these pass in one piece, all others byte by byte.

Null text counts as empty: no tokens, digests of the empty string. Rows are independent; repeated rows
give repeated results, extra columns are left out. Special tokens are never produced. Bytes of a text that aren't UTF-8 are read
as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import strings, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: States kept by one worker; words whose tokens it remembers.
MAX_STATES = 250_000
MAX_WORDS = 250_000
#: Bytes read between emissions inside one piece.
LOOKAHEAD = 1024
#: Bytes of a piece that goes side by side with others, and bytes and number of all that do at once.
SHORT = 256
ABREAST = 1 << 17
MAX_PIECES = 15_000
#: Characters of texts that are encoded at once (more, if one text has more).
CHUNK = 2_000_000
#: A space before white space or the end, where the split at spaces isn't safe; what follows it there.
ODD_SPACE, ODD_WORD = regex.compile(r" (?:\s|$)"), regex.compile(r"\s|$")


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, run after run."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int], parts_left: int = 1) -> list[bytes]:
    """BPE by its definition, for single tokens: join the neighbours of lowest rank, leftmost first, until
    so many parts are left or nothing can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > parts_left:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transitions:
    """Number to number, for many at a time: open addressing, never more than half full."""

    def __init__(self, most: int):
        bits = (2 * most).bit_length()
        self.shift, self.last, self.size = np.uint64(64 - bits), (1 << bits) - 1, 0
        #: Keys plus one, 0 where a slot is free.
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        slots, want = self.slots(keys), keys + 1
        there = self.keys[slots]
        out = np.where(there == want, self.values[slots], -1)
        open_ = np.flatnonzero((there != want) & (there != 0))
        while len(open_):
            slots[open_] = at = (slots[open_] + 1) & self.last
            there, own = self.keys[at], want[open_]
            hit = there == own
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: list[int]) -> None:
        """Keys that aren't there yet, each once."""
        table = self.keys
        for key, slot, value in zip(keys.tolist(), self.slots(keys).tolist(), values):
            while table[slot]:
                slot = (slot + 1) & self.last
            table[slot], self.values[slot] = key + 1, value
        self.size += len(values)


class Transducer:
    """Bytes of one piece in, tokens out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        #: Of equal byte strings states keep one.
        self.own = {t: t for t in ranks}
        #: Bytes of a token, by its rank.
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        #: Byte strings that some longer token starts with: only these can stay open.
        self.starts = {t[:n] for t in ranks for n in range(1, len(t))}
        #: For each token met: whether its own bytes encode to it, and the parts that stand at its right and
        #: at its left edge while it is built, each with the rank of the merge that takes the part in.
        self.edges: dict[bytes, tuple[bool, list, list]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state: the bytes since the first open end, and each open end in them with the last token there.
        self.states: list[tuple[bytes, tuple[tuple[int, bytes], ...]]] = [(b"", ((0, b""),))]
        self.ids = {self.states[0]: 0}
        #: By state and byte (state * 256 + byte): the next state and the last token after that byte. For one piece, with the
        #: token's length; for many at a time, with its rank, as state * 2**32 + rank.
        self.next: dict[int, tuple[int, int]] = {}
        self.table = Transitions(3 * MAX_STATES + ABREAST + SHORT)

    def full(self) -> bool:
        return len(self.states) > MAX_STATES or max(self.table.size, len(self.next)) > 3 * MAX_STATES

    def edge(self, token: bytes) -> tuple[bool, list, list]:
        if token not in self.edges:
            never = 1 << 60
            halves = merge_pairs(token, self.ranks, 2)
            right, left = [(token, never)], [(token, never)]
            if len(halves) == 2:
                rank = self.ranks[token]
                right += [(t, min(r, rank)) for t, r in self.edge(halves[1])[1]]
                left += [(t, min(r, rank)) for t, r in self.edge(halves[0])[2]]
            self.edges[token] = len(halves) <= 2, right, left
        return self.edges[token]

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether token b may follow token a (b'' before the first): no merge over their seam comes before
        both of its parts are taken into a and b."""
        own, _, left = self.edge(b)
        if not a or not own:
            return own
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.seam(self.edge(a)[1], left)
        return known

    def seam(self, right: list[tuple[bytes, int]], left: list[tuple[bytes, int]]) -> bool:
        rank = self.ranks.get
        for x, taken_x in right:
            for y, taken_y in left:
                m = rank(x + y)
                if m is not None and m < taken_x and m <= taken_y:
                    return False
        return True

    def step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The transition for one byte: the next state and the last token."""
        pending, ends = self.states[state]
        pending += bytes([byte])
        for start, previous in ends:
            token = self.own.get(pending[start:])
            if token is not None and self.fits(previous, token):
                break
        else:
            raise ValueError("ranks lack a single byte")
        still = [(e, t) for e, t in ends if pending[e:] in self.starts] + [(len(pending), token)]
        first = still[0][0]
        new = pending[first:], tuple([(e - first, t) for e, t in still])
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        return to, token

    def single(self, key: int) -> tuple[int, int]:
        to, token = self.step(key >> 8, key & 255)
        got = self.next[key] = to, len(token)
        return got

    def tokens(self, piece: bytes) -> Iterator[list[int]]:
        """The tokens of a piece, each emitted at most LOOKAHEAD bytes and two longest tokens after its end."""
        lengths: list[int] = []
        state, table, done = 0, self.next, 0
        for at in range(0, len(piece), LOOKAHEAD):
            if at:
                heads = {at - done - len(self.states[state][0]) + e for e, _ in self.states[state][1]}
                while len(heads) > 1:
                    heads.remove(e := max(heads))
                    heads.add(e - lengths[e - 1])
                meet = heads.pop()
                yield self.back(piece[done : done + meet], lengths)
                lengths, done = lengths[meet:], done + meet
            if self.full():
                state = self.restart(state)
                table = self.next
            for byte in piece[at : at + LOOKAHEAD]:
                key = state << 8 | byte
                got = table.get(key) or self.single(key)
                state = got[0]
                lengths.append(got[1])
        yield self.back(piece[done:], lengths)

    def restart(self, state: int) -> int:
        kept = self.states[state]
        self.reset()
        if kept in self.ids:
            return 0
        self.ids[kept] = 1
        self.states.append(kept)
        return 1

    def back(self, piece: bytes, lengths: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end > 0:
            start = end - lengths[end - 1]
            out.append(self.ranks[piece[start:end]])
            end = start
        return out[::-1]

    def encode(self, data: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each piece, and the tokens, piece after piece. ``stops``: where in the data each piece ends."""
        sizes = np.diff(stops, prepend=0)
        starts = stops - sizes
        bounds = [0, *stops.tolist()]
        whole = np.fromiter(map(self.ranks.get, map(data.__getitem__, map(slice, bounds, bounds[1:])), repeat(-1)), np.int64, len(sizes))
        counts = np.ones(len(sizes), np.int64)
        found = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for k in np.flatnonzero((whole < 0) & (sizes > SHORT)).tolist():
            ids = [t for part in self.tokens(data[bounds[k] : bounds[k + 1]]) for t in part]
            counts[k] = len(ids)
            found.append((np.array([k]), np.array(ids, np.int64)))
        rest = np.flatnonzero((whole < 0) & (sizes <= SHORT))
        array = np.frombuffer(data, np.uint8)
        cuts = np.diff(np.cumsum(sizes[rest]) // ABREAST) + np.diff(np.arange(len(rest)) // MAX_PIECES)
        for group in np.split(rest, np.flatnonzero(cuts) + 1):
            counts[group], ids = self.abreast(array, starts[group], sizes[group])
            found.append((group, ids))
        out, begins = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for group, ids in found:
            out[places(begins[group], counts[group])] = ids
        return counts, out

    def moves(self, keys: np.ndarray) -> np.ndarray:
        """The transitions, made on first use."""
        got = self.table.get(keys)
        lacking = np.flatnonzero(got < 0)
        if len(lacking):
            new = np.unique(keys[lacking])
            steps = [self.step(key >> 8, key & 255) for key in new.tolist()]
            self.table.add(new, [to << 32 | self.ranks[token] for to, token in steps])
            got[lacking] = self.table.get(keys[lacking])
        return got

    def abreast(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of the data that are read side by side, fewer than ABREAST + SHORT bytes in all."""
        if self.full():
            self.reset()
        # The longest first, so that those with a byte left are always the first ones.
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        begins = np.cumsum(sizes) - sizes
        last, state = np.empty(sizes.sum(), np.int64), np.zeros(len(sizes), np.int64)
        for at in range(sizes[0] if len(sizes) else 0):
            left = np.searchsorted(-sizes, -at)
            got = self.moves(state[:left] << 8 | data[starts[:left] + at])
            state, last[begins[:left] + at] = got >> 32, got & 0xFFFFFFFF
        # Back along the links, a token of each piece at a time.
        rounds, lanes, ends = [], np.arange(len(sizes)), sizes
        counts = np.zeros(len(sizes), np.int64)
        while len(lanes):
            tokens = last[begins[lanes] + ends - 1]
            rounds.append((order[lanes], tokens))
            counts[order[lanes]] += 1
            ends = ends - self.sizes[tokens]
            lanes, ends = lanes[ends > 0], ends[ends > 0]
        stops = np.cumsum(counts)
        out = np.empty(counts.sum(), np.int64)
        for k, (lanes, tokens) in enumerate(rounds):
            out[stops[lanes] - 1 - k] = tokens
        return counts, out


#: A character's bytes from its first one on: (first, last, the ranges of those that follow). The ranges after E0, ED, F0 and F4
#: leave out overlong forms, surrogates and what is beyond U+10FFFF. Fixed values of UTF-8.
_ANY = (0x80, 0xBF)
UTF8 = [
    (0x00, 0x7F, []),
    (0xC2, 0xDF, [_ANY]),
    (0xE0, 0xE0, [(0xA0, 0xBF), _ANY]),
    (0xE1, 0xEC, [_ANY, _ANY]),
    (0xED, 0xED, [(0x80, 0x9F), _ANY]),
    (0xEE, 0xEF, [_ANY, _ANY]),
    (0xF0, 0xF0, [(0x90, 0xBF), _ANY, _ANY]),
    (0xF1, 0xF3, [_ANY, _ANY, _ANY]),
    (0xF4, 0xF4, [(0x80, 0x8F), _ANY, _ANY]),
]
REPLACED = "\ufffd".encode()


def utf8_states() -> list[dict[int, int]]:
    """For each state, by byte, the next one; 0 is between characters. A state is what still has to follow."""
    names: dict[tuple, int] = {(): 0}
    states: list[dict[int, int]] = [{}]

    def state(rest: tuple) -> int:
        if rest not in names:
            names[rest] = len(states)
            states.append({})
            (low, high), after = rest[0], state(rest[1:])
            states[names[rest]].update({b: after for b in range(low, high + 1)})
        return names[rest]

    for first, last, rest in UTF8:
        states[0].update({b: state(tuple(rest)) for b in range(first, last + 1)})
    return states


class Utf8:
    """The machine: bytes in, whole characters out, as UTF-8."""

    STATES = utf8_states()

    def __init__(self) -> None:
        self.state, self.open = 0, b""

    def feed(self, data: bytes) -> bytes:
        out, start, done, now, states = [], 0, len(self.open), self.state, self.STATES
        data = self.open + data
        for k in range(done, len(data)):
            to = states[now].get(data[k])
            if to is None and now:
                # The open character ends here; this byte may begin another.
                out.append(REPLACED)
                now, start = 0, k
                to = states[0].get(data[k])
            if to is None:
                out.append(REPLACED)
                start = k + 1
            elif to:
                now = to
            else:
                out.append(data[start : k + 1])
                now, start = 0, k + 1
        self.state, self.open = now, data[start:]
        return b"".join(out)

    def end(self) -> bytes:
        left, self.state, self.open = self.open, 0, b""
        return REPLACED if left else b""


class Store:
    """Token sequences by name, for many at a time. Row 0 is the empty sequence."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = 1
        self.starts, self.sizes, self.uses = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.filled, self.ids = 0, np.zeros(4096, np.uint32)

    def add(self, names: dict[str, int], sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The rows of new sequences. ``names``: names by place among them; those without a name can't be found, and their rows
        go at the next thinning."""
        first, self.rows = self.rows, self.rows + len(sizes)
        for name in ("starts", "sizes", "uses"):
            setattr(self, name, self.room(getattr(self, name), first, self.rows))
        self.sizes[first : self.rows] = sizes
        self.starts[first : self.rows] = self.filled + np.cumsum(sizes) - sizes
        self.uses[first : self.rows] = 0
        self.ids = self.room(self.ids, self.filled, self.filled + len(ids))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.index.update(zip(names, (np.fromiter(names.values(), np.int64, len(names)) + first).tolist()))
        return np.arange(first, self.rows)

    @staticmethod
    def room(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
        if wanted <= len(array):
            return array
        larger = np.empty(max(wanted, len(array) * 3 // 2), array.dtype)
        larger[:used] = array[:used]
        return larger

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of the rows' sequences, and the sequences one after the other."""
        sizes = self.sizes[rows]
        return sizes, self.ids[places(self.starts[rows], sizes)]

    def thin(self, most: int) -> None:
        """Leaves the more used half, if there are more rows than ``most`` or sequences that are too long."""
        if self.rows <= most and self.filled <= 8 * most:
            return
        names = np.array(list(self.index), object)
        rows = np.fromiter(self.index.values(), np.int64, len(names))
        best = np.argsort(-self.uses[rows], kind="stable")[: most // 2]
        names, rows = names[best].tolist(), rows[best]
        sizes, ids = self.get(rows)
        uses = self.uses[rows] // 2
        fits = np.cumsum(sizes) <= 4 * most
        keep = int(fits.sum())
        self.__init__()
        new = self.add({name: k for k, name in enumerate(names[:keep])}, sizes[:keep], ids[: sizes[:keep].sum()])
        self.uses[new] = uses[:keep]


class Codec:
    """Splits texts by the pattern, encodes each piece, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.fst = Transducer(ranks)
        self.bytes = {v: k for k, v in ranks.items()}
        #: The bytes of all tokens, by rank, and where each begins.
        self.spelled = np.frombuffer(b"".join([self.bytes[i] for i in sorted(self.bytes)]), np.uint8)
        self.begins = np.cumsum(self.fst.sizes) - self.fst.sizes
        #: By token, whether it begins and ends between characters.
        self.closed = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        for token, i in ranks.items():
            machine = Utf8()
            self.closed[i] = machine.feed(token) == token and not machine.state
        self.words = Store()

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each piece, and the tokens, piece after piece."""
        text = "".join(pieces)
        data = text.encode()
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(data) > len(text):
            stops = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))[stops]
        return self.fst.encode(data, stops)

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts, each split on its own."""
        split = [self.split(text) for text in texts]
        sizes, ids = self.tokens([piece for pieces in split for piece in pieces])
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return np.diff(np.append(0, np.cumsum(sizes))[ends], prepend=0), ids

    def learn(self, words: list[str]) -> np.ndarray:
        """The rows of new words, each with a space before it."""
        pieces = self.split(" " + " ".join(words)) if words else []
        sizes, ids = self.tokens(pieces)
        # Only the first piece of a word holds a space.
        begins = [k for k, piece in enumerate(pieces) if piece[0] == " "]
        sizes = np.diff(np.append(0, np.cumsum(sizes))[[*begins, len(pieces)]])
        return self.words.add({w: k for k, w in enumerate(words) if len(w) <= 32 and "\n" not in w}, sizes, ids)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The pattern always ends a piece before a space that no white space follows, so texts are first cut there."""
        self.words.thin(MAX_WORDS)
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = offsets[:-1]
        spaced = np.ones(len(codes), bool)
        spaced[firsts] = False
        used = np.zeros(len(names), bool)
        used[codes[spaced]] = True
        rows = np.fromiter(map(self.words.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero((rows < 0) & used).tolist()
        odd = [k for k in new if ODD_WORD.match(names[k])] if ODD_SPACE.search(" " + " ".join([names[k] for k in new])) else []
        if odd:
            new = sorted({*new} - {*odd})
        rows[rows < 0] = 0
        rows[new] = self.learn([names[k] for k in new])
        self.words.uses[rows] += 1
        rows = rows[codes]
        # A text's first word has no space before it.
        rows[firsts] = self.words.add({}, *self.apart([names[k] for k in codes[firsts].tolist()]))
        sizes, ids = self.words.get(rows)
        bounds = np.append(0, np.cumsum(sizes))[offsets].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        if odd:
            own = np.unique(np.searchsorted(offsets, np.flatnonzero(np.isin(codes, odd) & spaced), "right") - 1).tolist()
            sizes, ids = self.apart([texts[k] for k in own])
            for k, part in zip(own, np.split(ids, np.cumsum(sizes)[:-1])):
                out[k] = part
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_stream(self, ids: np.ndarray, chunk: int = 16384) -> Iterator[bytes]:
        """Whole characters, as UTF-8, of a sequence of tokens."""
        names, machine = self.bytes, Utf8()
        for at in range(0, len(ids), chunk):
            part = ids[at : at + chunk]
            sizes = self.fst.sizes[part]
            data = self.spelled[places(self.begins[part], sizes)].tobytes()
            ends = np.cumsum(sizes)
            opened = np.flatnonzero(~self.closed[part]).tolist()
            k = 0
            for stop in [*opened, len(part)]:
                # Tokens that leave nothing open pass in one piece, unless something is open before them.
                while machine.state and k < stop:
                    yield machine.feed(names[int(part[k])])
                    k += 1
                if k < stop:
                    yield data[ends[k] - sizes[k] : ends[stop - 1]]
                k = max(k, stop)
                if k < len(part):
                    yield machine.feed(names[int(part[k])])
                    k += 1
        yield machine.end()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.decode_stream(np.array(ids, np.int64))).decode()


@lru_cache(maxsize=2)
def codec_for(ranks_path: str, pattern: str) -> Codec:
    """One for each Python worker, which Spark uses for many tasks."""
    return Codec(load_ranks(ranks_path), pattern)


def chunks(texts: Iterator[str]) -> Iterator[list[str]]:
    """The texts in groups of at most CHUNK characters; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > CHUNK:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256; with keep_ids also ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks_path, pattern)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for ids in chain.from_iterable(map(codec.encode_all, chunks(strings(batch)))):
                packed = ids.astype("<u4", copy=False)
                seen = hashlib.sha256()
                for part in codec.decode_stream(packed):
                    seen.update(part)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(packed.tobytes()).hexdigest())
                rows[2].append(seen.hexdigest())
                if keep_ids:
                    rows[3].append(ids.tolist())
                    rows[4].append(codec.decode(ids))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            own = [pa.array(r, k) for r, k in zip(rows[: 5 if keep_ids else 3], kinds)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *own], names[: len(own) + 1])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs.doc_id.cast("long"), "text").mapInArrow(run, schema + ", ids array<int>, decoded string" * keep_ids)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
