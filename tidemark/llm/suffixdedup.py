"""Removal of long repeats by a distributed merge sort of suffixes that knows common prefixes.

What counts as long is a ``Measure``: ``BYTES`` are strings of 400 bytes, ``WORDS`` are 51 words
in a row, whatever white space stands between them. A text is a row of symbols, its bytes or
40-bit codes of its words; both kinds go through the same passes, with one shuffle of the texts.

A string of ``length`` symbols that occurs twice holds, in both places, the same gram of least
hash (leftmost of equals). So only suffixes that start at such grams, the anchors, need sorting:
about one byte in 170. An anchor answers for the windows it is least in, which are consecutive;
what they cover is its left and right context. Anchors whose gram occurs once in the corpus
cannot repeat and leave by counts of hashes, before any text moves.

The others' right contexts are the suffixes. Tasks sort them in runs, in which equal contexts
meet and leave one of themselves, and exchange the runs front-coded (each suffix without the
prefix it shares with the one before), dealt by the gram. Receivers merge them by loser trees
whose nodes keep the prefix known to be common with the last suffix out, so that no byte of it
is compared again. Neighbours that share the gram form a group. A window at offset o before the
anchor repeats if another suffix of the group shares o symbols to the left and the rest to the
right; the merge has left the prefix lengths, the left contexts are compared from their ends.
A group of very many members is dealt out again by what its windows hold (``strips``).
All comparisons are of symbols; a gram's hash only ever decides who meets.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.util import discard, streamed, trimmed, written


@dataclass(frozen=True)
class Measure:
    """Symbols of ``wide`` bytes; ``length`` of them alike are a repeat; anchors are grams of ``gram``. ``low`` marks its hashes."""

    low: int
    wide: int
    length: int
    gram: int

    @property
    def reach(self) -> int:
        """Bytes of a gram."""
        return self.gram * self.wide


BYTES = Measure(0, 1, 400, 64)
#: Passages of over 50 words.
WORDS = Measure(1, 5, 51, 8)
MEASURES = (BYTES, WORDS)
#: Symbols or bytes of text whose hashes are made at once, contexts of a sorted run.
CHUNK, RUN = 1 << 18, 20_000
#: Words of more bytes are coded one by one.
LONG_WORD = 1 << 16
#: Bytes of contexts meant for a part of the exchange.
PART = 16 << 20
#: Groups up to this size are compared pair by pair, larger ones by classes.
PAIRS = 16
#: Groups above HOT members do not stay in one task: they meet again by strips of offsets, ever
#: narrower, until a strip is one window. PASSED of them go on at a time.
HOT, PASSED = 1 << 15, 1 << 10
SHARES = (8, 64, 1 << 10)
BASE = np.uint64(0xD6E8FEB86659FD93)
CODES = np.random.default_rng(400).integers(1, 1 << 63, 256, np.uint64)
PLACE = np.uint64((1 << 24) - 1)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: First bytes of the three that make an ideograph or a syllable of kana: scripts without spaces, of which each character is a word.
ALONE = (np.arange(256) >= 0xE3) & (np.arange(256) <= 0xE9)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= BASE
        return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` symbols from each place, by doubling."""
    h, power, wide = codes, BASE, 1
    with np.errstate(over="ignore"):
        while wide < gram:
            h = h[:-wide] * power + h[wide:]
            power, wide = power * power, 2 * wide
    return _mixed(h)


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start and end: runs without white space, and each character that is ALONE. None crosses the bounds of its text."""
    edge = np.unique(np.r_[starts, ends])
    begin, stop = [], []
    for a in range(0, len(data), CHUNK):
        b = min(len(data), a + CHUNK)
        held = np.r_[a > 0 and not SPACES[data[a - 1]], ~SPACES[data[a:b]], b < len(data) and not SPACES[data[b]]]
        cut = edge[np.searchsorted(edge, a) : np.searchsorted(edge, b, "right")] - a
        split = np.zeros(b - a + 1, bool)
        split[cut] = True
        alone = ALONE[data[max(0, a - 3) : b]]
        places = np.flatnonzero(alone) + max(0, a - 3) - a
        split[places[places >= 0]] = True
        after = places + 3
        split[after[(after >= 0) & (after <= b - a)]] = True
        if b < len(data) and ALONE[data[b]]:
            split[b - a] = True
        inner, before, behind = held[1:-1], held[:-2], held[2:]
        begin.append(a + np.flatnonzero(inner & (~before | split[:-1])))
        stop.append(a + 1 + np.flatnonzero(inner & (~behind | split[1:])))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begin]), np.concatenate([none, *stop])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        both = [np.full(n, x, np.uint64) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
    return both[0], both[1]


def word_codes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word, by differences of one running sum a chunk; very long words are hashed whole."""
    out = np.empty(len(begin), np.uint64)
    power, inverse = _powers(CHUNK + LONG_WORD + 1)
    long = stop - begin > LONG_WORD
    for k in np.flatnonzero(long):
        out[k] = xxhash.xxh64_intdigest(memoryview(data[begin[k] : stop[k]]))
    short = np.flatnonzero(~long)
    lo, hi = begin[short], stop[short]
    at = 0
    while at < len(short):
        a = int(lo[at])
        to = int(np.searchsorted(lo, a + CHUNK))
        x, y = lo[at:to] - a, hi[at:to] - a
        with np.errstate(over="ignore"):
            total = np.cumsum(CODES[data[a : a + int(y[-1])]] * power[: int(y[-1])], dtype=np.uint64)
            out[short[at:to]] = _mixed((total[y - 1] - np.where(x > 0, total[np.maximum(x - 1, 0)], np.uint64(0))) * inverse[x])
        at = to
    return out


def sliding_least(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` keys in a row."""
    n = len(keys) - wide + 1
    full = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    square = full.reshape(-1, wide)
    ahead = np.minimum.accumulate(square, 1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])


def narrow(codes: np.ndarray) -> bytes:
    """The low bytes of the codes, as many as a word's symbol has."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WORDS.wide].tobytes()


def anchors(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, measure: Measure) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, text number, anchor, first window, last window) for texts at ``starts`` to ``ends`` of symbols; places within the text.

    ``codes`` are bytes or word codes.
    """
    wide = measure.length - measure.gram + 1
    low, high = int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(ends) else 0
    for a in range(low, high, CHUNK):
        b = min(high, a + CHUNK + measure.length - 1)
        if b - a < measure.length:
            continue
        hashes = gram_hashes(CODES[codes[a:b]] if codes.dtype == np.uint8 else codes[a:b], measure.gram)
        keys = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_least(keys, wide) & PLACE).astype(np.int64)[:CHUNK]
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(at), "left")
        number = np.searchsorted(ends[first:last], a + np.arange(len(at)), "right") + first
        whole = np.nonzero(a + np.arange(len(at)) + measure.length <= ends[np.minimum(number, len(ends) - 1)])[0]
        if not len(whole):
            continue
        of = at[whole]
        cut = np.r_[0, np.nonzero((np.diff(of) != 0) | (np.diff(whole) != 1))[0] + 1]
        windows, until = whole[cut], whole[np.r_[cut[1:] - 1, len(whole) - 1]]
        text = number[windows]
        zero = a - starts[text]
        # The lowest bit tells the measures apart, so that grams of one never meet those of the other.
        yield (hashes[of[cut]] & ~np.uint64(1)) | np.uint64(measure.low), text, of[cut] + zero, windows + zero, until + zero


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column's texts; null texts are empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[: offsets[-1]], offsets[:-1], offsets[1:]


def _first_pass(measures: tuple[Measure, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rid, text to rows of a text (gram null: length and digest) and of its anchors."""
        names = ["rid", "n_bytes", "sha", "gram", "anchor", "first", "last"]
        for batch in trimmed(batches):
            rid = batch.column(0).to_numpy()
            data, starts, ends = _buffers(batch.column(1))
            view, n = memoryview(data), len(rid)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts, ends)]
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), pa.array(digests), pa.nulls(n, pa.int64()), none, none, none], names)
            for measure in measures:
                codes, low, high = data, starts, ends
                if measure is WORDS:
                    begin, stop = word_bounds(data, starts, ends)
                    codes, low, high = word_codes(data, begin, stop), np.searchsorted(begin, starts), np.searchsorted(begin, ends)
                for gram, text, anchor, first, last in anchors(codes, low, high, measure):
                    m = len(gram)
                    narrow = [pa.array(x.astype(np.int32)) for x in (anchor, first, last)]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[text]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(gram.view(np.int64)), *narrow], names)

    return run


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    step = 16
    while low < high:
        to = min(high, low + step)
        if a[low:to] == b[low:to]:
            low, step = to, 4 * step
        elif to - low == 1:
            break
        else:
            high, step = to, max(1, (to - low) // 2)
            while low < high:
                half = (low + high + 1) // 2
                if a[low:half] == b[low:half]:
                    low = half
                else:
                    high = half - 1
            return low
    return low


def pack(run: list[tuple]) -> bytes:
    """A sorted run (right, left, key, anchor, known), front-coded, then compressed: left contexts share much, too."""
    shared, rests, before = [], [], b""
    for right, *_ in run:
        n = common(before, right)
        shared.append(n)
        rests.append(right[n:])
        before = right
    return zstandard.ZstdCompressor(1).compress(pickle.dumps((shared, rests, *map(list, zip(*(x[1:] for x in run)))), 5))


def unpack(block: bytes) -> Iterator[tuple[int, tuple]]:
    """The run again, each entry with the prefix it shares with the one before."""
    right = b""
    for n, rest, *others in zip(*pickle.loads(zstandard.ZstdDecompressor().decompress(block))):
        right = right[:n] + rest
        yield n, (right, *others)


def merged(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """All runs' entries in order of right contexts, each with the prefix shared with the one before.

    A loser tree: each inner node keeps the run that lost there and the prefix its entry has in
    common with the winner that passed. A new entry comes with its prefix in common with the last
    one out. Of two, the longer such prefix is smaller; only if they are equal are bytes compared,
    and then only those behind the prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = None
    heads: list[tuple | None] = [next(r, (0, end))[1] for r in runs] + [end] * (size - len(runs))
    loser, shared = [0] * size, [0] * size

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix in common with the winner."""
        x, y = heads[a], heads[b]
        if y is end:
            return a, la, b, 0
        if x is end:
            return b, lb, a, 0
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = x[0], y[0]
        n = common(x, y, la)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, la, b, n
        return b, lb, a, n

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        winner, lw, loser[node], shared[node] = play(a, la, b, lb)
        return winner, lw

    winner, prefix = build(1)
    while heads[winner] is not end:
        yield prefix, heads[winner]
        prefix, heads[winner] = next(runs[winner], (0, end))
        node = (winner + size) // 2
        while node:
            winner, prefix, loser[node], shared[node] = play(winner, prefix, loser[node], shared[node])
            node //= 2


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(rid, start, stop) with overlapping and touching spans of a text made one."""
    out: list[list[int]] = []
    for rid, start, stop in sorted(spans):
        if out and out[-1][0] == rid and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([rid, start, stop])
    return [tuple(x) for x in out]


class _Runs:
    """Contexts (right, left) with where they stand, by what they are; full, they leave as sorted runs by part.

    Equal contexts leave one of themselves, marked known, and what all of them repeat. A text is
    known by ``rid`` and measure in one number, so that spans of one measure stay apart.
    """

    NAMES = ["part", "block", "key", "start", "stop"]
    SCHEMA = "part int, block binary, key long, start int, stop int"

    def __init__(self, parts: int):
        self.parts, self.held = parts, {}

    def add(self, right: bytes, left: bytes, by: int, key: int, at: int, known: bool = False) -> None:
        kind = key & 1
        same = self.held.setdefault((right, left, kind), [by % self.parts * 2 + kind, [], False])
        same[1].append((key, at))
        same[2] |= known

    def flush(self) -> pa.RecordBatch:
        runs: dict[int, list] = {}
        spans = []
        for (right, left, kind), (part, places, known) in self.held.items():
            known, wide = known or len(places) > 1, MEASURES[kind].wide
            runs.setdefault(part, []).append((right, left, *places[0], known))
            if known:
                spans += [(key, at - len(left) // wide, at + len(right) // wide) for key, at in places]
        self.held.clear()
        spans = united(spans)
        blocks = [(part, pack(sorted(run))) for part, run in runs.items()]
        n, m = len(blocks), len(spans)
        key, start, stop = zip(*spans) if spans else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(p for p, _ in blocks), *[None] * m], pa.int32()), pa.array([*(b for _, b in blocks), *[None] * m], pa.binary()),
                pa.array([*[None] * n, *key], pa.int64()), pa.array([*[None] * n, *start], pa.int32()), pa.array([*[None] * n, *stop], pa.int32()),
            ],
            self.NAMES,
        )


def _second_pass(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, text, anchors) to sorted runs by part, and to what repeats inside a run (part null)."""
        runs = _Runs(parts)
        for batch in trimmed(batches):
            for rid, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                symbols, found = [text.as_py().encode(), None], found.values
                fields = (found.field(k).to_pylist() for k in range(4))
                for gram, at, first, last in zip(*fields):
                    kind = gram & 1
                    if symbols[kind] is None:
                        data = np.frombuffer(symbols[0], np.uint8)
                        symbols[kind] = narrow(word_codes(data, *word_bounds(data, np.zeros(0, int), np.zeros(0, int))))
                    data, measure = symbols[kind], MEASURES[kind]
                    right, left = data[at * measure.wide : (last + measure.length) * measure.wide], data[first * measure.wide : at * measure.wide]
                    runs.add(right, left, gram >> 1, rid << 1 | kind, at)
                if len(runs.held) >= RUN:
                    yield runs.flush()
        yield runs.flush()

    return run


def strips(right: bytes, left: bytes, measure: Measure, share: int) -> Iterator[tuple[bytes, bytes, int]]:
    """The contexts of each strip of offsets, a ``share``-th of all, with a hash of what all its windows hold.

    A window at an offset from o to p holds the o symbols before the anchor and as many after it as
    one at p does. So windows that are equal lie in strips that hash alike; and contexts cut to what a
    strip's windows cover allow no other window.
    """
    w, length = measure.wide, measure.length
    n, m, step = len(left) // w, len(right) // w, max(1, (length - measure.gram + 1) // share)
    for o in range(0, length - measure.gram + 1, step):
        p = o + step - 1
        if max(o, length - m) <= min(p, n):
            held = left[(n - o) * w :] + right[: max(measure.gram, length - p) * w]
            yield right[: (length - o) * w], left[max(0, n - p) * w :], xxhash.xxh64_intdigest(held) >> 1


def _strip_pass(parts: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members (key, anchor, known, right, left) of large groups to runs by strip."""
        runs = _Runs(parts)
        for batch in trimmed(batches):
            for key, at, known, right, left in zip(*(batch.column(c).to_pylist() for c in range(5))):
                for r, l, by in strips(right, left, MEASURES[key & 1], share):  # noqa: E741
                    runs.add(r, l, by, key, at, known)
                if len(runs.held) >= RUN:
                    yield runs.flush()
        yield runs.flush()

    return run


def _pairs(group: list[tuple], shared: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    measure = MEASURES[group[0][2] & 1]
    wide = measure.wide
    for i, (right, left, *_) in enumerate(group):
        reach = len(right) // wide
        for j in range(i + 1, len(group)):
            reach = min(reach, shared[j])
            if reach < measure.gram:
                break
            other = group[j]
            back = common(left[::-1], other[1][::-1]) // wide
            for mine, of in ((i, group[i]), (j, other)):
                low, high = max(length - len(of[0]) // wide, length - reach), min(len(of[1]) // wide, back)
                if low <= high:
                    yield mine, low, high


def _classes(group: list[tuple], shared: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """As ``_pairs`` without pairs: at each offset, entries alike to the right and to the left share both classes."""
    m, wide = len(group), MEASURES[group[0][2] & 1].wide
    to_right = np.array(shared)
    back = [x[1][::-1] for x in group]
    order = sorted(range(m), key=back.__getitem__)
    to_left = np.array([0, *(common(back[a], back[b]) // wide for a, b in zip(order, order[1:]))])
    order = np.array(order)
    low = np.array([length - len(x[0]) // wide for x in group])
    high = np.array([len(x[1]) // wide for x in group])
    left, since = np.empty(m, np.int64), np.full(m, -1)
    for o in range(low.min(), high.max() + 2):
        right = np.cumsum(to_right < length - o)
        left[order] = np.cumsum(to_left < o)
        own = np.nonzero((low <= o) & (o <= high))[0]
        _, inverse, counts = np.unique(right[own] * (m + 1) + left[own], return_inverse=True, return_counts=True)
        hit = np.zeros(m, bool)
        hit[own[counts[inverse] > 1]] = True
        for i in np.nonzero(~hit & (since >= 0))[0].tolist():
            yield i, int(since[i]), o - 1
        since = np.where(hit, np.where(since < 0, o, since), -1)


def resolve(group: list[tuple], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(key, start, stop) of what repeats among neighbours (right, left, key, anchor, known) that share a gram; all in symbols."""
    if not group:
        return
    measure = MEASURES[group[0][2] & 1]
    wide = measure.wide
    places: dict[tuple[bytes, bytes], list] = {}
    kept, prefixes, reach = [], [], 1 << 30
    for n, x in zip(shared, group):
        same = places.setdefault(x[:2], [])
        reach = min(reach, n // wide)
        if not same:
            kept.append(x)
            prefixes.append(reach)
            reach = 1 << 30
        same.append(x)
    whole = set()
    for key, same in places.items():
        if len(same) > 1 or same[0][4]:
            whole.add(key)
            for right, left, of, at, known in same:
                if not known:
                    yield of, at - len(left) // wide, at + len(right) // wide
    if len(kept) > 1:
        for i, low, high in (_pairs if len(kept) <= PAIRS else _classes)(kept, prefixes, measure.length):
            right, left, of, at, _ = kept[i]
            if (right, left) not in whole:
                yield of, at - high, at - low + measure.length


MET = "key long, start int, stop int, anchor int, known boolean, right binary, left binary"


def _merge_pass(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs, sorted by part, to the spans that repeat (right null). Members of groups above ``most`` go on as they are."""
        names = [c.split(" ")[0] for c in MET.split(", ")]

        def told(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
            n = len(spans)
            key, start, stop = zip(*spans) if spans else ((), (), ())
            rest = [pa.nulls(n, kind) for kind in (pa.int32(), pa.bool_(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), *rest], names)

        def passed(group: list[tuple]) -> pa.RecordBatch:
            right, left, key, at, known = zip(*group)
            n = pa.nulls(len(group), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), n, n, pa.array(at, pa.int32()), pa.array(known, pa.bool_()), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names)

        def out(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            spans: list[tuple[int, int, int]] = []
            group, shared, large = [], [], False
            for n, x in merged([unpack(b) for b in blocks]):
                if n < MEASURES[x[2] & 1].reach:
                    if large:
                        yield passed(group) if group else told([])
                    elif len(group) > 1 or (group and group[0][4]):
                        spans += resolve(group, shared)
                    group, shared, large = [], [], False
                group.append(x)
                shared.append(n)
                if len(group) > (most if not large else PASSED):
                    yield passed(group)
                    group, shared, large = [], [], True
            if large and group:
                yield passed(group)
            yield told(united(spans if large else [*spans, *resolve(group, shared)]))

        here, blocks = None, []
        for batch in trimmed(batches):
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != here and blocks:
                    yield from out(blocks)
                    blocks = []
                here = part
                blocks.append(block.as_py())
        if blocks:
            yield from out(blocks)

    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [x[1:] for x in united([(0, *x) for x in spans])]


def _cut(measures: tuple[Measure, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, spans, what else) to the latter, with removed bytes, spans, digest and rest of each text, and its passages and their words.

        What ``measures`` found is removed, the passages counted whether or not they are.
        """
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(0), batch.column(1)):
                data, found = text.as_py().encode(), spans.as_py() or ()
                by = [_joined([(x["start"], x["stop"]) for x in found if x["low"] == m.low]) for m in MEASURES]
                gone = list(by[BYTES.low]) if BYTES in measures else []
                if by[WORDS.low] and WORDS in measures:
                    begin, stop = word_bounds(np.frombuffer(data, np.uint8), np.zeros(0, int), np.zeros(0, int))
                    gone += [(int(begin[a]), int(stop[b - 1])) for a, b in by[WORDS.low]]
                gone = _joined(gone)
                at, kept = 0, []
                for start, end in gone:
                    kept.append(data[at:start])
                    at = end
                rest = b"".join([*kept, data[at:]])
                passages = by[WORDS.low]
                rows.append((len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), len(passages), sum(b - a for a, b in passages)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], [*batch.schema.names[2:], "n_removed", "n_spans", "kept_sha", "kept", "n_passages", "n_passage_words"])

    return run


def repeats(rows: DataFrame, how: str, measures: tuple[Measure, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a stored (rid, text, ...): digests (rid, n_bytes, sha) of all rows, the rows with their ``anchors``, and (rid, spans) of what repeats.

    All three are stored, and ``rows`` removed. ``how`` joins rows and anchors: ``inner`` keeps the rows that have anchors, ``left`` all.
    The texts are shuffled once. A span is (low, start, stop), in
    symbols of the measure that ``low`` names.
    """
    texts = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    passed = written(
        streamed(texts).mapInArrow(_first_pass(measures), "rid long, n_bytes long, sha string, gram long, anchor int, first int, last int"), "anchors"
    )
    found = passed.where("gram IS NOT NULL").select("rid", "gram", "anchor", "first", "last")
    # A table of its own, so that both sides of the join are plain shuffles and a very common gram is split.
    twice = written(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    # Stored, so that the anchors' shuffles are gone before the texts are shuffled.
    again = written(found.join(twice, "gram", "left_semi"), "again")
    digests = written(passed.where("gram IS NULL").select("rid", "n_bytes", "sha"), "digests")
    discard(twice)
    discard(passed)
    listed = again.groupBy("rid").agg(F.collect_list(F.struct("gram", "anchor", "first", "last")).alias("anchors"))
    joined = written(rows.join(listed, "rid", how), "suspects")
    discard(again)
    discard(rows)  # the joined rows and the digests are all there is to them now
    suspects = joined.where("anchors IS NOT NULL")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = suspects.agg(F.sum(F.size("anchors"))).first()[0] or 0
    parts = max(parts, -(-many * 2 * BYTES.length // PART))
    found, stored = [], []
    source, how_to_run = suspects.select("rid", "text", "anchors"), _second_pass(parts)
    for level in range(len(SHARES) + 1):
        runs = written(streamed(source).mapInArrow(how_to_run, _Runs.SCHEMA), "runs")
        dealt = runs.where("part IS NOT NULL").select("part", "block").repartition(parts, "part").sortWithinPartitions("part")
        met = written(streamed(dealt).mapInArrow(_merge_pass(HOT if level < len(SHARES) else float("inf")), MET), "met")
        inside = written(runs.where("part IS NULL").select("key", "start", "stop"), "inside")
        discard(runs)
        stored += [met, inside]
        found += [met.where("right IS NULL").select("key", "start", "stop"), inside]
        source = met.where("right IS NOT NULL").select("key", "anchor", "known", "right", "left")
        if level == len(SHARES) or source.isEmpty():
            break
        how_to_run = _strip_pass(parts, SHARES[level])
    spans = reduce(DataFrame.unionByName, found)
    low = F.col("key").bitwiseAND(1).cast("int").alias("low")
    spans = spans.groupBy(F.shiftright("key", 1).alias("rid")).agg(F.collect_list(F.struct(low, "start", "stop")).alias("spans"))
    spans = written(spans, "spans")
    for table in stored:
        discard(table)
    return digests, joined, spans


def _without(frame: DataFrame, measures: tuple[Measure, ...], *keep: str) -> DataFrame:
    """(text, spans, kept columns) to the kept columns and what ``_cut`` adds."""
    added = StructType.fromDDL("n_removed long, n_spans long, kept_sha string, kept string, n_passages long, n_passage_words long")
    schema = StructType([*frame.select(*keep).schema.fields, *added.fields])
    return streamed(frame.select("text", "spans", *keep)).mapInArrow(_cut(measures), schema)


def remove_repeats(docs: DataFrame, text: str = "text", measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """``docs`` without what repeats by any of ``measures``: strings of 400 bytes, passages of over 50 words.

    All columns stay, whatever their names. Null texts stay null and match nothing. A character
    of which some bytes go, goes. Repeated rows are rows of their own and repeat each other. Of a
    passage all occurrences go, as of a string; white space around it stays.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *(docs[f"`{c}`"] for c in others)).alias("row"), docs[text].alias("text"),
        F.monotonically_increasing_id().alias("rid"),
    )
    _, joined, spans = repeats(written(packed, "documents"), "left", measures)
    clean = joined.where("anchors IS NULL").select("row", "text")
    cut = _without(joined.where("anchors IS NOT NULL").drop("anchors").join(spans, "rid", "left"), measures, "row")
    found = clean.unionByName(cut.select("row", F.col("kept").alias("text")))
    return found.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, by strings of 400 bytes; null texts are empty.

    Two columns follow: n_passages, the runs of words that passages of over 50 words cover which
    also start anywhere else (the same document included), and n_passage_words, their words.
    """
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "documents")
    keys = written(rows.select("rid", "doc_id"), "keys")
    whole, joined, spans = repeats(rows, "inner", MEASURES)
    cut = _without(joined.select("rid", "text").join(spans, "rid"), (BYTES,), "rid").drop("kept")
    found = keys.join(whole, "rid").join(cut, "rid", "left")
    counted = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return found.select(
        "doc_id", "n_bytes", counted("n_removed"), counted("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        counted("n_passages"), counted("n_passage_words"),
    )
