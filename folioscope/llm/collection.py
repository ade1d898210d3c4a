"""The Burrows-Wheeler transform and common prefixes of a collection of strings,
built column by column.

All strings are entered from their ends, one symbol each per round. The sorted
list of all suffixes entered so far is kept in three sequential files: the symbol
before each suffix (the transform), the length of the prefix it shares with the one
before it, and its string. A round reads them once: counting symbols gives the
places of the suffixes that are one symbol longer, and the least common prefix
since the last equal symbol gives theirs. It then copies the files once with the
new suffixes put in. Only what belongs to the strings themselves, some numbers
each, is held in memory; files are small ones in memory first and then on disk.
"""

from __future__ import annotations

import tempfile
import numpy as np

#: Symbols that a step reads, and bytes that a file holds before it goes to disk.
STEP, HELD = 1 << 18, 16 << 20
#: Stands for the start of a string; never a byte of UTF-8.
NONE = 0xFF
#: Longest common prefix that is told apart.
MOST = 254
_BASE = np.random.default_rng(51).integers(1 << 63, dtype=np.uint64) | np.uint64(1)
_TABLE = np.random.default_rng(52).integers(1 << 63, size=256, dtype=np.uint64)


class _Column:
    """A sequential file of numbers."""

    def __init__(self, kind: str) -> None:
        self.kind = np.dtype(kind)
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, values: np.ndarray) -> None:
        self.file.write(values.astype(self.kind, copy=False).tobytes())

    def rewind(self) -> None:
        self.file.seek(0)

    def next(self, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.file.close()


def _columns() -> tuple[_Column, _Column]:
    return _Column("u1"), _Column("u1")


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` for each pair."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
    return out


def _scan(files: tuple, n: int, newest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reads the list once. ``newest``: sorted places of the suffixes entered last
    that go on. Returns the new places of their extensions, with common prefixes,
    in the order of ``newest``, and places and values of prefixes that change."""
    seen = np.zeros(256, np.int64)
    since = np.full(256, -1, np.int64)  # least prefix since a symbol's last place; -1: it had none
    was_new = np.zeros(256, bool)
    places, prefixes, symbols = np.empty(len(newest), np.int64), np.empty(len(newest), np.int64), np.empty(len(newest), np.int64)
    changed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0
    for at in range(0, n, STEP):
        size = min(STEP, n - at)
        symbol, prefix = files[0].next(size), files[1].next(size)
        stop = int(np.searchsorted(newest, at + size))
        fresh = np.zeros(size, bool)
        fresh[newest[done:stop] - at] = True
        order = np.argsort(symbol, kind="stable")
        now = fresh[order]
        count = np.bincount(symbol, minlength=256)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        present = np.flatnonzero(count)
        after_new = np.empty(size, bool)
        after_new[1:] = now[:-1]
        after_new[begin[present]] = was_new[present]
        if count[NONE]:
            after_new[begin[NONE] :] = False
        needed = np.flatnonzero(now | after_new)
        place = order[needed]
        of = symbol[place]
        first = needed == begin[of]
        before = order[needed - 1] + 1
        before[first] = 0
        last = order[(begin + count - 1)[present]]
        inner = last < size - 1
        # with the least prefix after each symbol's last place, for the next step
        least = _least(
            prefix, np.concatenate([before, last[inner] + 1]), np.concatenate([place, np.full(inner.sum(), size - 1)])
        ).astype(np.int64)
        value = least[: len(needed)] + 1
        carried = since[of[first]]
        value[first] = np.where(carried < 0, 0, np.minimum(value[first], carried + 1))
        value = np.minimum(value, MOST)
        rank = seen[of] + needed - begin[of]
        new = now[needed]
        to = np.searchsorted(newest, place[new] + at)
        places[to], prefixes[to], symbols[to] = rank[new], value[new], of[new]
        changed.append((of[~new].astype(np.int64), rank[~new], value[~new]))
        since = np.where(since < 0, since, np.minimum(since, int(prefix.min())))
        since[present] = MOST + 1
        since[present[inner]] = least[len(needed) :]
        was_new[present] = fresh[last]
        seen += count
        done = stop
    seen[NONE] = 0
    base = np.concatenate([[0], np.cumsum(seen)[:-1]])
    moved = [np.concatenate(x) for x in zip(*changed)]
    return base[symbols] + places, prefixes, base[moved[0]] + moved[1], moved[2]


def build(strings: list[bytes]) -> tuple[_Column, _Column, int]:
    """The transform, the common prefixes and their number. The list begins with
    one empty suffix for each string."""
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(strings), np.uint8)

    def before(which: np.ndarray, length: int) -> np.ndarray:
        """The symbol before the suffix of that length."""
        out = np.full(len(which), NONE, np.uint8)
        some = sizes[which] > length
        out[some] = data[ends[which[some]] - length - 1]
        return out

    files = _columns()
    for file, values in zip(files, (before(np.arange(m), 0), np.zeros(m, np.uint8))):
        file.add(values)
    n, length = m, 0
    active = np.flatnonzero(sizes > 0)
    newest = active.copy()  # places, rising
    while len(active):
        for file in files:
            file.rewind()
        places, prefixes, moved, values = _scan(files, n, newest)
        places, moved = places + m, moved + m  # after the empty suffixes
        length += 1
        order = np.argsort(places, kind="stable")
        places, prefixes, who = places[order], prefixes[order], active[order]
        turn = np.argsort(moved, kind="stable")
        moved, values = moved[turn], values[turn]
        put = (before(who, length), prefixes.astype(np.uint8))
        for file in files:
            file.rewind()
        total, fresh = n + len(places), _columns()
        for at in range(0, total, STEP):
            size = min(STEP, total - at)
            a, b = np.searchsorted(places, (at, at + size))
            c, d = np.searchsorted(moved, (at, at + size))
            new = np.zeros(size, bool)
            new[places[a:b] - at] = True
            for k, file in enumerate(files):
                column = np.empty(size, file.kind)
                column[~new] = file.next(size - (b - a))
                column[new] = put[k][a:b]
                if k == 1:
                    column[moved[c:d] - at] = values[c:d]
                fresh[k].add(column)
        for file in files:
            file.close()
        files, n = fresh, total
        on = sizes[who] > length
        active, newest = who[on], places[on]
    for file in files:
        file.rewind()
    return *files, n


def suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(place, prefix)`` of all suffixes of one symbol or more, in order: where
    in the strings' concatenation one begins, and the length of the prefix it
    shares with the one before it. The places come from walking the finished
    transform back from every string's end at once."""
    m = len(strings)
    symbols, prefixes, n = build(strings)
    symbol, prefix = symbols.next(n), prefixes.next(n)
    symbols.close()
    prefixes.close()
    before = np.empty(n, np.int64)
    order = np.argsort(symbol, kind="stable")
    before[order] = np.arange(m, n + m)  # where the suffix longer by its symbol stands
    sizes = np.fromiter(map(len, strings), np.int64, m)
    ends = np.cumsum(sizes)
    place = np.empty(n, np.int64)
    who, at = np.flatnonzero(sizes > 0), np.flatnonzero(sizes > 0)
    for length in range(1, int(sizes.max(initial=0)) + 1):
        at = before[at]
        place[at] = ends[who] - length
        on = sizes[who] > length
        who, at = who[on], at[on]
    return place[m:], prefix[m:]


def _hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A hash of the ``window`` bytes at each place that has as many; equal bytes have
    equal hashes."""
    power = np.full(len(data), _BASE)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(data), pow(int(_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power)])
    return (total[window:] - total[:-window]) * back[: len(data) - window + 1]


def met(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first, count)`` for each string: the windows from the first to the last whose
    hash occurs again in the collection; others hold bytes that no other window has."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = np.maximum(sizes - window + 1, 0)
    begins = np.cumsum(sizes) - sizes
    first, count = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    if not counts.any():
        return first, count
    owner = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = _hashes(np.frombuffer(b"".join(strings), np.uint8), window)[begins[owner] + at]
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(owner), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    owner, at = owner[again], at[again]
    edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    own = owner[edge[:-1]]
    first[own] = at[edge[:-1]]
    count[own] = at[edge[1:] - 1] - first[own] + 1
    return first, count


def window_minima(strings: list[bytes], marks: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string and each of its windows, the least mark of the strings
    that hold the same bytes as a window. The collection that is built has, of each
    string, only the part whose windows may be in others, and equal parts once."""
    first, count = met(strings, window)
    some = np.flatnonzero(count)
    parts = [strings[i][f : f + n + window - 1] for i, f, n in zip(some.tolist(), first[some].tolist(), count[some].tolist())]
    names = {x: k for k, x in enumerate(sorted(set(parts)))}
    which = np.fromiter((names[x] for x in parts), np.int64, len(parts))
    least = np.full(len(names), np.iinfo(marks.dtype).max, marks.dtype)
    np.minimum.at(least, which, marks[some])
    found = _built_minima(list(names), least, window)
    counts = np.maximum(np.fromiter(map(len, strings), np.int64, len(strings)) - window + 1, 0)
    out = np.split(np.repeat(marks, counts), np.cumsum(counts)[:-1]) if len(strings) else []
    for i, f, n, k in zip(some.tolist(), first[some].tolist(), count[some].tolist(), which.tolist()):
        out[i][f : f + n] = found[k]
    return out


def _built_minima(strings: list[bytes], marks: np.ndarray, window: int) -> list[np.ndarray]:
    """``window_minima`` of the whole strings, from the collection's sorted suffixes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = np.maximum(sizes - window + 1, 0)
    shift = np.cumsum(sizes - counts) - (sizes - counts)  # places before a string that begin no window
    owner, ends = np.repeat(np.arange(len(strings)), sizes), np.cumsum(sizes)
    out = np.zeros(int(counts.sum()), marks.dtype)
    if len(out):
        place, prefix = suffixes(strings)
        run = np.cumsum(prefix < window)
        whole = place + window <= ends[owner[place]]
        run, place = run[whole], place[whole]
        own = owner[place]
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        least = np.minimum.reduceat(marks[own], begin)
        out[place - shift[own]] = np.repeat(least, np.diff(begin, append=len(run)))
    return np.split(out, np.cumsum(counts)[:-1]) if len(strings) else []
