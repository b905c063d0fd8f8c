"""Runs of words that repeat with a period, found on a grammar of each text.

The word ids of a text are compressed by Re-Pair: the most frequent pair of neighbouring symbols becomes a new symbol, again and
again, until no pair occurs twice; what is left is paired up into a tree. A run lies whole inside the lowest symbol that
contains it and crosses the border of that symbol's two parts. So each symbol is looked at once, for the runs that cross
its border; runs are then carried to all places where symbols occur, and pieces of one run are merged. A batch of
documents is compressed side by side; their symbols never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import small_batches

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
NONE = 1 << 60


class Grammar:
    """Rules of two symbols over terminals; ``first`` is a place where a symbol's words stand."""

    def __init__(self, n_terminals: int) -> None:
        self.terminals, self.made, self.parts = n_terminals, n_terminals, []

    def add(self, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        """New symbols for the given pairs, a generation of their own."""
        self.parts.append((left, right, first))
        self.made += len(left)
        return np.arange(self.made - len(left), self.made)

    def close(self) -> None:
        self.bounds = np.cumsum([self.terminals, *(len(p[0]) for p in self.parts)])
        empty = np.zeros(0, np.int64)
        self.left, self.right, self.first = (np.concatenate([empty, *(p[k] for p in self.parts)]) for k in range(3))
        self.size = np.ones(self.made, np.int64)
        for lo, hi in zip(self.bounds, self.bounds[1:]):
            rules = slice(lo - self.terminals, hi - self.terminals)
            self.size[lo:hi] = self.size[self.left[rules]] + self.size[self.right[rules]]


def re_pair(symbols: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """What is left of a sequence when no pair occurs twice, and the place of each symbol left.

    In a round the most frequent pair goes and, with it, every pair that is more frequent than those it overlaps; among
    equally frequent pairs the one of smaller symbols counts as more frequent. Pairs that occur once stay so, unless
    one of their symbols changes, and are looked at only then.
    """
    seq, place = symbols.astype(np.int64), np.arange(len(symbols), dtype=np.int64)
    active = np.ones(len(seq), bool)  # of the pair that starts here
    while len(seq) > 1:
        active[-1] = False
        at = np.flatnonzero(active)
        if len(at) == 0:
            break
        key = seq[at] * grammar.made + seq[at + 1]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new_key = np.append(True, key[1:] != key[:-1])
        # of a stretch a a a ... every second pair counts
        stretch = new_key | np.append(True, at[1:] != at[:-1] + 1)
        rank_in = np.arange(len(at))
        even = (rank_in - np.maximum.accumulate(np.where(stretch, rank_in, 0))) % 2 == 0
        group = np.cumsum(new_key) - 1
        count = np.bincount(group[even], minlength=group[-1] + 1)
        active[at[count[group] < 2]] = False
        if not (count >= 2).any():
            break
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
        rank[count < 2] = NONE
        ranks = np.full(len(seq) + 1, NONE)
        ranks[at] = rank[group]
        here = ranks[at]
        chosen = even & (here < NONE) & (here <= ranks[at + 1]) & (here <= ranks[at - 1])  # ranks[-1] is NONE
        group = np.where(chosen, group, -1)
        used = np.bincount(group[chosen], minlength=len(count))
        chosen &= used[group] >= 2
        at, group = at[chosen], group[chosen]
        numbers, lowest, back = np.unique(group, return_index=True, return_inverse=True)
        firsts = at[lowest]
        made = grammar.add(seq[firsts], seq[firsts + 1], place[firsts])
        seq[at] = made[back]
        active[at] = True
        active[at - 1] = True  # before the first place this is the last one, which starts no pair
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, place, active = seq[keep], place[keep], active[keep]
    return seq, place


def pair_up(seq: np.ndarray, place: np.ndarray, owner: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """One symbol an owner, by pairing neighbours level by level; the symbols and their owners."""
    while True:
        start = np.append(True, owner[1:] != owner[:-1]) if len(seq) else np.zeros(0, bool)
        if start.all():
            return seq, owner
        rank = np.arange(len(seq))
        even = (rank - np.maximum.accumulate(np.where(start, rank, 0))) % 2 == 0
        at = np.flatnonzero(even[:-1] & ~start[1:])
        seq[at] = grammar.add(seq[at], seq[at + 1], place[at])
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, place, owner = seq[keep], place[keep], owner[keep]


def _agree(words: np.ndarray, at: int, period: int, stop: int, step: int) -> int:
    """The place, ``stop`` at most, up to which words equal those one period on, from ``at`` in one direction."""
    reach = 16
    while at != stop:
        end = min(at + reach, stop) if step > 0 else max(at - reach, stop)
        lo, hi = (at, end) if step > 0 else (end + 1, at + 1)
        wrong = np.flatnonzero(words[lo:hi] != words[lo + period:hi + period])
        if len(wrong):
            return int(lo + (wrong[0] if step > 0 else wrong[-1]))
        at, reach = end, reach * 2
    return stop


def crossing(words: np.ndarray, start: int, border: int, end: int, pair_places: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) inside ``words[start:end]`` with words on both sides of ``border``.

    ``pair_places`` are all places in there of the two words at the border. A run repeats them one period before or after.
    Candidates that fail at a few places further on are dropped together, multiples of a period found are no
    smallest periods, and what is left is compared word by word.
    """
    x = border - 1
    period = np.abs(pair_places - x)
    seed = np.minimum(pair_places, x)
    able = (period > 0) & (LEAST_TIMES * period <= end - start)
    period, seed = period[able], seed[able]
    after, before = np.ones(len(period), bool), np.ones(len(period), bool)
    for step in (period // 2, period, period * 3 // 2):  # whichever way, half of the agreement lies there
        ahead, behind = seed + step, seed - step
        inside = ahead + period < end
        after &= inside & (words[np.where(inside, ahead, start)] == words[np.where(inside, ahead + period, start)])
        inside = behind >= start
        before &= inside & (words[np.where(inside, behind, start)] == words[np.where(inside, behind + period, start)])
    able = after | before
    period, seed = period[able], seed[able]
    order = np.lexsort((seed, period))
    period, seed = period[order], seed[order]
    found: list[tuple[int, int, int]] = []
    while len(period):
        q, at = int(period[0]), int(seed[0])
        last = _agree(words, at, q, end - q, 1) + q
        first = _agree(words, at, q, start - 1, -1) + 1
        rest = slice(1, None)
        period, seed = period[rest], seed[rest]
        if last - first >= max(LEAST_WORDS, LEAST_TIMES * q):
            found.append((first, last, q))
            other = (period % q != 0) | (seed < first) | (seed + period >= last)
            period, seed = period[other], seed[other]
    return found


def merged(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces of one period that share a period's length are one run."""
    out: list[tuple[int, int, int]] = []
    for start, end, period in sorted(runs, key=lambda r: (r[2], r[0], -r[1])):
        if out and out[-1][2] == period and start <= out[-1][1] - period:
            out[-1] = (out[-1][0], max(end, out[-1][1]), period)
        else:
            out.append((start, end, period))
    return out


def find_all(words: np.ndarray, owner: np.ndarray, n_words: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, end, period) of every owner that has any, as places in ``words``.

    ``words`` are numbers under ``n_words``, no number with two owners; an owner's words stand together.
    """
    grammar = Grammar(n_words)
    seq, place = re_pair(words, grammar)
    roots, owners = pair_up(seq, place, owner[place] if len(place) else owner, grammar)
    grammar.close()
    if grammar.made == grammar.terminals:
        return {}
    start, border = grammar.first, grammar.first + grammar.size[grammar.left]
    end = start + grammar.size[grammar.terminals:]
    # the two words at a border occur three times in a run
    key = words[:-1].astype(np.int64) * n_words + words[1:]
    places = np.argsort(key, kind="stable")
    in_order = key[places]
    rank = np.empty(len(key), np.int64)
    rank[places] = np.arange(len(key))

    def inside(ranks: np.ndarray, rules: np.ndarray) -> np.ndarray:
        known = (ranks >= 0) & (ranks < len(key))
        ranks = np.where(known, ranks, 0)
        return known & (in_order[ranks] == key[border[rules] - 1]) & (places[ranks] >= start[rules]) & (places[ranks] < end[rules] - 1)

    rules = np.flatnonzero(end - start >= LEAST_WORDS)
    at = rank[border[rules] - 1]
    near = {step: inside(at + step, rules) for step in (-2, -1, 1, 2)}
    rules = rules[near[-2] | (near[-1] & near[1]) | near[2]]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for rule in rules.tolist():
        a, b, c = int(start[rule]), int(end[rule]), int(border[rule])
        pair = key[c - 1]
        lo, hi = np.searchsorted(in_order, pair), np.searchsorted(in_order, pair, "right")
        same = places[lo:hi]
        same = same[np.searchsorted(same, a):np.searchsorted(same, b - 1)]
        runs = crossing(words, a, c, b, same)
        if runs:
            found[grammar.terminals + rule] = [(s - a, e - a, q) for s, e, q in runs]
    if not found:
        return {}
    has = np.zeros(grammar.made, bool)
    has[list(found)] = True
    for lo, hi in zip(grammar.bounds, grammar.bounds[1:]):
        part = slice(lo - grammar.terminals, hi - grammar.terminals)
        has[lo:hi] |= has[grammar.left[part]] | has[grammar.right[part]]
    inner: dict[int, list[tuple[int, int, int]]] = {}
    for symbol in np.flatnonzero(has).tolist():
        left, right = int(grammar.left[symbol - grammar.terminals]), int(grammar.right[symbol - grammar.terminals])
        shift = int(grammar.size[left])
        inner[symbol] = merged([
            *found.get(symbol, ()), *inner.get(left, ()), *((s + shift, e + shift, q) for s, e, q in inner.get(right, ())),
        ])
    out = {}
    for root, who in zip(roots.tolist(), owners.tolist()):
        if root in inner:
            a = int(start[root - grammar.terminals])
            out[who] = [(s + a, e + a, q) for s, e, q in inner[root]]
    return out


def runs_of_texts(texts: list[str]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period) by start and period."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at the six white characters of ASCII
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(split)), sizes)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64, len(owner))
    _, words = np.unique(owner * max(1, len(numbers)) + ids, return_inverse=True)
    found = find_all(words, owner, int(words.max(initial=-1)) + 1)
    starts = (np.cumsum(sizes) - sizes).tolist()
    return [
        (ws, sorted(((s - at, e - s, q) for s, e, q in found.get(i, ())), key=lambda r: (r[0], r[2])))
        for i, (ws, at) in enumerate(zip(split, starts))
    ]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One struct column ``row`` with the ``carry`` columns, and ``n_words``, ``runs``, ``collapsed``.

    ``runs`` are (start, length, period), sorted by start and period: maximal stretches of at least 6 words and 4 times
    their smallest period. ``collapsed`` keeps of each run the first period. Words are what lies between ASCII white space.
    A null, empty or white text has no words, no runs and an empty ``collapsed``. Rows stay as they are and where
    they are: repeated or null keys change nothing, names cannot clash, an empty table gives no rows. Texts are read whole;
    a very long one is a batch of its own. Overlapping runs of different periods are all given, so ties do not arise.
    """
    rows = docs.select(F.struct(*(F.col(n) for n in carry)).alias("row"), F.col(text).alias("body"))
    kind = rows.schema["row"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "body"):
            found = runs_of_texts([t or "" for t in batch.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([len(w) for w, _ in found], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs in found], run_type),
                pa.array([collapse(w, runs).decode("utf-8", "surrogatepass") for w, runs in found], pa.string()),
            ], ["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"row {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
