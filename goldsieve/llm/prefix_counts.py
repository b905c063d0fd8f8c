"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokens of a prefix are those of a shorter prefix and one last token. A token may follow another when byte-pair
merging of both together gives back just these two; exactly one token that ends at a place passes that test. So one pass
over the bytes of a piece finds the last token and the count at each of its prefixes. Counts are stored as
differences, one byte a character, and answer questions about truncation and budgets without the tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.bpe import PATTERN, Vocabulary, vocabulary
from goldsieve.llm.common import small_batches

#: Chunks of text whose differences a worker remembers; beyond them the memory is emptied.
REMEMBERED = 150_000
#: Pieces of like length that are worked on side by side.
PIECES = 50_000
#: Characters of the longest chunk that is remembered.
LONGEST_REMEMBERED = 64
#: Bytes of a piece up to which pieces go side by side, and bytes of a longer one that are looked up together.
SHORT, WINDOW = 256, 1 << 16
NEVER = 1 << 60


class Borders:
    """Whether one token may follow another, for many pairs at once."""

    #: Slots of the table of pairs already judged; a new pair takes the place of an older one.
    SLOTS = 1 << 20

    def __init__(self, vocab: Vocabulary) -> None:
        if len(np.unique(vocab.merged)) < len(vocab.merged):
            raise ValueError("a token is made by two merges")
        self.vocab = vocab
        self.made = np.full(len(vocab.lengths), -1, np.int64)  # the rank that makes a token
        self.made[vocab.merged] = np.arange(len(vocab.merged))
        self.seen, self.holds = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)
        self.left, self.right = vocab.left.tolist(), vocab.right.tolist()
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self.made_by = self.made.tolist()

    def judge(self, left: np.ndarray, right: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether no merge across the border comes before those that make ``left`` and ``right``.

        Goes back in time, taking the later made of the two symbols at the border apart. ``joined`` leaves out the merge
        of both whole tokens.
        """
        ok, at = np.ones(len(left), bool), np.arange(len(left))
        x, y = left, right
        x_taken = np.full(len(left), NEVER)
        y_taken = x_taken
        while len(at):
            rank = self.vocab.ranks(x, y)
            broken = (rank >= 0) & (rank < x_taken) & (rank <= y_taken)  # of equal ranks the leftmost place goes first
            if joined:
                broken[:] = joined = False
            ok[at[broken]] = False
            x_made, y_made = self.made[x], self.made[y]
            on = ~broken & ((x_made >= 0) | (y_made >= 0))
            at, x, y, x_taken, y_taken, x_made, y_made = (v[on] for v in (at, x, y, x_taken, y_taken, x_made, y_made))
            part = x_made > y_made
            x, x_taken = np.where(part, self.vocab.right[x_made], x), np.where(part, x_made, x_taken)
            y, y_taken = np.where(part, y, self.vocab.left[y_made]), np.where(part, y_taken, y_made)
        return ok

    def judge_one(self, x: int, y: int) -> bool:
        """As ``judge``, for one pair."""
        x_taken = y_taken = NEVER
        while True:
            rank = self.rank.get(x << 32 | y, NEVER)
            if rank < x_taken and rank <= y_taken:
                return False
            x_made, y_made = self.made_by[x], self.made_by[y]
            if x_made > y_made:
                x, x_taken = self.right[x_made], x_made
            elif y_made >= 0:
                y, y_taken = self.left[y_made], y_made
            else:
                return True

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = (key * 0x9E3779B97F4A7C1 >> 20) % self.SLOTS
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new) == 0:
            return self.holds[slot]
        fresh, back = np.unique(key[new], return_inverse=True)
        judged = self.judge(fresh >> 32, fresh & 0xFFFFFFFF)
        out = self.holds[slot]
        out[new] = judged[back]
        self.seen[slot[new]], self.holds[slot[new]] = key[new], out[new]  # of two new pairs of a slot the last stays
        return out


class PrefixCounter:
    """Differences of token counts between neighbouring prefixes of texts, in code points."""

    split = regex.compile(PATTERN)
    #: As a whole such a run is one piece at the end of a prefix; before other letters its last character stands apart.
    run = regex.compile(r"\s{2,}(?=\S)")
    #: Where cutting before every space could cut a run of white space in a wrong place.
    unsafe = regex.compile(r"\s (?:\s|$)")

    def __init__(self, vocab: Vocabulary) -> None:
        self.borders = Borders(vocab)
        self.special = sorted(vocab.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        reached = np.zeros(len(vocab.lengths), bool)  # others are never the tokens of any text
        reached[vocab.byte_ids] = True
        sound = self.borders.judge(vocab.left.astype(np.int64), vocab.right.astype(np.int64), joined=True)
        for token, left, right, ok in zip(vocab.merged.tolist(), vocab.left.tolist(), vocab.right.tolist(), sound.tolist()):
            reached[token] = ok and reached[left] and reached[right]
        step: dict[int, int] = {}  # node << 8 | byte before: node of a trie of reversed tokens
        token_at = [-1]
        for token in np.flatnonzero(reached).tolist():
            node = 0
            for byte in vocab.flat[vocab.offsets[token]:vocab.offsets[token] + vocab.lengths[token]][::-1].tolist():
                key = node << 8 | byte
                node = step.get(key, -1)
                if node < 0:
                    node = step[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = token
        self.longest = int(vocab.lengths.max())
        self.token_at = np.array(token_at, np.int64)
        keys = np.fromiter(step, np.int64, len(step))
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        tops = self.step_keys < 256  # steps from node 0; every byte is a token
        self.root = np.full(256, -1, np.int64)
        self.root[self.step_keys[tops]] = self.step_to[tops]
        self.known: dict[str, bytes | list[int]] = {}

    def _endings(self, letters: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token that ends at a byte inside its piece: the byte's place, the token's length, the token."""
        at = np.arange(len(letters))
        node, found, depth = self.root[letters], [(at[:0],) * 3], 1
        while len(at):
            token = self.token_at[node]
            ends = token >= 0
            found.append((at[ends], np.full(int(ends.sum()), depth), token[ends]))
            on = offset[at] > depth - 1
            at, node = at[on], node[on]
            key = node << 8 | letters[at - depth]
            where = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[where] == key
            at, node, depth = at[hit], self.step_to[where[hit]], depth + 1
        place, size, token = (np.concatenate(f) for f in zip(*found))
        return place, size, token

    def counts(self, letters: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Tokens of the prefix of its piece that ends with each byte; ``offset`` counts the bytes before it there."""
        if len(letters) == 0:
            return offset
        place, size, token = self._endings(letters, offset)
        order = np.lexsort((-size, place, offset[place]))  # by prefix length, then piece, the longest token first
        place, size, token = place[order], size[order], token[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # every place has its own byte at least
        level = offset[place[first]]
        cuts = np.searchsorted(level, np.arange(int(offset.max(initial=-1)) + 2))
        last, count = np.full(len(letters), -1, np.int64), np.zeros(len(letters), np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            at = first[lo:hi]
            while len(at):
                where, whole = place[at], size[at] == offset[place[at]] + 1
                before = where - size[at]
                fits = whole.copy()
                rest = np.flatnonzero(~whole)
                fits[rest] = self.borders.may_follow(last[before[rest]], token[at[rest]])
                good = at[fits]
                last[place[good]] = token[good]
                count[place[good]] = 1 + np.where(whole[fits], 0, count[before[fits]])
                at = at[~fits] + 1
        return count

    def long_counts(self, letters: np.ndarray) -> np.ndarray:
        """As ``counts`` for one long piece, byte after byte; only a window of it is looked up at a time."""
        last, count, judged = [-1], [0], {}
        for lo in range(0, len(letters), WINDOW):
            back = max(0, lo - self.longest)
            part = letters[back:lo + WINDOW]
            place, size, token = self._endings(part, np.arange(len(part)))
            order = np.lexsort((-size, place))
            order = order[place[order] >= lo - back]
            done = -1
            for end, size, token in zip((place[order] + back + 1).tolist(), size[order].tolist(), token[order].tolist()):
                if end == done:
                    continue
                before = last[end - size]
                if size == end:
                    fits = True
                elif (fits := judged.get(before << 32 | token)) is None:
                    fits = judged[before << 32 | token] = self.borders.judge_one(before, token)
                if fits:
                    done = end
                    last.append(token)
                    count.append(count[end - size] + 1)
        return np.array(count[1:], np.int64)

    def learn_pieces(self, pieces: set[str]) -> None:
        """Remembers the differences of pieces, those of like length side by side."""
        todo = sorted((p for p in pieces if p not in self.known), key=lambda p: len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")))
        for part in (todo[i:i + PIECES] for i in range(0, len(todo), PIECES)):
            bodies = [p.encode("utf-8", "surrogatepass") for p in part]
            short = next((i for i, b in enumerate(bodies) if len(b) > SHORT), len(bodies))  # few pieces are longer
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            letters = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64)
            offset = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside = letters & 0xC0 == 0x80
            ends = np.flatnonzero(np.append(~inside[1:], True))  # of characters; pieces begin with whole ones
            cut = int(sizes[:short].sum())
            parts = [self.counts(letters[:cut], offset[:cut]), *(self.long_counts(x) for x in np.split(letters[cut:], np.cumsum(sizes[short:])[:-1]) if len(x))]
            count = np.concatenate(parts)[ends]
            first = np.append(True, offset[ends[:-1] + 1] == 0)
            found = count - np.where(first, 0, np.append(0, count[:-1]))
            bounds = np.append(np.flatnonzero(first), len(found)).tolist()
            flat = _narrow(found)
            wide = None if flat.dtype == np.int8 else flat.tolist()
            flat = flat.tobytes()
            for piece, start, end in zip(part, bounds, bounds[1:]):
                self.known[piece] = flat[start:end] if wide is None else _pack(wide[start:end])
        for piece in ("'re", "'ve", "'ll"):  # the first two characters alone are two pieces
            if piece in pieces:
                self.known[piece] = _pack([1, 1, sum(_signed(self.known[piece])) - 2])

    def learn(self, texts: set[str]) -> None:
        """Remembers the differences of texts in which special tokens' strings are ordinary."""
        whole, split, pieces = [], {}, set()
        for text in texts:
            if text not in self.known:
                if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):
                    whole.append(text)
                    continue
                split[text] = found = self.split.findall(text), [m.span() for m in self.run.finditer(text)]
                pieces.update(found[0])
                for start, end in found[1]:
                    pieces.update((text[start:end], text[start:end - 1], text[end - 1]))
        pieces.update(whole)
        self.learn_pieces(pieces)
        known = self.known
        for text, (found, runs) in split.items():
            parts = [known[p] for p in found]
            if not runs and all(type(p) is bytes for p in parts):
                known[text] = b"".join(parts)
                continue
            out = [d for p in parts for d in _signed(p)]
            for start, end in runs:
                more = sum(_signed(known[text[start:end]])) - sum(_signed(known[text[start:end - 1]])) - sum(_signed(known[text[end - 1]]))
                out[end - 1] += more
                out[end] -= more
            known[text] = _pack(out)

    def differences(self, texts: list[str]) -> list[np.ndarray]:
        """Signed differences of the counts of whole texts, special tokens included."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self._cut(text) for text in texts]
        self.learn({chunk for chunks, _ in cut for chunk in chunks})
        found = [self._join(text, chunks, parts) for text, (chunks, parts) in zip(texts, cut)]
        for text in [k for k in self.known if len(k) > LONGEST_REMEMBERED]:
            del self.known[text]
        return found

    def _cut(self, text: str) -> tuple[list[str], list[str] | None]:
        """Chunks of a text that count by themselves; for a text with special tokens also what lies between them."""
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return [*(a + b[:-1] for a, b in zip(parts[::2], parts[1::2])), parts[-1]], parts
        if self.unsafe.search(text):
            return [text], None
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest], None

    def _join(self, text: str, chunks: list[str], parts: list[str] | None) -> np.ndarray:
        found = [self.known[c] for c in chunks]
        if parts is not None:  # at its last character a special token becomes one token
            out: list[int] = []
            for part, both in zip(parts[::2], found[:-1]):
                both = _signed(both)
                out += [*both, sum(both[:len(part)]) + 1 - sum(both)]
            return _narrow(np.array([*out, *_signed(found[-1])], np.int32))
        try:
            return np.frombuffer(b"".join(found), np.int8)
        except TypeError:  # a difference that no byte holds
            return _narrow(np.array([d for f in found for d in _signed(f)], np.int32))


def _signed(found: bytes | list[int]) -> list[int]:
    return found if isinstance(found, list) else np.frombuffer(found, np.int8).tolist()


def _pack(found: list[int]) -> bytes | list[int]:
    """Signed bytes where they fit."""
    small = _narrow(np.array(found, np.int64))
    return small.tobytes() if small.dtype == np.int8 else found


def _narrow(differences: np.ndarray) -> np.ndarray:
    fits = len(differences) == 0 or (differences.min() >= -128 and differences.max() < 128)
    return differences.astype(np.int8) if fits else differences.astype("<i4")


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(vocabulary(path))


def count_prefixes(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One struct column ``row`` with the ``carry`` columns, and ``n_bytes``, ``n_chars``, ``n_tokens``, ``prefix``.

    ``prefix`` holds, for every code point, by how much it changes the token count of the prefix that it ends: a signed
    byte each, or four little-endian bytes where one does not do. The count of a prefix is that of its text
    alone, special tokens included and nothing added. A null text counts as empty and has no differences. Rows stay
    as they are and where they are: repeated or null keys change nothing, names cannot clash, ties do not arise,
    and an empty table gives no rows. A very long text takes a task of its own for its length, whatever it holds.
    """
    rows = docs.select(F.struct(*(F.col(n) for n in carry)).alias("row"), F.col(text).alias("body"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in small_batches(batches, "body"):
            texts = [t or "" for t in batch.column("body").to_pylist()]
            found = count.differences(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(map(len, texts), pa.int64()), pa.array([int(f.sum(dtype=np.int64)) for f in found], pa.int64()),
                pa.array([f.tobytes() for f in found], pa.binary()),
            ], ["row", "n_bytes", "n_chars", "n_tokens", "prefix"])

    return rows.mapInArrow(run, f"row {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, prefix binary")


def prefix_array(prefix: bytes | None, n_chars: int) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... code points, from the stored differences."""
    kind = "<i4" if n_chars and len(prefix) == 4 * n_chars else np.int8
    return np.concatenate([[0], np.cumsum(np.frombuffer(prefix or b"", kind), dtype=np.int64)])


def _answers(counted: DataFrame, question: str, answer) -> DataFrame:
    asked = counted.select(F.struct("*").alias("all"), F.col("prefix").alias("p"), F.col("n_chars").alias("n"), F.expr(question).cast("bigint").alias("q"))
    kind = asked.schema["all"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "p"):
            found = [
                (None, None) if q is None else answer(prefix_array(p, n), q)
                for p, n, q in zip(batch.column("p").to_pylist(), batch.column("n").to_pylist(), batch.column("q").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("all"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
            ], ["all", "prefix_chars", "prefix_tokens"])

    return asked.mapInArrow(run, f"all {kind}, prefix_chars bigint, prefix_tokens bigint")


def tokens_at(counted: DataFrame, n_chars: str) -> DataFrame:
    """``prefix_tokens`` of the prefix whose length the SQL expression ``n_chars`` states, clipped to the text; all
    columns of ``counted`` come in the struct ``all``. A null length gives nulls."""
    return _answers(counted, n_chars, lambda counts, q: (k := min(max(q, 0), len(counts) - 1), int(counts[k])))


def longest_within(counted: DataFrame, budget: str) -> DataFrame:
    """The longest prefix whose own count is at most the SQL expression ``budget``: ``prefix_chars`` and ``prefix_tokens``.

    Counts can fall as a prefix grows, so the last place within the budget counts, not the first beyond it. A budget
    under 0 is met by nothing and gives nulls, as does a null budget.
    """
    def answer(counts: np.ndarray, most: int):
        within = np.flatnonzero(counts <= most)
        return (int(within[-1]), int(counts[within[-1]])) if len(within) else (None, None)

    return _answers(counted, budget, answer)
