"""Byte-level BPE over whole texts with a pair occurrence index.

A task gathers the distinct pieces of a stretch of its partition and lays their bytes out in one array. An index maps each
active rank (a pair that can merge) to all its positions. Ranks are applied in ascending order, every rank to all
of its positions at once, and the pairs on both sides of each merge enter the lists of their own ranks. Texts
are then put together from the encoded pieces.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import give_back, small_batches, spans, with_small_batches

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text a task encodes at a time.
STRETCH = 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next unused one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if (data.get("normalizer"), data["pre_tokenizer"]["type"], data["model"]["type"]) != (None, "ByteLevel", "BPE") or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        ids, letters = data["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        a = np.array([ids[m[0]] for m in merges], np.int64)
        b = np.array([ids[m[1]] for m in merges], np.int64)
        self.left, self.right = a.astype(np.int32), b.astype(np.int32)
        self.merged = np.array([ids[m[0] + m[1]] for m in merges], np.int32)
        made = {int(m): r for r, m in reversed(list(enumerate(self.merged)))}
        if any(made.get(int(x), -1) >= r for r, pair in enumerate(zip(a, b)) for x in pair):
            raise ValueError("a merge uses a token that a later merge makes; ranks must ascend")
        keys = a << 32 | b
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        byte_of = {c: i for i, c in enumerate(letters)}
        size = max([*ids.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in ids.items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            table[i] = token.encode()
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.lengths = np.fromiter(map(len, table), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(symbols: np.ndarray, word: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their words, for letters laid out word after word."""
    n = len(symbols)
    if n == 0:
        return symbols, word
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.append(word[1:] != word[:-1], True)
    after[ends] = -1
    before[np.flatnonzero(ends)[:-1] + 1] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}  # rank: positions of the left halves of its pair
    active: list[int] = []

    def enter(positions: np.ndarray) -> None:
        ranks = vocab.ranks(symbols[positions], symbols[after[positions]])
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
            if rank in index:
                index[rank].append(group)
            else:
                index[rank] = [group]
                heapq.heappush(active, rank)

    enter(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        follow = after[at]
        left, right = vocab.left[rank], vocab.right[rank]
        holds = alive[at] & (symbols[at] == left) & (follow >= 0) & (symbols[follow] == right)
        at, follow = at[holds], follow[holds]
        if left == right and len(at) > 1:  # of overlapping pairs the first, the third and so on
            at.sort()
            follow = after[at]
            first = np.append(True, follow[:-1] != at[1:])
            places = np.arange(len(at))
            odd = (places - np.maximum.accumulate(np.where(first, places, 0))) % 2 == 0
            at, follow = at[odd], follow[odd]
        if len(at) == 0:
            continue
        symbols[at] = vocab.merged[rank]
        alive[follow] = False
        beyond = after[follow]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        enter(np.unique(np.concatenate([at[inner], before[at][before[at] >= 0]])))
    return symbols[alive], word[alive]


class Stretch:
    """Texts of one stretch as numbers of chunks; chunks are encoded together at the end."""

    split = regex.compile(PATTERN)
    #: Where cutting before every space could cut a run of white space in a wrong place.
    unsafe = regex.compile(r"\s (?:\s|$)")

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.numbers, self.texts, self.size = vocab, defaultdict(count().__next__), [], 0
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def _chunks(self, text: str) -> list[str]:
        if self.unsafe.search(text):
            return self.split.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + w for w in rest]]

    def add(self, text: str) -> None:
        if self.specials is not None and any(s in text for s in self.vocab.special):
            chunks: list = []
            for part in self.specials.split(text):
                chunks += [(part,)] if part in self.vocab.special else self._chunks(part) if part else []
        else:
            chunks = self._chunks(text) if text else []
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
        self.size += len(text)

    def encode(self) -> list[np.ndarray]:
        """The ids of every text."""
        pieces: defaultdict[str, int] = defaultdict(count().__next__)
        piece_of, pieces_in = [], []
        for chunk in self.numbers:
            found = [chunk] if isinstance(chunk, tuple) else self.split.findall(chunk)
            piece_of += [pieces[p] for p in found]
            pieces_in.append(len(found))
        letters = [b"\0" if isinstance(p, tuple) else p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, letters), np.int64, len(letters))
        symbols = self.vocab.byte_ids[np.frombuffer(b"".join(letters), np.uint8)]
        ids, word = merge_all(symbols, np.repeat(np.arange(len(letters), dtype=np.int32), sizes), self.vocab)
        for at, piece in enumerate(pieces):
            if isinstance(piece, tuple):
                ids[np.searchsorted(word, at)] = self.vocab.special[piece[0]]
        piece_size = np.bincount(word, minlength=len(letters)).astype(np.int64)
        piece_at = np.cumsum(piece_size) - piece_size
        of, per = np.array(piece_of, np.int64), np.array(pieces_in, np.int64)
        flat = ids[spans(piece_at[of], piece_size[of])]
        bounds = np.append(0, np.cumsum(piece_size[of]))
        chunk_end = np.cumsum(per)
        chunk_at, chunk_size = bounds[chunk_end - per], bounds[chunk_end] - bounds[chunk_end - per]
        return [flat[spans(chunk_at[t], chunk_size[t])] for t in self.texts]


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> list[np.ndarray]:
    stretch = Stretch(vocab)
    for text in texts:
        stretch.add(text or "")
    return stretch.encode()


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return vocab.flat[spans(vocab.offsets[ids], vocab.lengths[ids])].tobytes().decode("utf-8", "replace")


def _schema(frame: DataFrame, names: list[str], more: str) -> str:
    kinds = dict(frame.dtypes)
    return ", ".join([*(f"`{n}` {kinds[n]}" for n in names), more])


def _encoded(docs: DataFrame, path: str, text: str, names: list[str], decode: bool) -> DataFrame:
    rows = docs.select(*(F.col(n) for n in names), F.col(text).alias("_text"))
    more = ["ids", "decoded"] if decode else ["ids"]

    def flush(waiting: list[pa.RecordBatch], stretch: Stretch, vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
        encoded, at = stretch.encode(), 0
        for batch in waiting:
            here = encoded[at:at + batch.num_rows]
            at += batch.num_rows
            columns = [pa.array([x.astype("<u4").tobytes() for x in here], pa.binary())]
            if decode:  # from the stored form, as a reader would
                read = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in columns[0])
                columns.append(pa.array([decode_ids(x, vocab) for x in read], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        give_back()  # what earlier tasks of this worker and the reading of the file have left
        waiting, stretch = [], Stretch(vocab)
        for batch in small_batches(batches, "_text"):
            for value in batch.column("_text").to_pylist():
                stretch.add(value or "")
            waiting.append(batch.select(names))
            if stretch.size >= STRETCH:
                yield from flush(waiting, stretch, vocab)
                waiting, stretch = [], Stretch(vocab)
        if waiting:
            yield from flush(waiting, stretch, vocab)
        del waiting, stretch
        give_back()

    return with_small_batches(rows).mapInArrow(run, _schema(rows, names, "ids binary, decoded string" if decode else "ids binary"))


def bpe_encode(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``ids``: little-endian unsigned 32-bit ids in one binary value.

    Whole texts are encoded, special tokens in a text included, and nothing is added. A null or empty text has no
    ids. Rows stay as they are and where they are: repeated or null keys change nothing, and an empty table gives no
    rows. ``path`` names a vocabulary file that every executor can open.
    """
    return _encoded(docs, path, text, list(carry), decode=False)


def bpe_encode_decode(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``bpe_encode``, with the text ``decoded`` from the ids beside them: one pass and one vocabulary a task for both."""
    return _encoded(docs, path, text, list(carry), decode=True)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The ``carry`` columns and ``text``, special tokens written out. Null ids give an empty text."""
    names = list(carry)
    rows = encoded.select(*(F.col(n) for n in names), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in small_batches(batches, "_ids"):
            texts = [decode_ids(np.frombuffer(x or b"", "<u4").astype(np.int64), vocab) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return with_small_batches(rows).mapInArrow(run, _schema(rows, names, "text string"))
