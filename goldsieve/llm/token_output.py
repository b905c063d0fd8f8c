"""Token ids in compact files: canonical length-limited Huffman codes from global counts.

A folder holds two Parquet tables. ``code`` has a code length for each id, from which codes follow; ``blocks`` has
independent blocks of whole documents in ascending key order: the bits of their ids, and the bit offset of every
``STEP``-th id. A reader needs one block and the code: all stretches between checkpoints are decoded side by side, each
step by one look into a table of prefixes.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldsieve.llm.common import partitions, small_batches, spans, stored, with_small_batches

#: Ids between checkpoints, ids in a block (a longer document makes a longer block), longest code in bits.
STEP, BLOCK, LIMIT = 256, 1 << 16, 20
#: Words a worker remembers before it forgets those it met least.
REMEMBERED = 500_000


# --- ids by the tokenizers library -----------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts for a vocabulary whose pieces never reach over white space: every new word is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.opening = os.path.commonprefix(specials).encode()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocabulary.values()) + 1 + len(specials), bool)
        self.closing[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.numbers, self.flat = defaultdict(count().__next__), np.zeros(0, np.int32)
        self.offsets, self.lengths, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep words that were met more than once, or more often, so that half of the room is free."""
        least = 2
        while np.count_nonzero(self.uses >= least) > REMEMBERED // 2:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        words = list(self.numbers)
        self.numbers = defaultdict(count(len(kept)).__next__, {words[at]: i for i, at in enumerate(kept.tolist())})
        self.flat = self.flat[spans(self.offsets[kept], self.lengths[kept])]
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids per word)."""
        flat, sizes = [], []
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            encoded = self.library.encode_batch_fast(part, add_special_tokens=False)
            lists = [e.ids for e in encoded]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
        return np.concatenate(flat or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: each is one piece, so many are encoded as one text and told apart by the ids
        that end a word."""
        flat, sizes = [], []
        for at in range(0, len(words), 2000):
            part = words[at:at + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            lengths = np.diff(np.flatnonzero(self.closing[ids]) + 1, prepend=0)
            if len(lengths) != len(part) or int(lengths.sum()) != len(ids):  # letters to Python but not to the library
                ids, lengths = self._pieces(part)
            flat.append(ids)
            sizes.append(lengths)
        return np.concatenate(flat or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _add(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words and put their ids at the end of ``flat``; (offsets, lengths)."""
        texts = [w.decode("utf-8") for w in words]
        simple = np.fromiter((t.isalpha() and "\u0130" not in t for t in texts), bool, len(texts))  # whose small letter is two signs
        offsets, lengths = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for chosen, encode in ((simple, self._letters), (~simple, self._pieces)):
            ids, sizes = encode([texts[i] for i in np.flatnonzero(chosen).tolist()])
            lengths[chosen] = sizes
            offsets[chosen] = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.append(self.flat, ids)
        return offsets, lengths

    def _learn(self) -> None:
        """Encode words that came in since. Stops and commas after a letter or digit are a piece of their own, so only
        what is before them needs the library, and that only if it is not known yet."""
        known = len(self.offsets)
        words = list(self.numbers)[known:]
        if not words:
            return
        bases = {i: b for i, w in enumerate(words) if w[-1:] in b".," and (b := w.rstrip(b".,"))[-1:].isalnum()}
        whole = [i for i in range(len(words)) if i not in bases] if bases else range(len(words))
        number = self.numbers.get
        further = list(dict.fromkeys(b for b in bases.values() if number(b) is None))
        tails = list(dict.fromkeys(words[i][len(b):] for i, b in bases.items()))
        at, size = self._add([*(words[i] for i in whole), *further, *tails])
        offsets, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n = len(whole)
        offsets[list(whole)], lengths[list(whole)] = at[:n], size[:n]
        if bases:
            place = {b: len(self.offsets) + len(words) + i for i, b in enumerate(further)}
            all_at = np.concatenate([self.offsets, offsets, at[n:n + len(further)]])
            all_size = np.concatenate([self.lengths, lengths, size[n:n + len(further)]])
            tail_at = {t: n + len(further) + i for i, t in enumerate(tails)}
            base = np.array([place[b] if b in place else number(b) for b in bases.values()], np.int64)
            tail = np.array([tail_at[words[i][len(b):]] for i, b in bases.items()], np.int64)
            joined = self.flat[spans(np.stack([all_at[base], at[tail]], axis=1).ravel(), np.stack([all_size[base], size[tail]], axis=1).ravel())]
            own, both = np.array(list(bases), np.int64), all_size[base] + size[tail]
            offsets[own], lengths[own] = len(self.flat) + np.cumsum(both) - both, both
            self.flat = np.append(self.flat, joined)
        self.offsets, self.lengths = np.append(self.offsets, offsets), np.append(self.lengths, lengths)
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each closed by ``end_id``; ids per text)."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        numbers, ends = [], []
        for text in texts:
            data = (text or "").encode("utf-8")
            words = (data if self.opening in data else data.lower()).split()
            numbers.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            ends.append(len(words))
        self._learn()
        words = np.concatenate(numbers)
        self.uses += np.bincount(words, minlength=len(self.uses))
        lengths = self.lengths[words]
        ids = self.flat[spans(self.offsets[words], lengths)]
        bounds = np.append(0, np.cumsum(lengths))
        sizes = np.diff(bounds[np.append(0, np.cumsum(ends))])
        return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def id_type(tokenizer: str, end_id: int) -> str:
    """The narrowest of two little-endian unsigned types that holds all ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, kind: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, n, ids``: ids of ``kind`` with the end id."""
    width = np.dtype(kind).itemsize
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids, sizes = encoder(tokenizer).encode(batch.column("text").to_pylist(), end_id)
            offsets = pa.py_buffer(np.append(0, np.cumsum(sizes * width)).astype("<i4"))
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), packed], ["id", "n", "ids"])

    return with_small_batches(rows).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n bigint, ids binary")


def batch_ids(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    """The ids of all rows of a batch, one after the other."""
    return np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind).astype(np.int64)


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in the whole table; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, np.int64)
        for batch in batches:
            for part in small_batches([batch], "ids"):
                counts = np.bincount(batch_ids(part, kind), minlength=len(totals))
                counts[: len(totals)] += totals
                totals = counts
        ids = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals[ids], pa.int64())], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.collect()}


# --- the code --------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    rows, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(rows) // 2 * 2
        both = np.concatenate([leaves, rows[0:even:2] + rows[1:even:2]])
        place = np.argsort(both, kind="stable")
        rows = both[place]
        kinds.append(place < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, then smaller ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.sizes = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.depth = int(self.sizes.max()) if len(ids) else 1
        shares = np.int64(1) << (self.depth - self.sizes)
        self.codes = (np.cumsum(shares) - shares) >> (self.depth - self.sizes)
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.size_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.size_of[self.ids] = self.codes, self.sizes

    @property
    def table(self) -> np.ndarray:
        """For every prefix of ``depth`` bits the id (above) and the code's size (lowest 5 bits)."""
        entries = np.repeat(self.ids << 5 | self.sizes, np.int64(1) << (self.depth - self.sizes))
        return np.concatenate([entries, np.zeros((1 << self.depth) - len(entries), np.int64)]).astype(np.uint32)


def pack(ids: np.ndarray, sizes: np.ndarray, code: Code) -> tuple[list[bytes], list[bytes]]:
    """For documents of ``sizes`` ids: their bits, from a whole byte on, and their checkpoints as 64-bit numbers."""
    bits = code.size_of[ids]
    ends = np.append(0, np.cumsum(bits))
    first = np.append(0, np.cumsum(sizes))
    own = ends[first[1:]] - ends[first[:-1]]
    room = (own + 7) // 8
    base = np.cumsum(room) - room
    start = ends[:-1] + np.repeat(base * 8 - ends[first[:-1]], sizes)
    word, shift = start >> 5, (start & 31)
    value = code.code_of[ids] << (64 - shift - bits).astype(np.uint64)
    out = np.zeros(int(room.sum()) // 4 + 3, np.uint32)
    if len(ids):
        cuts = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        at = word[cuts]
        out[at] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), cuts)
        out[at + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)
    data = out.astype(">u4").tobytes()
    place = np.arange(len(ids)) - np.repeat(first[:-1], sizes)
    every = np.flatnonzero(place % STEP == 0)
    marks = start[every] - np.repeat(base * 8, -(-sizes // STEP))
    mark_ends = np.cumsum(-(-sizes // STEP))
    offsets = [m.astype("<u8").tobytes() for m in np.split(marks, mark_ends[:-1])] if len(sizes) else []
    return [data[b:b + r] for b, r in zip(base.tolist(), room.tolist())], offsets


def unpack(payload: bytes, marks: np.ndarray, lengths: np.ndarray, table: np.ndarray, depth: int) -> np.ndarray:
    """The ids of stretches that begin at ``marks`` (bits) and hold ``lengths`` ids, in order; all stretches step together."""
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    order = np.argsort(-lengths, kind="stable")
    at, target = marks[order].astype(np.int64), (np.cumsum(lengths) - lengths)[order]
    live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max()) if len(lengths) else 0), side="right")
    out, cut = np.zeros(int(lengths.sum()), np.uint32), np.uint32(32 - depth)
    for step, n in enumerate(live.tolist()):
        here = at[:n]
        entry = table[words[here >> 3] << (here & 7).astype(np.uint32) >> cut]
        out[target[:n] + step] = entry >> 5
        here += entry & 31
    return out


# --- files -----------------------------------------------------------------------------------------------------


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id", limit: int = LIMIT,
) -> None:
    """Encode whole texts and write them to ``folder`` in ascending key order, null keys first.

    A null text counts as empty and holds the end id alone. Rows with equal keys are written one after the other, by
    their bits. Only ``text`` and ``key`` are read. An empty table writes a code and no blocks.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer, end_id)
    tokens = stored(tokenized(docs, tokenizer, end_id, kind, text, key), "tokens")
    counts = id_counts(tokens, kind)
    ids = np.array(sorted(counts), np.int64)
    lengths = code_lengths(np.array([counts[i] for i in ids.tolist()], np.int64), limit)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id bigint, bits bigint").coalesce(1).write.parquet(f"{folder}/code")
    key_type = dict(tokens.dtypes)["id"]
    # Plain ids are dealt out, as finding the ranges reads the rows once more.
    ranged = tokens.withColumn("salt", F.xxhash64("ids")).repartitionByRange(partitions(spark), "id", "salt").withColumn("part", F.spark_partition_id())
    ordered = ranged.sortWithinPartitions("id", "salt", "ids").select("part", "id", "n", "ids")
    ordered.mapInArrow(
        block_writer(Code(ids, lengths), kind), f"part int, block int, ids array<{key_type}>, sizes array<bigint>, total bigint, bits binary, marks binary"
    ).write.parquet(f"{folder}/blocks", compression="uncompressed")


def block_writer(code: Code, kind: str):
    """Consecutive documents of a partition in blocks of at least ``BLOCK`` ids."""

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        bits, marks = pack(batch_ids(rows, kind), rows.column("n").to_numpy(), code)
        at = np.cumsum([0, *map(len, bits)]) * 8
        moved = np.concatenate([np.frombuffer(m, "<u8") + np.uint64(a) for m, a in zip(marks, at.tolist())])
        sizes = rows.column("n")
        return pa.RecordBatch.from_pydict({
            "part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "block": pa.array([number], pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), rows.column("id")),
            "sizes": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), sizes),
            "total": pa.array([int(pa.compute.sum(sizes).as_py())], pa.int64()), "bits": pa.array([b"".join(bits)], pa.binary()),
            "marks": pa.array([moved.astype("<u8").tobytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        number = held = 0
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            start = 0
            while start < batch.num_rows:
                reach = held + np.cumsum(sizes[start:])
                end = start + int(np.searchsorted(reach, BLOCK)) + 1  # up to the document that fills the block
                parts.append(batch.slice(start, end - start))
                held = int(reach[min(end, batch.num_rows) - start - 1])
                if held >= BLOCK:
                    yield block(number, parts)
                    parts, held, number = [], 0, number + 1
                start = end
        if parts:
            yield block(number, parts)

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, n_tokens, ids`` of every document: ``start`` counts the ids of all documents before it."""
    listed = spark.read.parquet(f"{folder}/code").collect()
    code = Code(np.array([r.id for r in listed], np.int64), np.array([r.bits for r in listed], np.int64))
    table, depth = code.table, code.depth
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts, base, bases = blocks.groupBy("part").agg(F.sum("total").alias("n")).collect(), 0, []
    for r in sorted(parts, key=lambda r: r.part):  # one row for each part of the files
        bases.append((r.part, base))
        base += r.n
    first = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("part", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("in_part"))
    placed = blocks.join(before, ["part", "block"]).join(first, "part").select(
        (F.col("base") + F.col("in_part")).alias("start"), "ids", "sizes", "bits", "marks"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches([batch], "bits", 1 << 20):
                yield from decode_blocks(part, table, depth)

    kind = dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return placed.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids binary")


def decode_blocks(batch: pa.RecordBatch, table: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """Documents of the blocks in a batch; all stretches of all of them are decoded side by side."""
    payloads = batch.column("bits").to_pylist()
    shift = np.cumsum([0, *map(len, payloads)]) * 8
    marks = np.concatenate([np.frombuffer(m, "<u8").astype(np.int64) + s for m, s in zip(batch.column("marks").to_pylist(), shift.tolist())])
    lists, keys = batch.column("sizes"), batch.column("ids")
    sizes, per_block = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    stretches = -(-sizes // STEP)
    lengths = np.full(int(stretches.sum()), STEP, np.int64)
    lengths[np.cumsum(stretches) - 1] = sizes - (stretches - 1) * STEP
    ids = unpack(b"".join(payloads), marks, lengths, table, depth)
    ends = np.cumsum(sizes)
    block_first = np.cumsum(per_block) - per_block
    starts = ends - sizes - np.repeat((ends - sizes)[block_first], per_block) + np.repeat(batch.column("start").to_numpy(), per_block)
    flat = keys.flatten()
    for at in range(0, len(sizes), 4096):
        n = slice(at, at + 4096)
        values = pa.array([ids[e - s:e].astype("<u4").tobytes() for s, e in zip(sizes[n].tolist(), ends[n].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [flat.slice(at, len(values)), pa.array(starts[n], pa.int64()), pa.array(sizes[n], pa.int64()), values], ["id", "start", "n_tokens", "ids"]
        )
