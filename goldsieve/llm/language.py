"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends and labels every byte position with a language; a document's
probabilities are the mean over all its positions. Training is plain numpy with backpropagation through time, on
a bounded sample of labelled documents. As the state starts anew with each word, a task labels every
distinct word once and counts it wherever it occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import give_back, held_out, small_batches, with_small_batches

#: Most training documents per language, and words (evenly spaced over the whole text) taken from each.
DOCS, WORDS = 800, 100
HIDDEN, LONGEST, STEPS, BATCH, RATE = 16, 24, 900, 256, 6e-3
#: Words a task remembers before it starts again; words labelled at once.
REMEMBERED, AT_ONCE = 300_000, 4096
UNKNOWN = "und"
#: Letters, and the combining marks after the first; numerals that look like letters are none.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers and a softmax at every position, all in float32."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = lambda *shape: (random.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.parts = {}
        for way in ("f", "b"):
            self.parts |= {f"x{way}": scale(256, 3 * hidden), f"u{way}": scale(hidden, 3 * hidden), f"c{way}": np.zeros(3 * hidden, np.float32)}
        self.parts |= {"v": scale(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def _run(self, way: str, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, words, hidden) over the columns of ``data`` in the order of that direction."""
        h, p = self.hidden, self.parts
        state = np.zeros((len(data), h), np.float32)
        out = np.empty((data.shape[1], len(data), h), np.float32)
        columns = range(data.shape[1]) if way == "f" else range(data.shape[1] - 1, -1, -1)
        table, u = p[f"x{way}"] + p[f"c{way}"], p[f"u{way}"]
        for t in columns:
            x, s = table[data[:, t]], state @ u
            gates = _sigmoid(x[:, :2 * h] + s[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * s[:, 2 * h:])
            if keep is not None:
                keep.append((t, state, z, r, new, s[:, 2 * h:]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (steps, words, languages) at every position of words of one length."""
        both = np.concatenate([self._run("f", data), self._run("b", data)], axis=2)
        return self._softmax(both @ self.parts["v"] + self.parts["c"])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        h, p, grads = self.hidden, self.parts, {}
        kept = {"f": [], "b": []}
        states = {way: self._run(way, data, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        probs = self._softmax(both @ p["v"] + p["c"])
        steps, n, _ = probs.shape
        right = probs[:, np.arange(n), target]
        loss = float(-np.log(right + 1e-9).mean())
        error = probs / (steps * n)
        error[:, np.arange(n), target] -= np.float32(1 / (steps * n))
        grads["v"] = np.einsum("tnh,tnk->hk", both, error, optimize=True)
        grads["c"] = error.sum(axis=(0, 1))
        outer = error @ p["v"].T
        for way, part in (("f", outer[:, :, :h]), ("b", outer[:, :, h:])):
            u, back = p[f"u{way}"], np.zeros((n, h), np.float32)
            gu, gx = np.zeros_like(u), np.zeros_like(p[f"x{way}"])
            for t, state, z, r, new, sn in reversed(kept[way]):
                d = part[t] + back
                dz, dn = d * (state - new) * z * (1 - z), d * (1 - z) * (1 - new * new)
                dr = dn * sn * r * (1 - r)
                ds = np.concatenate([dz, dr, dn * r], axis=1)
                gu += state.T @ ds
                back = d * z + ds @ u.T
                np.add.at(gx, data[:, t], np.concatenate([dz, dr, dn], axis=1))
            grads[f"u{way}"], grads[f"x{way}"], grads[f"c{way}"] = gu, gx, gx.sum(axis=0)
        return loss, grads

    def fit(self, words: dict[int, list[bytes]], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> list[float]:
        """Adam on batches of words of one length, each language as likely as any other."""
        random = np.random.default_rng(seed)
        by_length: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        weight: dict[int, int] = defaultdict(int)
        for label, own in words.items():
            groups = defaultdict(list)
            for word in own:
                for piece in pieces(word):
                    groups[len(piece)].append(piece)
            for length, group in groups.items():
                by_length[length][label] = np.frombuffer(b"".join(group), np.uint8).reshape(-1, length)
                weight[length] += len(group)
        if not by_length:
            return []
        lengths = sorted(by_length)
        odds = np.array([weight[n] for n in lengths], float)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        losses = []
        for step in range(1, steps + 1):
            groups = by_length[lengths[random.choice(len(lengths), p=odds / odds.sum())]]
            labels = sorted(groups)
            target = random.choice(labels, batch)
            data = np.concatenate([groups[k][random.integers(len(groups[k]), size=int((target == k).sum()))] for k in labels])
            loss, grads = self.gradients(data, np.sort(target))
            losses.append(loss)
            rate = RATE * min(1.0, step / 30) * (1 - 0.95 * step / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.parts[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def pieces(word: bytes) -> list[bytes]:
    """Words longer than the network reads at a time, in parts."""
    return [word[i:i + LONGEST] for i in range(0, len(word), LONGEST)]


@dataclass
class Labeller:
    """Sums of position probabilities for words, remembered while a task runs."""

    network: Network

    def __post_init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.sums, self.sizes = np.zeros((0, len(self.network.languages)), np.float32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = [w.encode("utf-8") for w in list(self.numbers)[len(self.sums):]]
        if not new:
            return
        cut = [(at, piece) for at, word in enumerate(new) for piece in pieces(word)]
        lengths = np.array([len(p) for _, p in cut])
        sums = np.zeros((len(new), len(self.network.languages)), np.float32)
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            for i in range(0, len(chosen), AT_ONCE):
                part = chosen[i:i + AT_ONCE]
                data = np.frombuffer(b"".join(cut[k][1] for k in part), np.uint8).reshape(-1, length)
                np.add.at(sums, [cut[k][0] for k in part], self.network.positions(data).sum(axis=0))
        self.sums = np.concatenate([self.sums, sums])
        self.sizes = np.append(self.sizes, np.array([len(w) for w in new], np.int64))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.network.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.numbers) > REMEMBERED:
            self._reset()
        found = []
        for text in texts:
            words = LETTERS.findall((text or "").lower())
            found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self._learn()
        out = []
        for words in found:
            if len(words) == 0:
                out.append((UNKNOWN, 0.0))
                continue
            pooled = self.sums[words].sum(axis=0, dtype=np.float64) / self.sizes[words].sum()
            best = int(pooled.argmax())
            out.append((self.network.languages[best], float(min(max(pooled[best], 0.0), 1.0))))
        return out


def training_words(docs: DataFrame, text: str, key: str, lang: str, docs_per_language: int, words_per_doc: int) -> dict[str, list[bytes]]:
    """Words by language from at most about ``docs_per_language`` documents each, chosen by a hash of the key."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).agg(F.count(F.lit(1))).collect()}  # one row a language
    if not counts:
        return {}
    odds = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))))
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("train")), F.lit(1_000_000)) < odds[F.col(lang)] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            taken = []
            for value in batch.column("text").to_pylist():
                words = LETTERS.findall((value or "").lower())
                at = np.unique(np.linspace(0, len(words) - 1, words_per_doc).astype(int)) if words else []
                taken.append([words[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(taken, pa.list_(pa.string()))], ["lang", "place", "words"])

    sampled = chosen.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("place"), F.col(text).alias("text"))
    got = with_small_batches(sampled).mapInArrow(run, "lang string, place bigint, words array<string>").collect()
    out: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in sorted(got, key=lambda r: (r.lang, r.place, r.words)):
        out[r.lang] += [w.encode("utf-8") for w in r.words]
    return out


def train_language_model(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang",
    docs_per_language: int = DOCS, words_per_doc: int = WORDS, steps: int = STEPS,
) -> Network:
    """A network trained on labelled rows outside the held-out fold; rows without a label or key teach nothing."""
    words = training_words(docs, text, key, lang, docs_per_language, words_per_doc)
    network = Network(list(words))
    if len(words) > 1:
        network.fit({i: w for i, w in enumerate(words.values()) if w}, steps)
    return network


def identify_languages(
    docs: DataFrame, network: Network, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``key, held_out, lang_pred, score`` and the ``carry`` columns.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned. Every letter
    of a text counts with the combining marks after it, whatever its length; digits and punctuation are not read. Null and
    repeated keys are kept as they are; only ``text``, ``key`` and what is carried are read. An empty table gives no rows.
    """
    names = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(key).alias("id"), held_out(F.col(key)).alias("held_out"), *(F.col(c).alias(n) for c, n in zip(carry, names)), F.col(text).alias("text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in small_batches(batches, "text"):
            labels = labeller.label(batch.column("text").to_pylist())
            found = [pa.array([x for x, _ in labels], pa.string()), pa.array([s for _, s in labels], pa.float64())]
            kept = ["id", "held_out", *names]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *found], [*kept, "lang_pred", "score"])
        del labeller
        give_back()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in ("id", "held_out", *names))
    out = with_small_batches(rows).mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(F.col("id").alias(key), "held_out", "lang_pred", "score", *(F.col(n).alias(c) for n, c in zip(names, carry)))
