"""Language identification of code-switched text by a linear-chain conditional random field.

Every word has affix, byte n-gram and lexicon features; learned transitions tie
neighbouring words together; forward-backward gives each word's label probabilities. A
document's language is the label with the largest sum of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import common, kernels as K

#: Hash space of affix and n-gram features.
BITS = 18
#: Labelled rows that training looks at, the first in hash order of their ids, and bytes of text that it uses of them at most; each text is used whole.
TRAIN_ROWS = 4000
#: Of them for one language; Spark keeps so many of each partition before it shuffles.
LANG_ROWS = 1000
TRAIN_BYTES = 8_000_000
#: Words of a training sequence, and of the stretch it takes from one document.
LENGTH, STRETCH = 96, 24
#: Words of a block; long texts are gone through block by block side by side, with the exact messages between blocks.
BLOCK = 128
UNKNOWN = "und"
HELD_OUT = 2


class Words:
    """The words of some texts with their features."""

    def __init__(self, texts: pa.Array):
        data, off = common.spaced(texts)
        data = np.concatenate([np.array([32], np.uint8), K.LOWER[data]])
        inside = K.LETTER[data]
        flat = np.where(inside, data, np.uint8(32))
        self.start, self.end = K.spans(inside)
        self.first = np.searchsorted(self.start, off + 1)
        letter = np.flatnonzero(inside)
        wide = flat.astype(np.uint64)
        gram = wide[letter - 1] << np.uint64(16) | wide[letter] << np.uint64(8) | wide[letter + 1]
        shift = np.uint64(64 - BITS)
        self.grams = (K.mix(gram) >> shift).astype(np.int32)
        self.gram_edge = np.concatenate([[0], np.cumsum(self.end - self.start)])
        self.affixes = []
        for k in (1, 2, 3):
            head = K.span_hash(flat, self.start, np.minimum(self.start + k, self.end))
            tail = K.span_hash(flat, np.maximum(self.end - k, self.start), self.end)
            self.affixes += [(K.mix(head + np.uint64(k)) >> shift).astype(np.int32), (K.mix(tail + np.uint64(k + 8)) >> shift).astype(np.int32)]
        self.hash = K.span_hash(flat, self.start, self.end)


class Crf:
    def __init__(self, labels: list[str], lexicon: np.ndarray, entry: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon, self.entry = labels, lexicon, entry
        self.weight = np.zeros(((1 << BITS) + n + 1, n), np.float32)
        self.step, self.begin = np.zeros((n, n)), np.zeros(n)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon feature of each word: the label its entry stands for, or none."""
        none = (1 << BITS) + len(self.labels)
        if not len(self.lexicon):
            return np.full(len(hashes), none, np.int32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, (1 << BITS) + self.entry[at], none).astype(np.int32)

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.weight[words.grams], words.gram_edge[:-1], axis=0)
        for a in words.affixes:
            out += self.weight[a]
        return out + self.weight[self.lookup(words.hash)]

    def posteriors(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label probabilities of every word; ``first`` has the first word of each text, and one more."""
        n, count = len(self.labels), np.diff(first)
        blocks = -(-count // BLOCK)
        text = np.repeat(np.arange(len(count)), blocks)
        begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(first[text + 1] - begin, BLOCK)
        p = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
        go, out = np.exp(self.step - self.step.max()), np.empty_like(p)
        # messages into each block from before and from behind
        enter, leave = np.tile(np.exp(self.begin - self.begin.max()), (len(text), 1)), np.ones((len(text), n))
        if (blocks > 1).any():
            self._carry(p, go, blocks, begin, size, enter, leave)
        order = np.argsort(-size, kind="stable")
        size, begin, enter, leave = size[order], begin[order], enter[order], leave[order]
        longest, active = _active(size)
        state = None
        for t in range(longest):
            own = p[begin[: active[t]] + t]
            state = own * (enter[: active[t]] if t == 0 else state[: active[t]] @ go)
            state /= state.sum(axis=1, keepdims=True)
            out[begin[: active[t]] + t] = state
        back = leave[:0]
        for t in range(longest - 1, -1, -1):
            k, m = active[t], len(back)
            new = leave[:k].copy()
            if m:
                new[:m] = (back * p[begin[:m] + t + 1]) @ go.T
                new[:m] /= new[:m].sum(axis=1, keepdims=True)
            both = out[begin[:k] + t] * new
            out[begin[:k] + t] = both / both.sum(axis=1, keepdims=True)
            back = new
        return out

    def _carry(self, p: np.ndarray, go: np.ndarray, blocks: np.ndarray, begin: np.ndarray, size: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
        """Fill in the messages between the blocks of texts that have several: each block acts on them as one small matrix."""
        n = len(go)
        base, count = (np.cumsum(blocks) - blocks)[blocks > 1], blocks[blocks > 1]
        at = np.flatnonzero(np.repeat(blocks > 1, blocks))
        at = at[np.argsort(-size[at], kind="stable")]
        longest, active = _active(size[at])
        whole = np.empty((len(size), n, n))
        m = np.tile(np.eye(n), (len(at), 1, 1))
        for t in range(longest):
            k = active[t]
            m[:k] = (m[:k] if t == 0 else (m[:k].reshape(-1, n) @ go).reshape(-1, n, n)) * p[begin[at[:k]] + t][:, None]
            m[:k] /= m[:k].sum(axis=(1, 2), keepdims=True)
        whole[at] = m
        base = base[np.argsort(-count, kind="stable")]
        most, active = _active(np.sort(count)[::-1])
        for j in range(1, most):
            b = base[: active[j]] + j
            f = np.einsum("ki,kij->kj", enter[b - 1], whole[b - 1]) @ go
            enter[b] = f / f.sum(axis=1, keepdims=True)
        for j in range(most - 1, 0, -1):
            b = base[: active[j]] + j
            r = np.einsum("kij,kj->ki", whole[b], leave[b]) @ go.T
            leave[b - 1] = r / r.sum(axis=1, keepdims=True)


def _active(size: np.ndarray) -> tuple[int, np.ndarray]:
    """Of descending sizes: the largest, and how many are longer than each position."""
    longest = int(size[0]) if len(size) else 0
    return longest, np.searchsorted(-size, -np.arange(longest), side="left")


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.25, seed: int = 5) -> Crf:
    """Learn from whole texts with one language each.

    Sequences are put together from stretches of different texts, so that transitions between languages are learnt as well.
    """
    labels = sorted(set(langs))
    if not labels:
        return Crf([], np.empty(0, np.uint64), np.empty(0, np.int32))
    words = Words(pa.array(texts, pa.large_string()))
    count = np.diff(words.first)
    y = np.repeat(np.array([labels.index(x) for x in langs], np.int64), count)
    n = len(labels)
    # lexicon: words seen at least three times, nine times of ten in one language
    uniq, inverse = np.unique(words.hash, return_inverse=True)
    seen = np.zeros((len(uniq), n))
    np.add.at(seen, (inverse, y), 1)
    top, most = seen.argmax(axis=1), seen.max(axis=1)
    good = (most >= 3) & (most >= 0.9 * seen.sum(axis=1))
    crf = Crf(labels, uniq[good], top[good].astype(np.int32))
    if n < 2 or not len(y):
        return crf
    doc = np.repeat(np.arange(len(texts)), count)
    pieces = [np.arange(lo, min(lo + STRETCH, hi)) for lo0, hi in zip(words.first[:-1], words.first[1:]) for lo in range(lo0, hi, STRETCH)]
    del doc
    rng = np.random.default_rng(seed)
    lex, size = crf.lookup(words.hash), len(crf.weight)
    square, square_step = np.full(crf.weight.shape, 1e-6, np.float32), np.full((n, n), 1e-6)
    for _ in range(epochs):
        # half of the stretches stay with their neighbours from the same text
        order = np.arange(len(pieces))
        runs = np.split(order, np.flatnonzero(rng.random(len(order) - 1) < 0.35) + 1)
        flat = np.concatenate([pieces[i] for r in rng.permutation(len(runs)) for i in runs[r]])
        flat = flat[: len(flat) // LENGTH * LENGTH].reshape(-1, LENGTH)
        for lo in range(0, len(flat), 64):
            batch = flat[lo : lo + 64]
            at = batch.ravel()
            lengths = words.end[at] - words.start[at]
            edge = np.concatenate([[0], np.cumsum(lengths)])
            g_at = np.repeat(words.gram_edge[at] - edge[:-1], lengths) + np.arange(edge[-1])
            grams, owner = words.grams[g_at], np.repeat(np.arange(len(at)), lengths)
            rest = [a[at] for a in words.affixes] + [lex[at]]
            e = np.add.reduceat(crf.weight[grams], edge[:-1], axis=0) + sum(crf.weight[r] for r in rest)
            grad, grad_step = _gradient(crf, e.reshape(len(batch), LENGTH, n), y[at].reshape(len(batch), LENGTH))
            grad = grad.reshape(-1, n)
            feature = np.concatenate([grams, *rest])
            whose = np.concatenate([owner, *[np.arange(len(at))] * len(rest)])
            g = np.stack([np.bincount(feature, grad[whose, k], size) for k in range(n)], axis=1).astype(np.float32) / len(batch)
            hit = np.flatnonzero(g.any(axis=1))
            square[hit] += g[hit] ** 2
            crf.weight[hit] += rate * g[hit] / np.sqrt(square[hit])
            crf.weight[hit] *= 0.9995
            grad_step /= len(batch)
            square_step += grad_step**2
            crf.step += rate * grad_step / np.sqrt(square_step)
    return crf


def _gradient(crf: Crf, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by emission and by transition, for sequences of one length."""
    b, t, n = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
    go = np.exp(crf.step)
    f, r = np.empty_like(p), np.ones_like(p)
    for i in range(t):
        f[:, i] = p[:, i] if i == 0 else (f[:, i - 1] @ go) * p[:, i]
        f[:, i] /= f[:, i].sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        r[:, i] = (r[:, i + 1] * p[:, i + 1]) @ go.T
        r[:, i] /= r[:, i].sum(axis=1, keepdims=True)
    post = f * r
    post /= post.sum(axis=2, keepdims=True)
    pair = f[:, :-1, :, None] * go * (p[:, 1:] * r[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((n, n))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    return np.eye(n)[y] - post, seen - pair.sum(axis=(0, 1))


def choose(rows: list[dict], limit: int) -> list[int]:
    """Which of ``rows`` (in the order of choice) are used, so that their sizes add up to ``limit`` at most.

    Every language first gets an equal share, then what is left goes to any; a row that
    doesn't fit is passed over, so that one large text neither ends the choice nor takes another language's share.
    """
    first = list({tuple(r.values()): i for i, r in reversed(list(enumerate(rows)))}.values())[::-1]
    share = limit // max(1, len({r["lang"] for r in rows}))
    taken, used, total = set(), dict.fromkeys((r["lang"] for r in rows), 0), 0
    for i in first:
        r = rows[i]
        if used[r["lang"]] + r["size"] <= share:
            used[r["lang"]] += r["size"]
            total += r["size"]
            taken.add(i)
    for i in first:
        if i not in taken and total + rows[i]["size"] <= limit:
            total += rows[i]["size"]
            taken.add(i)
    return sorted(taken)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Crf:
    """Train on at most ``rows`` rows with a language whose crc32(id) mod 4 is not 2; without any, every document is ``und``.

    Rows that are equal in id, text and language count once. A text larger than ``TRAIN_BYTES``
    is passed over, so a language that has no other isn't learnt.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    known = known.where("id is not null and text is not null and lang is not null and pmod(crc32(cast(id as string)), 4) != 2")
    known = known.withColumns({"size": F.octet_length("text"), "code": F.xxhash64("text")}).where(F.col("size") <= TRAIN_BYTES)
    key = ["id", "lang", "code", "size"]
    # the first of every language in hash order, then the second of each, and so on: a rare language is learnt, too
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), *key))
    picked = known.select(*key).withColumn("turn", turn).where(F.col("turn") <= LANG_ROWS).orderBy("turn", F.xxhash64("id"), *key).limit(rows).drop("turn").toArrow()  # at most ``rows`` rows without texts
    picked = picked.take(pa.array(choose(picked.to_pylist(), TRAIN_BYTES), pa.int64()))
    chosen = docs.sparkSession.createDataFrame(picked)
    got = known.join(F.broadcast(chosen), key, "left_semi").dropDuplicates(key).select("id", "text", "lang").toArrow()  # at most TRAIN_BYTES of text
    got = got.take(pc.sort_indices(got, [("id", "ascending"), ("lang", "ascending"), ("text", "ascending")]))
    return train(got.column("text").to_pylist(), got.column("lang").to_pylist())


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the label's mean probability over the words) of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Of
    labels with equal sums the first in code-point order wins. Repeated rows are judged
    each; other columns aren't read. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)  # 2**BITS rows of one weight per language, and the lexicon of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in common.text_slices(batch):
                texts = part.column("text")
                words = Words(texts)
                count = np.diff(words.first)
                lettered = _lettered(texts, words)
                if own.labels:
                    p = own.posteriors(own.emissions(words), words.first)
                    total = np.concatenate([np.zeros((1, len(own.labels))), np.cumsum(p, axis=0, dtype=np.float64)])
                    mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(count, 1)[:, None]
                    best = mean.argmax(axis=1)
                    ok = lettered & (count > 0)
                    lang = np.where(ok, np.array(own.labels, object)[best], UNKNOWN)
                    score = np.where(ok, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                else:
                    lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return kept.mapInArrow(common.trimmed(run), f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _lettered(texts: pa.Array, words: Words) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or else any character that is one."""
    ascii_ = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~ascii_ & (np.diff(words.first) > 0)).tolist():
        ascii_[i] = any(c.isalpha() for c in texts[i].as_py())
    return ascii_


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. A null id is not held out."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
