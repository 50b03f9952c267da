"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for every vocabulary piece at every position. The
search keeps one best path into each position of a window, and commits ids as soon as all
surviving paths run through one boundary. Some boundaries are known beforehand: no piece of
the model crosses the place before a space mark, so every path runs through it. The ids
between two of them are the search's own, and a worker remembers them for the next time.

How paths compare depends on the model. In a unigram model the largest sum of scores
wins. In a BPE model an edge survives only if its piece and the path's last piece are
what the merge rules give for the two of them together; a sequence in which each pair
of neighbours is so is exactly the merge result of the whole, so one path survives at
each position and the ids are the library's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common

SPACE = "▁"
#: Stretches that a generation of a worker's memory holds, for one task, and neighbour pairs that a worker keeps.
REMEMBERED = 200_000
PAIRS = 500_000
#: Characters that are pushed at a time, and of the longest stretch that is remembered.
CHUNK = 1024
WINDOW = 64
#: Characters of a long text that are cut into stretches at a time, up to the next space mark.
BLOCK = 1 << 16
EDGE = re.compile(f"[^ {SPACE}](?=[ {SPACE}])")
BPE, UNIGRAM = 2, 1
#: A word and the marks after it.
TAIL = re.compile(r"(.*\w)(\W+)")


class Viterbi:
    """One text's search; push() takes characters and returns the ids committed so far, finish() the rest.

    The window holds one path into each position. Paths grow forward along the pieces' trie;
    a position is left once the longest piece from it is known to be in the window. Where no
    path reaches beyond the position that is left, or the paths into all open positions have
    one boundary behind them, all paths have converged: the ids before it are committed and
    the window starts there.
    """

    __slots__ = ("model", "text", "at", "far", "score", "last", "start")

    def __init__(self, model: Model):
        self.model, self.text, self.at, self.far = model, "", 0, 0
        # per position of the window, if a path arrives there: its score, its last piece (-1: none, -2: a character of no piece) and where that starts
        self.score: list[float] = [0.0]
        self.last: list[int | None] = [-1]
        self.start: list[int] = [0]

    def push(self, chars: str) -> list[int]:
        self.text += chars
        return self._search(len(self.text) - self.model.longest)

    def finish(self) -> list[int]:
        out = self._search(len(self.text))
        out += self._trace(0, len(self.text))
        return out

    def _search(self, stop: int) -> list[int]:
        """Leave all positions before ``stop``; the ids committed by that."""
        m, text, n = self.model, self.text, len(self.text)
        score, last, start, far, base = self.score, self.last, self.start, self.far, 0
        more = n + 1 - len(last)
        score += [0.0] * more
        last += [None] * more
        start += [0] * more
        trie, pairs, bpe, out = m.trie, m.pairs, m.kind == BPE, []
        at = self.at
        for i in range(at, max(at, stop)):
            before = last[i]
            if before is None:
                continue
            if i == far and i > base and stop < n:  # at the text's end all that is left is committed anyhow
                out += self._trace(base, i)
                base = i
            step = trie.get(text[i])
            if step is None or step[0] < 0:  # a character of no piece: its bytes
                if last[i + 1] is None or not bpe and score[i] + m.worst > score[i + 1]:
                    score[i + 1], last[i + 1], start[i + 1] = score[i] + m.worst, -2, i
                if far <= i:
                    far = i + 1
            k = i
            while step is not None:
                k += 1
                piece, node = step
                if piece >= 0:
                    if bpe:  # one path survives at each position
                        if last[k] is None:
                            ok = before < 0 or pairs.get(before << 32 | piece)
                            if ok or ok is None and m.neighbours(before, piece):
                                last[k], start[k] = piece, i
                                if k > far:
                                    far = k
                    else:
                        own = score[i] + m.score[piece]
                        if last[k] is None or own > score[k]:
                            score[k], last[k], start[k] = own, piece, i
                            if k > far:
                                far = k
                if node is None or k == n:
                    break
                step = node.get(text[k])
        at = max(at, stop)
        if stop < n and n - base >= 3 * m.longest:  # paths that overlap may have one boundary behind them all the same
            open_ = {k for k in range(at, far + 1) if last[k] is not None}
            while len(open_) > 1 and max(open_) > base:
                k = max(open_)
                open_.discard(k)
                open_.add(start[k])
            if (cut := max(open_)) > base:
                out += self._trace(base, cut)
                base = cut
        if base:  # the window starts at the last boundary
            self.text = text[base:]
            del score[:base], last[:base], start[:base]
            self.start = [x - base for x in start]
            self.start[0] = 0
        self.at, self.far = at - base, far - base
        return out

    def _trace(self, base: int, end: int) -> list[int]:
        out, last, start = [], self.last, self.start
        while end > base:
            piece = last[end]
            if piece >= 0:
                out.append(piece)
            else:
                out += self.model.bytes_of(self.text[start[end] : end])[::-1]
            end = start[end]
        out.reverse()
        return out


class Memory(dict):
    """Ids (as the bytes of an array) of the stretches met lately, in two generations; those longer than the window aren't kept."""

    def __init__(self, model: Model):
        self.model, self.old = model, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            tail = TAIL.fullmatch(text)
            if tail and text[tail.end(1) - 1 : tail.end(1) + 1] not in self.model.joints:  # no piece holds both characters, so every path stops between them
                got = self[tail[1]] + self[tail[2]]
            else:
                got = array("i", self.model.segment(text)).tobytes()
        if len(text) <= WINDOW:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Model:
    """A SentencePiece model file with identity normalisation, of type BPE or unigram."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.kind, self.prefix = m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix
        normal = [(i, p) for i, p in enumerate(m.pieces) if p.type in (1, 4)]
        self.ids = {p.piece: i for i, p in normal}
        self.score = {i: p.score for i, p in normal}
        self.pieces = [p.piece for p in m.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_at = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(m.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.bytes_at = [bytes([self.byte_at[i]]) if i in self.byte_at else b"" if i in self.control else p.encode() for i, p in enumerate(self.pieces)]
        self.bytes_at[self.unknown] = m.trainer_spec.unk_surface.encode()
        self.longest = max(map(len, self.ids))
        self.known = {p for p in self.ids if len(p) == 1}
        self.worst = min(self.score.values()) - 10
        if self.kind == UNIGRAM:  # sums are rounded as the library's are
            self.score = {i: np.float32(x) for i, x in self.score.items()}
            self.worst = np.float32(self.worst)
        self._all = self.ids
        if self.kind == BPE:  # a piece that its own characters don't merge into can't come out of any text
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        # a boundary before a space mark or around a character of no piece is one that every path shares, if no piece crosses it
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.cut = None
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any("\n" in p for p in self.ids) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.joints = {p[i : i + 2] for p in self._all for i in range(len(p) - 1)}
        trie: dict = {}
        for piece, i in self.ids.items():
            node = trie
            for c in piece:
                step = node.setdefault(c, [-1, {}])
                node = step[1]
            step[0] = i
        self.trie = _frozen(trie)
        self.pairs: dict[int, bool] = {}
        self.memory = Memory(self)

    def merge(self, text: str) -> list[str]:
        """The merge rules applied directly: the best-scored pair of neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self._all.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, last: int, piece: int) -> bool:
        """Whether two pieces are what the merge rules give for the two of them together."""
        ok = self.pairs.get(last << 32 | piece)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            a, b = self.pieces[last], self.pieces[piece]
            ok = self.pairs[last << 32 | piece] = self.merge(a + b) == [a, b]
        return ok

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def segment(self, text: str) -> list[int]:
        """Ids of a stretch that shares its ends with every path: a whole text's, if no boundary in it is known beforehand."""
        search, out = Viterbi(self), []
        if len(text) <= CHUNK:  # all of it is in the window
            search.text = text
            return search.finish()
        for lo in range(0, len(text), CHUNK):
            out += search.push(text[lo : lo + CHUNK])
        return out + search.finish()

    def raw(self, text: str | None) -> bytes:
        """The ids as the bytes of an array."""
        if not text:
            return b""
        if self.cut is None:
            text = text.replace(" ", SPACE)
            return array("i", self.segment(SPACE + text if self.prefix else text)).tobytes()
        out, lo = [], 0
        while lo < len(text):
            edge = EDGE.search(text, lo + BLOCK)  # no piece crosses the place before a space mark
            hi = edge.end() if edge else len(text)
            part = text[lo:hi].replace(" ", SPACE)
            out.append(b"".join(map(self.memory.__getitem__, self.cut.findall(SPACE + part if self.prefix and not lo else part))))
            lo = hi
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.raw(text)).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: byte pieces as UTF-8 (each byte that isn't, as U+FFFD), unknown ids as the model's mark for them, without the space mark added in front."""
        parts = [self.bytes_at[i] for i in ids]
        if self.prefix:  # the first piece that isn't a control piece
            first = next((k for k, i in enumerate(ids) if i not in self.control), None)
            if first is not None and ids[first] not in self.byte_at and parts[first].startswith(_MARK):
                parts[first] = parts[first][len(_MARK) :]
        try:
            text = b"".join(parts).decode() if self.control.isdisjoint(ids) else None
        except UnicodeDecodeError:
            text = None
        if text is None:  # runs of byte pieces one by one
            text = "".join(_lenient(b"".join(p for p, _ in run)) for _, run in groupby(zip(parts, ids), lambda x: x[1] in self.byte_at))
        return text.replace(SPACE, " ")


def _frozen(node: dict) -> dict | None:
    """A trie's node: by character the piece that ends there (-1: none) and the node behind it (None: nothing)."""
    return {c: (piece, _frozen(after)) for c, (piece, after) in node.items()} or None


_MARK = SPACE.encode()


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "\ufffd")
            at += e.start + 1
    return "".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text (array<int>; null and empty texts: no ids).

    A column named like ``ids_col`` is replaced; repeated rows are encoded each; an empty
    table stays empty. Nothing is shuffled. A text's own U+2581 reads as a space, as in the library.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        return [_lists(list(map(model(path).raw, texts.to_pylist())))]

    return common.with_columns(docs, text_col, run, T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType()))]), lambda: model(path).memory.forget())


def _lists(found: list[bytes]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(found), np.int32)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of every array of ids (null and empty ids: an empty text).

    A column named like ``text_col`` is replaced; repeated rows are decoded each; an empty table stays empty.
    """

    def run(ids: pa.Array) -> list[pa.Array]:
        return [pa.array([model(path).decode(x or []) for x in ids.to_pylist()], pa.string())]

    return common.with_columns(df, ids_col, run, T.StructType([T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_ids and exact: whether decoding gives the text back (a text's own U+2581 counted as a space).

    Each text is encoded and its ids decoded in one pass over its Arrow batch. Null and
    empty texts have no ids and are exact. Repeated rows are coded each; an empty table gives
    no rows; a null id stays null; other columns aren't read.
    """
    common.small_batches(docs.sparkSession)
    rest = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in common.text_slices(batch):
                texts = part.column("text").to_pylist()
                found = list(map(own.raw, texts))
                exact = [own.decode(array("i", x)) == (t or "").replace(SPACE, " ") for x, t in zip(found, texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(found), pa.array([len(x) // 4 for x in found], pa.int32()), pa.array(exact, pa.bool_())], ["id", "ids", "n_ids", "exact"])
        own.memory.forget()
        common.trim()

    return rest.mapInArrow(run, f"id {rest.schema['id'].dataType.simpleString()}, ids array<int>, n_ids int, exact boolean").withColumnRenamed("id", id_col)
