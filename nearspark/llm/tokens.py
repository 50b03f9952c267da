"""Token counts by the whole-token shortcut.

Method: a vocabulary string that is one pre-token and merges into itself is proved
offline, with the library, to cost one token; pre-tokens that match such a string count
1 straight away and only the others are merged. Pre-tokens are found with numpy over
code points; the class of a code point (letter, number, space, other) is asked from the
library's own pre-tokenizer, so Unicode versions can't differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from . import common, kernels as K

NOT_SEEN, LETTER, NUMBER, BLANK, OTHER = range(5)
#: Merged pre-tokens that a worker remembers; when full, the memory starts anew.
REMEMBERED = 1_000_000


class Counter:
    """Counts tokens of byte-level BPE vocabularies (GPT-2 pre-tokenization, no normaliser)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.classes = np.zeros(0x110000, np.uint8)
        self._classify(np.arange(0x558, dtype=np.uint32))
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = "".join(_byte_letters())
        self.proved = self._prove()
        self.merged: dict[bytes, int] = {}

    def _prove(self) -> dict[bytes, int]:
        back = {c: b for b, c in enumerate(self.letters)}
        texts = []
        for token in self.lib.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(back[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        texts = [t for t, e in zip(texts, self.lib.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1]
        return dict.fromkeys((t.encode() for t in texts), 1)

    def _classify(self, points: np.ndarray) -> None:
        split = self.lib.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            found = OTHER if 0xD800 <= p < 0xE000 else next((k for k, c in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(split(c + chr(p))) == 1), BLANK)
            self.classes[p] = found

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: 0)."""
        values = texts.to_pylist()
        odd = [i for i, t in enumerate(values) if t and any(s in t for s in self.special)]
        out = self._plain(pa.array(["" if t is None else t for t in values], pa.large_string()))
        if odd:  # the library cuts special strings out before anything else; each is one token
            parts, row = [], []
            for i in odd:
                rest = [values[i]]
                for s in self.special:
                    cut = [x.split(s) for x in rest]
                    out[i] = 0
                    rest = [y for x in cut for y in x]
                parts += rest
                row += [i] * len(rest)
                out[i] = len(rest) - 1
            np.add.at(out, row, self._plain(pa.array(parts, pa.large_string())))
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        data, off = common.spaced(texts)
        rows = len(off) - 1
        if not len(data):
            return np.zeros(rows, np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(lead), len(data))  # byte position of each character
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        cls = self.classes[points]
        if not cls.all():
            self._classify(np.unique(points[cls == NOT_SEEN]))
            cls = self.classes[points]
        doc = np.searchsorted(at, off)  # first character of each text; its last character is our space
        cls = cls.copy()
        ends = doc[1:] - 1
        cls[ends] = 0  # the space between texts belongs to none
        n = len(cls)
        new = np.ones(n, bool)
        new[1:] = cls[1:] != cls[:-1]
        start = new.copy()
        # a space before a run of anything else belongs to that run; another blank there stands alone
        nxt = np.zeros(n, np.uint8)
        nxt[:-1] = cls[1:]
        last_blank = (cls == BLANK) & (nxt != BLANK) & (nxt != 0)
        start[last_blank] = True
        joins = last_blank & (points == 32)
        start[1:][joins[:-1]] = False
        # contractions: an apostrophe that starts a token, then s, t, m, d, re, ve or ll
        p = np.flatnonzero((points[:-1] == 39) & start[:-1] & (nxt[:-1] == LETTER))
        if len(p):
            a, b = points[p + 1], points[np.minimum(p + 2, n - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for hit, width in ((one, 2), (two & ~one, 3)):
                q = p[hit]
                start[q + 1] = False
                if width == 3:
                    start[q + 2] = False
                start[q + width] = True
        start[ends] = False
        begin = np.flatnonzero(start)
        # a token ends where the next begins, or at the end of its text
        row = np.searchsorted(doc, begin, side="right") - 1
        stop = np.append(begin[1:], n)
        stop = np.minimum(stop, ends[row]) if len(begin) else stop[:0]
        lo, hi = at[begin], at[stop]
        # equal pre-tokens are counted once: by hash, and by their bytes where a hash stands for several
        _, first, inverse = np.unique(K.span_hash(data, lo, hi), return_index=True, return_inverse=True)
        like = first[inverse]
        alone = np.flatnonzero(~K.same_spans(data, lo, hi, lo[like], hi[like]))
        inverse[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate([first, alone])
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        raw = data.tobytes()
        counts = np.fromiter((self._count_one(raw[a:b]) for a, b in zip(lo[first].tolist(), hi[first].tolist())), np.int64, len(first))
        return np.bincount(row, counts[inverse], rows).astype(np.int64)

    def _count_one(self, piece: bytes) -> int:
        n = self.proved.get(piece) or self.merged.get(piece)
        if n is None:
            n = self._merge(piece)
            if len(piece) <= K.LONG:
                self.merged[piece] = n
        return n

    def _merge(self, piece: bytes) -> int:
        return len(self.lib.model.tokenize(piece.decode("latin-1").translate(self.letters)))


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary, made once in a worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; a null id stays null; repeated rows are
    counted each; other columns are not read, so their names can't clash. Nothing is
    shuffled. Special strings inside a text count as the library has them by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in common.text_slices(batch):
                n = own.count(part.column("text"))
                size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(common.trimmed(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
