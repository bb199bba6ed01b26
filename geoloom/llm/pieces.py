"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct words of a batch are concatenated and indexed by a suffix array. Every piece is binary-searched for its
range of occurrences; the occurrences, sorted by position, are the edges of a graph over positions. Relaxing an edge
keeps it where its piece may follow the last piece of the prefix that it extends: two pieces may stand together if
merging their joined text gives back the two. Byte-pair merging has the property that a text's encoding is the one path
whose neighbours all may, so the relaxed path is what the library's merging gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Characters indexed at once, texts cut at once and words kept: bounds on a worker's memory.
INDEXED, TOGETHER, CACHE = 400_000, 500, 1_000_000


class Model:
    """The pieces of a BPE model with byte fallback, and the encodings of words met so far."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        self.piece = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(len(self.piece)) if lib.is_control(i)}
        self.shown = [
            bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.silent else p.replace(BLANK, " ").encode("utf-8", "surrogatepass")
            for i, p in enumerate(self.piece)
        ]
        plain = [i for i in range(len(self.piece)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: lib.get_score(i) for i in plain}
        #: Words can be cut off before a blank, unless a piece has one after another character.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.made = {p: i for p, i in self.id.items() if self.merge(p) == [p]}
        #: A piece's place in the order of merging (characters come first) and the two pieces that it is merged from.
        self.rank = {p: -self.score[p] if len(p) > 1 else -1.0 for p in self.made}
        self.halves = {p: self.merge(p, 2) if len(p) > 1 else [p, p] for p in self.made}
        inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        #: No piece holds a letter and then one of these, so a word can be cut between the two.
        marks = [c for c in ",.;:!?)\"'" if not any(x[1] == c and x[0].isalpha() for x in inside)]
        self.mark = re.compile("(?<=[^\\W\\d_])(?=[" + re.escape("".join(marks)) + "])") if marks else None
        self.longest = max(map(len, self.made))
        signs = sorted({c for p in self.made for c in p})
        self.sign = {ord(c): k + 2 for k, c in enumerate(signs)}  # 0 ends a word, 1 is any other character
        pad = lambda p, fill: b"".join(self.sign[ord(c)].to_bytes(2, "big") for c in p) + fill * (2 * (self.longest - len(p)))
        order = sorted(self.made)
        self.first = np.array([pad(p, b"\0") for p in order], f"S{2 * self.longest}")
        self.beyond = np.array([pad(p, b"\xff") for p in order], f"S{2 * self.longest}")
        self.full = np.array([len(p) == self.longest for p in order])
        self.ids, self.size = np.array([self.made[p] for p in order]), np.array([len(p) for p in order])
        #: Ids as bytes, four for each, so that a text's are joined at once and a word takes little memory.
        self.words: dict[str, bytes] = {}
        self.shown_array = pa.array(self.shown, pa.large_binary())
        self.meets: dict[int, bool] = {}

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merging of a short text: the best-scored adjacent pair first, the left one of equals; ``least``:
        symbols to stop at."""
        at = list(text)
        while len(at) > least:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(at, at[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            at[k : k + 2] = [at[k] + at[k + 1]]
        return at

    def may_meet(self, p: str, q: str) -> bool:
        """Whether merging ``p + q`` gives back the pieces p and q.

        Merging undone step by step from the boundary: no pair across it may have been due before the merge, on either
        side, that made it impossible. Of merges of equal rank the left one is due first.
        """
        score, rank, halves, limit = self.score, self.rank, self.halves, float("inf")
        if p.strip(BLANK) == "" and q[0] == BLANK:
            return self.merge(p + q) == [p, q]  # runs of blanks share one rank
        while True:
            due = score.get(p + q)
            if due is not None and (-due < limit):
                return False
            a, b = rank[p], rank[q]
            if (a > b or len(q) == 1) and len(p) > 1:
                limit, p = a, halves[p][1]
            elif len(q) > 1:
                limit, q = b + 0.5, halves[q][0]
            else:
                return True

    def meeting(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """may_meet for pairs of ids, each distinct pair worked out once; a character without a piece (-1) meets all."""
        code = last.astype(np.int64) * len(self.piece) + piece
        code[(last < 0) | (piece < 0)] = -1
        distinct, back = np.unique(code, return_inverse=True)
        ok = np.empty(len(distinct), bool)
        if len(self.meets) > 2_000_000:
            self.meets.clear()
        for k, c in enumerate(distinct.tolist()):
            got = True if c < 0 else self.meets.get(c)
            if got is None:
                a, b = divmod(c, len(self.piece))
                got = self.meets[c] = self.may_meet(self.piece[a], self.piece[b])
            ok[k] = got
        return ok[back]

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of a piece in ``text``, by end and then start; words end with NUL."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen, back = np.unique(codes, return_inverse=True)
        small = np.array([0 if c == 0 else self.sign.get(int(c), 1) for c in seen], np.uint16)[back]
        n, deep = len(small), self.longest
        rank, k = small.astype(np.int64), 1
        while True:  # prefix doubling, as deep as the longest piece
            key = rank * (int(rank.max()) + 2)
            key[: max(n - k, 0)] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            k *= 2
            if k >= deep:
                break
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank = new
        wide = np.zeros(n + deep, ">u2")
        wide[:n] = small
        rows = np.lib.stride_tricks.sliding_window_view(wide, deep)[:n][order]
        suffixes = np.ascontiguousarray(rows).view(f"S{2 * deep}").ravel()
        lo = np.searchsorted(suffixes, self.first, "left")
        hi = np.where(self.full, np.searchsorted(suffixes, self.first, "right"), np.searchsorted(suffixes, self.beyond, "left"))
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        start = order[place]
        end, piece = start + self.size[which], self.ids[which]
        alone = np.flatnonzero((small == 1) | ((small > 1) & ~np.isin(small, self._single())))
        start, end, piece = np.r_[start, alone], np.r_[end, alone + 1], np.r_[piece, np.full(len(alone), -1)]
        by = np.lexsort((start, end))
        return start[by], end[by], piece[by]

    @lru_cache(maxsize=1)
    def _single(self) -> np.ndarray:
        return np.array([self.sign[ord(p)] for p in self.made if len(p) == 1], np.uint16)

    def learn(self, new: list[str]) -> None:
        """Encode words that are not known yet, some at a time."""
        some, size = [], 0
        for k, w in enumerate(new):
            some.append(w)
            size += len(w) + 1
            if size >= INDEXED or k == len(new) - 1:
                self._learn(some)
                some, size = [], 0

    def _learn(self, some: list[str]) -> None:
        text = "\0".join(some) + "\0"
        start, end, piece = self.edges(text)
        size = np.array([len(w) + 1 for w in some])
        begin = np.cumsum(size) - size
        depth = end - np.repeat(begin, size)[start]  # of an edge's end inside its word: all words are relaxed together
        by = np.argsort(depth, kind="stable")
        start, end, piece = start[by], end[by], piece[by]
        last = np.full(len(text) + 1, -3)  # -3: not reached; -2: a word's start
        last[begin] = -2
        back = np.zeros(len(text) + 1, np.int64)
        bounds = np.flatnonzero(np.r_[True, np.diff(depth[by]) > 0, True]) if len(by) else [0]
        for lo, hi in zip(bounds, bounds[1:]):
            i, j, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            live = np.flatnonzero(last[i] > -3)
            i, j, p = i[live], j[live], p[live]
            keep = self.meeting(last[i], p)
            last[j[keep]], back[j[keep]] = p[keep], i[keep]
        last, back = last.tolist(), back.tolist()
        at = 0
        for w in some:
            j, ids = at + len(w), []
            while j > at:
                i, p = back[j], last[j]
                if p < 0:
                    ids += [self.byte[b] for b in reversed(text[i:j].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(p)
                j = i
            self.words[w] = array("i", reversed(ids)).tobytes()
            at += len(w) + 1

    def cut(self, text: str) -> list[str]:
        """Words: runs of blanks with what follows them; the whole text where the pieces do not allow it."""
        if not text:
            return []
        if self.cuts and BLANK not in text and "" not in (plain := text.split(" ")):
            return list(map(BLANK.__add__, plain))
        text = BLANK + text.replace(" ", BLANK)
        if not self.cuts:
            return [text]
        out, run = [], ""
        for part in text.split(BLANK)[1:]:
            run += BLANK
            if part:
                out.append(run + part)
                run = ""
        return [*out, run] if run else out

    def inner(self, word: str) -> list[str]:
        """A word cut between letters and marks that no piece joins, and around NUL, which ends words in the index."""
        parts = [word]
        if "\0" in word:
            self.words.setdefault("\0", array("i", [self.byte[0]]).tobytes())
            parts = [p for x in word.split("\0") for p in (x, "\0")][:-1]
        return [q for p in parts if p for q in (self.mark.split(p) if self.mark is not None and self.cuts and not p.isalpha() else [p])]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as bytes of 32-bit numbers."""
        split = [self.cut(t) for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
        parts = {w: self.inner(w) for w in set().union(*split).difference(self.words)}
        self.learn(list({p for ps in parts.values() for p in ps if p not in self.words}))
        for w, ps in parts.items():
            if len(ps) > 1:
                self.words[w] = b"".join(map(self.words.__getitem__, ps))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("i", b).tolist() for b in self.encoded(texts)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """UTF-8 texts of the runs of ``ids`` between ``bounds``, as :meth:`decode` gives them but with stray bytes kept."""
        shown = self.shown_array.take(pa.array(ids))
        offsets = np.frombuffer(shown.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(shown.buffers()[2] or b"")
        places = offsets[bounds].tolist()
        for lo, hi in zip(places, places[1:]):
            yield bytes(data[lo + (hi > lo and data[lo] == 32) : hi])

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: bytes are joined to characters, blanks become spaces, and the first one is left out."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Piece ids of every text.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no ids. Rows are kept one for one. Returns
    doc_id, n_bytes, n_pieces, ids and round_trip (the ids decode to the text). No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                texts = some.column(1).to_pylist()
                ids = pieces.encoded(texts)
                size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat, bounds = np.frombuffer(b"".join(ids), np.int32), np.cumsum(np.r_[0, size])
                utf8 = list(map(str.encode, texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array(list(map(len, utf8)), pa.int64()), pa.array(size),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                        pa.array(list(map(bytes.__eq__, pieces.decode_all(flat, bounds), utf8)), pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_pieces", "ids", "round_trip"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pieces long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, decoded from the array column ``ids``; null ids give a null text, no ids the empty text."""

    @F.udf("string", useArrow=True)
    def text(ids):
        return None if ids is None else model(path).decode(list(ids))

    return rows.withColumn("text", text("ids"))
