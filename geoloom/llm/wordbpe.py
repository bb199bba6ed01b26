"""Word-level BPE of ``tokenizers`` JSON files: token counts by heap and linked list, and ids by the library.

Both cut a text at white space first. The vocabulary's normaliser and splitter never join or compare characters across
white space, so the tokens of a text are those of its words in order, and each distinct word is worked out once.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words kept by a worker before it starts anew; a bound on memory, not on results.
CACHE = 1_200_000

_ODD = "\x1c\x1d\x1e\x1f"
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")


def words(text: str) -> list[str]:
    """Runs of characters that are not Unicode White_Space (which, unlike ``str.split``, leaves out U+001C to U+001F)."""
    if any(c in text for c in _ODD):
        return [w for w in _BLANK.split(text) if w]
    return text.split()


def pre_tokens(word: str, pattern: regex.Pattern) -> list[str]:
    """The normalised pieces of a word, as the vocabulary's normaliser (NFC, lower case) and splitter give them."""
    if word.isascii():
        return [word.lower()] if word.isalpha() else pattern.findall(word.lower())
    plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
    return [plain] if plain.isalpha() else pattern.findall(plain)


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Word to number of tokens, worked out when first asked for."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.bytes = _byte_chars()
        self.vocab = model["vocab"]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, int] = {}
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if len(self.known) >= CACHE:
            self.known.clear()
        parts, n = [word], 0
        if self.special is not None and "<" in word and self.special.search(word):
            parts = self.special.split(word)
            n = len(parts) - 1
        for part in parts:
            for piece in pre_tokens(part, self.pieces):
                got = self.known.get(piece)
                if got is None:
                    got = self.known[piece] = self.count(piece)
                n += got
        self[word] = n
        return n

    def count(self, piece: str) -> int:
        """Initial symbols less merges. The heap holds adjacent pairs by rank, then place; stale ones are passed over."""
        symbols = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.vocab]
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Number of tokens of every text, without emitting ids.

    docs: doc_id, text; other columns are ignored. A null text counts as empty, and an empty one has no tokens. Rows
    are kept one for one, repeated ones included. Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    No shuffle; a worker holds one Arrow batch and at most CACHE words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            n = [sum(map(tokens.__getitem__, words(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


class Ids(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes, from the library.

    Distinct pieces of words are given to the library many at a time, joined by spaces; the ids of each end with the one
    whose symbol carries the vocabulary's end-of-word suffix. Words with a special token's string go there whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        for lo in range(0, len(new), 2_000):
            some = new[lo : lo + 2_000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the end of each piece")
            raw = ids.tobytes()
            self.known.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, [0, *ends.tolist()], ends.tolist()))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; words that are new are encoded together."""
        cut = [words(t) for t in texts]
        if len(self) >= CACHE:
            self.clear()
        if len(self.known) >= CACHE:
            self.known.clear()
        new = set().union(*cut).difference(self)
        plain = {w: w.lower() for w in new if w.isascii() and w.isalpha()}  # each is one piece
        parts = {}
        for w in new.difference(plain):
            if self.special is not None and "<" in w and self.special.search(w):
                self[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                parts[w] = pre_tokens(w, self.pieces)
        self._learn(list(set(plain.values()).union(*parts.values()).difference(self.known)))
        self.update(zip(plain, map(self.known.__getitem__, plain.values())))
        for w, ps in parts.items():
            self[w] = self.known[ps[0]] if len(ps) == 1 else b"".join(map(self.known.__getitem__, ps))
        for ws in cut:
            yield b"".join(map(self.__getitem__, ws))


@lru_cache(maxsize=2)
def library_ids(path: str) -> Ids:
    return Ids(path)
