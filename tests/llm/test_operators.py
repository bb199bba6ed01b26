"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import pieces, queries
from geoloom.llm.jaccard import jaccard_join, prefix_length
from geoloom.llm.packing import fill, pack_documents
from geoloom.llm.pii import base_spans, find_pii, luhn, mask, spans
from geoloom.llm.quality import quality
from geoloom.llm.sharding import Leaf, place, shard, topology
from geoloom.llm.substrings import dedup_bytes, dedup_words, strip_repeats
from geoloom.llm.vectors import near_vectors
from geoloom.llm.wordbpe import Counter as TokenCounter
from geoloom.llm.wordbpe import Ids, count_tokens, words

rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@cache
def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, repeats within a text, and odd rows."""
    passage, base = prose(90), prose(120)
    texts: list[str | None] = [prose(rng.randint(1, 200)) for _ in range(25)]
    texts += [base] * 5
    for _ in range(40):
        w = base.split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(15)]
    texts += [f"{prose(10)} {passage} {passage}", "ab" * 900, "x " * 700, "", " \n\t ", None, "eins zwei", "éé" * 300, prose(6000)]
    rows = list(enumerate(texts))
    return [*rows, rows[3], (None, texts[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    return frame.withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("kept", F.lit("y")).withColumn("v", F.lit(2)).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df) -> list:
    return df.collect()


# Sharding


def test_shards(docs, nothing):
    rows = collected(shard(docs))
    assert len(rows) == docs.count() and shard(nothing).count() == 0
    texts = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 24) for r in rows)


def test_weight_changes_stay_in_their_subtrees(spark):
    keys = spark.range(20_000)
    before = [Leaf("a", "a0", 0), Leaf("a", "a1", 1), Leaf("b", "b0", 2), Leaf("b", "b1", 3)]
    after = [Leaf("a", "a0", 0, 2.0), *before[1:]]
    moved = keys.select(place(before, F.col("id")).alias("p"), place(after, F.col("id")).alias("q")).groupBy("p", "q").count().collect()
    assert {(r.p, r.q) for r in moved if r.p != r.q} <= {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1)}
    share = {r.p: 0 for r in moved}
    for r in moved:
        share[r.p] += r["count"]
    assert all(abs(n - 5000) < 350 for n in share.values())
    assert len(topology(27)) == 27 and topology(27)[:24] == topology(24)


# Quality


def test_quality(docs, nothing):
    assert quality(nothing).count() == 0
    found = quality(docs)
    rows = Counter(tuple(r)[:6] for r in found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want: Counter = Counter()
    for d, t in corpus():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want[d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)] += 1
    assert rows == want
    assert found.where("kept AND (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)").count() == 0


def test_quality_tells_junk_from_prose(spark):
    good = [(i, ". ".join(prose(12) for _ in range(8))) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(30)]
    junk += [(2000 + i, " | ".join(prose(60).split())) for i in range(30)]
    rows = quality(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()
    assert sum(r.kept for r in rows if r.doc_id < 1000) == 300
    assert sum(r.kept for r in rows if r.doc_id >= 1000) == 0


# Tokens

ODD = ["", "  a  b", "naïve Ünï 東京タワー\n\tx", "<|endoftext|>a<|startoftext|> b", "\x1c a", "a" * 700, "a\0b \0", "▁x ▁▁", "<0x0A> <s>", " " * 40 + "z", "ΣΑΣ İ ﬁ 한국", "don't we'll I'd", "1234 56", "😀😀 👍🏽"]


def odd_texts() -> list[str]:
    return ODD + ["".join(rng.choice("ab c\néÉ1!'st▁東<|>") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_counts_equal_the_library(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), TokenCounter(path)
    for t in odd_texts():
        assert sum(map(counter.__getitem__, words(t))) == len(library.encode(t, add_special_tokens=False).ids), t
    assert count_tokens(nothing, path).count() == 0
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in corpus())
    assert Counter(tuple(r) for r in count_tokens(docs, path).collect()) == want


def test_pieces_equal_the_library(docs, nothing):
    from sentencepiece import SentencePieceProcessor

    path = queries.vocabulary("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), pieces.model(path)
    texts = odd_texts()
    assert own.encode(texts) == library.encode(texts)
    flat = [i for ids in library.encode(texts) for i in ids]
    bounds = np.cumsum([0, *map(len, library.encode(texts))])
    assert [b.decode("utf-8", "replace") for b in own.decode_all(np.array(flat, np.int32), bounds)] == library.decode(library.encode(texts))
    assert [own.decode(i) for i in library.encode(texts)] == library.decode(library.encode(texts))
    assert pieces.encode(nothing, path).count() == 0
    got = pieces.encode(docs, path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((d, tuple(library.encode(t or ""))) for d, t in corpus())
    back = pieces.decode(got.select("doc_id", "ids", F.lit(1).alias("text_")), path).where("doc_id = 3").collect()
    assert {r.text for r in back} == {corpus()[3][1]}


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert pack_documents(nothing, path).count() == 0
    rows = pack_documents(docs, path).collect()
    want: Counter = Counter()
    for d, t in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            cut = ids[k : k + 2048]
            want[d, k // 2048, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_bins_are_as_full_as_can_be():
    counts = Counter(rng.randint(1, 700) for _ in range(3000))
    bins = list(fill(counts, 2048))
    assert Counter(n for b in bins for n in b) == counts
    assert len(bins) == -(-sum(n * k for n, k in counts.items()) // 2048)
    assert list(fill({}, 10)) == [] and list(fill({10: 2}, 10)) == [[10], [10]]


def test_ids_of_words():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, own, texts = Tokenizer.from_file(path), Ids(path), odd_texts()
    for t, b in zip(texts, own.of(texts)):
        assert np.frombuffer(b, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# Vectors


def test_vectors(spark):
    g = np.random.default_rng(3)
    rows: list = []
    for k in range(60):
        c = g.standard_normal(16)
        rows += [(10 * k + j, (c + g.standard_normal(16) * s).tolist()) for j, s in enumerate((0, 0.05, 0.08, 0.3))]
    rows += [(5000 + k, rows[0][1]) for k in range(5)] + [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [None] + [1.0] * 15), (6004, []), (6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, tile=40).collect()}
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near: dict = {i: [j for j, w in ok if j != i and len(w) == len(v) and v @ w >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)] for i, v in ok}
    for i, _ in rows:
        if i is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), min(seen) == i)
    assert near_vectors(frame.limit(0)).count() == 0


# Repeats


def masks(width: int, rows: list, key) -> list[np.ndarray]:
    seen = Counter(key(r[i : i + width]) for r in rows for i in range(len(r) - width + 1))
    out = []
    for r in rows:
        m = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[key(r[i : i + width])] > 1:
                m[i : i + width] = True
        out.append(m)
    return out


def test_repeated_bytes(docs, nothing):
    raw = [(t or "").encode() for _, t in corpus()]
    want: Counter = Counter()
    for (d, _), b, m in zip(corpus(), raw, masks(200, raw, bytes)):
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        want[d, len(b), int(m.sum()), runs, np.frombuffer(b, np.uint8)[~m].tobytes()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_bytes(docs).collect())
    assert got == want
    assert dedup_bytes(nothing).count() == 0
    left = strip_repeats(docs)
    assert left.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in left.collect())
    assert texts == Counter((d, t and np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")) for (d, t), b, m in zip(corpus(), raw, masks(200, raw, bytes)))


def test_repeated_words(docs, nothing):
    cut = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in corpus()]
    want = Counter((d, len(w), int(m.sum()), " ".join(x for x, g in zip(w, m) if not g)) for (d, _), w, m in zip(corpus(), cut, masks(35, cut, tuple)))
    assert Counter(tuple(r) for r in dedup_words(docs).collect()) == want
    assert dedup_words(nothing).count() == 0


# Jaccard


def test_jaccard(docs, nothing):
    sets = {}
    for d, t in corpus():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n = min(5, len(w))
        sets.setdefault(d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    copies = Counter(d for d, _ in corpus())
    near = {
        a: {b for b, t in sets.items() if b is not None and b != a and s & t and 10 * len(s & t) >= 8 * len(s | t)}
        for a, s in sets.items() if a is not None
    }
    got = [r for r in jaccard_join(docs, tile=10).collect()]
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_links == 0 and r.kept
            continue
        seen, todo = {r.doc_id}, [r.doc_id]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        links = sum(copies[b] for b in near[r.doc_id]) + copies[r.doc_id] - 1 if sets[r.doc_id] else 0
        assert (r.n_links, r.component_id, r.kept) == (links, min(seen), min(seen) == r.doc_id)
    assert jaccard_join(nothing).count() == 0
    assert prefix_length(0.8, 0.999) == 4


# Personal data


def slow_base(t: str) -> list:
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])


def test_base_spans():
    for _ in range(4000):
        t = "".join(rng.choice("ab@.@.-+1234567890 ()%") for _ in range(rng.randint(1, 80)))
        assert sorted(base_spans(t)) == slow_base(t), t
    assert base_spans("a" * 200_000 + "@" + "1" * 200_000) == [] and luhn("4111111111111111")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john (at) example (dot) com now", ["john (at) example (dot) com"]),
        ("write to john at example dot com", ["john at example dot com"]),
        ("call plus one two one two five five five oh one two three", ["plus one two one two five five five oh one two three"]),
        ("ip one nine two dot one six eight dot one dot one two ok", ["one nine two dot one six eight dot one dot one two"]),
        ("jоhn@exаmple.com", ["jоhn@exаmple.com"]),
        ("card ４１１１ １１１１ １１１１ １１１１.", ["４１１１ １１１１ １１１１ １１１１"]),
        ("look at the dot on this", []),
        ("we met at one two three places", []),
        ("one two three four", []),
    ],
)
def test_disguises(text, want):
    base, all_ = spans(text)
    assert [text[a:b] for a, b, _ in all_ if (a, b, _) not in base] == want


def test_pii_rows(docs, spark, nothing):
    assert find_pii(nothing).count() == 0 and find_pii(docs).count() == docs.count()
    frame = spark.createDataFrame([(1, "a.b@c.de and +1 (988) 555-2485, 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(frame).collect()}
    assert got[1].base == "email:0:8,phone:13:30,ip:32:40" == got[1].spans and got[2].base == ""
    assert [r.text for r in mask(frame).orderBy("doc_id").collect()] == ["<email> and <phone>, <ip>", None]


def test_registered_queries():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 11))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
