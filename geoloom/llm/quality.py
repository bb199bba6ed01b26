"""Quality rules with weak supervision.

Rules vote good (1), junk (-1) or abstain (0). Junk is of several kinds, which different rules see; so the votes are modelled by
a latent class of good documents and one for each kind of junk. Expectation-maximisation over the counts of vote patterns
estimates each class's share and how its documents make every rule vote, and the posterior probability of being good decides.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import SPACE, stage

WINDOW = 8
STRETCH = 100
#: The rules that a kind of junk is first thought to be seen by. Only start values: the fit may end with others.
KINDS = (("symbols", "marks", "letters"), ("repeats", "variety", "lines"), ("word_length", "capitals", "sentences"))
#: Start values: a class's share, and chances of the votes junk, abstain and good on good documents, of a kind's own rules on its junk, of other
#: rules on junk. SMOOTH is added to each count.
SHARE, ON_GOOD, OWN, OTHER, SMOOTH = 0.7, (0.05, 0.15, 0.8), (0.7, 0.15, 0.15), (0.1, 0.2, 0.7), 0.5


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda body is evaluated anew for each element otherwise."""
    return F.get(F.transform(F.array(value), then), 0)


def _windows(words: Column) -> Column:
    """64-bit hashes of all runs of WINDOW words, in order; empty if the text is shorter."""
    steps = F.sequence(F.lit(0), F.size(words) - F.lit(WINDOW))
    return F.when(
        F.size(words) >= WINDOW,
        _let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.transform(steps, lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)])),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal windows are neighbours once sorted, then gaps are summed."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(o: Column) -> Column:
        flagged = F.transform(
            o,
            lambda x, i: F.when(
                ((i > 0) & (F.get(o, i - 1)["h"] == x["h"])) | ((i < F.size(o) - 1) & (F.get(o, i + 1)["h"] == x["h"])), x["i"]
            ),
        )
        return F.array_sort(F.array_compact(flagged))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        _let(order, repeated),
        start,
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )


def _varied(words: Column) -> Column:
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(words, i, STRETCH))))


def features(docs: DataFrame) -> DataFrame:
    """Counts per document, by DataFrame functions in one pass without a shuffle.

    docs: doc_id, text; other columns are ignored; a null text has no words. Words are runs of characters other than
    the six ASCII white spaces. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all as
    documented in :func:`quality`), n_varied (distinct words of each stretch of STRETCH words, summed), n_upper, n_lines (with a
    word), n_marks (runs of symbols), n_ends (full stops, exclamation and question marks).
    """
    text = F.coalesce("text", F.lit(""))
    blanks = "\x20\x09\x0a\x0b\x0c\x0d"
    rows = docs.select("doc_id", text.alias("text"))
    trimmed = F.regexp_replace("text", f"^[{SPACE}]+|[{SPACE}]+$", "")
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0))
    rows = rows.withColumn("windows", _windows(F.col("words")))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", blanks, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
        _let(F.col("words"), _varied).cast("long").alias("n_varied"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]+")).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long").alias("n_ends"),
    )


def votes() -> dict[str, Column]:
    """The rules: name to vote. Each may say good or junk, and abstains between; single votes may be wrong."""
    n, chars, lines = (F.greatest(F.col(k), F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))

    def rule(junk: Column, good: Column) -> Column:
        return F.when(junk, -1).when(good, 1).otherwise(0)

    mean, letters, ends = F.col("word_chars") / n, (F.col("word_chars") - F.col("n_symbols")) / n, F.col("n_ends") / n
    return {
        "symbols": rule(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") <= 0.02 * n),
        "word_length": rule((mean < 3.0) | (mean > 7.0), (mean >= 4.0) & (mean <= 6.2)),
        "repeats": rule(F.col("n_repeat_words") > 0.25 * n, F.col("n_repeat_words") <= 0.05 * n),
        "variety": rule(F.col("n_varied") < 0.35 * n, F.col("n_varied") >= 0.5 * n),
        "capitals": rule(F.col("n_upper") > 0.3 * chars, F.col("n_upper") <= 0.1 * chars),
        "lines": rule(F.col("n_dup_lines") > 0.3 * lines, F.col("n_dup_lines") <= 0.1 * lines),
        "marks": rule(F.col("n_marks") > 0.08 * n, F.col("n_marks") <= 0.02 * n),
        "sentences": rule((ends < 0.01) | (ends > 0.3), ends.between(0.03, 0.2)),
        "letters": rule(letters < 3.6, letters >= 4.0),
    }


def posterior(shares: list[float], chances: list[dict[str, tuple[float, float, float]]]) -> Column:
    """Array of the classes' probabilities, the good one first, given the vote columns.

    chances: for each class and rule those of the votes -1, 0 and 1.
    """
    # Numbers stand in array literals, which are not written into compiled code, so that all rounds of a fit share that code.
    logs = []
    for share, by in zip(shares, chances):
        held = F.lit([log(share)] + [log(x) for p in by.values() for x in p])
        total = F.get(held, F.lit(0))
        for k, name in enumerate(by):
            total = total + F.get(held, F.col(name) + (3 * k + 2))
        logs.append(total)
    scaled = lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    part = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    return _let(_let(F.array(*logs), scaled), part)


def fit(patterns: DataFrame, names: list[str], rounds: int = 20) -> tuple[list[float], list[dict[str, tuple[float, float, float]]]]:
    """Expectation-maximisation over ``patterns`` (a vote column per rule, and n), at most 3 ** len(names) rows.

    names: ``vote_`` and a rule's name. Returns the classes' shares and each class's chances of every rule's votes, the good class
    first. Each round is one aggregate of the pattern table; only its sums, three for each rule and class, reach the driver.
    That a rule abstains says something too. With no rows the start values stay.
    """
    kinds = [{f"vote_{k}" for k in kind} for kind in KINDS]
    shares = [SHARE] + [(1 - SHARE) / len(kinds)] * len(kinds)
    chances = [dict.fromkeys(names, ON_GOOD)] + [{k: OWN if k in kind else OTHER for k in names} for kind in kinds]
    classes = range(len(shares))
    for _ in range(rounds):
        weighed = patterns.withColumn("p", posterior(shares, chances)).select(
            "n", "p", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("vote")) for k in names])).alias("v")
        )
        got = weighed.groupBy("v.rule", "v.vote").agg(*[F.sum(F.col("n") * F.get("p", F.lit(c))).alias(f"c{c}") for c in classes]).collect()
        if not got:
            break
        sums = {(r.rule, r.vote): [r[f"c{c}"] for c in classes] for r in got}
        whole = [sum(sums.get((names[0], v), [0.0] * len(shares))[c] for v in (-1, 0, 1)) for c in classes]
        shares = [(x + 1) / (sum(whole) + len(shares)) for x in whole]
        chances = [
            {k: tuple((sums.get((k, v), [0.0] * len(shares))[c] + SMOOTH) / (whole[c] + 3 * SMOOTH) for v in (-1, 0, 1)) for k in names} for c in classes
        ]
    return shares, chances


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, base_failed, p_good and kept.

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines: lines (split at line
    feeds) that have a word and equal an earlier line; n_repeat_words: words inside 8-word windows found twice or more;
    base_failed: fewer than 20 words, or over 30 % of them in repeated windows; kept: not base_failed and the posterior
    probability of good at least ``least``. Null and empty texts have no words and fail. Counts, votes and the fit cover
    all rows; the fit sees only counts of vote patterns.
    """
    rules = votes()
    counted = stage(features(docs))
    voted = counted.select("*", *[c.alias(f"vote_{k}") for k, c in rules.items()])
    names = [f"vote_{k}" for k in rules]
    patterns = stage(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    shares, chances = fit(patterns, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("p_good", F.get(posterior(shares, chances), F.lit(0)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"), "p_good", *names,
        )
    )
