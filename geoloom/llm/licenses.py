"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its words in lower case. The rules' keywords are looked up among them, and only rules whose keyword is there run
their regex. Detections are then ordered by start, longer first, stronger priority first; one that lies within an earlier one
of equal or stronger priority is suppressed. Nothing is shuffled: a document is scanned where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.license_rules import RULES, Rule

#: What separates words: ASCII characters that are neither digits nor letters in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that count wherever their words stand in a row, and their labels; in the order of the labels' columns.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Confidence in a detection of each priority; phrases count as priority PHRASE.
CONFIDENCE, PHRASE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}, 2
#: Characters that no word has, for the begin and end of a match.
OPEN, CLOSE = "\x01", "\x02"


def compiled(regex: str) -> str:
    """A rule's regex for texts in which every word has a space before and a full stop after it, so that matches never share a character."""
    return " (?:" + regex.replace(" ?", r"(?:\. )?").replace(" ", r"\. ") + r")\."


def _places(text: Column, regex: Column) -> Column:
    """Array of (start, stop) in words of the matches of ``regex``. Linear in the text: matches are marked, and marks found among the words."""
    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{OPEN}$0{CLOSE}")), " ")
    at = lambda mark: F.filter(F.transform(marked, lambda w, k: F.when(F.contains(w, F.lit(mark)), k)), lambda k: k.isNotNull())
    return F.when(F.regexp_like(text, regex), F.arrays_zip(at(OPEN).alias("start"), at(CLOSE).alias("stop"))).otherwise(
        F.array().cast("array<struct<start:int,stop:int>>")
    )


def _plain(docs: DataFrame) -> DataFrame:
    trimmed = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), rf"^{BETWEEN}|{BETWEEN}\z", "")
    rows = docs.select("doc_id", trimmed.alias("trimmed"))
    rows = rows.select("doc_id", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BETWEEN)).alias("words"))
    return rows.select("doc_id", "words", F.concat(F.lit(" "), F.array_join("words", ". "), F.lit(".")).alias("plain"))


def _detections(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, words, plain and ``hits``: array of (start, minus_stop, priority, number) of all rules, in the order of suppression."""
    keywords, regexes = F.lit([r.keyword for r in rules]), F.lit([compiled(r.regex) for r in rules])
    priorities = F.lit([r.priority for r in rules])
    rows = _plain(docs).withColumn("there", F.array_intersect("words", F.lit(sorted({r.keyword for r in rules}))))
    gated = F.filter(F.lit(list(range(len(rules)))), lambda k: F.array_contains("there", F.get(keywords, k)))
    rows = rows.withColumn("gated", F.when(F.size("there") > 0, gated).otherwise(F.array().cast("array<int>")))

    def found(k: Column) -> Column:
        one = lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("minus_stop"), F.get(priorities, k).alias("priority"), k.alias("number"))
        return F.transform(_places(F.col("plain"), F.get(regexes, k)), one)

    return rows.select("doc_id", "words", "plain", F.array_sort(F.flatten(F.transform("gated", found))).alias("hits"))


def hits(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every rule's detections before suppression, a row each: doc_id, label, number, priority, start and stop (words from 0, end exclusive)."""
    labels = F.lit([r.label for r in rules])
    return _detections(docs, rules).select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", F.get(labels, F.col("h.number")).alias("label"), "h.number", "h.priority", "h.start", (-F.col("h.minus_stop")).alias("stop")
    )


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The licenses that every whole text names.

    docs: doc_id, text; other columns are ignored, repeated rows stay, a null text is empty. A-Z become a-z; words are runs of digits, a-z
    and characters beyond ASCII. Returns doc_id; n_words; n_base, first_word, last_word (places of PHRASES, the smallest and the
    largest start in words from 0, null without one); base_labels and labels (distinct, sorted, comma-joined: those of phrases;
    those and the rules' kept detections); n_hits and n_kept (detections before and after suppression); score (0 to 1: the
    confidence in the strongest priority found, 0 without a label).

    A detection is suppressed if an earlier one, by start, then longer, then priority, then rule, ends no sooner and is of
    equal or stronger priority. One pass with the furthest end of each priority settles this, since a suppressed detection
    suppresses nothing that its suppressor does not.
    """
    labels = F.lit([r.label for r in rules])
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rows = _detections(docs, rules)
    for k, (phrase, _) in enumerate(PHRASES):
        spoken = F.lit(phrase.replace(" ", ". "))
        rows = rows.withColumn(f"base_{k}", F.when(F.contains("plain", spoken), _places(F.col("plain"), F.lit(compiled(phrase)))).otherwise(none))
    far = F.array(*[F.lit(-1) for _ in CONFIDENCE])
    start = F.struct(far.alias("far"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("n"))

    def settle(acc: Column, h: Column) -> Column:
        stop, p = -h["minus_stop"], h["priority"]
        further = F.transform(acc["far"], lambda e, k: F.when(k + 1 >= p, F.greatest(e, stop)).otherwise(e))
        grown = F.struct(further.alias("far"), F.array_union(acc["kept"], F.array(h["number"])).alias("kept"), (acc["n"] + 1).alias("n"))
        return F.when(F.get(acc["far"], p - 1) >= stop, acc).otherwise(grown)

    starts = F.flatten(F.array(*[F.transform(f"base_{k}", lambda x: x["start"]) for k in range(len(PHRASES))]))
    based = F.array_compact(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), starts.alias("starts"), F.array_sort(based).alias("based"),
        F.size("hits").cast("long").alias("n_hits"), F.aggregate("hits", start, settle).alias("told"),
    )
    named = F.array_sort(F.array_distinct(F.concat("based", F.transform("told.kept", lambda k: F.get(labels, k)))))
    strongest = F.array_min(F.concat(
        F.transform("told.kept", lambda k: F.get(F.lit([r.priority for r in rules]), k)), F.when(F.size("based") > 0, F.array(F.lit(PHRASE))).otherwise(F.array().cast("array<int>"))
    ))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), F.array_join("based", ",").alias("base_labels"), F.array_join(named, ",").alias("labels"),
        "n_hits", F.col("told.n").cast("long").alias("n_kept"), F.coalesce(F.get(F.lit([0.0, *CONFIDENCE.values()]), strongest), F.lit(0.0)).alias("score"),
    )


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The scan as DuckDB SQL over the documents table."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({r.number},{quote(r.label)},{r.priority},{quote(r.keyword)},{quote(compiled(r.regex))})" for r in rules)
    phrases = ", ".join(f"({-1 - k},{quote(label)},{PHRASE},{quote(compiled(phrase))})" for k, (phrase, label) in enumerate(PHRASES))
    score = " ".join(f"WHEN {p} THEN {c}::DOUBLE" for p, c in CONFIDENCE.items())
    return f"""
WITH rules(number, label, priority, keyword, regex) AS (VALUES {values}),
phrases(number, label, priority, regex) AS (VALUES {phrases}),
rows AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '^{BETWEEN}|{BETWEEN}$', '', 'g') AS trimmed FROM documents),
plain AS (
  SELECT doc_id, row_id, CASE WHEN trimmed = '' THEN [] ELSE string_split_regex(trimmed, '{BETWEEN}') END AS words,
    ' ' || CASE WHEN trimmed = '' THEN '' ELSE regexp_replace(trimmed, '{BETWEEN}', '. ', 'g') END || '.' AS plain
  FROM rows),
wanted AS (
  SELECT row_id, plain, number, label, priority, regex FROM plain, rules WHERE list_contains(words, keyword)
  UNION ALL SELECT row_id, plain, number, label, priority, regex FROM plain, phrases),
marked AS (
  SELECT row_id, number, label, priority, string_split(regexp_replace(plain, regex, chr(1) || '\\0' || chr(2), 'g'), ' ') AS parts
  FROM wanted WHERE regexp_matches(plain, regex)),
places AS (
  SELECT row_id, number, label, priority,
    unnest(list_filter(range(len(parts)), lambda k: contains(parts[k + 1], chr(1)))) AS start,
    unnest(list_filter(range(len(parts)), lambda k: contains(parts[k + 1], chr(2)))) AS stop
  FROM marked),
judged AS (
  SELECT *, coalesce(max(stop) FILTER (WHERE priority <= 1) OVER w, -1) AS far1, coalesce(max(stop) FILTER (WHERE priority <= 2) OVER w, -1) AS far2,
    coalesce(max(stop) FILTER (WHERE priority <= 3) OVER w, -1) AS far3, coalesce(max(stop) OVER w, -1) AS far4
  FROM places WHERE number >= 0
  WINDOW w AS (PARTITION BY row_id ORDER BY start, stop DESC, priority, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT * FROM judged WHERE stop > CASE priority WHEN 1 THEN far1 WHEN 2 THEN far2 WHEN 3 THEN far3 ELSE far4 END),
base AS (SELECT row_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE number < 0 GROUP BY row_id),
named AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(priority) AS strongest
  FROM (SELECT row_id, label, priority FROM kept UNION ALL SELECT row_id, label, priority FROM places WHERE number < 0) GROUP BY row_id),
counts AS (SELECT row_id, count(*) AS n_hits FROM places WHERE number >= 0 GROUP BY row_id),
left_over AS (SELECT row_id, count(*) AS n_kept FROM kept GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(n_kept, 0)::BIGINT AS n_kept,
  CASE strongest {score} ELSE 0::DOUBLE END AS score
FROM plain LEFT JOIN base USING (row_id) LEFT JOIN named USING (row_id) LEFT JOIN counts USING (row_id) LEFT JOIN left_over USING (row_id)
"""
