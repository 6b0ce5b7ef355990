"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Documents are counted by
vote pattern, at most 3 ** len(RULES) rows whatever the corpus size; on these
counts expectation-maximisation estimates, for each rule, how often it is right
on good and on bad documents. The posterior probability of "good" then replaces
the usual all-rules-must-pass filter.

Defined results. Null and empty texts have no words, no votes beyond those on
the counts, and fail the base rules. Repeated rows are judged each on its own.
An empty table gives an empty table. Columns other than the id and the text are
not read, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, written

ROUNDS = 20
#: Beliefs before any data, with the weight of SEEN documents: how often a rule
#: votes bad, abstains and votes good on good and on bad documents.
SEEN = 10.0
PRIOR = 0.8
GOOD = (0.005, 0.4975, 0.4975)
BAD = (0.2, 0.4, 0.4)

#: Votes by name: SQL over the features, valid in Spark and in DuckDB.
RULES = {
    "symbols": "CASE WHEN 20 * n_symbols > n_words THEN -1 ELSE 0 END",
    "repeats": "CASE WHEN 10 * n_repeat_words > 4 * n_words THEN -1 WHEN 20 * n_repeat_words < n_words THEN 1 ELSE 0 END",
    "stutter": "CASE WHEN 10 * n_stutters > n_words THEN -1 ELSE 0 END",
    "capitals": "CASE WHEN 10 * n_capitals > 2 * word_chars THEN -1 ELSE 0 END",
    "shouting": "CASE WHEN 20 * n_shouts > n_words THEN -1 ELSE 0 END",
    "duplicate_lines": "CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN -1 WHEN n_dup_lines = 0 AND n_lines > 1 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 ELSE 0 END",
    "letters": "CASE WHEN 10 * n_letters < 9 * word_chars THEN -1 ELSE 0 END",
    "marked_words": "CASE WHEN 20 * n_marks > n_words THEN -1 ELSE 0 END",
}


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts that the rules look at, one row for each row of df."""
    t = F.coalesce(F.col(text), F.lit("")).alias("_t")
    words = df.select(*keep, t).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    # Hashes of words, then of windows: longs keep sets and sorts cheap.
    hashed = words.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_n", F.size("_w"))
    windows = F.expr("zip_with(zip_with(slice(_h, 1, _n - 2), slice(_h, 2, _n - 2), (a, b) -> xxhash64(a, b)), slice(_h, 3, _n - 2), (a, b) -> xxhash64(a, b))")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    step = (
        hashed.withColumn("_s", F.when(F.col("_n") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_l", lines)
        .withColumn("_stutters", F.expr("CASE WHEN _n < 2 THEN 0 ELSE size(filter(zip_with(slice(_h, 1, _n - 1), slice(_h, 2, _n - 1), (a, b) -> a = b), x -> x)) END"))
    )
    # Windows that occur again sit side by side once sorted with their places.
    again = "size(array_distinct(flatten(transform(array(array_sort(transform(_s, (h, i) -> struct(h, i)))), a -> flatten(transform(a, (x, k) -> IF((k > 0 AND a[k - 1].h = x.h) OR (k + 1 < size(a) AND a[k + 1].h = x.h), array(x.i, x.i + 1, x.i + 2), CAST(array() AS array<int>))))))))"
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    return step.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        (F.char_length("_t") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_s")) == F.size("_s"), F.lit(0)).otherwise(F.expr(again)).cast("long").alias("n_repeat_words"),
        F.col("_stutters").cast("long").alias("n_stutters"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_shouts"),
        count(r"[\p{L}\p{N}]").alias("n_letters"),
        count(r"[#*$%&|<>]+").alias("n_marks"),
    )


def _vote_key() -> Column:
    """A document's votes as one number: digits vote + 1 in base 3."""
    return sum((F.expr(f"({sql} + 1) * {3**k}") for k, sql in enumerate(RULES.values())), F.lit(0)).cast("int")


def _log_odds(votes: str, state: str) -> str:
    return f"ln({state}.prior / (1 - {state}.prior)) + aggregate(transform({votes}, (v, k) -> ln({state}.good[3 * k + v + 1] / {state}.bad[3 * k + v + 1])), 0D, (a, x) -> a + x)"


def learned(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """votes (key int) to (key, p_good): expectation-maximisation on pattern counts.

    The state holds the prior of "good" and, for good and for bad documents, how
    often each rule votes -1, 0 and 1. The counts of all patterns stand in one
    row, bounded by the number of rules.
    """
    n = len(RULES)
    counts = votes.groupBy("key").agg(F.count("*").alias("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("found"))
    pattern = f"transform(sequence(0, {n - 1}), k -> CAST(floor(p.key / power(3, k)) AS INT) % 3 - 1)"
    one = one.withColumn("patterns", F.expr(f"transform(found, p -> struct(p.key AS key, CAST(p.n AS DOUBLE) AS n, {pattern} AS v))"))
    odds = f"transform(patterns, p -> struct(p.v AS v, p.n AS n, 1 / (1 + exp(-({_log_odds('p.v', 's')}))) AS q))"
    rated = f"transform({odds}, p -> struct(p.v AS v, p.n * p.q AS g, p.n * (1 - p.q) AS b))"
    total = lambda what: f"aggregate(r, 0D, (a, p) -> a + {what})"
    rates = lambda mass, start: f"transform(sequence(0, {3 * n - 1}), c -> ({total(f'IF(p.v[CAST(floor(c / 3) AS INT)] = c % 3 - 1, p.{mass}, 0D)')} + {SEEN}D * {_array(start)}[c % 3]) / ({total('p.' + mass)} + {SEEN}D))"
    step = f"transform(array({rated}), r -> struct(({total('p.g')} + {PRIOR * SEEN}D) / ({total('p.g + p.b')} + {SEEN}D) AS prior, {rates('g', GOOD)} AS good, {rates('b', BAD)} AS bad))[0]"
    start = f"struct({PRIOR}D AS prior, flatten(array_repeat({_array(GOOD)}, {n})) AS good, flatten(array_repeat({_array(BAD)}, {n})) AS bad)"
    fitted = one.withColumn("state", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})"))
    return fitted.select("state", F.explode("patterns").alias("p")).select(
        F.col("p.key").alias("key"), F.expr(f"1 / (1 + exp(-({_log_odds('p.v', 'state')})))").alias("p_good")
    )


def _array(rates: tuple[float, ...]) -> str:
    return f"array({', '.join(f'{x}D' for x in rates)})"


def quality_votes(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior p_good and kept for every row of df."""
    counted = written(features(df, text, keep).withColumn("key", _vote_key()))
    # At most 3 ** len(RULES) rows, so it can be sent to every task.
    posterior = F.broadcast(learned(counted.select("key")))
    judged = counted.join(posterior, "key", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold)).drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: base counts and verdicts of every document."""
    return quality_votes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """The same in DuckDB: counts, then the rounds of estimation as one CTE each."""
    n = len(RULES)
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    votes = ", ".join(f"{sql} AS v{k}" for k, sql in enumerate(RULES.values()))
    names = ", ".join(f"v{k}" for k in range(n))
    rate = lambda c, k: f"CASE v{k} " + " ".join(f"WHEN {v} THEN s.{c}{k}_{v + 1}" for v in (-1, 0, 1)) + " END"
    odds = "ln(s.prior / (1 - s.prior)) + " + " + ".join(f"ln(({rate('g', k)}) / ({rate('b', k)}))" for k in range(n))
    cells = [(c, m, start, k, v) for c, m, start in (("g", "n * q", GOOD), ("b", "n * (1 - q)", BAD)) for k in range(n) for v in range(3)]
    steps = [f"s0 AS MATERIALIZED (SELECT {PRIOR}::DOUBLE AS prior, " + ", ".join(f"{start[v]}::DOUBLE AS {c}{k}_{v}" for c, _, start, k, v in cells) + ")"]
    for i in range(ROUNDS):
        steps.append(f"q{i} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM pat p, s{i} s)")
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT (sum(n * q) + {PRIOR * SEEN}) / (sum(n) + {SEEN}) AS prior, "
            + ", ".join(f"(coalesce(sum({m}) FILTER (v{k} = {v - 1}), 0) + {SEEN * start[v]}) / (sum({m}) + {SEEN}) AS {c}{k}_{v}" for c, m, start, k, v in cells)
            + f" FROM q{i})"
        )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {words} AS w FROM documents),
win AS (SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
win2 AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win2),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words,
  (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1]))::BIGINT AS n_stutters,
  len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_capitals,
  len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
  len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]'))::BIGINT AS n_letters,
  len(regexp_extract_all(t, '[#*$%&|<>]+'))::BIGINT AS n_marks
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
v AS (SELECT *, {votes} FROM f),
pat AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY {names}),
{", ".join(steps)},
judged AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS p_good FROM v, s{ROUNDS} s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p_good >= 0.5) AS kept
FROM judged"""
