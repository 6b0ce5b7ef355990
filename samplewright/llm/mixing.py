"""Mixing sources to target weights, in DataFrame functions only.

Each source is a stream of words, its documents one after another in a
pseudorandom order, packed into blocks of `block` words. The mix is a row of
slots, cut into output shards. A permutation of all slots deals them to sources
so that each source gets its exact number; a shard's counts by source are a
multinomial draw given these totals (drawn free of them, small sources would
miss their targets). Within a source, slot k of pass k div n takes block
perm(k mod n), perm being the source's own permutation of its n blocks. A
source's last slot leaves out the words beyond its target. Documents and slots
then meet by block number.

Both kinds of permutation are swap-or-not shuffles: exact on any range up to
2^62, no table, the same on every run. Positions come from sums over (source,
bucket), so no task holds a whole source; buckets are hashes of ids.

Defined results. Null and empty texts have size 0 and take 0. A null source is
a source of its own, last in order. Equal rows are interchangeable. An empty
table gives an empty table. Only id, text and source are read, so clashing
names don't matter. The words taken of a source are its target, rounded.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_words, table, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK, SHARD_SLOTS, BUCKETS, ROUNDS = 64, 1024, 4096, 16
#: Sources up to this number are sent to all tasks; more are joined.
MAX_BROADCAST = 100_000
PRIME = 2147483647


def _constants(r: int) -> dict[str, int]:
    """Multipliers of round r: for the partner's offset (two draws, so that it covers any range) and for the coin."""
    power = lambda base, most=PRIME: base ** (r + 1) % PRIME % most
    return {"a": power(48271), "b": power(69621, 1000003), "c": power(16807), "d": power(39373, 1000003), "e": power(62089911), "f": power(742938285, 1000003), "g": power(950706376)}


#: Of round constants r.a to r.g, salt and n: where x may swap to, and the coin that decides, the same for both places.
OFFSET = f"((r.a + salt * r.b) % {PRIME} * {PRIME + 1} + (r.c + salt * r.d) % {PRIME}) % n"
COIN = f"((greatest(x, y) % {PRIME}) * r.e + (greatest(x, y) // {PRIME}) % {PRIME} * r.f + r.g + salt) % {PRIME}"


def shuffle_steps(x: str, n: str, salt: str, inverse: bool = False) -> list[dict[str, str]]:
    """DuckDB columns to replace, one after another, that permute x within 0 to n - 1.

    In each round x may swap places with its partner y; a bit hashed from the
    larger of both decides. The rounds backwards give the inverse.
    """
    out = []
    for r in range(ROUNDS)[:: -1 if inverse else 1]:
        fill = lambda sql, r=r: re.sub(r"\b(r\.[a-g]|salt|n|x|y)\b", lambda m: {"salt": salt, "n": n, "x": x, "y": "_y"}.get(m[0]) or str(_constants(r)[m[0][2:]]), sql)
        out += [{"_y": fill(f"((({OFFSET}) - x) % n + n) % n")}, {"_t": fill(COIN)}, {x: f"CASE WHEN ((_t * _t) % {PRIME} & 1024) > 0 THEN _y ELSE {x} END"}]
    return out


def _shuffled(df: DataFrame, x: str, n: str, salt: str, inverse: bool = False) -> DataFrame:
    """The same in Spark, a column upon a column each round, so that rounds are compiled, as functions on arrays are not.

    Every few rounds x goes through an array of one, exploded. Filters on x stay
    above it (below, each would nest all rounds within each other), and the rounds
    are compiled to several methods; the JVM only interprets long ones.
    """
    for k, r in enumerate(range(ROUNDS)[:: -1 if inverse else 1]):
        known = {"salt": f"({salt})", "n": f"({n})", "x": x, "y": "_y", **{f"r.{c}": f"{v}L" for c, v in _constants(r).items()}}
        fill = lambda sql, known=known: re.sub(r"\b(r\.[a-g]|salt|n|x|y)\b", lambda m: known[m[0]], sql.replace("//", "div"))
        coin = fill(COIN)
        df = df.withColumn("_y", F.expr(fill(f"pmod({OFFSET} - x, n)"))).withColumn(x, F.expr(f"IF(({coin}) * ({coin}) % {PRIME} & 1024 > 0, _y, {x})")).drop("_y")
        if k % 4 == 3:
            df = df.withColumn(x, F.explode(F.array(x)))
    return df


#: A pseudorandom number from an id, or from the size where the id is null.
ORDER = f"((((coalesce(doc_id, size) % {PRIME} + {PRIME}) % {PRIME}) * 48271 + 12345) % {PRIME}) * 69621 % {PRIME}"
WEIGHT = f"CASE (rank - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END"


#: From target, source_size, n_blocks and _at: whole passes over the source, words left for a last pass, words its short
#: block lacks, blocks of the last pass, all slots, and the words that the very last slot leaves out to meet the target.
SLOTS = {
    "_want": "CAST(floor(target + 0.5) AS BIGINT)",
    "_passes": "CASE WHEN source_size > 0 THEN _want // source_size ELSE 0 END",
    "_rest": "_want - _passes * source_size",
    "_lacks": "n_blocks * BLOCK - source_size",
    "_k": "CASE WHEN (_rest + BLOCK - 1) // BLOCK <= _at THEN (_rest + BLOCK - 1) // BLOCK ELSE (_rest + _lacks + BLOCK - 1) // BLOCK END",
    "n_slots": "_passes * n_blocks + _k",
    "cut": "CASE WHEN _k = 0 THEN 0 ELSE _k * BLOCK - (CASE WHEN _k > _at THEN _lacks ELSE 0 END) - _rest END",
}


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """sizes (source, source_size) to targets, slots and blocks of each source.

    Target is the level times the weight, but at most MOST times the size; the
    level is the first that, the most easily filled sources being full, the next
    one can take. One row a source goes through one task.
    """
    by_rank = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_rank).cast("long")).withColumn("weight", F.expr(WEIGHT))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filling = W.orderBy("ratio", "rank")
    before, onwards = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    level = (
        ranked.withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
        .withColumn("place", F.row_number().over(filling))
        .withColumn("level", (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onwards))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(everything))
    )
    out = level.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block))).withColumn("_at", F.greatest(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    # Where the last block, which may be short, comes in the source's order.
    out = _shuffled(out.where("n_blocks > 0"), "_at", "n_blocks", "rank", inverse=True).unionByName(out.where("n_blocks = 0"))
    for name, sql in SLOTS.items():
        out = out.withColumn(name, F.expr(sql.replace("//", "div").replace("BLOCK", str(block))))
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return out.select("source", "rank", "source_size", "target", "n_slots", "n_blocks", "cut", F.coalesce(F.sum("n_slots").over(upto), F.lit(0)).alias("first_slot"))


def slots(sources: DataFrame) -> DataFrame:
    """sources (from targets, written) to (shard, slot, rank, pass, block, cut), one row a slot; cut words at the block's end are left out."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    cell = max(1, -(-total // 1024))
    spans = sources.where("n_slots > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"first_slot div {cell}"), F.expr(f"(first_slot + n_slots - 1) div {cell}"))))
    spans = spans.select("cell", "rank", "first_slot", "n_slots", "n_blocks", F.col("cut").alias("_cut"))
    if n <= MAX_BROADCAST:
        spans = F.broadcast(spans)
    tasks = max(spark.sparkContext.defaultParallelism, total // 4_000_000)
    dealt = _shuffled(spark.range(0, total, 1, tasks).select(F.col("id").alias("slot"), F.col("id").alias("_p")), "_p", f"CAST({max(1, total)} AS BIGINT)", "CAST(0 AS BIGINT)")
    dealt = dealt.withColumn("cell", F.expr(f"_p div {cell}")).join(spans, "cell").where("_p >= first_slot AND _p < first_slot + n_slots")
    dealt = dealt.withColumn("_k", F.expr("_p - first_slot")).withColumn("pass", F.expr("_k div n_blocks")).withColumn("block", F.expr("_k % n_blocks"))
    dealt = dealt.withColumn("cut", F.when(F.col("_k") == F.col("n_slots") - 1, F.col("_cut")).otherwise(0))
    return _shuffled(dealt, "block", "n_blocks", "rank").select(F.expr(f"slot div {SHARD_SLOTS}").alias("shard"), "slot", "rank", "pass", "block", "cut")


def shard_counts(sources: DataFrame) -> DataFrame:
    """(shard, rank, n): how many slots of each output shard go to each source, a multinomial draw given the sources' totals."""
    return slots(sources).groupBy("shard", "rank").agg(F.count("*").alias("n"))


def positions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, ...) with rank, source_size, target and start in the stream."""
    small = F.broadcast(sources) if sources.count() <= MAX_BROADCAST else sources
    small = small.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    ordered = rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_m", F.expr(ORDER)).withColumn("bucket", F.expr(f"_m % {BUCKETS}"))
    sums = ordered.groupBy("rank", "bucket").agg(F.sum("size").alias("_sum"))
    upto = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("rank", "bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    within = W.partitionBy("rank", "bucket").orderBy("_m", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        ordered.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(base, ["rank", "bucket"])
        .withColumn("start", F.col("_base") + F.col("_before"))
        .drop("_m", "bucket", "_before", "_base")
    )


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed with a row for each block a document lies in: block, first and last word."""
    end = F.col("start") + F.col("size")
    numbers = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).otherwise(F.array(F.lit(-1).cast("long")))
    out = placed.withColumn("block", F.explode(numbers))
    return out.withColumn("low", F.greatest("start", F.col("block") * block)).withColumn("high", F.least(end, (F.col("block") + 1) * block))


def mixed(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) for every row of df; first_shard is the first output shard with one of its blocks."""
    rows = written(df.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block))
    times = slots(sources).groupBy("rank", "block").agg(F.count("*").alias("times"), F.sum("cut").alias("cut"), F.min("shard").alias("shard"))
    parts = pieces(positions(rows, sources), block).join(times, ["rank", "block"], "left")
    # Only a source's last slot is cut, so of a block's times at most one.
    lost = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut")))
    taken = F.coalesce(F.sum(F.col("times") * (F.col("high") - F.col("low")) - lost), F.lit(0)).alias("taken")
    first = F.min("shard").alias("first_shard")
    # Rows without words share a start; each counts as itself.
    none = parts.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    some = parts.where("size > 0").groupBy("rank", "start", "doc_id", "size", "source_size", "target").agg(taken, first)
    return some.select("doc_id", "size", "source_size", "target", "taken", "first_shard").unionByName(none)


def _takes(df: DataFrame, id: str, text: str, source: str, block: int) -> tuple[DataFrame, DataFrame]:
    """df, stored as one struct (_d) with a number for each row (_row), so that no names clash, and what slots take of it: (_row, size, start, shard, slot, pass, low, high) in words of the row."""
    stored = written(df.select(F.struct("*").alias("_d"), F.monotonically_increasing_id().alias("_row")))
    rows = written(stored.select("_row", F.col(f"_d.{id}").alias("doc_id"), F.col(f"_d.{source}").alias("source"), n_words(F.col(f"_d.{text}")).alias("size")))
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block))
    parts = pieces(positions(rows.where("size > 0"), sources), block).join(slots(sources), ["rank", "block"])
    high = F.least("high", F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut")).alias("high")
    took = parts.select("_row", "size", "start", "shard", "slot", "pass", "low", high).where("low < high")
    return stored, took.select("_row", "size", "start", "shard", "slot", "pass", (F.col("low") - F.col("start")).alias("low"), (F.col("high") - F.col("start")).alias("high"))


def _words(text: str):
    """A text's words with the white space after them; what precedes the first goes with it."""
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    joined = F.concat(F.array(F.concat(words[0], F.coalesce(F.get(words, F.lit(1)), F.lit("")))), F.slice(words, 3, 2147483647))
    return F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), joined).otherwise(words)


def mixed_texts(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as rows of df: for each document and pass, the text of the words taken.

    A document taken whole keeps its text as it is; otherwise the words taken
    stand with the white space that follows them. Rows without words are left out.
    """
    stored, takes = _takes(df, id, text, source, block)
    per_pass = takes.groupBy("_row", "pass", "size").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))
    per_row = per_pass.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pass", "size", "spans"))).alias("_takes"))
    taken = F.when(F.col("_whole"), F.col(f"_d.{text}")).otherwise(
        F.array_join(F.flatten(F.transform("_take.spans", lambda s: F.slice(F.col("_w"), s["low"].cast("int") + 1, (s["high"] - s["low"]).cast("int")))), "")
    )
    whole = F.expr("aggregate(_take.spans, 0L, (a, s) -> a + s.high - s.low) = _take.size")
    out = stored.join(per_row, "_row").withColumn("_w", _words(f"_d.{text}")).withColumn("_take", F.explode("_takes")).withColumn("_whole", whole)
    return out.select(F.col("_d").withField(text, taken).alias("_d")).select("_d.*")


def blocks(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as output shards: (shard, slot, n_words, text), the fixed-length blocks in their slots, words joined by a space.

    A slot holds `block` words; only a source's last block may be shorter, and the
    last slot that a source takes.
    """
    stored, takes = _takes(df, id, text, source, block)
    pieces_ = stored.select("_row", F.split(F.trim(F.regexp_replace(f"_d.{text}", r"[\x20\x09-\x0D]+", " ")), " ").alias("_w")).join(takes, "_row")
    pieces_ = pieces_.select("shard", "slot", "start", F.slice("_w", F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int")).alias("_p"))
    # A block is a stretch of the stream: at most `block` pieces.
    parts = pieces_.groupBy("shard", "slot").agg(F.array_sort(F.collect_list(F.struct("start", F.size("_p").alias("n"), F.array_join("_p", " ").alias("t")))).alias("_p"))
    return parts.select("shard", "slot", F.aggregate("_p", F.lit(0), lambda n, p: n + p["n"]).cast("long").alias("n_words"), F.array_join(F.transform("_p", lambda p: p["t"]), " ").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what the mix takes of every document."""
    return mixed(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB, with the same permutations."""

    def shuffled(name: str, inner: str, x: str, n: str, salt: str, inverse: bool = False) -> str:
        """CTEs, one a round, the last called name."""
        steps, ctes = shuffle_steps(x, n, salt, inverse), [f"{name}0 AS MATERIALIZED (SELECT *, 0::BIGINT AS _y, 0::BIGINT AS _t FROM ({inner}))"]
        for r in range(ROUNDS):
            sql = f"{name}{r}"
            for step in steps[3 * r : 3 * r + 3]:
                for column, text in step.items():
                    sql = f"(SELECT * REPLACE ({text} AS {column}) FROM {sql})"
            ctes.append(f"{name}{r + 1} AS MATERIALIZED {sql}")
        return ", ".join(ctes) + f", {name} AS (SELECT * EXCLUDE (_y, _t) FROM {name}{ROUNDS})"

    total = "(SELECT greatest(1, sum(n_slots)) FROM s)::BIGINT"
    dealt = shuffled("dealt", f"SELECT j, j AS p, {total} AS total FROM (SELECT unnest(range(coalesce((SELECT sum(n_slots) FROM s), 0)::BIGINT)) AS j)", "p", "total", "0::BIGINT")
    blocks = shuffled("blocks", f"SELECT rank, n_blocks, j // {SHARD_SLOTS} AS shard, CASE WHEN p - first_slot = n_slots - 1 THEN cut ELSE 0 END AS cut, (p - first_slot) % n_blocks AS block FROM dealt JOIN s ON p >= first_slot AND p < first_slot + n_slots", "block", "n_blocks", "rank")
    last = shuffled("l0", "SELECT * FROM s5 WHERE n_blocks > 0", "_at", "n_blocks", "rank", inverse=True).replace("l0 AS (SELECT", "l0 AS (SELECT * FROM s5 WHERE n_blocks = 0 UNION ALL BY NAME SELECT")
    steps = ",\n".join(f"l{k + 1} AS (SELECT *, ({sql.replace('BLOCK', str(BLOCK))})::BIGINT AS {name} FROM l{k})" for k, (name, sql) in enumerate(SLOTS.items()))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, {WEIGHT} AS weight FROM s0),
s2 AS (SELECT *, {MOST} * source_size / weight AS ratio FROM s1),
s3 AS (SELECT *, row_number() OVER f AS place,
  ({SHARE} * (SELECT sum(source_size) FROM s0) - coalesce(sum({MOST} * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s2 WINDOW f AS (ORDER BY ratio, rank)),
s4 AS (SELECT *, least({MOST} * source_size::DOUBLE, (SELECT min_by(level, place) FROM s3 WHERE level <= ratio) * weight) AS target FROM s3),
s5 AS (SELECT source, rank, source_size, target, ceil(source_size / {BLOCK})::BIGINT AS n_blocks, greatest(0, ceil(source_size / {BLOCK})::BIGINT - 1) AS _at FROM s4),
{last},
{steps},
s AS MATERIALIZED (SELECT *, coalesce(sum(n_slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot FROM l{len(SLOTS)}),
{dealt},
{blocks},
times AS (SELECT rank, block, count(*) AS times, sum(cut)::BIGINT AS cut, min(shard) AS shard FROM blocks GROUP BY rank, block),
m AS (SELECT doc_id, size, rank, source_size, target, {ORDER} AS m FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY m % {BUCKETS}, m, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  row_number() OVER () AS rid FROM m),
parts AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1) ELSE [-1] END) AS block FROM placed)
SELECT doc_id, size, source_size, target,
  coalesce(sum(times * (high - low) - greatest(0, high - greatest(low, least((block + 1) * {BLOCK}, source_size) - cut))) FILTER (size > 0), 0)::BIGINT AS taken,
  (min(shard) FILTER (size > 0))::BIGINT AS first_shard
FROM (SELECT *, greatest(start, block * {BLOCK}) AS low, least(start + size, (block + 1) * {BLOCK}) AS high FROM parts LEFT JOIN times USING (rank, block))
GROUP BY rid, doc_id, size, source_size, target"""
