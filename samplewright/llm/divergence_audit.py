"""How a language's sources differ in their words: distances of all pairs, and the terms that stand out.

Sort-based streaming. Every task counts (lang, source, term) over its documents
and emits a row for each when its table is full; the rows are repartitioned by
(lang, term) and sorted by (lang, term, source, document). One scan over the
runs then adds up occurrences by source and documents by term, and lets the
terms pass that enough documents of their language have. A second scan, over
runs of (lang, block of sources, block of sources, term), adds up the distances
of the pairs of sources, emitting partial sums at the end of a run. So tasks
hold one term's sources or one block of pairs, never a language or a source.

Hot keys. A term that all documents have arrives as one row a task and source,
not one a document. Sources go in blocks of BLOCK, so a task's matrix has a
fixed size however many sources a language has; the terms of a block pair are
dealt over all tasks. The result itself has a row for each two sources of a
language.

Defined results. Null text, lang and source are ''. Every row is a document of
its own, repeated ones too. Terms are the longest runs of letters A to Z and
characters beyond ASCII, only A to Z lowered. Groups without terms, and
languages without kept terms, have their pairs, with value 0 in the latter case.
Counts are exact at any size: decimals of 38 digits. An empty table gives an
empty table. Only text, lang, source and the id are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_spread, on_workers, table, written

MIN_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of counts that a task holds before it emits them, bytes of a text that are split at once, sources of a block.
HELD, PIECE, BLOCK = 1 << 19, 1 << 22, 128
#: Bits of a term's occurrences beside its documents; a task emits long before they are full.
SHIFT = 40
#: Every byte that isn't part of a term becomes a blank, A to Z become a to z; bytes beyond ASCII are parts of letters.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_COUNTS = "lang string, term string, source string, document long, n_documents long, n long"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, some at a time."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if len(folded) - at > PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counts(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """df (id, text, lang, source) to each task's counts: documents and occurrences by lang, term and source."""
    on_workers(df.sparkSession)

    def emitted(held: dict, first: int) -> pd.DataFrame:
        parts = []
        for (lang, source), own in held.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            term = b"\n".join(own).decode("utf-8", "surrogatepass").split("\n") if own else []
            parts.append(pd.DataFrame({"lang": lang, "term": term, "source": source, "document": first, "n_documents": both >> SHIFT, "n": both & (1 << SHIFT) - 1}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["lang", "term", "source", "document", "n_documents", "n"])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Documents and occurrences of a term in one number.
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size, one, first, seen, docs = 0, 1 << SHIFT, None, 0, 0
        for batch in batches:
            for doc, text, lang, source in zip(batch["_id"], batch["text"], batch["lang"], batch["source"], strict=True):
                found: Counter[bytes] = Counter()
                for some in terms(text):
                    found.update(some)
                first = doc if first is None else first
                own = held.setdefault((lang, source), {})
                size -= len(own)
                seen, docs = seen + found.total(), docs + 1
                get = own.get
                for term, n in found.items():
                    own[term] = get(term, 0) + one + n
                size += len(own)
                if size > HELD or seen >= one >> 2 or docs >= 1 << 62 - SHIFT:
                    yield emitted(held, first)
                    held, size, first, seen, docs = {}, 0, None, 0, 0
        yield emitted(held, first or 0)

    blank = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return df.select(F.coalesce(F.col(id), F.lit(-1)).cast("long").alias("_id"), blank("text"), blank("lang"), blank("source")).mapInPandas(of, _COUNTS)


def _arrow_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted counts to (lang, term, source, n, total, head): the kept terms' occurrences by source and in all; head on a term's first row.

    Columns stay in Arrow, as Python strings would cost more than the scan.
    """
    held: list[pa.Table] = []
    key = ["lang", "term", "source"]

    def scanned(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        other = {c: pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy() for c in key}
        new = np.concatenate(([True], other["lang"] | other["term"]))
        part = np.flatnonzero(new | np.concatenate(([True], other["source"])))
        run = np.flatnonzero(new[part])  # a term's first source
        n, docs = (np.add.reduceat(rows[c].to_numpy(), part) for c in ("n", "n_documents"))
        length = np.diff(np.append(run, len(part)))
        kept = np.repeat(np.add.reduceat(docs, run) >= least, length)
        total, head = np.repeat(np.add.reduceat(n, run), length), new[part]
        out = rows.select(key).take(pa.array(part[kept]))
        for name, values in (("n", n), ("total", total), ("head", head)):
            out = out.append_column(name, pa.array(values[kept]))
        return out.to_batches()

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]).select([*key, "n_documents", "n"])
        last = (rows["lang"][-1], rows["term"][-1])
        ended = np.flatnonzero(pc.or_(pc.not_equal(rows["lang"], last[0]), pc.not_equal(rows["term"], last[1])).to_numpy())
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if held and (cut or (held[-1]["lang"][-1], held[-1]["term"][-1]) != last):
            yield from scanned(pa.concat_tables([*held, rows[:cut]]))
            held = []
        elif cut:
            yield from scanned(rows[:cut])
        held.append(rows[cut:])
        if len(held) > 1:
            # A term that goes on: one row for each of its sources is enough.
            sums = pa.concat_tables(held).group_by(key, use_threads=False).aggregate([("n_documents", "sum"), ("n", "sum")])
            held = [pa.table({c: sums[c if c in key else f"{c}_sum"] for c in rows.column_names})]
    if held:
        yield from scanned(pa.concat_tables(held))


def _runs(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The scan of _arrow_runs() on pandas frames."""
    found = _arrow_runs((pa.RecordBatch.from_pandas(batch, preserve_index=False) for batch in batches), least)
    return (batch.to_pandas() for batch in found)


def kept_terms(df: DataFrame, least: int = MIN_DOCUMENTS, id: str = "doc_id") -> DataFrame:
    """(lang, term, source, n, total, head) of the terms that at least so many documents of their language have."""
    sorted_ = counts(df, id).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document").drop("document")
    return sorted_.mapInArrow(lambda batches: _arrow_runs(batches, least), "lang string, term string, source string, n long, total long, head boolean")


def _share(n: Column, all_: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (all_ + SMOOTHING * v)), exactly; 0 where there are no terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    below = (all_ + SMOOTHING * v).cast("decimal(20,0)")
    return F.when(v == 0, 0).otherwise(1 + F.call_function("div", above, F.when(below > 0, below))).cast("long")


def groups(df: DataFrame, kept: DataFrame) -> DataFrame:
    """A row a lang and source: place i in the lang (from 0), n_group, n_lang, v (kept terms of the lang), p0 (share of a term that it lacks), _rows."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("_rows"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("head").alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    there = df.select(*blank).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    there = there.select("lang", "source", *map(zero, ("n_group", "n_lang", "v", "_rows")))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    return there.select("*", place.alias("i"), _share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")).alias("p0"))


def _vectors(shares: DataFrame, by_group: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Shares by block of sources: (lang, block, base), and (lang, term, block, p) with p the places and shares of the sources that have the term."""
    block = F.floor(F.col("i") / size).cast("int").alias("block")
    pack = lambda p: F.array_sort(F.collect_list(F.struct((F.col("i") % size).alias("at"), F.col(p).alias("p"))))
    base = by_group.groupBy("lang", block).agg(F.transform(pack("p0"), lambda x: x["p"]).alias("base"))
    return base, shares.groupBy("lang", "term", block).agg(pack("p").alias("p"))


def _summed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (lang, a, b, term, block) to partial sums of the distances of a's sources to b's; rows without a term carry the blocks' bases."""
    at, left, right, sums = None, None, None, None
    term, p, q = None, None, None

    def ended() -> pd.DataFrame:
        lang, a, b = at
        i, j = np.indices(sums.shape)
        some = i.ravel() < j.ravel() if a == b else slice(None)
        return pd.DataFrame({"lang": lang, "i": a * size + i.ravel()[some], "j": b * size + j.ravel()[some], "value": sums.ravel()[some]})

    for batch in batches:
        for lang, a, b, word, block, base, places, shares in zip(*(batch[c] for c in ("lang", "a", "b", "term", "block", "base", "places", "shares")), strict=True):
            if (lang, a, b) != at:
                if at is not None:
                    if term is not None:
                        sums += np.abs(p[:, None] - q[None, :])
                    yield ended()
                at, left, right, sums, term = (lang, a, b), None, None, None, None
            if word is None:
                left = base if block == a else left
                right = base if block == b else right
                sums = np.zeros((len(left), len(right)), np.int64) if left is not None and right is not None else None
                continue
            if word != term:
                if term is not None:
                    sums += np.abs(p[:, None] - q[None, :])
                term, p, q = word, left, right
            if block == a:
                p = left.copy()
                p[places] = shares
            if block == b:
                q = right.copy()
                q[places] = shares
    if at is not None:
        if term is not None:
            sums += np.abs(p[:, None] - q[None, :])
        yield ended()


def pair_sums(shares: DataFrame, by_group: DataFrame, size: int = BLOCK) -> DataFrame:
    """(lang, i, j, value) for i < j: the distances of all pairs of a lang's sources, in blocks of so many sources."""
    spark = shares.sparkSession
    on_workers(spark)
    base, vectors = _vectors(shares, by_group, size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = by_group.groupBy("lang").agg(F.floor(F.max("i") / size).cast("int").alias("last"))
    # A block meets the blocks from 0 to the last, itself too: the smaller one is a, the larger b.
    other = F.explode(F.sequence(F.lit(0), "last")).alias("other")
    pair = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("places", "shares")]
    deal = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    bases = base.join(blocks, "lang").select("*", other).select("lang", *pair, F.lit(None).cast("string").alias("term"), "block", "base", *none, deal)
    split = [F.transform("p", lambda x: x[c].cast("long")).alias(n) for c, n in (("at", "places"), ("p", "shares"))]
    deal = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")
    rows = vectors.join(F.broadcast(blocks) if _few(blocks) else blocks, "lang").select("*", other)
    rows = rows.select("lang", *pair, "term", "block", F.lit(None).cast("array<long>").alias("base"), *split, deal)
    met = bases.unionByName(rows).repartition(parts, "part").sortWithinPartitions("lang", "a", "b", F.asc_nulls_first("term"), "block")
    found = met.mapInPandas(lambda batches: _summed(batches, size), "lang string, i int, j int, value long")
    return found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _few(by_lang: DataFrame, most: int = 10_000) -> bool:
    """Whether so few languages that a row for each may be sent to all tasks."""
    return by_lang.limit(most + 1).count() <= most


def audit(df: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP, id: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups: pairs by distance, terms by what they exceed the lang's share."""
    kept = written(kept_terms(df, least, id))
    by_group = written(groups(df, kept))
    shares = joined_spread(kept, by_group.select("lang", "source", "n_group", "n_lang", "v", "i", "_rows"), ["lang", "source"])
    shares = written(
        shares.select(
            "lang", "source", "term", "i",
            _share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), _share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"),
        )
    )
    halves = written(pair_sums(shares, by_group, size))
    both = halves.unionByName(halves.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), "value"))
    name = lambda i, as_: by_group.select("lang", F.col("i").alias(i), F.col("source").alias(as_))
    pairs = both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.select("*", rank).unionByName(own.select("*", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: distances and terms of all sources."""
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op13."""
    share = f"1 + ({SCALE}::HUGEINT * ({{n}} + {SMOOTHING})) // ({{all}} + {SMOOTHING} * v)"
    return rf"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    found AS MATERIALIZED (
        SELECT d, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs)),
    terms AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM found GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCUMENTS}),
    langs AS (SELECT lang, coalesce(any_value(n), 0)::HUGEINT AS n_lang, coalesce(any_value(k), 0)::HUGEINT AS v
        FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, sum(total) AS n, count(*) AS k FROM terms GROUP BY lang) USING (lang) GROUP BY lang),
    own AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN terms USING (lang, term) GROUP BY ALL),
    grps AS MATERIALIZED (SELECT lang, source, coalesce(any_value(m), 0)::HUGEINT AS n_group, any_value(n_lang) AS n_lang, any_value(v) AS v
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS m FROM own GROUP BY ALL) USING (lang, source) JOIN langs USING (lang) GROUP BY lang, source),
    shares AS MATERIALIZED (
        SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n, {share.format(n="coalesce(n, 0)", all="n_group")} AS p, {share.format(n="total", all="n_lang")} AS q
        FROM grps g JOIN terms t USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = t.term),
    pairs AS (SELECT lang, source, item, sum(f) AS value FROM (
            SELECT a.lang, a.source, b.source AS item, abs(a.p - b.p) AS f FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            UNION ALL SELECT a.lang, a.source, b.source, 0 FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source) GROUP BY ALL)
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INTEGER AS r
    FROM shares WHERE n > 0 AND p > q QUALIFY r <= {TOP}
    """
