"""The mix: small sources, wide permutations, output shards."""

import importlib
import re
from collections import Counter

import duckdb
import pytest

mixing = importlib.import_module("samplewright.llm.mixing")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(f"s{s}d{k}w{w}" for w in range(24)), f"s{s:02}") for s in range(40) for k in [s]]
    rows += [(100 + k, " ".join(f"t{k}w{w}" for w in range(7 * k + 3)), "t") for k in range(30)] + [(200, " " + "u " * 3000, None), (None, None, "t"), (201, "", "u")]
    rows += [(300, "same words in every row", "hot")] * 200
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, target string, shard int")


def test_every_source_meets_its_target(spark, docs):
    taken, target, size = Counter(), {}, Counter()
    for r in mixing.mixed(docs).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
    rows = mixing.mixed(docs.where("doc_id is not null")).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        size[source[r["doc_id"]]] += r["size"]
        target[source[r["doc_id"]]] = r["target"]
    for s, want in target.items():
        assert abs(taken[s] - want) <= 0.5, s
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))


def test_permutations_reach_everywhere():
    for n in (7, 10**6, 2 * 10**11, 10**17):
        m = min(n, 20000)
        sql = f"SELECT id, id * {n // m}::BIGINT AS x, 0::BIGINT AS _y, 0::BIGINT AS _t FROM range({m}) t(id)"
        back = None
        for inverse in (False, True):
            for step in mixing.shuffle_steps("x", f"{n}::BIGINT", "5::BIGINT", inverse):
                for column, text in step.items():
                    sql = f"SELECT * REPLACE ({text} AS {column}) FROM ({sql})"
            if not inverse:
                with duckdb.connect() as c:
                    there = [r[0] for r in c.sql(f"SELECT x FROM ({sql}) ORDER BY id").fetchall()]
            else:
                with duckdb.connect() as c:
                    back = [r[0] for r in c.sql(f"SELECT x FROM ({sql}) ORDER BY id").fetchall()]
        at = [k * (n // m) for k in range(m)]
        assert back == at and len(set(there)) == m and 0 <= min(there) <= max(there) < n
        if n > 7:
            near = sum(min(abs(a - b), abs(a + b - n)) < 0.05 * n for a, b in zip(at, there, strict=True)) / m
            assert near < 0.23, (n, near)  # 0.19 where all places are alike


def test_blocks_fill_the_shards(spark, docs):
    found = mixing.blocks(docs).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    assert all(r["n_words"] == len(r["text"].split()) <= mixing.BLOCK and r["shard"] == r["slot"] // mixing.SHARD_SLOTS for r in found)
    words = Counter(w for r in found for w in r["text"].split())
    texts = Counter(w for r in mixing.mixed_texts(docs).collect() for w in r["text"].split())
    assert words == texts
    assert sum(words.values()) == sum(r["taken"] for r in mixing.mixed(docs).collect())
    assert mixing.mixed_texts(docs).columns == docs.columns


def test_shards_draw_from_all_sources(spark):
    sizes = spark.createDataFrame([(f"s{k}", 200_000 * (k + 1)) for k in range(4)], "source string, source_size long")
    sources = mixing.written(mixing.targets(sizes))
    total = {r["rank"]: r["n_slots"] for r in sources.collect()}
    share = {k: n / sum(total.values()) for k, n in total.items()}
    shards = Counter(r["shard"] for r in mixing.shard_counts(sources).collect())
    assert set(shards.values()) == {4}
    for r in mixing.shard_counts(sources).where(f"shard < {len(shards) - 1}").collect():
        n, p = mixing.SHARD_SLOTS, share[r["rank"]]
        assert abs(r["n"] - n * p) < 5 * (n * p * (1 - p)) ** 0.5


@pytest.mark.parametrize("inverse", [False, True])
def test_permutations_are_compiled_and_as_in_sql(spark, capsys, inverse):
    """No functions on arrays, which Spark only interprets, and no method longer than 8000 bytes, which the JVM only interprets."""
    sizes = [1, 2, 7, 1000, 10**6, mixing.PRIME, mixing.PRIME + 1, 2 * 10**11, 10**17]
    rows = [(k, n, s, x) for k, (n, s, x) in enumerate((n, s, x) for n in sizes for s in (0, 3, 90_000) for x in sorted({v * (n // min(n, 20)) for v in range(min(n, 20))}))]
    df = mixing._shuffled(spark.createDataFrame(rows, "id long, n long, salt long, x long"), "x", "n", "salt", inverse).where("x >= 0")
    df.explain()
    df.explain("codegen")
    shown = capsys.readouterr().out
    assert "lambda" not in shown.lower() and max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown))) < 8000
    sql = "SELECT *, 0::BIGINT AS _y, 0::BIGINT AS _t FROM given"
    with duckdb.connect() as c:
        c.execute("CREATE TABLE given (id BIGINT, n BIGINT, salt BIGINT, x BIGINT)")
        c.executemany("INSERT INTO given VALUES (?, ?, ?, ?)", rows)
        for r in range(mixing.ROUNDS):
            for step in mixing.shuffle_steps("x", "n", "salt", inverse)[3 * r : 3 * r + 3]:
                for column, text in step.items():
                    sql = f"SELECT * REPLACE ({text} AS {column}) FROM ({sql})"
            c.execute(f"CREATE TABLE r{r} AS {sql}")
            sql = f"SELECT * FROM r{r}"
        assert sorted(map(tuple, df.select("id", "x").collect())) == c.sql(f"SELECT id, x FROM r{mixing.ROUNDS - 1} ORDER BY id").fetchall()
