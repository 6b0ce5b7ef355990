"""URL filters: pattern rules found by their rarest literal token.

A pattern is literal text with `*` (anything), `^` (a separator or an end), a
leading `|` (the start) or `||` (the start of the host or of one of its labels).
Its literal tokens are the runs of letters and digits that any fitting address
must hold as whole tokens. Each rule is filed under the one of them that is
rarest in the table at hand. An address's tokens fetch candidate rules and only
those run their regular expression. Of fitting rules the lower tier wins, then
the longer pattern, then the name. Case folds for A to Z only, everywhere.

Up to MAX_BROADCAST rules are sent to the tasks as an index; more are joined by
token, address by address.

Defined results. Null urls, and urls without "://", have an empty host and path,
fit no rule and are allowed. Repeated rows are judged each on its own. An empty
table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table

MAX_BROADCAST = 100_000
TOKEN = r"[a-z0-9]+"
#: Beyond MAX_BROADCAST rules, tasks that share the addresses of one token.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


class Rule(NamedTuple):
    name: str
    pattern: str
    action: str
    tier: int = 1


#: Fixed rules: a host with its subdomains and the start of a path.
FIXED = [
    Rule(name, f"||{name}", action, 0)
    for name, action in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
]
#: Names of sites that sell, bet or spam, wherever a whole token has them.
NAMES = ("adult", "bets", "betting", "casino", "casinos", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Further rules of hosts, paths and wildcards: adverts, trackers, machinery of sites, offers.
WIDER = [
    ("ad-host", "||ads.*/", "block"), ("ad-server", "||adserver.*/", "block"), ("ad-click", "^ad^click^", "block"), ("banner-ad", "/banner^*^ad^", "block"),
    ("tracker", "/track^pixel^", "block"), ("redirect", "^redirect^url^", "block"), ("login", "/wp-login.php^", "block"), ("admin", "/wp-admin^", "block"),
    ("cgi", "/cgi-bin^*.cgi^", "block"), ("free-download", "^free^download^", "block"), ("buy-cheap", "^buy^*^cheap^", "block"), ("win-prize", "^win^*^prize^", "block"),
    ("session", "^phpsessid^", "block"), ("sex-chat", "^live^sex^", "block"), ("slots", "^online^slots^", "block"), ("loans", "^payday^loans^", "block"),
    ("health", "^casino^*^addiction^help^", "allow"), ("spam-report", "^report^spam^", "allow"), ("anti-spam", "^anti^spam^", "allow"),
]
PATTERNS = [Rule(word, f"^{word}^", "block") for word in NAMES] + [Rule(*r) for r in WIDER]


def expression(rule: Rule) -> str:
    """The regular expression of a rule on host + path; tier 0 minds case, others fold A to Z only.

    Nothing but explicit classes, so Python, Java and RE2 read it alike.
    """
    body, start = rule.pattern, ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    parts = {"*": r"[\s\S]*", "^": "(?:[^A-Za-z0-9]|^|$)"}
    letter = lambda c: f"[{c.lower()}{c.upper()}]" if rule.tier and c.isascii() and c.isalpha() else re.escape(c)
    return start + "".join(parts.get(c) or letter(c) for c in body)


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that an address needs whole: bounded on both sides within the pattern."""
    body = rule.pattern.translate(_FOLD)
    at = len(body) - len(body.lstrip("|"))
    return [m.group() for m in re.finditer(TOKEN, body) if (m.start() == at > 0 or m.start() > at and body[m.start() - 1] != "*") and m.end() < len(body) and body[m.end()] != "*"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without a "://"."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(address, _UPPER, _LOWER), F.lit(TOKEN), F.lit(0)))


def filed(addresses: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token in addresses (host, path); under "" those without any."""
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    spark = addresses.sparkSession
    tokens = F.explode(_tokens(F.concat("host", "path")))
    of_rules = spark.createDataFrame([(t,) for t in wanted], "token string")
    if len(wanted) <= MAX_BROADCAST:
        of_rules = F.broadcast(of_rules)
    # Counted within each task before any shuffle, so a token that all rows share costs no more than a rare one.
    # At most one row for each token of the rules comes back.
    counts = addresses.select(tokens.alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.join(of_rules, "token", "left_semi").collect()}
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        out.setdefault(min(literal_tokens(rule), key=lambda t: (seen.get(t, 0), t), default=""), []).append(rule)
    return out


def _rank(rule: Rule) -> tuple:
    return (rule.tier, -len(rule.pattern), rule.name)


def judged(df: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep, then host, path, the deciding rule's name, tier and action (null: none fits).

    A rule is compiled when a token first fetches it, once a task. Rules without a
    token that an address must have whole are tried on every address, so a list
    should have few of them; beyond MAX_BROADCAST rules that is a row for each
    distinct address and such rule.
    """
    spark = df.sparkSession
    on_workers(spark)
    host, path = host_and_path(F.col(url))
    # One struct for what is kept: no names clash with these.
    rows = df.select(F.struct(*keep).alias("_k"), host.alias("host"), path.alias("path"))
    index = filed(rows, rules)
    if len(rules) > MAX_BROADCAST:
        return _joined(rows, index).select("_k.*", "host", "path", "name", "tier", "action")
    sent = spark.sparkContext.broadcast(index)

    @F.pandas_udf("name string, tier int, action string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        filed_, ready, none = sent.value, {}, (None, None, None)

        def fetched(token: str) -> list[tuple]:
            if token not in ready:
                ready[token] = [(_rank(r), re.compile(expression(r)), r) for r in filed_[token]]
            return ready[token]

        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths, strict=True):
                address = h + p
                tokens = [t for t in {"", *re.findall(TOKEN, address.translate(_FOLD))} if t in filed_] if address else []
                fits = [(rank, r) for t in tokens for rank, regex, r in fetched(t) if regex.search(address)]
                best = min(fits)[1] if fits else None
                out.append((best.name, best.tier, best.action) if best else none)
            yield pd.DataFrame(out, columns=["name", "tier", "action"]).astype({"tier": "Int32"})

    return rows.select("_k", "host", "path", decide("host", "path").alias("_r")).select("_k.*", "host", "path", "_r.*")


def _joined(rows: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The same for any number of rules: distinct addresses joined with rules by token."""
    spark = rows.sparkSession
    flat = [(t, expression(r), *_rank(r), r.name, r.action) for t, own in index.items() for r in own]
    by_token = spark.createDataFrame(flat, "token string, regex string, tier int, length int, tie string, name string, action string")
    by_token = by_token.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    address = F.concat("host", "path")
    distinct = rows.select("host", "path").distinct().where(address != "").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    tokens = F.array_union(F.array(F.lit("")), _tokens(address))
    fits = distinct.select("host", "path", "salt", F.explode(tokens).alias("token")).join(by_token, ["token", "salt"]).where(F.expr("concat(host, path) rlike regex"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("tier", "length", "tie", "name", "action")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select("_k", "host", "path", "b.name", "b.tier", "b.action")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: host, path, rule and verdict of every page."""
    fixed = F.col("tier") == 0
    return judged(table(spark, sf_dir, "pages"), FIXED + PATTERNS).select(
        "page_id", "host", "path", F.when(fixed, F.col("name")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict")
    )


def oracle() -> str:
    """The same in DuckDB, by trying all rules on all pages."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    fixed = sorted(FIXED, key=_rank)
    arms = [(r.name, r.action, fits(r.name.split("/")[0], r.name[r.name.index("/") :])) for r in fixed]
    wider = sorted(PATTERNS, key=_rank)
    verdicts = " ".join(f"WHEN regexp_matches(host || path, '{expression(r)}') THEN '{r.action}'" for r in wider)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {test} THEN '{name}'" for name, _, test in arms)} END AS rule,
  CASE {" ".join(f"WHEN {test} THEN '{action}'" for _, action, test in arms)}
  {verdicts} ELSE 'allow' END AS verdict
FROM b"""
