"""URL filter: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower

#: tokens are runs of letters and digits; everything else separates
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A verdict for addresses (lower-cased host followed by path) in which `regex` is found.

    `tokens` are whole tokens that every such address holds. A rule without any is tried
    on every address. `length` ranks rules of one list; the longest wins, then the name.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with `path`."""
    tokens = re.findall(TOKEN, host.lower())
    # the last token of the path may go on in the url, so it only counts when it is closed
    tokens += re.findall(rf"(?<![A-Za-z0-9]){TOKEN}(?=[^A-Za-z0-9])", path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(dict.fromkeys(tokens)), len(host + path))


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits where the words stand next to each other in the host, whatever separates them."""
    body = r"[^a-z0-9/]+".join(map(re.escape, words))
    return Rule("-".join(words), verdict, rf"^(?:[^/]*[^a-z0-9/])?{body}(?:[^a-z0-9]|$)", tuple(words), sum(map(len, words)))


#: block lists of the default method: names that advertising and link farms use
DEFAULT_WORDS = (("spam", "farm"), ("cheap", "pills"), ("link", "farm"), ("casino",), ("porn",), ("xxx",), ("free", "download"), ("click", "bait"), ("viagra",),
                 ("payday", "loans"), ("adult", "content"), ("warez",))
DEFAULT_RULES = tuple(word_rule("block", *w) for w in DEFAULT_WORDS)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(address), F.lit(f"({TOKEN})"), F.lit(1)))


def token_counts(addresses: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many addresses hold each of the given tokens; the result is as long as the rules' token list."""
    found = (addresses.select(F.explode(_tokens(F.col("address"))).alias("token")).where(F.col("token").isin(tokens))
             .groupBy("token").agg(F.count("*").alias("n")))
    counts = {r["token"]: r["n"] for r in found.collect()}
    return {t: counts.get(t, 0) for t in tokens}


def _index(spark: SparkSession, rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[int]], list[int], int]:
    """Rules per hash bucket of their rarest token, and rules without a token."""
    token = [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None for r in rules]
    size = 1 << max(1, (4 * len(rules)).bit_length())
    names = sorted({t for t in token if t is not None})
    place = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in names] or [("",)], "t string")
             .select("t", F.pmod(F.xxhash64("t"), F.lit(size)).cast("int").alias("b")).collect()}
    buckets: list[list[int]] = [[] for _ in range(size)]
    for i, t in enumerate(token):
        if t is not None:
            buckets[place[t]].append(i)
    return buckets, [i for i, t in enumerate(token) if t is None], size


def judged(df: DataFrame, address: str, rules: tuple[Rule, ...], counts: dict[str, int], name: str) -> DataFrame:
    """Adds `name`: the index of the longest fitting rule, NULL without one, and name_tried: the candidates tested.

    The index is a literal array of hash buckets, so the rule list must be one that fits in
    a query plan (some ten thousand rules). Each address looks up the bucket of each of its
    tokens and runs only those rules' regular expressions, all within its own row: no join,
    no shuffle, and a url or host that repeats costs no more than others.
    """
    if not rules:
        return df.withColumn(name, F.lit(None).cast("int")).withColumn(f"{name}_tried", F.lit(0))
    buckets, always, size = _index(df.sparkSession, rules, counts)
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    index = F.array(*[ints(b) for b in buckets])
    fetched = F.flatten(F.transform(_tokens(F.col(address)), lambda t: F.get(index, F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))))
    pattern = F.array(*[F.lit(r.regex) for r in rules])
    rank = sorted(range(len(rules)), key=lambda i: (-rules[i].length, rules[i].name))
    place = {i: k for k, i in enumerate(rank)}
    order = [place[i] for i in range(len(rules))]
    df = df.withColumn(f"{name}_cand", F.array_distinct(F.concat(fetched, ints(always))))
    fits = F.filter(F.col(f"{name}_cand"), lambda i: F.regexp_like(F.col(address), F.get(pattern, i)))
    best = F.array_min(F.transform(fits, lambda i: F.get(ints(order), i)))
    return df.withColumn(name, F.get(ints(rank), best)).withColumn(f"{name}_tried", F.size(f"{name}_cand")).drop(f"{name}_cand")


def filter_urls(df: DataFrame, rules: tuple[Rule, ...], method_rules: tuple[Rule, ...] = DEFAULT_RULES,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (of the given list, else NULL), verdict (allow or block), method_rule, rules_tried.

    The given list decides first, its longest fitting rule wins; without one the method's
    own rules decide, and an address that fits none is allowed. One pass counts the rules'
    tokens over all addresses to find each rule's rarest, a second judges. A missing url or
    one without :// has empty host and path and is allowed unless a rule fits an empty
    address. Rows are judged alone, so repeated rows and ids, missing ids and empty tables
    need no special case; other columns are not read.
    """
    url = F.col(f"`{url_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("address", F.concat("host", "path"))
    every = sorted({t for r in (*rules, *method_rules) for t in r.tokens})
    counts = token_counts(rows, every)
    rows = judged(rows, "address", rules, counts, "own")
    rows = judged(rows, "address", method_rules, counts, "method")
    pick = lambda rs, what, c: F.get(F.array(*[F.lit(getattr(r, what)) for r in rs]), F.col(c)) if rs else F.lit(None).cast("string")
    return rows.select("id", "host", "path", pick(rules, "name", "own").alias("rule"),
                       F.coalesce(pick(rules, "verdict", "own"), pick(method_rules, "verdict", "method"), F.lit("allow")).alias("verdict"),
                       pick(method_rules, "name", "method").alias("method_rule"), (F.col("own_tried") + F.col("method_tried")).alias("rules_tried"))
