"""URL filters: pattern rules indexed by their rarest literal token.

A rule blocks URLs, or allows them if it begins with ``@@``. In its pattern ``||`` is the start of a host or of one of its
parent domains, ``|`` the start or end of the URL, ``*`` any run of characters and ``^`` a separator or the end; ``/.../`` (slashes around
the whole pattern) is a regular expression as it is. URLs are compared in lower case. Options after ``$`` speak of requests, which a
table of URLs does not have: a rule with any raises ValueError, and so does an expression that does not compile.

A token is a run of letters and digits. Each rule is filed under the one of its whole literal tokens (bounded in the
pattern by signs that are no token's) that fewest URLs contain, counted over all URLs; a rule without one is tried on
every URL. A URL's tokens fetch its candidate rules, and only those run their regular expressions.

The counts are one aggregation over the rules' own tokens. The index is then shipped to the tasks; its size is that of the
rule list, a parameter, and is checked against ``MAX_RULES``: beyond, rules and URL tokens meet in a join instead, with the same
expressions in the same engine. Rules without a token are tried on every URL, so no more than ``MAX_RULES`` of them are taken. URLs are
filtered where they are read.

Edge cases: a null URL matches nothing and is not blocked; an empty one is matched by rules of only stars; very long URLs are
matched whole; repeated rows keep a row each; ties of token counts go to the token first in order; an allow rule that
matches outweighs all block rules; without rules nothing is blocked; an empty table gives an empty table. The columns kept must not be called
``blocked`` or ``rules``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import runtime

MAX_RULES = 200_000
TOKEN = re.compile("[a-z0-9]+")

#: Kinds of rules: hosts, sections, query parameters, page kinds, expressions.
KINDS = (
    "||tionble.example.com^",
    "||ththre.example.org^*/en/",
    "||therha.example.net^",
    "||thering.example.org^$",
    "@@||tionble.example.com/de/*",
    "utm_source=feed|",
    "@@||example.net/*utm_source=feed|",
    "?page=2&ref=x",
    "@@/es/*?page=2&",
    "|http://m.*",
    "||blog.ththth.example.org/en/*",
    "/fr/1*.html|",
    "/de/*9.html|",
    "#top|",
    "@@/en/*#top|",
    "||example.org/es/*",
    r"/^https?://[^/]+/[a-z]{2}/\d*(\d)\1\1\d*(\D|$)/",
    r"@@/^https://www\./",
)


def rule_list(n: int) -> tuple[str, ...]:
    """A list as long as those in use: the kinds above, and ``n`` rules of a site, a section and a page each."""
    sites = [f"{a}{b}" for a in ("th", "ther", "tion", "ha", "in") for b in ("sh", "th", "ble", "re", "rin", "ring", "rha", "tion", "than", "an")]
    tails, made = ("com", "org", "net"), []
    for i in range(n):
        site, tail, section = sites[i * 7 % len(sites)], tails[i % 3], ("en", "de", "fr", "es")[i // 3 % 4]
        page = i * 613 % 200_003
        made.append((f"||{site}.example.{tail}/{section}/{page}^", f"/{section}/{page}.html|", f"@@||example.{tail}/*/{page}?page=2^", f"||{site}.example.{tail}/{section}/{page % 1000}*#top|", f"/{section}/{page}/*")[i % 5])
    return (*KINDS, *made)


RULES = rule_list(2000)


def _body(rule: str) -> tuple[str, bool, bool]:
    """(pattern or expression, whether it is an expression, whether the rule allows)."""
    allow = rule.startswith("@@")
    body = rule.removeprefix("@@")
    if len(body) > 2 and body[0] == body[-1] == "/":
        try:
            re.compile(body[1:-1], re.ASCII)
        except re.error as e:
            raise ValueError(f"rule {rule!r} is no regular expression") from e
        return body[1:-1], True, allow
    body, _, options = body.partition("$")
    if options:
        raise ValueError(f"rule {rule!r}: option {options!r} cannot be told from a URL")
    return body.lower(), False, allow


def rule_regex(rule: str) -> tuple[str, bool]:
    """(regular expression to search for in a lower-case URL, whether it allows)."""
    body, plain, allow = _body(rule)
    if plain:
        return body, allow
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    middle = "".join({"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}.get(c) or (c if c.isalnum() or c in "_/:=&#%,~@! <>;'\"" else "\\" + c) for c in body)
    return head + middle + tail, allow


def literal_tokens(rule: str) -> list[str]:
    """The tokens that every URL which the rule matches contains as whole tokens."""
    body, plain, _ = _body(rule)
    if plain:
        return []
    out = []
    for m in TOKEN.finditer(body):
        before, after = body[: m.start()], body[m.end() :]
        # at the pattern's open ends and beside a star, a URL's token may go on
        left = bool(before) and before[-1] != "*"
        right = bool(after) and after[0] != "*"
        if left and right:
            out.append(m[0])
    return sorted(set(out))


class Index:
    """Rules by token; ``match`` gives the numbers of the rules that match a URL, in order."""

    def __init__(self, rules: Sequence[str], counts: dict[str, int]) -> None:
        self.rules, self.by_token, self.always, self.tried = [rule_regex(r) for r in rules], {}, [], 0
        self.compiled: list[re.Pattern | None] = [None] * len(rules)
        for i, rule in enumerate(rules):
            tokens = literal_tokens(rule)
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def candidates(self, url: str) -> list[int]:
        found = list(self.always)
        for token in set(TOKEN.findall(url)):
            found += self.by_token.get(token, ())
        return sorted(found)

    def match(self, url: str) -> list[int]:
        url, out = url.lower(), []
        for i in self.candidates(url):
            pattern = self.compiled[i]
            if pattern is None:
                pattern = self.compiled[i] = re.compile(self.rules[i][0], re.ASCII)
            self.tried += 1
            if pattern.search(url):
                out.append(i)
        return out

    def blocked(self, matched: list[int]) -> bool:
        return bool(matched) and not any(self.rules[i][1] for i in matched)


def token_counts(pages: DataFrame, rules: Sequence[str], column: str = "url") -> dict[str, int]:
    """In how many URLs each literal token of the rules stands, over all URLs."""
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), F.lit(1)))
    small = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    small = F.broadcast(small) if len(wanted) <= 3 * MAX_RULES else small
    return {r[0]: r[1] for r in pages.select(F.explode(tokens).alias("token")).join(small, "token").groupBy("token").count().collect()}


def url_filter(pages: DataFrame, rules: Sequence[str] = RULES, keep: tuple[str, ...] = ("page_id", "url"), column: str = "url") -> DataFrame:
    """``keep`` columns, ``blocked`` and ``rules``: the numbers (from 0, comma-separated) of all rules that match."""
    if {"blocked", "rules"} & set(keep):
        raise ValueError("the pages already have columns 'blocked' or 'rules'")
    rules = list(rules)
    counts = token_counts(pages, rules, column)
    if len(rules) > MAX_RULES:
        return _joined(pages, rules, counts, keep, column)
    shared = pages.sparkSession.sparkContext.broadcast((rules, counts))
    source = pages.select(*keep, F.col(column).alias("_url"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("blocked", T.BooleanType(), False), T.StructField("rules", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            found = [[] if u is None else index.match(u) for u in batch.column(len(keep)).to_pylist()]
            blocked, named = [index.blocked(m) for m in found], [",".join(map(str, m)) for m in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(blocked, pa.bool_()), pa.array(named, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


@functools.lru_cache(1 << 16)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.ASCII)


def _joined(pages: DataFrame, rules: list[str], counts: dict[str, int], keep: tuple[str, ...], column: str) -> DataFrame:
    """The same for a rule list too large to ship: URL tokens and rules meet in a join."""
    rows, always = [], []
    for i, rule in enumerate(rules):
        tokens = literal_tokens(rule)
        if tokens:
            rows.append((min(tokens, key=lambda t: (counts.get(t, 0), t)), i, *rule_regex(rule)))
        else:
            always.append((i, *rule_regex(rule)))
    if len(always) > max(MAX_RULES, 1000):
        raise ValueError(f"{len(always)} rules without a literal token would be tried on every URL")
    spark = pages.sparkSession
    table = spark.createDataFrame(rows, "_token string, _rule int, _regex string, _allow boolean")
    numbered = runtime.written(pages.select(*keep, F.col(column).alias("_url")).withColumn("_row", F.monotonically_increasing_id()), "urls")
    lower = numbered.where("_url IS NOT NULL").select("_row", F.lower("_url").alias("_low"))
    tokens = F.array_distinct(F.regexp_extract_all("_low", F.lit("([a-z0-9]+)"), F.lit(1)))
    candidates = lower.withColumn("_token", F.explode(tokens)).join(table, "_token").select("_row", "_low", "_rule", "_regex", "_allow")
    shared = spark.sparkContext.broadcast(always)
    names = ["_row", "_rule", "_allow"]

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(_compiled(x).search(u)) for u, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4)], names=names).filter(pa.array(hit, pa.bool_()))

    def tried_always(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(r, i, allow) for r, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x, allow in shared.value if _compiled(x).search(u)]
            yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.bool_()))], names=names)

    schema = "_row long, _rule int, _allow boolean"
    hits = candidates.mapInArrow(tried, schema).unionByName(lower.mapInArrow(tried_always, schema))
    grouped = hits.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("_rule")), ",").alias("_found"), F.bool_or("_allow").alias("_allowed"))
    out = numbered.join(grouped, "_row", "left")
    return out.select(*keep, (F.col("_found").isNotNull() & ~F.coalesce("_allowed", F.lit(False))).alias("blocked"), F.coalesce("_found", F.lit("")).alias("rules"))


def oracle_sql(rules: Sequence[str] = RULES) -> str:
    """Every rule's regular expression on every URL; back references are spelt out, as the engine has none."""
    values = []
    for i, rule in enumerate(rules):
        regex, allow = rule_regex(rule)
        if r"(\d)\1\1" in regex:
            regex = regex.replace(r"(\d)\1\1", "(" + "|".join(str(d) * 3 for d in range(10)) + ")")
        quoted = regex.replace("'", "''")
        values.append(f"({i}, '{quoted}', {str(allow).upper()})")
    return f"""
WITH r(i, x, allow) AS (VALUES {', '.join(values)}),
m AS (SELECT page_id, i, allow FROM pages, r WHERE regexp_matches(lower(url), x)),
b AS (SELECT page_id, NOT bool_or(allow) AS blocked, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rules FROM m GROUP BY page_id)
SELECT page_id, url, coalesce(blocked, FALSE) AS blocked, coalesce(rules, '') AS rules FROM pages LEFT JOIN b USING (page_id)
"""
