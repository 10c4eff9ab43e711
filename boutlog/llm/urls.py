"""URL filter: host and path rules first, a weighted vocabulary of URL terms for the rest.

One Aho-Corasick automaton finds all terms of the vocabulary in a single pass over the lower-cased
url. A hit counts only between boundaries (no ASCII letter or digit on either side). A term of
weight STRICT blocks by itself; distinct soft terms block together once their weights reach
``soft_limit``. Rows are judged where they are: no shuffle, and the vocabulary is a parameter of
fixed size.

Null urls and urls without ``://`` have an empty host and path and fit no rule; null and empty urls
hold no term and are allowed. Repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

STRICT = 100
#: Weight of each term: STRICT blocks by one hit.
VOCABULARY: dict[str, int] = {
    "casino": STRICT, "porn": STRICT, "xxx": STRICT, "pills": STRICT, "viagra": STRICT, "bets": STRICT, "betting": STRICT, "spam": STRICT,
    "ads": 1, "track": 1, "tracker": 1, "free": 1, "cheap": 1, "win": 1, "bonus": 1, "farm": 1, "click": 1, "promo": 1, "adult": 1, "deal": 1, "prize": 1, "loan": 1,
}
SOFT_LIMIT = 2
#: Rules as (verdict, host/path); the longest that fits wins.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        of_host, slash, start = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class TermCounter:
    """Distinct terms of a vocabulary in a url, by one pass of an Aho-Corasick automaton."""

    def __init__(self, vocabulary: Mapping[str, int]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def hits(self, url: str) -> dict[str, int]:
        low, found = url.lower(), {}
        edge = lambda i: not (0 <= i < len(low) and low[i].isascii() and low[i].isalnum())
        for end, (term, weight) in self.automaton.iter(low):
            if edge(end + 1) and edge(end - len(term)):
                found[term] = weight
        return found


def judge_urls(pages: DataFrame, vocabulary: Mapping[str, int] | None = None, soft_limit: int = SOFT_LIMIT, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, strict_hits, soft_weight, terms (distinct, sorted) of every row."""
    vocabulary = dict(VOCABULARY if vocabulary is None else vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(vocabulary)
        for batch in batches:
            found = [counter.hits(u or "") for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([sum(w >= STRICT for w in x.values()) for x in found], pa.int64()),
                    pa.array([sum(w for w in x.values() if w < STRICT) for x in found], pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=["_key", "_url", "strict_hits", "soft_weight", "terms"],
            )

    kind = pages.schema[key].dataType.simpleString()
    counted = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url")).mapInArrow(count, f"_key {kind}, _url string, strict_hits long, soft_weight long, terms array<string>")
    host, path = split_url(F.col("_url"))
    split = counted.select("*", host.alias("host"), path.alias("path"))
    ruled = split.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("_rule"))
    found = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), found).alias("verdict"), "strict_hits", "soft_weight", F.array_join("terms", ",").alias("terms"))


def oracle_sql() -> str:
    """The same for DuckDB: a boundary-checked regular expression for each term."""
    strict = [t for t, w in VOCABULARY.items() if w >= STRICT]
    soft = [(t, w) for t, w in VOCABULARY.items() if w < STRICT]
    hit = lambda t: f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + f" ELSE CASE WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END"
    return f"""
    WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM a),
    c AS (SELECT page_id, coalesce(host, '') AS host, path,
                 {" + ".join(f"CAST({hit(t)} AS BIGINT)" for t in strict)} AS strict_hits,
                 {" + ".join(f"{w} * CAST({hit(t)} AS BIGINT)" for t, w in soft)} AS soft_weight,
                 array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in VOCABULARY)}], lambda x: x IS NOT NULL)), ',') AS terms FROM b),
    d AS (SELECT *, {rule} AS rule FROM c)
    SELECT page_id, host, path, rule, {verdict} AS verdict, strict_hits, soft_weight, terms FROM d"""
