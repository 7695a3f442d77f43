"""URL filters: path and domain rules, then logistic regression on hashed character n-grams.

The classifier learns on the driver from a small labelled table whose size is
bounded. Its weights are rounded to integers and sent as one constant array of
``BUCKETS`` entries, so judging a URL is a sum of array lookups inside generated
JVM code, exact in any order. No Python runs where URLs are judged.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.plans.scratch import pick

N = 4
BUCKETS = 4093
#: Labelled URLs beyond this are an error: the table is meant to be small.
MAX_LABELLED = 10_000
_SCALE = 1_000_000
_FACTORS = (7919, 104_729, 1_299_709, 15_485_863)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled URLs, 1 for those to block. A fixed table, in natural order.
LABELLED: list[tuple[str, int]] = [
    ("https://ads-network.example/banner/1", 1),
    ("http://m.ads-server.example/track?id=2", 1),
    ("https://ads-track.example/pixel", 1),
    ("http://track-click.example/en/7", 1),
    ("https://www.ads-track.example/fr/31.html", 1),
    ("https://casino-bonus.example/play", 1),
    ("http://www.casino-win.example/slots/44", 1),
    ("https://blog.casino-royal.example/de/5", 1),
    ("http://win-casino.example/jackpot", 1),
    ("https://free-bets.example/football", 1),
    ("http://m.free-bets.example/es/12", 1),
    ("https://sports-bets.example/odds/en/3", 1),
    ("http://www.free-spins.example/poker", 1),
    ("https://spam-farm.example/links/1", 1),
    ("http://blog.spam-farm.example/en/90", 1),
    ("https://link-farm.example/seo", 1),
    ("https://m.spam-links.example/fr/8", 1),
    ("https://cheap-pills.example/order", 1),
    ("http://www.cheap-pills.example/en/17.html", 1),
    ("https://cheap-meds.example/viagra", 1),
    ("http://buy-pills.example/de/2", 1),
    ("https://adult-x.example/videos", 1),
    ("http://m.adult-x.example/es/23", 1),
    ("https://adult-cams.example/xxx/1", 1),
    ("http://www.xxx-adult.example/en/6", 1),
    ("", 0),
    ("https://blog.garden.example/en/12", 0),
    ("http://www.kitchen.example/recipes/soup", 0),
    ("https://news.example/fr/2021/04/report.html", 0),
    ("https://m.weather.example/de/today", 0),
    ("http://library.example/catalogue?page=2&ref=x", 0),
    ("https://docs.example/python/tutorial.html", 0),
    ("http://www.university.example/department/history", 0),
    ("https://museum.example/es/exhibitions/33/", 0),
    ("http://blog.travel.example/en/825?utm_source=feed", 0),
    ("https://shop.example/books/4411", 0),
    ("https://www.city.example/de/council/minutes-12", 0),
    ("http://m.ththth.example/en/25#top", 0),
    ("https://onthe.example/fr/676", 0),
    ("http://therea.example/es/770.html", 0),
    ("https://blog.tionre.example/de/853/", 0),
    ("https://health.example/article/sleep", 0),
    ("http://sports.example/results/football", 0),
    ("https://addresses.example/en/adult-education", 0),
    ("http://www.cheapside.example/history", 0),
    ("https://freedom.example/essays/5", 0),
    ("http://track-and-field.example/athletics", 0),
    ("https://m.farm.example/milk", 0),
    ("http://www.windows.example/help/17", 0),
    ("https://betty.example/letters", 0),
]

#: Rules of the query, each host and path in one string.
RULES: list[tuple[str, str]] = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _split(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(_UPPER, _LOWER)), m[2]) if m else ("", "")


def grams(part: str, salt: int) -> list[int]:
    """Buckets of the n-grams of one part, its ends marked."""
    codes = [94, 94, *map(ord, part), 36]
    return [(sum(f * c for f, c in zip(_FACTORS, codes[i : i + N])) + salt) % BUCKETS for i in range(len(codes) - N + 1)]


def train(labelled: list[tuple[str | None, int]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[list[int], int]:
    """(integer weights by bucket, integer bias) of logistic regression by full gradient steps.

    A positive sum means block. Without labels every weight is 0, and nothing is blocked.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    x = np.zeros((len(labelled), BUCKETS))
    for row, (url, _) in enumerate(labelled):
        host, path = _split(url)
        for b in grams(host, 0) + grams(path, 17):
            x[row, b] += 1
    y = np.array([float(v) for _, v in labelled])
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds if len(labelled) else 0):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        g = (p - y) / len(y)
        w -= rate * (x.T @ g + decay * w)
        bias -= rate * float(g.sum())
    return [int(v) for v in np.rint(w * _SCALE)], int(np.rint(bias * _SCALE))


@lru_cache(maxsize=4)
def _default_model() -> tuple[tuple[int, ...], int]:
    w, b = train(LABELLED)
    return tuple(w), b


def _score(part: Column, salt: int, weights: Column) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^^"), part, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    bucket = lambda c, i: (sum((F.lit(f) * F.get(c, i + k) for k, f in enumerate(_FACTORS)), F.lit(salt))) % BUCKETS
    last = F.length(part) + 3 - N
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i <= last)
    # the codes are bound once by an array of one, not built again for each n-gram
    sums = F.transform(F.array(codes), lambda c: F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + F.get(weights, bucket(c, i).cast("int"))))
    return F.get(sums, 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: list[tuple[str | None, int]] | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row of ``pages(page_id, url)``.

    ``verdict`` is the fitting rule's, else block where the classifier's sum is
    positive. A null url, or one without ``://``, has an empty host and path and
    is judged by the classifier, which allows it. Repeated rows give repeated
    results, an empty table an empty one; other columns are ignored.
    """
    weights, bias = _default_model() if labelled is None else train(labelled)
    table = F.from_json(F.lit(str(list(weights))), "array<bigint>")
    rows = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    score = _score(F.col("host"), 0, table) + _score(F.col("path"), 17, table) + F.lit(bias)
    out = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), score.alias("score"))
    learned = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "score")


def sql() -> str:
    """The query over ``pages`` in DuckDB SQL."""
    weights, bias = _default_model()
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    whens = {"rule": [], "by_rule": []}
    for text, what in rules:
        h, _, p = text.partition("/")
        test = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        whens["rule"].append(f"WHEN {test} THEN '{text}'")
        whens["by_rule"].append(f"WHEN {test} THEN '{what}'")
    gram = " + ".join(f"{f} * unicode(substr(t, i + {k}, 1))::BIGINT" for k, f in enumerate(_FACTORS))
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '{_HOST}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path
  FROM pages),
w AS (SELECT unnest(range({BUCKETS})) AS b, unnest({list(weights)}) AS w),
part AS (SELECT r, '^^' || host || '$' AS t, 0 AS salt FROM u UNION ALL SELECT r, '^^' || path || '$', 17 FROM u),
gram AS (SELECT r, t, salt, unnest(range(1, length(t) - {N} + 2)) AS i FROM part),
s AS (SELECT r, sum(w)::BIGINT + {bias} AS score FROM (SELECT r, ({gram} + salt) % {BUCKETS} AS b FROM gram) JOIN w USING (b) GROUP BY r),
j AS (SELECT page_id, host, path, coalesce(score, {bias}) AS score,
    CASE {" ".join(whens["rule"])} END AS rule, CASE {" ".join(whens["by_rule"])} END AS by_rule
  FROM u LEFT JOIN s USING (r))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM j
"""
