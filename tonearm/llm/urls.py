"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled table of URLs with plain arithmetic on the driver; its weights are whole
numbers, so sums are exact in any order, and scoring is one expression of built-in functions.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS, GRAM, UNIT = 1024, 3, 1 << 16

#: Words of hosts, by label: ordinary vocabulary, chosen without any table to be judged. 1: block.
_BLOCK = (
    "poker", "pokerroom", "freepoker", "betting", "bet-now", "sportsbetting", "slots", "megaslots", "slotmachine", "jackpot", "jackpot-city", "roulette", "lottery-win",
    "porn", "pornhost", "freeporn", "xxxvideos", "xxx-cams", "livecams", "sexcams", "sexdates", "hookup-dates", "escorts", "nudecams",
    "viagra", "cheap-viagra", "cialis", "buy-cialis", "pharma-discount", "discount-meds", "miracle-diet", "diet-shakes",
    "warez", "warezdown", "keygen", "crack-keygen", "serials-crack", "torrentcrack", "malware", "malwarehost", "trojan-get", "phishing", "phish-verify", "verify-login", "login-verify",
    "adserver", "adserve-click", "adclick", "clicktracker", "tracker-click", "popunder", "popads", "banner-clicks", "trackpixel",
    "payday-loans", "fast-loans", "quickcash", "cash-now", "replica-watches", "replicabags", "free-prizes", "win-prizes", "getrich-now", "forex-profits",
)
_ALLOW = (
    "library", "citylibrary", "university", "stateuniversity", "museum", "artmuseum", "gazette", "weather", "mountainweather", "recipes", "familyrecipes", "gardening", "kitchen-garden", "hospital",
    "children-hospital", "council", "towncouncil", "railway", "railway-history", "astronomy", "chemistry", "history", "localhistory", "orchestra", "theatre", "village-theatre", "bakery", "school",
    "musicschool", "primary-school", "atlas", "dictionary", "encyclopedia", "journal", "science-journal", "research", "polar-research", "archive", "newsarchive", "parliament", "forestry", "geology",
    "cycling", "cyclingclub", "football-club", "marathon", "chess", "chessclub", "knitting", "photography", "architecture", "cathedral", "festival", "filmfestival", "airport", "harbour", "teachers",
    "engineering", "software-docs", "opensource", "mathematics", "languages", "translation", "bookshop", "newspaper", "daily-news",
)
_HOSTS = ("https://{}.com", "http://www.{}.org", "https://m.{}.net", "https://{}.co.uk")
_PATHS = ("/", "/index.html", "/articles/{}", "/page/{}/view?ref=mail", "/2021/05/{}#start")


def labelled(held: int | None = None) -> list[tuple[str, int]]:
    """The labelled table: every word with every host form, paths in turn. held: without the words of that quarter (by crc32 of the word)."""
    out = []
    for label, names in ((1, _BLOCK), (0, _ALLOW)):
        for i, name in enumerate(names):
            if held is None or zlib.crc32(name.encode()) % 4 != held:
                out += [(host.format(name) + _PATHS[(i + j) % len(_PATHS)].format(1000 + 37 * i + 411 * j), label) for j, host in enumerate(_HOSTS)]
    return out


def held_out_accuracy() -> float:
    """Of the table's rows, the share judged right by a regression that was trained without their words' quarter."""
    right = total = 0
    for part in range(4):
        kept = labelled(part)
        bias, w = train(tuple(kept))
        for url, y in set(labelled()) - set(kept):
            right += (bias + sum(w[g] for g in set(grams(*split_url(url)))) > 0) == bool(y)
            total += 1
    return right / total


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the columns below have them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def grams(host: str, path: str) -> list[int]:
    s = f"^{host}${path}$"
    return [(ord(s[i]) * 961 + ord(s[i + 1]) * 31 + ord(s[i + 2])) % BUCKETS for i in range(len(s) - GRAM + 1)]


@lru_cache
def train(table: tuple[tuple[str, int], ...] | None = None, epochs: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Bias and bucket weights, times UNIT. The table is small by contract (its bound: what one literal holds)."""
    rows = [(sorted(set(grams(*split_url(u)))), y) for u, y in (labelled() if table is None else table)]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        step = [0.0] * BUCKETS
        step_bias = 0.0
        for own, y in rows:
            z = bias + sum(w[g] for g in own)
            e = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            step_bias += e
            for g in own:
                step[g] += e
        bias += rate * step_bias / len(rows)
        w = [a + rate * (s / len(rows) - decay * a) for a, s in zip(w, step, strict=True)]
    return round(bias * UNIT), tuple(round(x * UNIT) for x in w)


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def score(host: Column, path: Column, bias: int, weights: tuple[int, ...]) -> Column:
    """The regression's sum times UNIT, over the distinct buckets of the n-grams; above 0: block."""
    # the characters' codes, made once: taking them from the text one by one would cost its square
    codes = F.transform(F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), ""), F.ascii)
    table = F.lit(list(weights))

    def total(c: Column) -> Column:
        gram = lambda i: (F.get(c, i) * 961 + F.get(c, i + 1) * 31 + F.get(c, i + 2)) % BUCKETS
        buckets = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), gram))
        return F.aggregate(buckets, F.lit(bias).cast("long"), lambda a, b: a + F.get(table, b).cast("long"))

    return F.get(F.transform(F.array(codes), total), F.lit(0))


def judge(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, table: tuple[tuple[str, int], ...] | None = None) -> DataFrame:
    """pages with host, path, rule (of the longest that fits, else null), score and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins (of equal length,
    the first in code-point order). A null url, or one without ``://``, has an empty host and path and is judged by the
    regression like any other; a very long url is judged by all its n-grams. Repeated rows are judged alike, an empty
    table stays empty; extra columns stay, and if names clash the new columns get underscores before them. One narrow
    stage, no shuffle.
    """
    names = fresh(pages, "host", "path", "rule", "score", "verdict")
    host, path, rule, value, verdict = (F.col(f"`{n}`") for n in names)
    bias, weights = train(table) if table is not None else train()
    h, p = host_and_path(F.col(f"`{url}`"))
    out = pages.withColumns({names[0]: h, names[1]: p})
    best, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, word in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        best, said = F.when(fits, name).otherwise(best), F.when(fits, word).otherwise(said)
    out = out.withColumns({names[2]: best, names[3]: score(host, path, bias, weights) / UNIT})
    return out.withColumn(names[4], F.coalesce(said, F.when(value > 0, "block").otherwise("allow")))


def sql(pages: str = "pages", rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same for DuckDB."""
    bias, weights = train()
    best = said = ""
    for name, word in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, start = name.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')"
        best, said = best + f" WHEN {fits} THEN '{name}'", said + f" WHEN {fits} THEN '{word}'"
    return f"""WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
scored AS (
  SELECT *, {bias} + list_sum(list_transform(list_distinct(list_transform(range(1, length('^' || host || '$' || path || '$') - 1),
    lambda i: (unicode(substr('^' || host || '$' || path || '$', i, 1)) * 961 + unicode(substr('^' || host || '$' || path || '$', i + 1, 1)) * 31
      + unicode(substr('^' || host || '$' || path || '$', i + 2, 1))) % {BUCKETS})), lambda b: {list(weights)}[b + 1])) AS z FROM split)
SELECT page_id, host, path, CASE{best} END AS rule, CASE{said} WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict FROM scored"""
