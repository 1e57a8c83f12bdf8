"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import ship, tidy
from .exact_dedup import ascii_lower
from .linear import fit_logistic, ngram_ids, sigmoid

#: Rules of the query: verdict and rule, a host and then a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The labelled URLs that the classifier learns from: spam, gambling, pill, adult and malware hosts against ordinary ones.
BLOCKED_URLS = (
    "http://spam-farm.example.org/en/12?utm_source=feed",
    "http://www.spam-farm.example.net/fr/340",
    "https://m.spam-farm.example.com/es/77.html",
    "http://cheap-pills.example.com/en/450?page=2",
    "https://www.cheap-pills.example.net/de/9",
    "http://blog.cheap-pills.example.org/es/31/",
    "http://free-bets.example.net/en/8",
    "https://m.free-bets.example.com/fr/17#top",
    "http://www.free-bets.example.org/de/605",
    "http://casino-win.example.net/en/23",
    "https://blog.casino-win.example.com/es/4/",
    "http://m.casino-win.example.org/fr/88.html",
    "http://adult-x.example.com/en/71",
    "https://www.adult-x.example.net/de/203#top",
    "http://blog.adult-x.example.org/fr/6",
    "http://buy-cheap-meds.example.org/pills/order-now",
    "http://online-casino-bonus.example.com/free-spins",
    "http://best-bets-tips.example.net/win/jackpot",
    "http://xxx-adult-videos.example.org/watch/1",
    "http://link-farm-seo.example.com/spam/backlinks",
    "http://poker-win-money.example.net/bet/now",
    "http://payday-loan-fast.example.org/cash/apply",
    "http://free-crack-download.example.com/keygen.exe",
    "http://lottery-winner-claim.example.net/prize",
)
ALLOWED_URLS = (
    "https://www.example.com/en/148.html",
    "https://blog.example.net/en/960",
    "http://m.example.org/fr/369#top",
    "https://tionsh.example.net/es/533/",
    "https://blog.tionble.example.com/en/853/",
    "https://m.tiontion.example.com/de/25#top",
    "http://blog.ththth.example.org/fr/728?utm_source=feed",
    "https://www.thther.example.org/en/685",
    "http://ththon.example.com/en/676",
    "https://m.ththan.example.net/es/671?page=2&ref=x",
    "http://www.thtion.example.com/fr/825",
    "https://therin.example.net/en/770#top",
    "http://erining.example.org/de/14.html",
    "https://blog.ouhaed.example.com/es/978",
    "http://city-library.example.org/en/catalogue/12",
    "https://www.university-press.example.com/en/journal/2021",
    "https://news.example.net/en/politics/report.html",
    "https://docs.example.org/de/manual/install.html",
    "https://museum-guide.example.com/fr/visite/horaires",
    "http://weather-station.example.net/es/tiempo/hoy",
    "https://open-data.example.org/en/dataset/44",
    "https://cooking-school.example.com/fr/recettes/3",
    "http://m.travel-notes.example.net/en/lisbon/",
    "https://www.history-society.example.org/de/archiv/1900",
)

SIZES, BITS = (3, 4, 5), 14


def url_host(url: Column) -> Column:
    """What lies after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""

    def fits(rule: str) -> Column:
        rule_host, _, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)

    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        found = F.when(fits(rule), F.lit(rule)).otherwise(found)
    return found


def url_features(host: str, path: str) -> np.ndarray:
    ids = np.concatenate([ngram_ids(f"^{host}$", SIZES, BITS, seed=1), ngram_ids(f"^{path}$", SIZES, BITS, seed=2) + (1 << BITS)])
    return ids.astype(np.int32)


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL, as :func:`url_host` and :func:`url_path` give them."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


def train(blocked: Sequence[str] = BLOCKED_URLS, allowed: Sequence[str] = ALLOWED_URLS) -> tuple[np.ndarray, float]:
    """Weights of 2 ** (BITS + 1) features and an intercept, from the labelled URLs."""
    rows = [url_features(*split_url(u)) for u in (*blocked, *allowed)]
    labels = np.array([1] * len(blocked) + [0] * len(allowed))
    return fit_logistic(rows, labels, np.ones(2 << BITS), l2=0.5)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict and block_score of every row of ``pages``.

    The longest rule that fits decides; without one the classifier does: block if its score is at least 0.5. A null
    url, or one without ``://``, has an empty host and path and is judged by the classifier as such. Rows that
    repeat are judged alike, an empty table gives an empty result, and other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train())  # 2 ** (BITS + 1) floats
    parsed = pages.select(F.col(id_col), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parsed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for b in batches:
            pairs = zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)
            score = [sigmoid(float(weights[url_features(h, p)].sum()) + intercept) for h, p in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "block_score"])

    ship(pages.sparkSession)
    out = ruled.mapInArrow(tidy(scored), f"{id_col} {dict(pages.dtypes)[id_col]}, host string, path string, rule string, block_score double")
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_score")
