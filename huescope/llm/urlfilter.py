"""URL filter: longest matching rule, else gradient-boosted trees on lexical
features of the URL.

The trees learn from labelled URLs.  In the query the rules label the URLs
they fit; features never see the rules, only the URL's letters: lengths,
depth, digit ratio, entropy, parameter counts and how often labelled URLs
with the same host suffix were blocked.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees
from .common import hash_share, sample_rows, strings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    ``rules``: (verdict, host, path).  A short list becomes one CASE in the
    scan, longest first; equal lengths go by text order.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    """The host's last label, and its last two."""
    parts = host.rsplit(".", 2)
    return parts[-1], ".".join(parts[-2:])


class UrlModel:
    """Suffix statistics and boosted trees; some kilobytes."""

    def __init__(self, suffix_rates: dict[str, float], prior: float):
        self.rates, self.prior, self.trees = suffix_rates, prior, None

    def features(self, url: str, host: str, path: str) -> list[float]:
        query = url.partition("?")[2].partition("#")[0] if "?" in url else ""
        last, two = _suffixes(host)
        letters = len(url) or 1
        return [
            len(url), len(host), len(path), len(query), path.count("/"), host.count("."), sum(map(str.isdigit, url)) / letters, sum(map(str.isdigit, host)),
            _entropy(url), _entropy(path), query.count("&") + bool(query), url.count("-"), url.count("%"), url.count("_"), float("#" in url), float(url[:6].lower() == "https:"),
            float(path.endswith("/")), float("." in path.rpartition("/")[2]), max(map(len, path.split("/"))), len(path.split("/")[1]) if path.count("/") else 0.0,
            self.rates.get(last, self.prior), self.rates.get(two, self.prior),
        ]

    @classmethod
    def fit(cls, urls: list[tuple[str, str, str]], labels: np.ndarray) -> "UrlModel":
        """urls: (url, host, path); labels: 1 for blocked.  Suffix rates are
        smoothed, and left-out for each row so that it does not see itself."""
        prior = (labels.sum() + 1) / (len(labels) + 2)
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for (_, host, _), y in zip(urls, labels):
            for s in set(_suffixes(host)):
                seen[s][0] += y
                seen[s][1] += 1
        rate = lambda s, y=0.0, n=0.0: (seen[s][0] - y + 5 * prior) / (seen[s][1] - n + 5)
        model = cls({s: rate(s) for s in seen}, prior)
        if not urls:
            model.trees = BoostedTrees()
            return model
        x = np.array([model.features(*u) for u in urls])
        for i, ((_, host, _), y) in enumerate(zip(urls, labels)):
            x[i, -2:] = [rate(s, y, 1) for s in _suffixes(host)]
        model.trees = BoostedTrees(trees=60, depth=4).fit(x, labels)
        return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, labelled: Column | None = None, sample: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    ``labelled`` (1 block, 0 allow, else null) marks the URLs to learn from;
    by default those that a rule fits.  At most ``sample`` different ones,
    chosen by a hash of the URL, are fitted on the driver.  ``score`` is the
    trees' probability of a block, for ruled rows too; from 0.5 on the
    method blocks.  A null url has empty host and path and no rule; without
    labels of both kinds the base rate decides, and nothing is blocked where
    there are no labels at all.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), (labelled if labelled is not None else F.lit(None)).cast("int").alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    label = F.col("given") if labelled is not None else F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    known = base.where(label.isNotNull() & F.col("url").isNotNull()).select("url", "host", "path", label.alias("y"))
    n = known.count()
    some = known.where(hash_share(F.col("url"), 2 * sample / max(n, 1))).dropDuplicates(["url", "y"])
    got = sample_rows(some, ["url", "y"], sample)
    got.sort(key=lambda r: (r.url, r.y))
    model = spark.sparkContext.broadcast(UrlModel.fit([(r.url, r.host, r.path) for r in got], np.array([r.y for r in got], float)))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = model.value
        for b in batches:
            urls, hosts, paths = (strings(b.column(c)) for c in ("url", "host", "path"))
            x = np.array([m.features(*u) for u in zip(urls, hosts, paths)]).reshape(len(urls), -1)
            score = m.trees.probability(x) if len(got) and len(urls) else np.zeros(len(urls))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), b.column("ruled"), pa.array(score, pa.float64())], schema=schema)

    scored = base.select("page_id", "url", "host", "path", "rule", "ruled").mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
