"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

The trees learn from URLs that a rule decides and then judge those that none does. A URL's features are taken
from its characters alone: lengths, depth, share of digits, entropy, parameters, and what the labelled URLs with
the same host suffix, first path segment or last path suffix were (their statistics). All of those URLs are counted
and learned from, and a tree may split between any two values of a feature: features are whole steps on fixed
grids, so there are few hundred. Everything is DataFrame functions and Spark ML, so no URL leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import discard, if_small, pick, store

BLOCK, ALLOW = "block", "allow"
#: A task of the learning holds about so many URLs. A single one adds in the order of the URLs, the same in every run.
URLS_PER_TASK = 100_000
#: Rounds of boosting, levels of a tree, step, and the sampling seed of Spark ML.
ROUNDS, DEPTH, STEP, SEED = 20, 4, 0.2, 7
#: A suffix's share of blocked URLs is drawn to the share of all by so many URLs.
PRIOR_URLS = 20.0
#: Suffixes of fewer labelled URLs have no statistics: they would only give away their URLs' own labels.
LEAST_URLS = 10
#: Kinds of suffixes with statistics of their own.
SUFFIXES = ("host_suffix", "host_domain", "first_segment", "path_suffix")
LEXICAL = (
    "url_length", "host_length", "path_length", "labels", "hyphens", "depth", "digit_ratio", "host_digit_ratio",
    "entropy", "parameters", "has_fragment", "is_secure",
)
#: Steps of a feature's grid per unit: of its own value, or of the logarithm of 1 and a count or length.
LINEAR_STEPS = {
    "digit_ratio": 64, "host_digit_ratio": 64, "entropy": 16, "has_fragment": 1, "is_secure": 1,
    **{f"{kind}_share": 64 for kind in SUFFIXES},
}
LOG_STEPS = 16
#: No feature has more values than this: 16 steps for each e-fold of a length below 2^31 are fewer.
GRID_VALUES = 500
#: Spark ML squares the number of bins as a 32-bit integer.
MOST_BINS = 46_340
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest of ``rules``, (verdict, ``host/path``), that fits, and its verdict; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones a
    block goes first, then the smaller text.
    """
    if bad := [rule for rule in rules if rule[0] not in (BLOCK, ALLOW) or "/" not in rule[1]]:
        raise ValueError(f"a rule is ({BLOCK!r} or {ALLOW!r}, 'host/path'), not {bad[0]!r}")
    text = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK, tuple(-ord(c) for c in r[1]))):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the characters alone; a null URL counts as empty. Each is one pass over the URL."""
    url = F.coalesce(url, F.lit(""))

    def times(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def digits(text: Column) -> Column:
        left = F.length(F.translate(text, "0123456789", ""))
        return F.when(F.length(text) > 0, (F.length(text) - left) / F.length(text)).otherwise(0.0)

    # Shares of the distinct characters; each is counted by taking it out.
    length = F.length(url)
    kinds = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / length
    entropy = F.aggregate(kinds, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": length.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "labels": F.when(F.length(host) > 0, times(host, ".") + 1).otherwise(0).cast("double"),
        "hyphens": (times(host, "-") + times(path, "-")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda part: part != "")).cast("double"),
        "digit_ratio": digits(url),
        "host_digit_ratio": digits(host),
        "entropy": entropy,
        "parameters": F.when(F.length(query) > 0, times(query, "&") + 1).otherwise(0).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_secure": F.startswith(F.translate(url, _UPPER, _LOWER), F.lit("https://")).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """What the statistics are kept of: last label and last two of the host, first segment and extension of the path."""
    segments = F.filter(F.split(path, "/"), lambda part: part != "")
    return {
        "host_suffix": F.substring_index(host, ".", -1),
        "host_domain": F.substring_index(host, ".", -2),
        "first_segment": F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")),
        "path_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


@dataclass(frozen=True)
class UrlModel:
    """The trees, the statistics of suffixes (a row per kind and suffix) and the share of blocked URLs."""

    trees: GBTClassificationModel
    statistics: DataFrame
    blocked: float


def _featured(urls: DataFrame) -> DataFrame:
    """Adds the features and the suffixes of ``_url``, ``_host`` and ``_path``."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    return urls.withColumns(lexical_features(url, host, path) | suffixes(host, path))


def _with_statistics(urls: DataFrame, statistics: DataFrame, blocked: float) -> DataFrame:
    """Adds each suffix's share of blocked URLs and its count, and all features on their grids.

    The statistics have a row per frequent suffix. Up to ``BROADCAST_ROWS`` of a kind are sent to every task, as the
    commonest suffix may belong to most URLs; more are joined, where adaptive execution splits such a suffix.
    """
    for kind in SUFFIXES:
        known = statistics.where(F.col("kind") == kind).select(
            F.col("suffix").alias(kind), F.col("share").alias(f"{kind}_share"), F.col("urls").alias(f"{kind}_urls")
        )
        urls = urls.join(if_small(known), kind, "left")
    shares = {f"{kind}_share": F.coalesce(f"{kind}_share", F.lit(blocked)) for kind in SUFFIXES}
    counts = {f"{kind}_urls": F.coalesce(f"{kind}_urls", F.lit(0.0)) for kind in SUFFIXES}
    inputs = [*LEXICAL, *shares, *counts]
    steps = {name: _on_grid(name).cast("double") for name in inputs}
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(urls.withColumns(shares | counts).withColumns(steps))


def _on_grid(name: str) -> Column:
    value = F.col(name)
    return F.floor(value * LINEAR_STEPS[name]) if name in LINEAR_STEPS else F.floor(F.log1p(value) * LOG_STEPS)


def _split(df: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """The columns of ``df`` as ``_c<n>``, and ``_url, _host, _path, _rule, _ruled``."""
    marked = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    source = F.col(f"_c{df.columns.index(url)}")
    host, path = host_and_path(source)
    parted = marked.select("*", source.alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, verdict = matched_rule(F.col("_host"), F.col("_path"), rules)
    return parted.withColumns({"_rule": rule, "_ruled": verdict})


def learn(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url") -> UrlModel | None:
    """Trees from all distinct URLs of ``pages`` that ``rules`` decide; None unless both verdicts occur.

    Repeated URLs count once. Shares and statistics are exact counts. Up to ``URLS_PER_TASK`` URLs are learned from
    in one task, which makes the trees the same in every run; more are learned from by several, whose
    sums Spark ML adds as they come, so scores may differ from run to run as the rounding of such sums does.
    """
    labelled = _split(pick(pages, url), url, rules).where(F.col("_ruled").isNotNull())
    distinct = labelled.select("_url", "_host", "_path", "_ruled").distinct()
    chosen = store(_featured(distinct), "labelled-urls")
    is_block = (F.col("_ruled") == BLOCK).cast("double")
    urls, blocked = chosen.agg(F.count("*"), F.sum(is_block)).head()
    if not urls or blocked in (0, urls):
        discard(chosen)
        return None
    share = blocked / urls
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES]))
    statistics = store(
        chosen.select(is_block.alias("block"), each.alias("of")).groupBy("of.kind", "of.suffix").agg(
            F.count("*").cast("double").alias("urls"),
            ((F.sum("block") + PRIOR_URLS * share) / (F.count("*") + PRIOR_URLS)).alias("share"),
        ).where(F.col("urls") >= LEAST_URLS),
        "url-suffixes",
    )
    rows = _with_statistics(chosen, statistics, share).select(is_block.alias("label"), "_features", "_url")
    ordered = rows.coalesce(-(-urls // URLS_PER_TASK)).sortWithinPartitions("_url").select("label", "_features")
    # Spark ML looks for splits in a sample unless the square of this is at least the number of rows.
    bins = max(GRID_VALUES, min(isqrt(urls) + 1, MOST_BINS))
    classifier = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, maxBins=bins, stepSize=STEP, seed=SEED
    )
    trees = classifier.fit(ordered)
    discard(chosen)
    return UrlModel(trees, statistics, share)


def with_verdicts(pages: DataFrame, rules: Sequence[Rule], model: UrlModel | None, *, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_score``; columns of ``pages`` with such a name are dropped.

    A rule's verdict stands; other URLs are blocked where the trees give 0.5 or more. ``block_score`` is the trees'
    probability for every URL, those that a rule decides included. A null URL, or one without ``://``, has an
    empty host and path, which no rule fits. Without a model URLs without a rule are allowed, with score 0.
    Repeated rows each get theirs.
    """
    new = ("host", "path", "rule", "verdict", "block_score")
    kept = [(f"_c{i}", name) for i, name in enumerate(pages.columns) if name not in new]
    parted = _split(pages, url, rules)
    if model is None:
        scored = parted.withColumn("_score", F.lit(0.0))
    else:
        ready = _with_statistics(_featured(parted), model.statistics, model.blocked)
        scored = model.trees.transform(ready).withColumn("_score", vector_to_array("probability")[1])
    learned = F.when(F.col("_score") >= 0.5, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("_ruled"), learned)
    found = [F.col("_host"), F.col("_path"), F.col("_rule"), verdict, F.col("_score")]
    return scored.select(*[mark for mark, _ in kept], *found).toDF(*[name for _, name in kept], *new)
