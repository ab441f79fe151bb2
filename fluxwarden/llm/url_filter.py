"""URL filters: host and path rules first, else logistic regression on hashed character n-grams of host and path.

Method: rules name a host (and all its subdomains) and a path prefix; the longest that fits decides. Any other URL is
scored by a logistic regression over hashed character 3- to 5-grams of ``^host$`` and of the path, trained from a small
labelled URL table (the built-in one, or any DataFrame of url and blocked).

Everything is a DataFrame or Spark ML (JVM) operation: no Python runs on executors, and scoring needs no shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, which fit no rule and are scored as
such; repeated rows are returned each; extra columns are kept; an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: (host, path, verdict); a rule's string is host + "/" + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SIZES = (3, 4, 5)
N_FEATURES = 1 << 14
THRESHOLD = 0.5

#: Small labelled table: what blocked names speak of, and names of ordinary places. Both stand under the same domains, prefixes and
#: paths, so that only the names tell them apart.
BLOCKED_TOPICS = ("casino", "spam", "pills", "adult", "warez", "torrent", "phish", "malware", "tracker", "ads", "bonus", "betting", "keygen", "poker", "loans", "xxx", "cams", "crack", "lottery", "clickbait", "bets", "jackpot", "viagra", "escort")
BLOCKED_FORMS = ("{0}-{1}", "cheap-{0}", "{0}-farm", "free-{0}", "{0}{1}", "best-{0}-online", "{0}-win", "{0}-track", "{0}-x")
ALLOWED_NAMES = (
    "news", "library", "docs", "museum", "university", "science", "recipes", "weather", "forum", "garden", "history", "travel", "music", "school", "research", "theatre", "rivers", "hiking", "letters", "archive",
)
#: Ordinary names are also made of these.
SYLLABLES = ("th", "er", "in", "on", "an", "re", "ti", "es", "ing", "ou", "nd", "le", "ha", "wh", "sh", "ly", "ed", "ra", "mo", "ka", "lu", "ber", "sta", "vel")
DOMAINS = ("example.com", "example.net", "example.org", "example.info")
PREFIXES = ("", "www.", "m.", "blog.", "shop.")
PATHS = ("/en/{0}", "/fr/{0}.html", "/de/{0}/", "/es/{0}", "/{0}/index.html", "/")


def labelled_urls(spark: SparkSession, blocked: int = 300, allowed: int = 900) -> DataFrame:
    """url, blocked (double): URLs of either kind, made from the lists above by counting through them with odd steps. Most are allowed, as most of the web is."""
    names = []
    for k in range(blocked):
        t, u = BLOCKED_TOPICS[k % len(BLOCKED_TOPICS)], BLOCKED_TOPICS[(7 * k + 3) % len(BLOCKED_TOPICS)]
        names.append((BLOCKED_FORMS[(k // len(BLOCKED_TOPICS)) % len(BLOCKED_FORMS)].format(t, u), 1.0))
    for k in range(allowed):
        made = "".join(SYLLABLES[(k * step + step * step + k // len(SYLLABLES)) % len(SYLLABLES)] for step in (1, 5, 7, 11)[: 2 + k % 3])
        names.append((made if k % 5 else ALLOWED_NAMES[(k // 5) % len(ALLOWED_NAMES)], 0.0))
    rows = []
    for k, (name, label) in enumerate(names):
        path = PATHS[(k // 4) % len(PATHS)].format(k * 37 % 1000)
        rows.append((f"https://{PREFIXES[(k // 2) % len(PREFIXES)]}{name}.{DOMAINS[(k + k // 7) % len(DOMAINS)]}{path}", label))
    return spark.createDataFrame(rows, "url string, blocked double")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased. Path: from there up to ? or #."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(rule_name(r[0], r[1])), r[0], r[1])):  # the longest is put outermost
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def char_grams(text: Column, prefix: str) -> Column:
    """Character n-grams of each size, marked so that host and path don't share features; texts shorter than one size
    give none of it."""
    parts = [
        F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.concat(F.lit(prefix), F.substr(text, i, F.lit(n)))))
        .otherwise(F.array().cast("array<string>"))
        for n in SIZES
    ]
    return F.concat(*parts)


def featurised(urls: DataFrame, host: Column, path: Column, grams: str, features: str, n_features: int = N_FEATURES) -> DataFrame:
    marked_host = F.concat(F.lit("^"), host, F.lit("$"))
    urls = urls.withColumn(grams, F.array_distinct(F.concat(char_grams(marked_host, "h:"), char_grams(path, "p:"))))
    return HashingTF(inputCol=grams, outputCol=features, numFeatures=n_features, binary=True).transform(urls).drop(grams)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", max_iter: int = 50, reg: float = 0.001, n_features: int = N_FEATURES) -> LogisticRegressionModel:
    host, path = split_url(F.col(url_col))
    t = labelled.where(F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("label"))
    t = featurised(t, F.col("host"), F.col("path"), "grams", "features", n_features).coalesce(1)
    return LogisticRegression(maxIter=max_iter, regParam=reg, standardization=False).fit(t)


def judge(urls: DataFrame, model: LogisticRegressionModel, url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``urls`` plus host, path, rule, verdict and score (probability of block by the regression)."""
    host, path, rule, verdict, score, grams, features, raw, prob, guess, ruled = fresh(urls, "host", "path", "rule", "verdict", "score", "_grams", "_features", "_raw", "_prob", "_guess", "_ruled")
    h, p = split_url(F.col(url_col))
    d = urls.select("*", h.alias(host), p.alias(path))
    name, v = rule_columns(F.col(host), F.col(path), rules)
    d = d.select("*", name.alias(rule), v.alias(ruled))
    d = featurised(d, F.col(host), F.col(path), grams, features, model.numFeatures)
    model = model.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(guess)
    d = model.transform(d).withColumn(score, F.get(vector_to_array(F.col(prob)), F.lit(1)))
    d = d.withColumn(verdict, F.coalesce(F.col(ruled), F.when(F.col(score) >= threshold, "block").otherwise("allow")))
    return d.select(*[F.col(f"`{c}`") for c in urls.columns], host, path, rule, verdict, score)
