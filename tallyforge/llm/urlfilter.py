"""URL filter: gradient-boosted trees on what a URL looks like, under rules that go first.

Features are lengths, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix.
The trees are Spark ML's; features are built-in functions, so judging is one pass without Python. A labelled
URL's own label never reaches its features: rates of hosts and suffixes come from the folds other than its own, of
which an unlabelled URL has one too. One fold is
kept from the trees and calibrates their log odds, from the share of labels to block on: the less the trees know of that
fold, the closer all probabilities are to the share. Every URL is scored by the trees.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path) of the registered query.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
#: Folds of labelled urls, by a hash of the url; the first one is kept from the trees.
FOLDS = 5
#: Least slope of calibrated log odds: the trees' order of URLs is always kept. How strongly slope and shift are held to no change.
LEAST_SLOPE, HELD = 0.02, (6.0, 4.0)
FEATURES = ["url_len", "host_len", "path_len", "query_len", "depth", "labels", "digits", "digit_ratio", "hyphens", "entropy", "params", "has_fragment", "secure", "suffix_count", "suffix_rate", "host_count", "host_rate"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host after the first :// up to /, ?, # or the end, A-Z lower-cased; path then up to ?, # or the end."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, found, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits. Of equal length the first one given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits stands
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (…, url, host, path) with the lexical features; null urls have zeros."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    bare = F.translate(url, string.digits, "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda a, c: a + F.when(c == "", 0.0).otherwise((lambda p: -p * F.log2(p))((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url))),
    )
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
    return urls.withColumns(
        {
            "url_len": F.length(url).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"), "query_len": F.length(query).cast("double"),
            "depth": count(F.regexp_replace(path, "/+$", ""), "/"), "labels": F.when(host == "", 0.0).otherwise(count(host, ".") + 1),
            "digits": (F.length(url) - F.length(bare)).cast("double"), "digit_ratio": F.when(url == "", 0.0).otherwise((F.length(url) - F.length(bare)) / F.length(url)),
            "hyphens": count(host, "-"), "entropy": entropy, "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "has_fragment": url.contains("#").cast("double"), "secure": url.startswith("https:").cast("double"),
        }
    )


def _statistics(urls: DataFrame, taught: DataFrame, name: str, prior: float) -> DataFrame:
    """Per key: how many urls have it, and its smoothed share of blocked labelled ones without each fold."""
    key = f"_{name}"
    n = urls.groupBy(key).agg(F.log1p(F.count("*").cast("double")).alias(f"{name}_count"))
    sums = [F.sum(F.when(F.col("fold") != k, x)) for k in range(FOLDS) for x in (F.col("label"), F.lit(1.0))]
    rate = taught.groupBy(key).agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in sums]).alias("_s"))
    smooth = lambda b, n: (b + 20 * prior) / (n + 20)
    apart = F.array(*[smooth(F.col("_s")[2 * k], F.col("_s")[2 * k + 1]) for k in range(FOLDS)])
    rate = rate.select(key, apart.alias(f"{name}_apart"))
    return written(n.join(rate, key, "left"))


def ranking(rows: DataFrame, score: str, label: str = "label") -> tuple[float, float]:
    """(area under the ROC curve, its standard error if there were nothing to rank by); (0.5, 0) without both labels.

    Scores are counted in 1000 steps, ties are half.
    """
    steps = rows.groupBy(F.floor(F.col(score) * 1000).alias("s")).agg(F.sum(label).alias("bad"), F.count("*").alias("n")).orderBy("s").collect()  # 1001 rows at most
    below = area = 0.0
    for r in steps:
        area += r.bad * (below + (r.n - r.bad) / 2)
        below += r.n - r.bad
    bad = sum(r.bad for r in steps)
    if not bad or not below:
        return 0.5, 0.0
    return area / (bad * below), ((bad + below + 1) / (12 * bad * below)) ** 0.5


def calibration(z: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """(slope, shift): the log odds of y are base + shift + slope * z, fitted with a ridge towards those of base alone."""
    x, at, ridge = np.stack([z, np.ones(len(z))]), np.zeros(2), np.diag(HELD)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(base + at @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + ridge, x @ (p - y) + ridge @ at)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), LEAST_SLOPE), float(at[1])


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean loss of log odds."""
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z)))) if len(y) else 0.0


def judged(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = (), max_train: int = 20_000, trees: int = 10, depth: int = 3, report: dict | None = None) -> DataFrame:
    """Every row of urls with host, path, rule, verdict, p_block and the method's own verdict.

    urls: (page_id, url). labelled: (url, label), 1 to block. The trees are fitted to at most about max_train
    labelled urls, those whose hash falls under max_train / (all of them), but for one fold of FOLDS; suffix and host
    statistics count all urls and labels. That fold, a fifth of max_train at most, calibrates the trees: p_block is their
    probability for every url. report: gets auc and chance on it, slope and shift, and loss (each half of the fold
    calibrated by the other) beside prior_loss, that of the share of labels to block. Null urls and urls without ://
    have empty host and path and are judged by their looks, urls of any length whole. With labels of one kind only, or
    none, or of one kind outside the fold, there are no trees, and the method says what the share of labels says, or
    allow. A url is blocked at a probability of one half or more. Repeated rows stay; null page_ids too. Other
    columns are not looked at. Empty in, empty out.
    """
    host, path = parts(F.col("url"))
    keyed = lambda df: df.withColumns({"host": host, "path": path}).withColumns({"_suffix": suffix(F.col("host")), "_host": F.col("host")})
    fold = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS)).cast("int")
    at = keyed(urls.select("page_id", "url")).withColumn("fold", fold)
    taught = keyed(labelled.select("url", F.col("label").cast("double")).where("label is not null")).withColumn("fold", fold)
    n, blocked = taught.agg(F.count("*"), F.sum("label")).first()
    prior = (blocked or 0.0) / n if n else 0.0
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    score = F.lit(prior)
    scored = at
    if 0 < prior < 1:
        statistics = {name: _statistics(at, taught, name, prior) for name in ("suffix", "host")}

        def featured(rows: DataFrame) -> DataFrame:
            rows = lexical(rows)
            for name, known in statistics.items():
                rows = rows.join(known, f"_{name}", "left")
                rows = rows.withColumns({f"{name}_rate": F.coalesce(F.col(f"{name}_apart")[F.col("fold")], F.lit(prior)), f"{name}_count": F.coalesce(f"{name}_count", F.lit(0.0))})
            return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

        sample = taught.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < 1e6 * max_train / n)
        sample = written(featured(sample).select("features", "label", "fold"))
        start, kept_out = sample.where("fold > 0"), sample.where("fold = 0")
        both = start.agg(F.min("label"), F.max("label")).first()
        if both[0] != both[1]:
            model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(start)
            margin = 2 * vector_to_array("rawPrediction")[1]
            centre = model.transform(start).agg(F.avg(margin)).first()[0]
            base = float(np.log(prior / (1 - prior)))
            rows = model.transform(kept_out).select((margin - centre).alias("z"), "label").toArrow()
            z, y = (rows.column(c).to_numpy() for c in ("z", "label"))
            slope, shift = calibration(z, y, base)
            if report is not None:
                halves = np.arange(len(z)) % 2
                crossed = [calibration(z[halves != h], y[halves != h], base) for h in (0, 1)]
                odds = np.where(halves == 0, *(base + b + a * z for a, b in crossed))
                auc, chance = ranking(model.transform(kept_out).withColumn("p", vector_to_array("probability")[1]), "p")
                report.update(auc=auc, chance=chance, slope=slope, shift=shift, loss=log_loss(odds, y), prior_loss=log_loss(np.full(len(y), base), y))
            scored = model.transform(featured(at))
            score = 1 / (1 + F.exp(-(base + shift + slope * (margin - centre))))
    own = F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.withColumn("p_block", score).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block", own.alias("method_verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages whose url ends in the number of a labelled document: low quality or toxic is to block."""
    number = F.expr("try_cast(regexp_extract(url, '^[^?#]*?/([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) as bigint)")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.expr("quality = 0 or toxic = 1").cast("int")).alias("label"))
    return pages.select("url", number.alias("_doc")).join(bad, "_doc").select("url", "label")


def op2_urlfilter(spark, sf_dir: str) -> DataFrame:
    """All pages, by rules and by trees that learn from labelled_urls."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judged(pages, labelled_urls(pages, labels), RULES)
