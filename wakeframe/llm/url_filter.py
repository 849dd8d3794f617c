"""Blocking URLs: rules on host and path first, then a logistic model on their character n-grams.

DataFrame functions and Spark ML only. N-grams are cut by one regular expression (a look-ahead at each
place), so a long URL takes linear time; they are hashed to a fixed number of features.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
FEATURES = 1 << 16
L2 = 0.0005
THRESHOLD = 0.5
# Labelled rows that a model is fitted on, at most: those whose URL has the smallest hash.
LABELLED_ROWS = 50_000


@dataclass(frozen=True)
class Rule:
    """``place`` is a host, with its subdomains, and what the path starts with."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.place[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit(f".{self.host}"))) & F.startswith(path, F.lit(self.path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, ?, # or the end, A-Z in lower case; '' for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The rule that fits, as a struct (place, verdict); the longest of several, null if none does. A short list: it becomes one expression."""
    out = F.lit(None).cast("struct<place:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.place)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.place).alias("place"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(value: Column, sizes: tuple[int, ...]) -> list[Column]:
    return [F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]


def _features(urls: DataFrame, host: Column, path: Column, name: str, features: int) -> DataFrame:
    """``urls`` with a vector of hashed n-grams: of the host between marks, so that its ends count, and of the path. What both hold is one feature."""
    marked = F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")
    grams = F.concat(*_grams(marked, HOST_GRAMS), *_grams(path, PATH_GRAMS))
    cut = HashingTF(inputCol=f"{name}_grams", outputCol=name, numFeatures=features, binary=True)
    return cut.transform(urls.withColumn(f"{name}_grams", grams)).drop(f"{name}_grams")


def train(labelled: DataFrame, features: int = FEATURES, rows: int = LABELLED_ROWS) -> LogisticRegressionModel | float:
    """A model of label 1 (block) from (url, label 0/1); other labels and null URLs do not count.

    Of more than ``rows`` labelled rows, those whose URL hashes lowest are taken. With one class or no rows there is
    nothing to fit: the smoothed share of label 1 is returned instead.
    """
    known = labelled.filter(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    picked = known.orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    total, positive = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, total):
        return (positive + 1) / (total + 2)
    # One partition in a fixed order, so that the same rows give the same model.
    cut = _features(picked.orderBy(F.xxhash64("url"), "url", "label").coalesce(1), host_of(F.col("url")), path_of(F.col("url")), "features", features)
    return LogisticRegression(regParam=L2, elasticNetParam=0.0, maxIter=100, standardization=False, fitIntercept=False).fit(cut.select("label", "features"))


def judge(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel | float, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score DOUBLE): for every row, no shuffle.

    ``rule`` is the longest one that fits, null if none does; then the verdict is ``block`` for a score above ``threshold``.
    A null URL, or one without ``://``, has an empty host and path, no n-grams, and a score of a half, so it is allowed by default.
    Rows that repeat are judged each; other columns are not read, whatever their names. An empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    cut = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    if isinstance(model, float):
        scored = cut.withColumn("score", F.lit(model))
    else:
        vector = model.setFeaturesCol("features").setProbabilityCol("chances").setRawPredictionCol("").setPredictionCol("")
        scored = vector.transform(_features(cut, host, path, "features", model.numFeatures)).withColumn("score", vector_to_array("chances")[1])
    ruled = scored.withColumn("found", rule_of(rules, host, path))
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("found.place").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "score")


# A small labelled table (fixed values): what hosts to block are about, ordinary topics, and words that go with either.
BLOCKED_TOPICS = """
casino poker slots betting bets jackpot lottery viagra pills pharmacy meds loans credit payday ads adserver
banner popup tracker click pixel spam farm bulk porn adult xxx cams dating replica prize warez crack phish
""".split()
ORDINARY_TOPICS = """
news herald library garden weather trains math history museum science kitchen cooking hiking birds council health school
district art theatre linux python docs wiki journal research film chess cycling tennis music maps photos poems letters
stories travel essays village forest
""".split()
NAMELESS = 60
MODIFIERS = "online best free cheap my top win shop club world daily city".split()
SUFFIXES = ["example.com", "example.org", "example.net"]
FORMS = ["https://{t}.{s}/en/{n}", "http://www.{t}.{s}/de/{n}.html", "https://m.{t}.{s}/fr/{n}/", "http://blog.{t}.{s}/es/{n}?page=2", "https://{t}.{s}/{n}"]


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label): each topic alone, before or after other words in a host name, and as a folder. Prefixes, suffixes, words and
    numbers turn alike for both labels, so that only the topic tells them apart. Made-up names are ordinary."""
    out = []
    for k in range(NAMELESS):
        digest = hashlib.sha256(str(k).encode()).digest()
        name = "".join(LOWER[b % 26] for b in digest[: 4 + k % 5])
        out.append((FORMS[k % len(FORMS)].format(t=name, s=SUFFIXES[k % 3], n=211 * (k % 30)), 0))
    for label, topics in ((1, BLOCKED_TOPICS), (0, ORDINARY_TOPICS)):
        for k, topic in enumerate(topics):
            words = [MODIFIERS[(k + 5 * i) % len(MODIFIERS)] for i in range(4)]
            names = [topic, f"{words[0]}-{topic}", f"{topic}-{words[1]}", f"{words[2]}-{topic}", f"{topic}-{words[3]}"]
            for i, name in enumerate(names):
                out.append((FORMS[(k + i) % len(FORMS)].format(t=name, s=SUFFIXES[(k + i) % 3], n=211 * (k % 30) + i), label))
            out.append((f"https://www.{SUFFIXES[k % 3]}/{topic}/{211 * (k % 30)}", label))
    return out
