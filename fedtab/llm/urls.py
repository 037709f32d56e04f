"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The model is trained here from a small labelled URL table (``training_urls``, or any table of ``url`` and
``label`` 1 = block). Everything runs on DataFrame functions and the DataFrame-based ML library.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by
the model on empty text; repeated rows are judged one by one; an empty table gives an empty result. Only the
identifier and url columns are read. Rules are a list written in code, hence small; they travel in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
GRAMS = (3, 4)
BUCKETS = 1 << 14
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of the default training table.
_PLAIN_SITES = ("library", "news", "museum", "weather", "garden", "history", "university", "city-council",
                "recipes", "travel-notes", "physics", "gazette", "hospital", "theatre", "railways", "theorem", "northern", "station", "blossom", "winter-sports")
_PLAIN_PATHS = ("/articles/about.html", "/2021/05/report", "/docs/index.html", "/wiki/Main")
_BOTH_PATHS = ("/en/120", "/de/3/", "/fr/25.html", "/es/981", "/en/44/", "/", "")
_SPAM_SITES = ("spam-farm", "cheap-pills", "casino-bonus", "free-money", "adult-cams", "win-prize", "crack-keygen",
               "payday-loans", "miracle-diet", "hot-singles", "link-farm", "replica-watches")
_SPAM_PATHS = ("/buy-now", "/free-bonus.html", "/cheap/offer", "/win/click")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty when there is no ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = [F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2)]
    return F.translate(part[0], _UPPER, _LOWER), part[1]


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones the longer host."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda x: (len(x[1] + x[2]), len(x[1]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
                      ).otherwise(best)
    return best


def _grams(text: Column, mark: str) -> Column:
    """Marked character n-grams of a text with its ends fenced."""
    fenced = F.concat(F.lit("^"), text, F.lit("$"))
    lists = [F.when(F.length(fenced) >= n, F.transform(
        F.sequence(F.lit(1), F.length(fenced) - (n - 1)),
        lambda i, n=n: F.concat(F.lit(mark), F.substring(fenced, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
        for n in GRAMS]
    return F.concat(*lists)


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``__features``: hashed counts of the n-grams of host and path."""
    host, path = host_and_path(F.col(url_col))
    grams = urls.withColumn("__grams", F.concat(_grams(host, "h"), _grams(path, "p")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features").transform(grams).drop("__grams")


def training_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: every site of the two lists with every path of its list; paths of
    both lists, endings and prefixes are dealt alike, so that they say little by themselves."""
    hosts = [f"{prefix}{{}}.{end}" for prefix in ("", "www.", "blog.", "m.") for end in ("org", "net", "com", "example.org", "example.net")]
    rows = []
    for label, sites, paths in ((0, _PLAIN_SITES, _PLAIN_PATHS), (1, _SPAM_SITES, _SPAM_PATHS)):
        pairs = [(site, path) for site in sites for path in paths + _BOTH_PATHS]
        rows += [(f"https://{hosts[7 * i % len(hosts)].format(site)}{path}", label) for i, (site, path) in enumerate(pairs)]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fits the model; rows without a label are left out."""
    rows = features(labelled).select("__features", F.col("label").cast("double").alias("label")).dropna()
    return LogisticRegression(featuresCol="__features", labelCol="label", maxIter=60, regParam=0.002,
                              standardization=False, probabilityCol="__probability", predictionCol="__prediction",
                              rawPredictionCol="__raw").fit(rows)


def judge(urls: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]] = RULES,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``urls``: the identifier, host, path, rule, verdict, score (probability of block)."""
    light = urls.select(F.col(id_col), F.col(url_col).alias("__url"))
    scored = model.transform(features(light, "__url"))
    host, path = host_and_path(F.col("__url"))
    score = vector_to_array("__probability")[1]
    split = scored.select(F.col(id_col), host.alias("host"), path.alias("path"), score.alias("score"))
    hit = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return (split.withColumn("__hit", hit)
            .select(id_col, "host", "path", F.col("__hit.rule").alias("rule"),
                    F.coalesce("__hit.verdict", own).alias("verdict"), "score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(training_urls(spark)))
