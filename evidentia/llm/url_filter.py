"""URL filters: longest-match rules, then logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table (url, blocked), a parameter. The default one is composed by a rule from
common words of unwanted and of ordinary sites; its hosts are invented, under reserved top-level names, and none is a host
that is judged. It knows what kind of words stand in host names, not which hosts are bad.

Cases: a url that is null or has no `://` has an empty host and path; it fits no rule and is judged on no n-grams. Of rules
of equal length, the last by host and path counts. A url of any length is read whole. n-grams are of code points as Spark
splits text, so a character beyond the basic plane may count as two. Empty tables give empty results; extra columns are
ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 500
# Words of host names that a filter of unwanted sites looks for, and words of ordinary sites.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "bets", "lottery", "roulette", "pills", "viagra", "pharmacy", "meds", "adult", "xxx", "cams", "escort", "porn",
    "ads", "adserver", "tracker", "clicks", "popup", "spam", "warez", "keygen", "loans", "payday", "cheap", "free", "win", "bonus",
    "tracking", "linkfarm", "spammer", "betting", "adverts",
)
ORDINARY = (
    "weather", "together", "nothing", "station", "education", "nation", "other", "father", "northern", "library", "museum", "gardens", "history", "science", "travel", "recipes",
    "health", "schools", "university", "theatre", "music", "sports", "economy", "politics", "climate", "reading", "writing", "teaching", "nature", "kitchen", "thread", "there",
    "ciencia", "noticias", "cultura", "salud", "turismo", "nachrichten", "wissenschaft", "schule", "reise", "histoire", "cuisine", "jardin", "musique", "culture", "ether", "within",
)
# Syllables of made-up names, and what stands around a host name; all kinds of hosts have all of these.
SYLLABLES = ("ba", "ke", "lo", "mi", "ru", "san", "ter", "vin", "don", "gra", "thel", "sho")
FORMS = (("", "-", "/"), ("www.", "-", "/en/12"), ("m.", "-", "/es/81.html"), ("blog.", "-", "/de/7/"), ("", "", "/fr/4"))


def composed(words: tuple, steps: tuple) -> list[str]:
    """Urls of hosts of two words: every word with those that stand `steps` places after it, in all forms."""
    return [f"http://{start}{word}{mark}{words[(i + step) % len(words)]}.example{path}" for i, word in enumerate(words) for step in steps for start, mark, path in FORMS]


def made_up() -> list[str]:
    """Urls of hosts with made-up names, one form each: names that say nothing are let through."""
    names = [a + b + end for a in SYLLABLES for b in SYLLABLES for end in ("", "n")]
    return [f"http://{FORMS[i % 5][0]}{name}.example{FORMS[i % 5][2]}" for i, name in enumerate(names)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, blocked."""
    rows = [(u, True) for u in composed(UNWANTED, (1, 5))] + [(u, False) for u in composed(ORDINARY, (1,)) + made_up()]
    return spark.createDataFrame(rows, "url string, blocked boolean").coalesce(1)


def host_of(url: Column) -> Column:
    after = F.regexp_replace(url, r"(?s)^.*?://", "")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.regexp_replace(url, r"(?s)^.*?://", "")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_columns(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null where none does) and its verdict, as one chain of conditions, longest first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def ngrams(chars: Column, mark: str, sizes=(3, 4, 5)) -> Column:
    """All character n-grams of an array of characters; mark tells host from path. chars should be a column of the table: an
    expression would be worked out again for each n-gram."""
    empty = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(F.lit(mark), *(F.get(chars, i + k) for k in range(n))))
        return F.when(F.size(chars) >= n, each).otherwise(empty)

    return F.concat(*map(grams, sizes))


def featured(rows: DataFrame, slots: int = 1 << 14) -> DataFrame:
    """rows (host, path) with a sparse 0/1 vector of hashed n-grams of each between end marks; an empty one has none."""
    marked = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(F.concat(F.lit("^"), c, F.lit("$")), ""), lambda x: x != ""))
    rows = rows.withColumns({"_host": marked("host"), "_path": marked("path")})
    rows = rows.withColumn("_grams", F.concat(ngrams(F.col("_host"), "h"), ngrams(F.col("_path"), "p"))).drop("_host", "_path")
    return HashingTF(numFeatures=slots, binary=True, inputCol="_grams", outputCol="_features").transform(rows)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fits the classifier to a table (url, blocked)."""
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label"))
    fit = LogisticRegression(
        featuresCol="_features",
        labelCol="label",
        regParam=0.01,
        maxIter=60,
        predictionCol="_says",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
    )
    return fit.fit(featured(rows))


def url_filter(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row: the verdict of the longest rule that fits, else the classifier's."""
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(rules)
    said = F.when(F.col("_says") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return model.transform(featured(rows)).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, said).alias("verdict"))
