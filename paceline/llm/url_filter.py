"""URL verdicts: rules, and gradient-boosted trees on lexical features for all other URLs.

Rules name a host and a path. The URLs that a rule decides are the labelled ones: from
at most `sample` of them, the first by a hash, the trees learn to tell block from allow
by length, depth, digit ratio, entropy, number of parameters and how often URLs of the
same host suffix are blocked. Suffix counts cover all labelled URLs; suffixes are hashed
into a fixed number of buckets, so the table that is sent to all tasks is bounded.

A null url, or one without `://`, has an empty host and path, so no rule fits, and the
trees judge it like any other. If no URL is labelled, or all are labelled alike, all
others get that verdict (allow without labels). Repeated rows give rows each. An empty
table gives no row. Extra columns are left out; a null page_id is kept.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import shared_folder, stored, table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SAMPLE = 20_000
SUFFIX_BUCKETS = 4096
#: Labelled URLs that a suffix must have until its own rate counts for half.
PRIOR = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_length",
    "host_length",
    "path_length",
    "host_depth",
    "path_depth",
    "digit_ratio",
    "entropy",
    "parameters",
    "symbols",
    "domain_rate",
    "domain_seen",
    "top_rate",
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for a null url or one without `://`."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def fitting(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host before path on equal lengths), and its verdict."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))

    def first(value) -> Column:
        cases = [
            F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.lit(value((h, p, v))))
            for h, p, v in order
        ]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    return first(lambda r: r[0] + r[1]), first(lambda r: r[2])


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    counts = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    bits = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def number_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def suffix_bucket(labels: int) -> Column:
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -labels)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_depth": F.size(F.split("host", r"\.")).cast("double"),
            "path_depth": number_of(F.col("path"), "/").cast("double"),
            "digit_ratio": number_of(url, "[0-9]") / n,
            "entropy": entropy(url),
            "parameters": F.when(query == "", 0.0).otherwise(number_of(query, "&") + 1.0),
            "symbols": number_of(url, "[-_%~@]").cast("double"),
            "domain": suffix_bucket(2),
            "top": suffix_bucket(1),
        }
    )


def suffix_rates(labelled: DataFrame, name: str, overall: float) -> DataFrame:
    """Share of blocked URLs in each bucket, drawn to the overall share: at most SUFFIX_BUCKETS rows."""
    n, blocked = F.count("*"), F.sum("label")
    return labelled.groupBy(name).agg(((blocked + PRIOR * overall) / (n + PRIOR)).alias(f"{name}_rate"), F.log1p(n).alias(f"{name}_seen"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = parts(F.col("url"))
    rule, decided = fitting(rules)
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    urls = urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "decided": decided})
    spark, out = pages.sparkSession, ["page_id", "host", "path", "rule", "verdict"]
    folder = shared_folder(spark, "urls")
    known = lexical(urls.where("decided is not null")).withColumn("label", (F.col("decided") == "block").cast("double"))
    known = known.select("url", "label", "domain", "top", *FEATURES[:9])
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        only = "block" if 1.0 in counts else "allow"
        return urls.withColumn("verdict", F.coalesce("decided", F.lit(only))).select(*out)
    overall = counts[1.0] / sum(counts.values())
    rates = [(name, stored(suffix_rates(known, name, overall), f"{folder}/{name}")) for name in ("domain", "top")]

    def rated(frame: DataFrame) -> DataFrame:
        for name, rate in rates:
            frame = frame.join(F.broadcast(rate), name, "left")  # at most SUFFIX_BUCKETS rows
        frame = frame.fillna(overall, ["domain_rate", "top_rate"]).fillna(0.0, ["domain_seen"])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)

    picked = known.orderBy(F.xxhash64("url"), "url").limit(sample)
    train = rated(stored(picked, f"{folder}/sample")).select("label", "features")
    model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=42).fit(train.coalesce(1))
    judged = model.transform(rated(lexical(urls)))
    method = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("decided", method)).select(*out)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
