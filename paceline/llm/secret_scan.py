"""Secrets in texts: word candidates, and a random forest that removes false positives.

Candidates are words that hold a digit and a long value or a known key format, and all
values of 8 characters or more assigned to a credential's name, in the same word or in
one before. The forest sees the value's length, entropy, character transitions,
shares of digits, capitals and vowels, how much of it common words cover, the path of
the document (column `path`, or else `source`) and the words around it. It learns from
labelled findings: those given, or else the candidates whose kind is beyond doubt (known
key formats and values assigned to a credential's name against numbers, identifiers,
addresses, placeholders and words), at most `sample` of each label, the first by a hash.
The rarer label's findings are repeated up to the other's number, so every tree sees them.

A null or empty text has no candidates; so has an empty table. Without findings of both
labels no forest can be grown, and the findings labelled as secrets are returned.
Repeated rows give rows each; a null doc_id is kept. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import shared_folder, stored, table

SAMPLE = 20_000
TREES, DEPTH = 20, 6
LEAST_SCORE = 0.5
REDACTED = "[SECRET]"
SPACE = r"[\x09-\x0D\x20]+"
TRAILING = "\"'`)]}>.,;:!?=*#$%&~^|+-_/\\»”’…"
DELIMITERS = "=:\"'`([{<,;|&"
NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer)"
CREDENTIAL = rf"(?i){NAME}\W*$"
SEPARATOR = r"(?:=>|:=|=|:)"
#: A word after which a credential's value comes.
ANNOUNCES = rf"(?i)({NAME}[\"'`)\]]*{SEPARATOR}|\bbearer)$"
#: A value behind its name: up to the closing quote, or to the next name of a list or query.
WITHIN = rf"(?i)(?:{NAME}|key)[\"'`]?{SEPARATOR}(?:\"([^\"]+)|'([^']+)|([^\"'].*?)(?=[;,&|][\"']?\w+[\"']?[=:]|$))"
PLACEHOLDER = r"(?i)(example|changeme|placeholder|dummy|sample|your[_-]|xxxx|0000000|1234567|<|\$\{)"
#: Words that are no comment on the candidate beside them.
ADDRESS = r"\S*[@./]\S*"
#: Public key formats.
FORMATS = r"(?:A(?:KI|SI)A[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"
FORMAT = f"^{FORMATS}$"
FORMAT_WITHIN = f"(?<![A-Za-z0-9]){FORMATS}(?![A-Za-z0-9])"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
#: Parts of common words.
DICTIONARY = ["tion", "ing", "ment", "able", "the", "and", "ent", "ion", "user", "name", "test", "file", "page", "data", "http", "html", "version", "release", "node", "com", "www", "index", "item", "ver", "ung", "eau", "ado"]
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
FEATURES = [
    "length",
    "entropy",
    "transitions",
    "digits",
    "capitals",
    "vowels",
    "hexadecimal",
    "covered",
    "credential",
    "assigned",
    "placeholder",
    "dots",
    "test_path",
    "path_depth",
]


def around(text: Column) -> Column:
    """Candidate words of a text with their place and neighbours."""

    def wanted(words: Column, i: Column) -> Column:
        word = F.get(words, i)
        long = (F.length(word) >= 12) & word.rlike(r"[0-9]") & word.rlike(r"[A-Za-z0-9+/_-]{12}|[0-9.]{7}")
        named = (F.length(word) >= 12) & word.rlike(WITHIN)
        return long | named | announced(words, i) | ((F.length(word) >= 12) & word.rlike(FORMAT_WITHIN))

    def announced(words: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        apart = before.rlike(f"^{SEPARATOR}$") & F.get(words, i - 2).rlike(CREDENTIAL)
        return (F.length(F.get(words, i)) >= 8) & F.coalesce(before.rlike(ANNOUNCES) | apart, F.lit(False))

    def entry(words: Column, i: Column) -> Column:
        before = F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))
        return F.struct(
            i.alias("place"), F.get(words, i).alias("word"), before.alias("before"), F.get(words, i + 1).alias("after"), announced(words, i).alias("announced")
        )

    def of(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        return F.transform(F.filter(places, lambda i: wanted(words, i)), lambda i: entry(words, i))

    # as an array of one, the words are split once and not for each place
    return F.flatten(F.transform(F.array(F.split(text, SPACE)), of))


def share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1))


def entropy(text: Column) -> Column:
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    bits = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def value_of() -> Column:
    """The value in a candidate word: a known format, what is assigned to a name, or what follows the last delimiter."""
    word = F.col("word")
    trimmed = F.rtrim(word, F.lit(TRAILING))
    marked = F.translate(trimmed, DELIMITERS, "\x01" * len(DELIMITERS))
    plain = F.right(trimmed, F.length(F.substring_index(marked, "\x01", -1)))
    known = F.regexp_extract(word, FORMAT_WITHIN, 0)
    # only one of the three is not empty
    within = F.rtrim(F.concat(*[F.regexp_extract(word, WITHIN, k) for k in (1, 2, 3)]), F.lit(TRAILING))
    alone = F.regexp_replace(trimmed, r"^[\"'`(\[{<]+", "")
    return F.when(known != "", known).when(within != "", within).when(F.col("announced"), alone).otherwise(plain)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place, value and features of each candidate; text_key: a hash of the text."""
    path = next((c for c in ("path", "source") if c in docs.columns), None)
    path = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), path.alias("path")).where("text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "path", F.inline(around(F.col("text"))))
    rows = rows.withColumn("value", value_of()).where("length(value) >= 8")
    head = F.left("word", F.instr("word", F.col("value")) - 1)
    context = F.concat_ws(" ", "before", head)
    value, lower = F.col("value"), F.lower("value")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return rows.withColumns(
        {
            "length": F.length(value).cast("double"),
            "entropy": entropy(value),
            "transitions": (F.length(runs) - 1) / F.greatest(F.length(value) - 1, F.lit(1)),
            "digits": share(value, "[0-9]"),
            "capitals": share(value, "[A-Z]"),
            "vowels": share(lower, "[aeiou]"),
            "hexadecimal": flag(lower.rlike("^[0-9a-f]+$")),
            "covered": share(lower, "|".join(DICTIONARY)),
            "credential": flag(context.rlike(CREDENTIAL)),
            "assigned": flag(context.rlike(r"[=:]\W*$|(?i)\bbearer\W*$")),
            "placeholder": flag(F.concat_ws(" ", F.regexp_replace("before", ADDRESS, ""), value).rlike(PLACEHOLDER)),
            "dots": share(value, "[.]"),
            "test_path": flag(F.col("path").rlike(TEST_PATH)),
            "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
            "url": flag(F.col("word").rlike("://|@|^www[.]")),
        }
    )


def labelled(found: DataFrame) -> DataFrame:
    """Candidates beyond doubt, with `label` 1 for secrets and 0 for others."""
    value = F.col("value")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    named = (F.col("credential") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 8)
    false = (
        ((F.col("url") == 1) & (~named | value.rlike("://|^www[.]")))
        | value.rlike(r"^[0-9.,:/()+_-]*$")
        | value.rlike(UUID)
        | ((F.col("covered") >= 0.5) & (F.col("entropy") < 3.5))
        | (~mixed & ~named)
    )
    plain = (F.col("credential") == 0) & (F.col("transitions") < 0.2)
    sure = F.when(F.col("placeholder") == 1, 0.0).when(value.rlike(FORMAT), 1.0).when(false, 0.0)
    # a name's value without a digit is left to the forest
    label = sure.when(named & mixed, 1.0).when(plain, 0.0)
    return found.withColumn("label", label).where("label is not null")


def scored(found: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The candidates with `score`: the share of trees' votes for a secret."""
    known = labelled(found) if findings is None else findings
    order = F.xxhash64("value", "doc_id", "place")
    of_label = [known.where(F.col("label") == k).orderBy(order, "value").limit(sample) for k in (0.0, 1.0)]
    picked = of_label[0].unionByName(of_label[1]).select("label", *FEATURES)
    picked = stored(picked, shared_folder(found.sparkSession, "findings"))
    counts = {r[0]: r[1] for r in picked.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        sure = labelled(found).select("doc_id", "text_key", "place", "value", F.col("label").alias("score"))
        return sure
    times = F.when(F.col("label") == 1, round(max(counts.values()) / counts[1.0])).otherwise(round(max(counts.values()) / counts[0.0]))
    even = picked.select("*", F.explode(F.sequence(F.lit(1), times)).alias("copy_number"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42)
    model = forest.fit(assembler.transform(even).coalesce(1))
    judged = model.transform(assembler.transform(found))
    return judged.select("doc_id", "text_key", "place", "value", vector_to_array("probability")[1].alias("score"))


def secrets(docs: DataFrame, findings: DataFrame | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, text_key, place (word number), value and score of each secret."""
    found = stored(candidates(docs), shared_folder(docs.sparkSession, "candidates"))
    return scored(found, findings).where(F.col("score") >= least_score)


def redacted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with each secret replaced, and n_chars counted anew where it is a column."""
    found = secrets(docs, least_score=least_score).select("text_key", F.struct((-F.length("value")).alias("n"), "value").alias("secret"))
    # a text's own secrets, the longest first
    of_text = found.groupBy("text_key").agg(F.sort_array(F.collect_set("secret")).alias("secrets_found"))
    keyed = docs.withColumn("text_key_here", F.xxhash64(F.col("text").cast("string")))
    # one way of joining at every size: findings are few, but their number is not bounded
    joined = keyed.join(of_text.hint("merge"), F.col("text_key_here") == of_text["text_key"], "left")
    clean = F.aggregate("secrets_found", F.col("text").cast("string"), lambda t, s: F.replace(t, s["value"], F.lit(REDACTED)))
    joined = joined.withColumn("text", F.when(F.col("secrets_found").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        count = F.when(F.col("secrets_found").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        joined = joined.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: whose, which word, the value's SHA-256 and the score."""
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("value_length"), "score")
