"""Secret scan with false-positive removal by a random forest, in DataFrame and SQL functions only.

*Candidates.* Every run of non-space characters that, without quotes and closing punctuation and without a ``name=`` or
``name:`` before it, has at least ``MIN_LENGTH`` characters and a digit or an issuer's format; and every non-empty value, however short,
that is assigned to a credential's name in its run (``pwd=x``, ``"api_key":"x"``) or in the runs before it (``password = x``, ``token: x``).
Members of compact JSON are taken apart. Each keeps the name, the two runs before it, the one after it, and the path of its document.

*Features.* Length; shares of digits, capitals, small letters and other characters; entropy and share of distinct
characters; transitions between character classes per character, and between vowels and consonants; share of the
value covered by dictionary words; signs of test paths; whether the name and the neighbouring words speak of
credentials or of harmless identifiers; digits only, hexadecimal only, repeated characters.

*Forest.* Trained on a bounded sample of labelled findings (``sample`` per label, those with the smallest hash), and
applied to every candidate. ``seed_labels`` gives labels where none exist: formats whose prefix and length are fixed
by their issuers, and values assigned to a credential's name, are secrets; addresses, dates, plain numbers and
values made of dictionary words are not; everything else stays unlabelled for the forest to decide.

Defined results: null or empty texts give no candidates; equal findings get equal scores and are all reported;
ids may be null or repeated; null paths count as no path; without labelled findings of both labels every
score is the share of secrets among them (0.5 without any); values are shown masked; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut

MIN_LENGTH = 12
CREDENTIAL = "pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth(orization)?|credentials?|bearer|private.?key|key"
HARMLESS = "sha(1|256|512)?|md5|commit|hash|checksum|digest|uuid|guid|isbn|issn|doi|version|card|phone|tel|id|ref|order|invoice|example|sample|dummy|placeholder"
#: words whose presence inside a value speaks against a random string
DICTIONARY = (
    "example", "sample", "test", "dummy", "placeholder", "changeme", "your", "here", "password", "secret", "token", "user", "name", "admin", "root", "local", "host", "mail",
    "http", "https", "www", "com", "org", "net", "html", "json", "index", "image", "file", "page", "data", "date", "time", "version", "the", "and", "for", "that", "this",
    "with", "from", "have", "not", "are", "was", "will", "can", "all", "der", "die", "und", "das", "ist", "nicht", "ein", "les", "des", "une", "est", "pour", "dans", "que",
    "los", "las", "del", "una", "por", "para", "con", "tion", "ment", "ing", "ung", "cion",
)
#: formats fixed by their issuers
ISSUED = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)$"
PLAIN = (
    r"^[^@]+@[^@]+\.[A-Za-z]+$",  # mail address
    r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$",  # network address
    r"^[\d.,:/+()\-]+$",  # numbers, dates, telephone and card numbers
    r"^(https?://|www\.)",  # web address
)
FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_entropy", "f_distinct", "f_class_steps", "f_vowel_steps", "f_dictionary",
    "f_test_path", "f_path_depth", "f_name_credential", "f_name_harmless", "f_near_credential", "f_near_harmless", "f_after_credential", "f_hex", "f_number", "f_repeat",
)
VOWELS, CONSONANTS = "aeiouyAEIOUY", "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"


#: a name before its value, quoted or not
NAMED = r"^([A-Za-z_][A-Za-z0-9_.\-]*)[\"'`]?(?::=|=>|[=:](?!//))"
#: the comma between two members of compact JSON
MEMBERS = r"(?<=[\"'\]}0-9el]),(?=[\"'])"
LONG = f"[0-9]|{ISSUED.strip('^$')}"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, place, name, value, before2, before1, after): ``place`` is the run's number in the text, from 0."""
    runs = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.split(F.col(text_col).cast("string"), r"\s+").alias("runs"))
    each = runs.select("id", "path", "runs", F.posexplode("runs").alias("place", "run"))
    at = lambda step: F.coalesce(F.get("runs", F.col("place") + step), F.lit(""))
    long = (F.length("run") >= MIN_LENGTH) & F.col("run").rlike(LONG)
    each = each.filter(long | F.col("run").rlike("[=:]") | at(-1).rlike("[=:]>?$"))
    parted = each.select("id", "path", "place", at(-2).alias("before2"), at(-1).alias("before1"), at(1).alias("after"), F.explode(F.split("run", MEMBERS)).alias("piece"))
    parted = parted.withColumn("bare", F.regexp_replace("piece", r"""^["'`(\[{<]+|["'`)\]}>,;.!?]+$""", ""))
    name = F.regexp_extract("bare", NAMED, 1)
    value = F.regexp_replace(F.regexp_replace("bare", NAMED, ""), r"""^["'`]+""", "")
    out = parted.select("id", "path", "place", name.alias("name"), value.alias("value"), "before2", "before1", "after")
    return out.filter(((F.length("value") >= MIN_LENGTH) & F.col("value").rlike(f"[0-9]|{ISSUED}")) | ((F.col("value") != "") & assigned()))


def assigned() -> Column:
    """Whether a value is assigned to a credential's name, in its own run or in those before it."""
    sign = F.col("before1").isin("=", ":", ":=", "=>")
    before = (sign & (speaks_of(CREDENTIAL, "before2") > 0)) | (F.col("before1").rlike("[=:]>?$") & (speaks_of(CREDENTIAL, "before1") > 0))
    return (speaks_of(CREDENTIAL, "name") > 0) | ((F.col("name") == "") & before)


def speaks_of(words: str, *columns: str) -> Column:
    return F.greatest(*[F.lower(F.col(c)).rlike(rf"(^|[^a-z])({words})([^a-z]|$)").cast("double") for c in columns], F.lit(0.0))


def runs_of(value: Column) -> Column:
    """Number of runs of equal characters."""
    return F.length(F.regexp_replace(value, r"(.)\1*", "x"))


def share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def with_features(found: DataFrame) -> DataFrame:
    size = F.length("value").cast("double")
    found = found.withColumn("chars", F.array_distinct(F.split("value", "")))
    portion = lambda c: 1 - F.length(F.replace(F.col("value"), c, F.lit(""))) / size
    entropy = F.aggregate("chars", F.lit(0.0), lambda a, c: a - portion(c) * F.log2(portion(c)))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[A-Z]", "\u0001"), "[a-z]", "\u0002"), "[0-9]", "\u0003"), "[^\u0001\u0002\u0003]", "\u0004")
    sounds = F.translate(F.translate("value", VOWELS, "\u0001" * len(VOWELS)), CONSONANTS, "\u0002" * len(CONSONANTS))
    around = F.greatest(speaks_of(CREDENTIAL, "before1", "before2"), F.lit(0.0))
    features = {
        "f_length": F.length("value").cast("double"),
        "f_digits": share("[^0-9]"), "f_upper": share("[^A-Z]"), "f_lower": share("[^a-z]"), "f_other": share("[A-Za-z0-9]"),
        "f_entropy": entropy, "f_distinct": F.size("chars") / size,
        "f_class_steps": runs_of(classes) / F.length("value"), "f_vowel_steps": runs_of(sounds) / F.length("value"),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower("value"), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.length("value"),
        "f_test_path": F.coalesce(F.lower("path").rlike("test|example|sample|fixture|docs?/"), F.lit(False)).cast("double"),
        "f_path_depth": F.coalesce(F.length("path") - F.length(F.regexp_replace("path", "/", "")), F.lit(0)).cast("double"),
        "f_name_credential": speaks_of(CREDENTIAL, "name"), "f_name_harmless": speaks_of(HARMLESS, "name"),
        "f_near_credential": around, "f_near_harmless": speaks_of(HARMLESS, "before1", "before2"), "f_after_credential": speaks_of(CREDENTIAL, "after"),
        "f_hex": F.col("value").rlike("^[0-9a-f]+$").cast("double"), "f_number": F.col("value").rlike(r"^[\d.,:/+()\-]+$").cast("double"),
        "f_repeat": F.col("value").rlike(r"(.)\1{5,}").cast("double"),
    }
    return found.withColumns(features).drop("chars")


def seed_labels() -> Column:
    """1, 0 or null for a candidate with features, by rules that need no judgement."""
    plain = F.lit(False)
    for pattern in PLAIN:
        plain = plain | F.col("value").rlike(pattern)
    plain = plain | (F.col("f_dictionary") >= 0.6) | (F.col("f_repeat") > 0)
    return F.when(F.col("value").rlike(ISSUED), 1).when(plain, 0).when(assigned() & (F.col("f_entropy") >= 2.5), 1)


def forest(labelled: DataFrame, sample: int = 4000, trees: int = 20, depth: int = 6, seed: int = 11):
    """A fitted forest, or the share of secrets where the labels are not of both kinds."""
    key = F.xxhash64("value", "name", "before1", "before2", "after")
    parts = [labelled.filter(F.col("label") == k).orderBy(key, "value", "name", *FEATURES).limit(sample) for k in (0, 1)]
    rows = cut(parts[0].unionByName(parts[1]).select("label", *FEATURES).coalesce(1).sort("label", *FEATURES), "secret-sample")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")).coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(vectors)


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", **params) -> DataFrame:
    """One row per candidate: id, ``place``, ``name``, masked value, its length and checksum, ``score`` and ``is_secret``.

    ``labels`` holds labelled findings (value, label); without it ``seed_labels`` teaches.
    """
    found = cut(with_features(candidates(docs, id_col, text_col, path_col)), "secret-candidates")
    if labels is None:
        taught = found.withColumn("label", seed_labels())
    else:
        taught = found.join(labels.groupBy("value").agg(F.max("label").cast("int").alias("label")), "value", "left")
    model = forest(taught.filter("label is not null"), **params)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        whole = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(found)
        scored = model.transform(whole).withColumn("score", vector_to_array("probability")[1])
    masked = F.concat(F.substring("value", 1, 4), F.lit("..."))
    return scored.select(F.col("id").alias(id_col), "place", "name", masked.alias("shown"), F.length("value").alias("length"), F.crc32(F.col("value").cast("binary")).alias("value_crc32"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))
