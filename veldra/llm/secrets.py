"""Secret scanning: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Features of a candidate are its length, how its characters follow one another, how much of it a
dictionary covers, where it stands (path) and which words stand beside it. The forest is Spark's own
and is trained on labelled findings, a table of the same columns with a ``label``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that secrets are assigned to, forms of issued keys, and words that speak for or against a secret.
ASSIGNED = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "access-key", "auth_token", "client_secret", "private_key", "credential")
ISSUED = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk_live_[A-Za-z0-9]{16,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----(?:[^-]*+-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----)?",
)
FOR_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "key", "auth", "bearer", "credential", "login")
AGAINST_WORDS = ("example", "sample", "placeholder", "dummy", "test", "fixture", "hash", "sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "uuid", "guid", "id", "etag")
PATHS = ("test", "tests", "example", "examples", "fixture", "fixtures", "doc", "docs", "sample", "samples", "mock")

_NAMED = rf"(?i:{'|'.join(ASSIGNED)})[\"']?\s?(?::|=)\s?[\"']?"
_RUN = r"(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])"
#: A candidate: a value assigned to a secret's name (the name is part of the match), an issued key, or a long run.
PATTERN = rf"(?:(?<![A-Za-z0-9]){_NAMED}[^\s\"'<>]{{6,}}+|{'|'.join(rf'(?<![A-Za-z0-9]){p}' for p in ISSUED)}|(?<![A-Za-z0-9+/_=-]){_RUN})"
#: Whole words that are looked at on either side.
NEIGHBOURS = 5
#: Words of the dictionary: the first so many of a vocabulary's whole words of at least four letters.
WORDS, SHORTEST = 12_000, 4

CLASSES = {"v": "[aeiou]", "c": "[b-df-hj-np-tv-z]", "u": "[A-Z]", "d": "[0-9]", "o": "[^A-Za-z0-9]"}
FEATURES = ["length", *(f"t_{a}{b}" for a in CLASSES for b in CLASSES), "distinct", "hex", "coverage", "assigned", "issued", "for_words", "against_words", "path_words"]
#: Longer values have this length as a feature; the value itself is never cut.
LONGEST = 256
TREES, DEPTH, SEED, THRESHOLD = 40, 12, 7, 0.5
#: The forest is fitted on at most so many findings, the first in the order of their hash.
SAMPLE = 20_000


def dictionary(vocabulary: str, words: int = WORDS) -> list[str]:
    """Whole words of a public tokenizer's vocabulary file (word ends marked ``</w>``), the most common first."""
    with open(vocabulary, encoding="utf-8") as f:
        ranked = json.load(f)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(ranked, key=ranked.get) if w.endswith("</w>"))
    return [w for w in whole if len(w) >= SHORTEST and re.fullmatch("[a-z]+", w)][:words]


@lru_cache(maxsize=4)
def any_of(words: tuple[str, ...]) -> str:
    """A pattern for the longest of ``words`` at a place, as a tree over their letters."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def written(at: dict) -> str:
        rest = [c + written(below) for c, below in sorted(at.items()) if c]
        if not rest:
            return ""
        body = rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})"
        return body if "" not in at else f"(?:{body})?"

    return written(tree) or "(?!)"


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """``(doc_id, pos, value, name, before, after, path)`` for each candidate of each row's whole text.

    Values of any length are whole, and so are the :data:`NEIGHBOURS` words on either side. Null and empty
    texts have none; null and repeated ``doc_id`` are ordinary rows; an empty table gives no rows. Extra
    columns are not carried, so their names do not matter.
    """
    path = F.col(path_col) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    hit = rows.where(F.col("text").rlike(PATTERN)).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    parts = hit.withColumn("gaps", F.split("text", PATTERN, -1)).select("doc_id", "path", "gaps", F.posexplode("found").alias("pos", "match"))
    gap = lambda i: F.translate(F.element_at("gaps", (F.col("pos") + i).cast("int")), "\t\n\r", "   ")
    value = F.regexp_replace("match", f"^{_NAMED}", "")
    name = F.regexp_extract("match", f"^{_NAMED}", 0)
    before, after = F.substring_index(gap(1), " ", -(NEIGHBOURS + 1)), F.substring_index(gap(2), " ", NEIGHBOURS + 1)
    return parts.select("doc_id", "pos", value.alias("value"), name.alias("name"), before.alias("before"), after.alias("after"), "path")


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of ``words`` stands in the text by itself: not inside an address, a path or another name."""
    return F.lower(text).rlike(rf"(?<![a-z0-9.@/_-])(?:{'|'.join(words)})(?![a-z0-9@/_-]|\.[a-z0-9])").cast("double")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with a number for each of :data:`FEATURES`, nulls read as empty; ``words`` is the dictionary."""
    value = F.coalesce("value", F.lit(""))
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    text = F.concat_ws(" ", "before", "name", "after")
    unknown = F.regexp_replace(F.lower(value), any_of(tuple(words)) + r"|(.)\1{3,}", "")
    cols = {
        "length": F.least(n, F.lit(float(LONGEST))),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "coverage": 1 - F.length(unknown) / n,
        "assigned": (F.coalesce("name", F.lit("")) != "").cast("double"),
        "issued": value.rlike("|".join(ISSUED)).cast("double"),
        "for_words": _any_word(text, FOR_WORDS),
        "against_words": _any_word(text, AGAINST_WORDS),
        "path_words": F.lower(F.coalesce("path", F.lit(""))).rlike(rf"(?<![a-z])(?:{'|'.join(PATHS)})(?![a-z])").cast("double"),
    }
    for a, first in CLASSES.items():
        for b, second in CLASSES.items():
            cols[f"t_{a}{b}"] = F.regexp_count(value, F.lit(f"{first}(?={second})")) / n
    return found.withColumns(cols)


def train(labelled: DataFrame, words: list[str], sample: int = SAMPLE) -> RandomForestClassificationModel:
    """A forest for ``labelled(value, name, before, after, path, label)``; label 1 is a secret.

    At most ``sample`` findings in one sorted partition: which rows a tree draws depends on partitions and
    their order, and so the same findings give the same forest on any cluster.
    """
    given = labelled.select("value", "name", "before", "after", "path", F.col("label").cast("double").alias("label"))
    order = [F.xxhash64(*given.columns), *given.columns]
    some = given.orderBy(*order).limit(sample).repartition(1).sortWithinPartitions(*order)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(some, words)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)


def scan(docs: DataFrame, forest: RandomForestClassificationModel, words: list[str], threshold: float = THRESHOLD, path_col: str = "source") -> DataFrame:
    """Each candidate of ``docs`` with ``p_secret`` and ``is_secret``; a document without candidates has no row.

    Odd rows are as said at :func:`candidates`.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, path_col), words))
    scored = forest.transform(rows).withColumn("p_secret", vector_to_array("probability")[1])
    return scored.select("doc_id", "pos", "name", "value", "p_secret", (F.col("p_secret") >= threshold).alias("is_secret"))


def findings(spark: SparkSession, words: list[str], n: int = 9000) -> DataFrame:
    """``n`` labelled findings by rule: issued and assigned keys, and what is often taken for them.

    Stands in for a table of reviewed findings. Secrets are drawn from digits of a hash in many lengths and
    alphabets, in the forms of :data:`ISSUED` or assigned to a name; the others are placeholders, words of
    the dictionary, references to settings, digests named as such, identifiers, paths and numbers.
    """
    draw = lambda i, k: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(k)).cast("int")
    among = lambda i, options: F.element_at(F.array(*[F.lit(x) for x in options]), draw(i, len(options)) + 1)
    common = words[:: max(1, len(words) // 400)] or ["word"]
    word = lambda i: among(i, common)
    syllable = lambda i: among(i, ("an", "er", "in", "on", "at", "re", "en", "ti", "ou", "ha", "the", "ing", "ed", "es", "or"))

    h = F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256)
    more = F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512)
    base = F.regexp_replace(F.base64(F.unhex(more)), "[=\r\n]", "")
    letters = F.regexp_replace(base, "[+/]", "")
    cut = lambda text, i, lengths: F.substr(text, F.lit(1), among(i, lengths))
    invented = lambda i, k: F.concat(*[syllable(i + j) for j in range(k)])
    prose = F.when(draw(90, 2) == 0, F.concat_ws(" ", word(91), word(92), word(93), word(94))).otherwise(F.concat_ws(" ", *[invented(100 + 10 * k, 3) for k in range(4)]))
    # Any word may stand beside a secret, also one that speaks against it.
    prose = F.when(draw(99, 4) == 0, F.concat_ws(" ", prose, among(89, AGAINST_WORDS), word(88))).otherwise(prose)
    after = F.concat(among(95, (' "', "\n", " ", ", ", '" ')), F.when(draw(96, 2) == 0, word(97)).otherwise(invented(150, 3)))
    name = among(1, [w + s for w in ASSIGNED for s in (' = "', "=", ": ", '": "', " = ")])
    name = F.when(draw(2, 4) == 0, F.upper(name)).otherwise(name)
    against = F.concat_ws(" ", prose, among(5, AGAINST_WORDS), F.lit(""))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    none, path = F.lit(""), among(98, ("src/app", "web", "lib/core/main", "src1", "notes"))
    digest = F.when(draw(6, 4) == 0, F.upper(h)).otherwise(h)
    pem = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base, F.lit("\n-----END RSA PRIVATE KEY-----"))
    number = F.conv(F.substring(h, 1, 8), 16, 10)
    #: (value, name, before, path, label)
    forms = [
        (cut(digest, 7, (24, 32, 36, 48, 56, 64)), name, prose, path, 1),
        (cut(digest, 8, (20, 28, 32, 44, 64)), name, prose, path, 1),
        (cut(letters, 9, (16, 22, 32, 43, 64)), name, prose, path, 1),
        (cut(base, 10, (24, 40, 64)), name, prose, path, 1),
        (F.concat(F.substring(letters, 1, 7), among(11, ("!", "#", "$", "%")), F.substring(letters, 9, 3)), name, prose, path, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), none, prose, path, 1),
        (F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)), none, prose, path, 1),
        (F.concat(F.lit("xoxb-"), F.substring(number, 1, 8), F.lit("-"), F.substring(letters, 1, 24)), none, prose, path, 1),
        (F.concat(F.lit("eyJ"), F.substring(letters, 1, 20), F.lit("."), F.substring(letters, 20, 30), F.lit("."), F.substring(letters, 40, 30)), among(12, ("token: ", "")), prose, path, 1),
        (cut(letters, 13, (32, 40)), none, F.concat_ws(" ", prose, among(14, ("bearer", "auth", "login", "key")), F.lit("")), path, 1),
        (pem, none, prose, path, 1),
        (F.concat_ws("_", word(20), word(21), word(22)), name, prose, path, 0),
        (F.concat(word(20), among(23, ("123", "2024", "1", "007"))), name, prose, path, 0),
        (F.concat(among(24, ("your", "my", "the", "insert")), F.lit("-"), word(20), among(25, ("-here", "-token", "-value"))), name, prose, path, 0),
        (F.concat(among(26, ("${", "$(", "os.environ[", "process.env.", "config.get(")), F.upper(F.concat_ws("_", word(20), word(21))), among(27, ("}", ")", "]"))), name, prose, path, 0),
        (F.concat(F.repeat(among(28, ("x", "0", "*", "1", "a")), draw(29, 20) + 8)), name, prose, path, 0),
        (invented(30, 8), name, prose, path, 0),
        (F.substr(digest, F.lit(1), among(31, (32, 40, 64))), none, against, path, 0),
        (uuid, none, against, path, 0),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), none, against, among(32, ("tests/fixtures/keys", "docs/examples/setup")), 0),
        (cut(letters, 33, (24, 32, 40)), name, prose, among(34, ("tests/unit", "examples/app", "docs/guide")), 0),
        (F.concat_ws("/", word(20), word(21), invented(50, 4), F.concat(word(22), F.substring(number, 1, 3))), none, prose, path, 0),
        (F.concat(F.concat_ws("-", word(20), word(21), word(22), word(23)), F.lit("-"), F.substring(number, 1, 4)), none, prose, path, 0),
        (F.concat(invented(60, 9), F.substring(number, 1, 2)), none, prose, path, 0),
    ]
    kinds = F.array(*[F.struct(v.alias("value"), m.alias("name"), b.alias("before"), p.alias("path"), F.lit(y).alias("label")) for v, m, b, p, y in forms])
    rows = spark.range(n).withColumn("f", F.element_at(kinds, (F.col("id") % len(forms) + 1).cast("int")))
    return rows.select("f.value", "f.name", "f.before", after.alias("after"), "f.path", "f.label")
