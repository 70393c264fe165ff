"""Secret scanning: broad candidates, and a random forest that removes false positives.

Candidates are runs of sixteen or more key characters that mix digits and letters, or
lower and upper case inside the run, and the values assigned after a secret-like word
(quoted, or up to white space; any length and characters).  Where a value and a run
differ, both are candidates.  The forest sees their length, the transitions
between kinds of characters and how many are common letter pairs, the share covered by
dictionary words, the path (here: the document's source) and the neighbouring words.  It
is trained by Spark ML on labelled findings (:func:`labelled_findings`: a table with
candidate, before, after, path and label; a generated one is provided and any other may be
passed).  DataFrame functions and Spark ML's own transformers only, no Python per row.

Null or empty text has no candidates; a null path counts as empty; very long texts are
scanned whole.  Repeated rows give repeated findings.  An empty table gives an empty
result.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.llm._common import durable

_RUN = r"[A-Za-z0-9+/=_\-]{16,}"
#: Where an assigned value begins: after a secret-like word, the rest of its name, a closing quote, = or :, and a scheme.
_NAME = r"(?i:passphrase|passwd|password|passw|pwd|secret|token|api.?key|access.?key|private.?key|client.?key|auth|authorization|credentials?)[\w.\-]{0,20}[\"']?\]?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}"
_SCHEME = r"(?i:(?:bearer|basic)[ \t]{1,4})?"
_AFTER = lambda quote: rf"(?<=[=:>\s]{quote})(?<={_NAME}{_SCHEME}{quote})"
_ASSIGNED = (
    rf"""{_AFTER('"')}[^"\r\n]+(?=")|{_AFTER("'")}[^'\r\n]+(?=')|{_AFTER("[\"']")}[^\s"']+"""
    rf"""|{_AFTER("")}(?!(?i:bearer|basic)[ \t]|=>|[=:>][\s"'])[^\s"'](?:\S*[^\s"',;.)\]}}>])?"""
)
#: Words that stand before keys, and before harmless long values.
_NEAR_SECRET = r"(?i)(token|secret|passw|passwd|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|client.?key)"
_NEAR_HARMLESS = r"(?i)(commit|sha-?\d*|checksum|digest|hash|uuid|guid|md5|integrity|revision|etag|version|build|id|ref|see|file|page|url|trace|example|sample|dummy)\W*$"
_PLACE_SECRET = r"(?i)(config|\.env|settings|deploy|secret|credential|\.ya?ml|\.ini|\.properties)"
_PLACE_HARMLESS = r"(?i)(test|example|sample|doc|vendor|fixture|lock|mock|node_modules)"
#: Common words of code; the dictionary where no other is passed.
_WORDS = (
    "the and for with from this that have not are you your here key token secret password value name user data file test example sample "
    "change placeholder default config service client server access account public private string number index table order page image "
    "content message error request response build version release production staging internal external module package class method "
    "function object array list map set get put post delete update insert select create handler manager factory controller"
).split()
#: The most frequent letter pairs of English.
_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = [
    f"f_{name}" for name in "length letters_digits lower_upper repeats pairs dictionary distinct digits upper symbols hex uuid "
    "before_secret before_harmless assigned quoted path_secret path_harmless prefix punctuation".split()
]


def vocabulary_words(*paths: str) -> tuple[str, ...]:
    """A dictionary: the whole words (a space before them, four letters or more) of tokenizer vocabularies, whose files
    have one base64 token and its rank a line."""
    found = set()
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                if re.fullmatch(r" [^\W\d_]{4,}", token):
                    found.add(token[1:].lower())
    return tuple(sorted(found))


@lru_cache(maxsize=4)
def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for the longest of the words at a place, as a tree of their letters: a word costs its length, not the
    dictionary's size."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def shown(node: dict) -> str:
        rest = [re.escape(letter) + shown(below) for letter, below in sorted(node.items()) if letter]
        if not rest:
            return ""
        return f"(?:{'|'.join(rest)})" + ("?" if "" in node else "")

    return shown(tree)


def features(candidate: Column, before: Column, after: Column, path: Column, words: tuple[str, ...] = tuple(_WORDS)) -> list[Column]:
    """The numbers the forest sees, in the order of FEATURES.  The share of a candidate that the dictionary's ``words``
    make up is its dictionary coverage."""
    size = F.char_length(candidate)
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / size
    low = F.lower(candidate)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    covered = 1 - F.char_length(F.regexp_replace(low, _any_of(words), "")) / size
    values = [
        F.least(size, F.lit(200)), share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        share(r"(.)(?=\1)"), F.regexp_count(low, F.lit("(?=(" + "|".join(_PAIRS) + "))")) / size, covered,
        F.size(F.array_distinct(F.split(candidate, ""))) / size, share("[0-9]"), share("[A-Z]"), share(r"[+/=_\-]"),
        flag(candidate.rlike("^(?i)[0-9a-f]+$")), flag(candidate.rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")),
        flag(F.substring(before, -30, 30).rlike(_NEAR_SECRET)), flag(F.regexp_replace(F.substring(before, -30, 30), r"[=:\"'\s]+$", "").rlike(_NEAR_HARMLESS)),
        flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        flag(path.rlike(_PLACE_SECRET)), flag(path.rlike(_PLACE_HARMLESS)), flag(candidate.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk_|sk-|pk_|xox|eyJ|glpat|npm_)")),
        share(r"[^A-Za-z0-9+/=_\-]"),
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)]


def labelled_findings(spark: SparkSession, rows: int = 8000, seed: int = 5, words: tuple[str, ...] = tuple(_WORDS)) -> DataFrame:
    """Generated findings with labels: keys of many kinds in their usual places, and look-alikes, made of words spread
    over the dictionary (some two hundred of them) and of the common ones."""
    some = [*_WORDS, *words[:: len(words) // 100 or 1]]

    def draw(salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0

    def pick(salt: int, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.floor(draw(salt) * len(options)) + 1).cast("int"))

    def chars(salt: int, alphabet: str, n: Column) -> Column:
        one = lambda k: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(k, F.col("id"), F.lit(salt), F.lit(seed)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), one), "")

    def joined(salt: int, by: str, n: int, words: list[str]) -> Column:
        return F.array_join(F.array(*(pick(salt + k, words) for k in range(n))), by)

    lower, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed = lower + lower.upper() + digits
    capital = [w.capitalize() for w in some]
    spoken = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    length = F.floor(draw(1) * 44) + 20
    hex_any = chars(2, hexa, F.element_at(F.array(*map(F.lit, (32, 40, 40, 40, 48, 64))), (F.floor(draw(3) * 6) + 1).cast("int")))
    hex_any = F.when(draw(4) < 0.2, F.upper(hex_any)).otherwise(hex_any)
    uuid = F.concat_ws("-", *(chars(10 + k, hexa, F.lit(n)) for k, n in enumerate((8, 4, 4, 4, 12))))
    kinds = [  # candidate, label, harmless surroundings
        (hex_any, 1, False), (chars(5, mixed + "+/", length), 1, False), (F.concat(F.lit("AKIA"), chars(6, lower.upper() + digits, F.lit(16))), 1, False),
        (F.concat(pick(7, ["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_"]), chars(8, mixed, F.lit(30))), 1, False), (chars(9, mixed, F.lit(24)), 1, False),
        (hex_any, 0, True), (uuid, 0, True), (joined(40, "", 3, capital), 0, True), (joined(50, "_", 3, [*some, "v2", "x1", "2024"]), 0, True),
        (F.concat(joined(60, "/", 3, some), F.lit("/2024/"), chars(20, digits, F.lit(4))), 0, True), (F.concat(F.lit("your_"), joined(70, "_", 2, some), F.lit("_1")), 0, False),
        (F.repeat(pick(21, ["xX", "0a", "A1", "x0x", "12ab"]), 10), 0, False), (F.concat(F.lit("2024"), chars(22, digits, F.lit(12)), F.lit("a")), 0, True),
        (F.concat(joined(80, "", 5, spoken), chars(23, digits, F.lit(2)), joined(90, "", 4, spoken)), 0, True),
        (F.concat(joined(100, "-", 3, some), F.lit("-"), chars(24, digits, F.lit(3))), 0, True),
        # assigned values: short, with punctuation, of one kind of character; and what else stands after such words
        (chars(110, mixed, F.floor(draw(111) * 9) + 6), 1, False), (chars(112, mixed + "!@#$%^&*.:,?", F.floor(draw(113) * 18) + 7), 1, False),
        (chars(114, digits, F.floor(draw(115) * 10) + 6), 1, False), (chars(116, lower, F.floor(draw(117) * 12) + 8), 1, False),
        (F.concat(pick(118, capital), chars(119, digits, F.lit(3)), pick(120, ["!", "#", "$", "", "."])), 1, False),
        (pick(121, [*some, *capital]), 0, False), (joined(122, " ", 3, some), 0, False), (joined(130, ".", 2, some), 0, False), (joined(134, "_", 2, some), 0, False),
        (pick(140, ["None", "null", "true", "false", "required", "optional", "string", "str", "0", "1", "the", "a", "********", "xxxxxxxx", "...", "<password>", "<secret>"]), 0, False),
        (F.concat(pick(141, ["${", "{{", "$(", "<", "%"]), F.upper(joined(142, "_", 2, some)), pick(145, ["}", "}}", ")", ">", "%"])), 0, False),
        (F.concat(pick(146, ["os.environ[", "getenv(", "config.get(", "self.", "request."]), joined(147, "_", 2, some)), 0, False),
    ]
    secret = pick(30, ['token = "', "api_key: ", 'API_KEY="', "password=", 'secret = "', "Authorization: Bearer ", "access_key = '", 'TOKEN = "', "auth_token: "])
    harmless = pick(31, ["commit ", "sha256:", 'checksum = "', "see file ", "uuid=", 'id: "', "the page ", "digest: ", "revision ", "http://x.example/", " and the ", "etag: "])
    before = F.concat(pick(32, ["the value of ", "set ", "\n", "const ", "in the ", "# ", ""]), F.when(F.col("plain"), harmless).otherwise(secret))
    quote = F.regexp_extract(before, "([\"'])$", 1)
    which = (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int")
    table = spark.range(rows).withColumn(
        "k", F.element_at(F.array(*(F.struct(c.alias("candidate"), F.lit(y).alias("label"), F.lit(p).alias("plain")) for c, y, p in kinds)), which)
    ).select("id", "k.*")
    return table.select(
        "candidate", before.alias("before"), F.concat(quote, pick(33, [" ", "\n", ";", ", and", "."])).alias("after"),
        pick(34, ["", "", "forum", "app/config.yaml", "src/main.py", ".env", "docs/readme.md", "tests/test_a.py"]).alias("path"), "label",
    )


def trained(findings: DataFrame, *, words: tuple[str, ...] = tuple(_WORDS), trees: int = 24, depth: int = 8, seed: int = 3) -> PipelineModel:
    table = durable(findings.select(*features(*(F.col(c) for c in ("candidate", "before", "after", "path")), words), F.col("label").cast("double").alias("label")))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8,
    )
    return PipelineModel([gather, forest.fit(gather.transform(table))])


def _matches(docs: DataFrame, pattern: str, text: str, path: str) -> DataFrame:
    """doc_id, start (characters before it), candidate, before, after, path of each match."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.where(body.rlike(pattern)).select(
        "doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1)).alias("runs"), F.split(body, pattern, -1).alias("gaps"),
    )
    cells = F.aggregate(
        F.sequence(F.lit(0), F.size("runs") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, k: F.struct(
            (acc["at"] + F.char_length(F.get("gaps", k)) + F.char_length(F.get("runs", k))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.char_length(F.get("gaps", k)))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    return found.select("doc_id", "path", "runs", "gaps", F.posexplode(cells).alias("k", "start")).select(
        "doc_id", "start", F.get("runs", F.col("k")).alias("candidate"), F.substring(F.get("gaps", F.col("k")), -60, 60).alias("before"),
        F.substring(F.get("gaps", F.col("k") + 1), 1, 20).alias("after"), "path",
    )


def candidates(docs: DataFrame, *, text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, start (characters before it), candidate, before, after, path."""
    c = F.col("candidate")
    mixes = c.rlike("[0-9]") & c.rlike("[A-Za-z]") | c.rlike("[a-z][A-Z]")
    # a value that is a whole run is found as that run, unless its name runs into it
    apart = ~(c.rlike(f"^{_RUN}$") & mixes & ~F.col("before").rlike(r"[A-Za-z0-9+/=_\-]$") & ~F.col("after").rlike(r"^[A-Za-z0-9+/=_\-]"))
    # the name alone is a far cheaper search than the value behind it
    named = docs.where(F.coalesce(F.col(text), F.lit("")).rlike(_NAME))
    return _matches(docs, _RUN, text, path).where(mixes).unionByName(_matches(named, _ASSIGNED, text, path).where(apart))


def scan(docs: DataFrame, findings: DataFrame | None = None, *, words: tuple[str, ...] = tuple(_WORDS), text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start, length, sha256, score, is_secret.  ``words``: the dictionary, for example
    :func:`vocabulary_words`; a part of the plan, so a hundred thousand words at most."""
    if len(words) > 100_000:
        raise ValueError("the dictionary may have 100,000 words at most")
    words = tuple(words)
    model = trained(labelled_findings(docs.sparkSession, words=words) if findings is None else findings, words=words)
    own = candidates(docs, text=text, path=path)
    measured = own.select(
        "doc_id", "start", F.char_length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256"),
        *features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), words),
    )
    scored = model.transform(measured).withColumn("score", F.round(vector_to_array("_probability")[1], 6))
    return scored.select("doc_id", "start", "length", "sha256", "score", (F.col("score") >= 0.5).alias("is_secret"))
