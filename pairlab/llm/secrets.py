"""Secret scans in DataFrame functions: candidate values, and a random forest that removes false positives.

A candidate is a value of 12 or more key characters with a digit and a letter, wherever it stands, one of 6
or more characters of any kind that a credential's name is set to, or a password of any length in a URL; a word
can have many. An authentication scheme such as `Bearer` belongs to the name and is no value. Features are length, character transitions, alphabet, dictionary coverage, path and neighbouring words. The forest is trained by
Spark ML on labelled findings and becomes a column expression, so scanning is one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import hashed_share, materialise

#: Documents that the forest's findings stand in at most, and three-letter groups in the dictionary.
SAMPLE, GROUPS = 400, 600
TREES, DEPTH = 15, 5
MASK = "[SECRET]"
#: Names that credentials and digests go by.
CREDENTIAL = "(?i)(token|secret|passw|pwd|api|(?<![a-z])key|key(?![a-z])|auth(?!or)|bearer|credential|private|access|://[^\\s/:@]*:$)"
NAME = "(?:token|secret|passw(?:or)?d?|passphrase|pwd|key|auth|credentials?)"
SCHEMES = "(?:bearer|basic|digest|token|negotiate|ntlm|apikey)"
DIGEST = "(?i)(commit|sha|md5|checksum|hash|digest|uuid|guid|etag|rev|version|build|order|invoice|doc|page|isbn|file|image)"
KEY = "[A-Za-z0-9+/_~.-]"
#: A whole run of key characters with a digit and a letter; only a run's start is tried, so long runs cost their length.
RUN = f"(?<!{KEY})(?={KEY}*[0-9])(?={KEY}*[A-Za-z]){KEY}{{12,}}+={{0,2}}"
#: What a credential's name is set to; ends at a quote, a comma, or the next setting of a query string.
SET = rf"(?<={NAME}[A-Za-z_]{{0,12}}[\"']{{0,2}}[:=][\"'(]{{0,2}})(?!{SCHEMES}$)(?:[^\s\"',;<>&(){{}}]|&(?![\w.-]+=)){{6,}}+"
#: What stands between a URL's user name and its host; the first condition spares most places the second.
URL = r"(?<=:)(?<=://[^\s/:@]{0,255}:)[^\s/@]++(?=@)"
VALUE = f"(?i:{SET})|{URL}|{RUN}"
#: A word that holds a setting, and text before a word that ends in one.
SETS, SET_BEFORE = rf"(?i){NAME}[A-Za-z_]{{0,12}}[\"']{{0,2}}[:=]", rf"(?i){NAME}[A-Za-z_]{{0,12}}[\"')]{{0,2}}\s*[:=]\s*[\"'(]?$"
#: Words that set a name of authentication to a scheme, whose value is the next word.
SCHEME_BEFORE = rf"(?i)auth[A-Za-z_]{{0,12}}[\"')]{{0,2}}\s*[:=]\s*[\"'(]?{SCHEMES}$"
#: Characters before a later value of a word that are its cue, and values back that a cue without letters is looked for.
CUE, BACK = 60, 32
FEATURES = ["length", "transitions", "digits", "uppers", "hexes", "distinct", "dictionary", "separators", "path", "prefix", "assigned", "credential", "digest", "quoted"]


def set_before(last: Column, second: Column, third: Column) -> Column:
    """Whether the words before, the nearest first, set a credential's name to what follows, or name a scheme that it belongs to."""
    named = last.rlike("[:=][\"'(]?$") & F.concat_ws(" ", second, last).rlike(SET_BEFORE)
    return named | (last.rlike(f"(?i){SCHEMES}$") & F.concat_ws(" ", third, second, last).rlike(SCHEME_BEFORE))


def has_candidates(word: Column, *before: Column) -> Column:
    run = (F.length(word) >= 12) & word.rlike("[0-9]") & word.rlike("[A-Za-z]") & word.rlike(f"{KEY}{{12}}")
    url = word.contains("://") & word.contains("@")
    return run | (word.rlike("[:=]") & word.rlike(SETS)) | url | ((F.length(word) >= 6) & set_before(*before))


def values_of(word: Column, before: Column) -> Column:
    """array of (value, near, head, around) for all values in a word; before: the two words ahead of it, blank-joined.

    near is the cue: for the first value `before` and what stands ahead of it in the word, for a later one the text
    since the value before; where that has no letter (lists), the last such text that has one. around is the word,
    or where it has several values, the value with its own surroundings.
    """

    def of(parts: Column) -> Column:
        values, gaps = parts["values"], parts["gaps"]
        first = F.concat_ws(" ", before, F.get(gaps, F.lit(0)))

        def one(v: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            start = F.greatest(i + 1 - BACK, F.lit(2))
            lettered = F.filter(F.slice(gaps, start, F.greatest(i + 2 - start, F.lit(0))), lambda g: g.rlike("[A-Za-z]"))
            near = F.when(i == 0, first).when(F.size(lettered) > 0, F.right(F.get(lettered, F.size(lettered) - 1), F.lit(CUE))).otherwise(first)
            around = F.when(F.size(values) == 1, word).otherwise(F.concat(F.right(gap, F.lit(CUE)), v, F.left(F.get(gaps, i + 1), F.lit(1))))
            return F.struct(v.alias("value"), near.alias("near"), gap.alias("head"), around.alias("around"))

        return F.transform(values, one)

    parts = F.struct(F.regexp_extract_all(word, F.lit(VALUE), F.lit(0)).alias("values"), F.split(word, VALUE).alias("gaps"))
    return F.flatten(F.transform(F.array(parts), of))


def share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def feature_struct(found: Column, groups: Column) -> Column:
    """The features of a value as values_of gives it."""
    v, near, head, around = (found[k] for k in ("value", "near", "head", "around"))
    n = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1"))
    low = F.lower(v)
    threes = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))), lambda g: g.rlike("^[a-z]{3}$"))
    known = F.size(F.filter(threes, lambda g: F.array_contains(groups, g)))

    def flag(c: Column) -> Column:
        return c.cast("double")

    values = {
        "length": F.length(v).cast("double"), "transitions": (runs - 1) / n, "digits": share(v, "[^0-9]"), "uppers": share(v, "[^A-Z]"),
        "hexes": share(v, "[^0-9a-fA-F]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "dictionary": known / n,
        "separators": share(v, "[^/._~-]"), "path": flag(around.rlike(r"/.*/|://|\.(html?|php|js|css|png|jpg|py|txt|com|org|net)\b") | around.contains("@")),
        "prefix": flag(v.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|eyJ|glpat)")), "assigned": flag(near.rlike(r"[=:]\s*[\"']?$")),
        "credential": flag(near.rlike(CREDENTIAL)), "digest": flag(near.rlike(DIGEST)), "quoted": flag(head.rlike("[\"']$")),
    }
    return F.struct(v.alias("value"), *[values[k].cast("double").alias(k) for k in FEATURES])


def candidates(text: Column, groups: Column) -> Column:
    """array of (position, f): a candidate's value and features, and its word's number from 0."""

    def of(words: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(words, i), F.lit(""))

        def whole(i: Column) -> Column:
            """The word; after words that set a name, with a name of its own, so that its pattern sees it."""
            return F.when(set_before(at(i - 1), at(i - 2), at(i - 3)), F.concat(F.lit("key="), at(i))).otherwise(at(i))

        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: has_candidates(at(i), at(i - 1), at(i - 2), at(i - 3)))
        found = F.flatten(F.transform(places, lambda i: F.transform(values_of(whole(i), F.concat_ws(" ", at(i - 2), at(i - 1))), lambda x: F.struct(i.alias("position"), x.alias("x")))))
        return F.transform(found, lambda c: F.struct(c["position"].alias("position"), feature_struct(c["x"], groups).alias("f")))

    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.flatten(F.transform(F.array(words), of))


def dictionary(docs: DataFrame, groups: int = GROUPS) -> list[str]:
    """The commonest three-letter groups of lower-case words: at most `groups` of the 17,576 there can be."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) between 3 and 30").groupBy("w").agg(F.count("*").alias("n"))
    threes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("g"), "n")
    top = threes.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(groups).collect()
    return sorted(r.g for r in top)


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(text, label): findings of known kind set among words of the documents, fifteen secrets and twenty false positives each."""
    low = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    w = [F.coalesce(F.get(low, F.lit(i)), F.lit("word")) for i in (1, 3, 5)]
    salt = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    sha, md5 = F.sha1(salt), F.md5(salt)
    upper = F.translate(F.upper(F.substring(F.sha2(salt, 256), 1, 16)), "0189", "XYZW")
    base = F.regexp_replace(F.base64(F.unhex(F.substring(F.sha2(salt, 256), 1, 48))), "[+/=]", "x")
    year = F.concat(F.lit("20"), F.substring(F.regexp_replace(sha, "[a-f]", "1"), 1, 2))
    uuid = F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12))
    digits = F.regexp_replace(sha, "[a-f]", "7")
    lit = F.lit
    secret = [
        F.concat(lit('token = "'), sha, lit('"')), F.concat(lit("password="), F.substring(md5, 1, 18)), F.concat(lit("AKIA"), upper),
        F.concat(lit("api_key: "), base), F.concat(lit("secret: '"), md5, lit("'")), F.concat(lit("auth token "), base),
        F.concat(lit("password: "), w[0], w[1], w[2], w[0]), F.concat(lit('password = "'), F.substring(base, 1, 5), lit("&"), F.substring(digits, 1, 2), F.substring(base, 7, 4), lit('"')),
        F.concat(lit("pwd="), F.initcap(w[0]), lit("-"), F.initcap(w[1]), F.substring(digits, 1, 3), lit("!")), F.concat(lit("secret_key='"), F.substring(base, 1, 12), lit("#"), w[2], lit("'")),
        F.concat(lit('{"access_token":"'), base, lit('"}')),
        F.concat(lit("Authorization: Bearer "), base), F.concat(lit("Proxy-Authorization: Basic "), F.substring(base, 1, 20), lit("==")),
        F.concat(lit("postgres://"), w[0], lit(":"), F.substring(base, 1, 12), lit("@"), w[1], lit(".com/"), w[2]), F.concat(lit("https://"), w[1], lit(":"), w[0], F.substring(digits, 1, 3), lit("@"), w[2], lit(".org")),
    ]
    plain = [
        F.concat(lit("commit "), sha), F.concat(lit("md5: "), md5), F.concat(lit("id="), uuid), F.concat(lit("checksum = "), sha),
        F.concat(lit("https://www."), w[0], lit(".com/"), year, lit("/"), w[1], lit("-"), w[2], lit(".html")), F.concat(lit("/usr/lib/"), w[0], F.substring(digits, 1, 2), lit("/"), w[1], w[2]),
        F.concat(w[0], w[1], w[2], F.substring(digits, 1, 2)), F.concat(w[0], lit("_"), w[1], lit("_"), year), F.concat(w[0], lit("."), F.substring(digits, 1, 2), lit("@"), w[1], lit("."), w[2], lit(".org")),
        F.concat(lit("author: "), w[0], w[1]), F.concat(lit("keywords: "), w[0], lit("-"), w[1]), F.concat(lit("monkey="), w[0], w[2], F.substring(digits, 1, 2)),
        F.concat(lit("token: "), w[0]), F.concat(lit("password: "), w[1]), F.concat(lit("key="), w[2]),
        F.concat(lit('{"commit":"'), sha, lit('"}')), F.concat(lit("digest "), F.sha2(salt, 256)), F.concat(lit('"etag":"'), md5, lit('"')),
        F.concat(F.upper(F.substring(w[0], 1, 5)), lit("-"), F.substring(digits, lit(1), 9 + F.pmod(F.crc32(salt), lit(14)).cast("int"))), F.concat(w[1], lit(" "), F.substring(digits, 3, 4), lit("-"), F.substring(digits, 9, 8), lit("-"), F.substring(w[0], 1, 1)),
    ]
    rows = F.array(*[F.struct(c.alias("finding"), lit(1.0).alias("label")) for c in secret], *[F.struct(c.alias("finding"), lit(0.0).alias("label")) for c in plain])
    return docs.select(F.explode(rows).alias("r"), w[0].alias("a"), w[1].alias("b")).select(F.concat_ws(" ", "a", "b", "r.finding", "b").alias("text"), "r.label")


def tree_votes(node, fields: Column) -> Column:
    """A tree of the forest as a column: 1.0 where it says secret."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    name = FEATURES[split.featureIndex()]
    return F.when(fields[name] <= float(split.threshold()), tree_votes(node.leftChild(), fields)).otherwise(tree_votes(node.rightChild(), fields))


class Scanner:
    """A dictionary and a forest, as columns."""

    def __init__(self, groups: list[str], trees: list):
        self.groups, self.trees = groups, trees

    def chance(self, fields: Column) -> Column:
        """Share of the trees that say secret; without trees, what the cues alone say."""
        if not self.trees:
            return F.when((fields["credential"] + fields["prefix"] > 0) & (fields["digest"] == 0), F.lit(1.0)).otherwise(F.lit(0.0))
        return reduce(lambda a, b: a + b, [tree_votes(t, fields) for t in self.trees]) / len(self.trees)


def train(docs: DataFrame, rows: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Scanner:
    """Trains on findings among the words of at most about `rows` documents, chosen by a hash of the id; the dictionary is of all."""
    usable = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    sample = hashed_share(usable, "doc_id", rows, usable.count())
    groups = dictionary(docs)
    found = labelled_findings(sample).select(F.explode(candidates(F.col("text"), F.lit(groups).cast("array<string>"))).alias("c"), "label").select("c.f.*", "label")
    found = materialise(found.select(*FEATURES, "label"), "findings")  # training reads it many times
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found).select("features", "label")
    kinds = ready.agg(F.count_distinct("label")).first()[0]
    if kinds < 2:
        return Scanner(groups, [])
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, featureSubsetStrategy="0.6", cacheNodeIds=False).fit(ready)
    return Scanner(groups, [t._call_java("rootNode") for t in model.trees])


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """docs plus findings: array of (position, value, score, secret); secret from the threshold on.

    A null or wordless text has none; a text of any length is one row's work. A column named findings is replaced, others pass through; repeated
    rows stay; an empty table gives no rows. A value that stands twice is found twice.
    """
    groups = F.lit(scanner.groups).cast("array<string>")
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "findings"]
    scored = F.transform(candidates(F.col("text"), groups), lambda c: F.struct(c["position"].alias("position"), c["f"]["value"].alias("value"), scanner.chance(c["f"]).alias("score")))
    marked = F.transform(scored, lambda c: F.struct(c["position"].alias("position"), c["value"].alias("value"), c["score"].alias("score"), (c["score"] >= threshold).alias("secret")))
    return docs.select(*names, marked.alias("findings"))


def redacted(text: Column, findings: Column) -> Column:
    """text with each secret value replaced by MASK."""
    values = F.array_distinct(F.transform(F.filter(findings, lambda f: f["secret"]), lambda f: F.struct((-F.length(f["value"])).alias("less"), f["value"].alias("value"))))
    return F.aggregate(F.array_sort(values), text, lambda t, v: F.replace(t, v["value"], F.lit(MASK)))  # the longest first: one can be part of another


def mask_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The documents with their secrets masked; n_chars, where there is one, follows the text.

    A null text stays null; other columns, repeated rows and an empty table stay as they are.
    """
    found = scan(docs, scanner)
    text = redacted(F.col("text"), F.col("findings"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.exists("findings", lambda f: f["secret"]), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[v.alias(k) for k, v in columns.items()])


def digest(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, positions, secrets_sha256): word positions and hash of the values of the secrets."""
    found = scan(docs.select("doc_id", "text"), scanner).withColumn("secrets", F.filter("findings", lambda f: f["secret"]))
    positions = F.array_join(F.transform("secrets", lambda f: f["position"].cast("string")), ",")
    values = F.array_join(F.transform("secrets", lambda f: f["value"]), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), positions.alias("positions"), F.sha2(values, 256).alias("secrets_sha256"))
