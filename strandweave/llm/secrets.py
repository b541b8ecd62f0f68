"""Secret scans: candidates by shape, false positives removed by a random forest; DataFrame functions and MLlib only.

Candidates are private keys, values set to key-like words, and long runs; the
forest rejects. Its features are those of the candidate (length, character
transitions, dictionary coverage), of the path it stands in, and of the
neighbouring words.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import let

# fixed values: what a candidate is, and what marks the keys of some issuers
_KEYWORD = "passwd|password|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth[_-]?key|credentials?"
#: A private key's block, whole.
_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=,:\s-]*+"
#: What a key-like word is set to, from six characters on, of any kind but blanks, quotes and separators.
_VALUE = rf"""(?<=[=:>\s"'])(?<=[=:>][ \t"']{{0,4}})(?<=(?i:{_KEYWORD})["']?[ \t]{{0,2}}(?:=>?|:)[ \t]{{0,2}}["']?)[^\s"'`,;<>(){{}}]{{6,}}+"""
#: Runs of 16 and more characters of keys and encodings.
_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
CANDIDATE = f"{_BLOCK}|{_VALUE}|{_RUN}"
#: Characters on either side that count as neighbourhood.
NEAR = 48

#: Words that make up identifiers and prose rather than keys.
DICTIONARY = "the and for with from this that name user users data file path test example sample version release build index item value list type group image images static assets content config default main page post article news blog product category public private module package library server client local time date year month report update create delete google python java script style theme color size width height header footer title section button".split()
_KEYISH = r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|api|access|private)"
_HASHISH = r"(?i)(commit|sha[0-9]*|md5|hash|checksum|digest|uuid|guid|etag|version|build|revision|integrity|doi|isbn)"
_PLACEHOLDER = r"(?i)(example|placeholder|changeme|change_me|your[_-]?|dummy|redacted|xxxx|\*\*\*\*|\$\{|%\(|^none$|^null$|^true$|^false$|process\.env|os\.environ|getenv)"
_MARKED = r"^(?:A(?:KIA|SIA|IDA|GPA|ROA)[A-Z2-7]{12}|gh[pousr]_|glpat-|sk-|xox[abprs]-|AIza|ya29|eyJ|-----BEGIN )"
_TESTPATH = r"(?i)(test|example|sample|fixture|mock|lock|vendor|min\.js)"

FEATURES = ("marked", "length", "turns", "digits", "uppers", "distinct", "hex", "covered", "test_path", "keyish", "hashish", "assigned", "quoted", "slashes", "dashes", "letters", "others", "vowels", "block", "placeholder")


def _features(c: Column, before: Column, after: Column, path: Column) -> list[Column]:
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    def flag(cond: Column) -> Column:
        return F.coalesce(cond.cast("double"), F.lit(0.0))

    turns = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    left = F.length(F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    cols = [
        flag(c.rlike(_MARKED)),
        n,
        share(turns),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        1 - left / n,
        flag(path.rlike(_TESTPATH)),
        flag(before.rlike(_KEYISH)),
        flag(before.rlike(_HASHISH)),
        flag(before.rlike("[:=]>?\\s*[\"']?$")),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        share("/"),
        share("[-_]"),
        flag(c.rlike("^[A-Za-z]+$")),
        share("[^A-Za-z0-9+/=_-]"),
        share("[aeiouAEIOU]"),
        flag(F.startswith(c, F.lit("-----BEGIN "))),
        flag(c.rlike(_PLACEHOLDER)),
    ]
    return [x.cast("double").alias(name) for x, name in zip(cols, FEATURES, strict=True)]


def labelled_findings(spark: SparkSession, rows: int = 9600, salt: str = "finding") -> DataFrame:
    """(candidate, before, after, path, label): ``rows`` findings generated by rule, half of them secrets; ``salt`` draws others.

    Secrets are random hex, base64, alphanumeric and all-letter strings and
    passwords set to keys, keys marked by their issuer, and private keys. False positives are digests,
    commit ids, identifiers and paths of words and numbers, long words and
    numbers in prose, code and placeholders that are set to keys, and random strings in test paths. These stand in
    for findings that people have judged; pass your own for your code.
    """
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    at = lambda k, size: F.conv(F.substring(h, k, 3), 16, 10).cast("int") % size
    pick = F.col("id") % 24
    one_of = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (at(k, len(xs)) + 1).cast("int"))
    word = lambda k: one_of(3 * k + 1, DICTIONARY)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    letters = F.regexp_replace(F.concat(b64, F.base64(F.unhex(F.reverse(h)))), "[^A-Za-z]", "")
    case = F.when(F.col("id") % 3 == 0, F.upper(h)).otherwise(h)
    size = one_of(31, (12, 16, 20, 32, 40, 40, 64)).cast("int")
    secret_of = {
        0: F.substring(case, F.lit(1), size), 1: F.substring(case, F.lit(1), size), 2: F.substring(h, F.lit(3), F.lit(40)), 3: b64,
        4: F.substring(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), one_of(33, (16, 20, 24, 32)).cast("int")),
        5: F.substring(letters, F.lit(1), one_of(33, (20, 32, 43)).cast("int")),
        6: F.concat(F.substring(letters, 1, 4), F.lit("!"), F.substring(h, 5, 3), one_of(35, ("#", "&", "$", "@", "%")), F.substring(letters, 9, 4)),
        7: F.concat(F.initcap(word(3)), F.substring(h, 7, 2), one_of(37, ("!", "?", "*", "&3!")), F.substring(letters, 3, 5)),
        8: F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n"), F.reverse(b64), F.lit("\n-----END RSA PRIVATE KEY-----")),
        10: F.substring(h, F.lit(5), one_of(31, (12, 16, 18, 20, 24)).cast("int")), 11: F.substring(F.regexp_replace(b64, "[+/]", ""), F.lit(1), one_of(33, (8, 10, 12, 14)).cast("int")),
        9: F.when(F.col("id") % 48 < 24, F.concat(one_of(39, ("ghp_", "sk-", "xoxb-", "glpat-")), F.substring(letters, 1, 12), F.substring(h, 9, 12))).otherwise(F.concat(one_of(39, ("AKIA", "ASIA", "AIDA", "AGPA")), F.substring(F.upper(F.regexp_replace(b64, "[^A-Za-z2-7]", "")), 1, 16))),
    }
    parts = ("er", "tion", "an", "sche", "lich", "os", "re", "ga", "ment", "ba", "ing", "ver", "ne", "ul", "dad", "eux")
    invented = F.concat(*[one_of(k, parts) for k in (3, 9, 15, 21, 27, 33)])
    false_of = {
        12: F.substring(case, F.lit(1), size), 13: F.substring(h, F.lit(1), F.lit(40)),
        14: F.concat_ws("-", word(0), word(1), word(2), at(40, 4000).cast("string")), 15: F.concat_ws("_", word(3), word(4), word(5), word(6)),
        16: F.concat_ws("/", word(6), word(7), at(47, 4000).cast("string"), word(8)), 17: F.concat(word(1), word(2), word(3), word(4)),
        18: F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))),
        19: one_of(41, ("your_api_key_here", "changeme", "<placeholder>", "${SECRET_TOKEN}", "process.env.TOKEN", "xxxxxxxxxxxxxxxx", "os.environ[KEY]", "example_token_value", "None", "getenv(KEY)")),
        20: F.concat(word(2), F.lit("."), word(3), F.lit("_"), word(4)), 21: F.substring(case, F.lit(1), size),
        22: F.when(F.col("id") % 72 < 24, invented).when(F.col("id") % 72 < 48, F.upper(invented)).otherwise(F.initcap(invented)), 23: F.substring(F.translate(h, "abcdef", "135790"), F.lit(1), one_of(31, (16, 16, 20)).cast("int")),
    }
    candidate = None
    for k, c in {**secret_of, **false_of}.items():
        candidate = F.when(pick == k, c) if candidate is None else candidate.when(pick == k, c)
    quote = F.when(at(60, 3) > 0, '"').otherwise("")
    prose = F.concat(word(9), F.lit(" "), word(10), F.lit(" "))
    name = one_of(50, ("token", "api_key", "secret", "password", "auth_token", "TOKEN", "access_key", "client_secret", "GATEWAY_SIGNING_SECRET", "pwd"))
    sums = one_of(52, ("commit ", "sha256: ", "md5 = ", 'checksum: "', 'integrity="', "revision ", 'uuid = "', 'etag: "'))
    set_to = F.concat(prose, name, one_of(55, (" = ", ": ", "=", " => ")), quote)
    # private keys, and keys whose issuer marks them, also stand in plain prose
    before = F.when((pick == 8) | ((pick == 9) & (at(57, 4) > 0)), prose).when((pick <= 11) | pick.isin(19, 20, 21), set_to).when(pick <= 13, F.concat(prose, sums)).otherwise(prose)
    path = F.when(pick == 21, F.concat(F.lit("tests/fixtures/"), word(11))).otherwise(F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    after = F.when((pick <= 13) | pick.isin(19, 20, 21), F.concat(quote, F.lit(" "))).otherwise(" ")
    return spark.range(rows).select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), (pick <= 11).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 20, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings; rows without candidate or label don't count."""
    known = findings.where("candidate is not null and label is not null")
    rows = known.select(*_features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))), "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def _running(sizes: Column) -> Column:
    """(at, starts): the sum of gaps and matches, and where each match starts, from 0."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(sizes, none, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["g"])).alias("starts")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, candidate, before, after, path) of each candidate; start counts characters from 1."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(path, F.lit("")).alias("__path"))
    rows = rows.where(F.col("__text").rlike(CANDIDATE))
    cut = rows.select("__id", "__path", F.split("__text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # sums by stretches of 256 and within them, since an array that grows by one is copied each time
    sizes = F.zip_with(F.slice("gaps", 1, F.size("found")), "found", lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    number = F.floor((F.size("found") - 1) / 256).cast("int")
    cut = cut.withColumn("__blocks", let(sizes, lambda s: F.transform(F.sequence(F.lit(0), number), lambda b: _running(F.slice(s, b * 256 + 1, F.lit(256))))))
    bases = F.aggregate("__blocks", F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
    place = F.flatten(F.zip_with(bases, "__blocks", lambda base, b: F.transform(b["starts"], lambda x: x + base)))
    # what stands before a candidate may be another one
    before = F.transform(F.slice("gaps", 1, F.size("found")), lambda g, i: F.right(F.concat(F.when(i > 0, F.right(F.get("found", i - 1), F.lit(NEAR))).otherwise(""), g), F.lit(NEAR)))
    after = F.transform(F.slice("gaps", 2, F.size("found")), lambda g: F.left(g, F.lit(NEAR)))
    each = cut.select("__id", "__path", F.explode(F.arrays_zip(place.alias("start"), F.col("found").alias("candidate"), before.alias("before"), after.alias("after"))).alias("c"))
    return each.select("__id", "__path", F.col("c.start").cast("long").alias("start"), "c.candidate", "c.before", "c.after")


def secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, length, sha256, score) of each secret; the value itself isn't returned.

    ``score`` is the forest's share of votes, at least ``threshold``. Null and
    empty texts hold none; a null path counts as an ordinary one, as does a
    missing path column. Ids repeat and may be null, and repeated rows report
    their own. Very long texts are read whole. Other columns aren't read, so
    their names can't clash. An empty table gives an empty result. Without a
    ``model`` one is trained on :func:`labelled_findings`.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = candidates(docs, id_col, text_col, path_col)
    rows = found.select("__id", "start", "candidate", *_features(F.col("candidate"), F.col("before"), F.col("after"), F.col("__path")))
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    out = judged.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).where(F.col("score") >= threshold)
    return out.select(F.col("__id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), F.round("score", 6).alias("score"))
