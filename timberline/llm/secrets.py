"""Secret scanning with a random forest that removes false positives; DataFrame functions and Spark ML only.

A candidate is one of: three dotted runs that begin like a JSON web token; what
follows a secret cue ("password", "token", "api_key" ...) and an assignment, if it
has at least ``MIN_ASSIGNED`` characters without space or quote, whatever they are;
and a run of at least ``MIN_LENGTH`` letters, digits and ``_ + / -`` with a digit in
it, and the equals signs that pad it.  Its features are its length, how often its characters change
class, how many are distinct, the shares of digits, capitals and vowels, whether
it is hexadecimal, how much of it dictionary words cover, its path marks, and the
words and signs before and after it.  A random forest trained on labelled
findings tells secrets from the rest.

``findings`` makes the labelled findings: credentials of several makes in the
places they are found in, and the usual false positives (commit ids, checksums,
UUIDs, card and order numbers, paths, identifiers, placeholders), all from
hashes of a running number, so that training is the same everywhere.

Scale: a text is split at its candidates in place; only candidates are shuffled,
by document row, to add up their offsets.

Defined cases: a null text is empty and has no candidates; offsets are code
points, the end exclusive; repeated rows are scanned one by one; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_LENGTH = 16
MIN_ASSIGNED = 8
_RUN = "A-Za-z0-9_+/-"
# of each kind, what is cheap to rule out comes first
_TOKEN = f"(?=eyJ)(?<![.{_RUN}])eyJ[A-Za-z0-9_-]{{6,}}[.][A-Za-z0-9_-]{{6,}}[.][A-Za-z0-9_-]{{6,}}+"
_CUES = "password|passwd|pwd|secret|token|api_key|apikey|access_key"
_ASSIGNED = (
    r"""(?<=[=:"'` ])(?<=[=:][ "'`]{0,3})(?![ =:"'`])(?<=(?i:""" + _CUES + r""")["'`]?[ ]{0,2}[=:][ ]{0,2}["'`]?)[^\s"'`,;]""" + f"{{{MIN_ASSIGNED},}}+"
)
CANDIDATE = f"{_TOKEN}|{_ASSIGNED}|(?<![{_RUN}])(?=[A-Za-z_+/-]*[0-9])[{_RUN}]{{{MIN_LENGTH},}}+={{0,2}}+"
CONTEXT = 48

#: Words that a dictionary covers in identifiers and prose.
WORDS = (
    "about access account action address after again application array author batch before branch build bundle button cache change "
    "child class client cluster code color column commit common component config connect content context control count create current "
    "data date default delete device document domain download driver element email enable error event example export factory field file filter "
    "first folder format from function global group handle header height history host image import index info init input insert instance int "
    "invoice item label language last layout length level library license line link list load local location login manager map message method "
    "model module month name network node number object offset option order output package page param parent parse path pattern photo point "
    "position post price process product profile project property public query queue random record release remote report request reset resource "
    "response result return root route sample schema screen script search section select server service session settings size source stack "
    "start state static status step storage stream string style system table target task template test text that theme there thing this thread "
    "time title token type update upload user util value version video view width window with word work year your"
).split()
FEATURES = ("length", "changes", "distinct", "digits", "capitals", "vowels", "hex", "words", "slashes", "marks", "cue", "other_cue", "assigned", "quoted", "path_before", "placeholder")


def candidates(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, value, before, after for each candidate of each text."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    gaps = F.split("text", CANDIDATE)
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("value"), gaps.alias("gap"), F.slice(gaps, 2, 2147483647).alias("rest"))
    each = rows.select("doc_id", "row", F.posexplode(parts).alias("i", "p")).select("doc_id", "row", "i", "p.*").where("value IS NOT NULL")
    upto = F.sum(F.length("gap") + F.length("value")).over(Window.partitionBy("row").orderBy("i"))
    return each.select(
        "doc_id",
        (upto - F.length("value")).alias("start"),
        upto.alias("end"),
        "value",
        F.when(F.col("i") > 0, F.concat(F.lit(" "), F.expr(f"right(gap, {CONTEXT})"))).otherwise(F.expr(f"right(gap, {CONTEXT})")).alias("before"),
        F.expr(f"left(rest, {CONTEXT})").alias("after"),
    )


def featured(found: DataFrame) -> DataFrame:
    """Adds the features of value, before and after."""
    value, lower, n = F.col("value"), F.lower("value"), F.length("value").cast("double")
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))

    def share(pattern: str, of=value):
        return (n - F.length(F.regexp_replace(of, pattern, ""))) / n

    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "+/=_-", "#####")
    flag = lambda c: c.cast("double")
    columns = {
        "length": n,
        "changes": (F.length(F.regexp_replace(classes, "#+", "#")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(32.0)),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "hex": flag(lower.rlike("^[0-9a-f]+$") & lower.rlike("[a-f]")),
        "words": share("|".join(sorted(WORDS, key=lambda w: (-len(w), w))), lower),
        "slashes": n - F.length(F.replace(value, F.lit("/"), F.lit(""))),
        "marks": n - F.length(F.regexp_replace(value, "[_-]", "")),
        "cue": flag(before.rlike(r"(key|token|secret|passw|pwd|auth|credential|bearer|private|signature)[^\n]{0,24}$")),
        "other_cue": flag(before.rlike(r"(commit|sha|md5|hash|checksum|digest|uuid|guid|revision|build|order|invoice|tracking|card|phone|serial|etag|request|trace)[^\n]{0,16}$")),
        "assigned": flag(before.rlike(r"([=:]|=>|bearer)\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "path_before": flag(before.rlike(r"(://|/|\.|\\|@)[^\s\"'=:]*$")),
        "placeholder": flag(lower.rlike(r"(.)\1{5}|example|sample|placeholder|your|changeme|12345678|abcdef|xxxx")),
    }
    return found.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})


def findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings: value, before, after, label (1: a secret), ``n`` of them."""

    def h(k: int):
        return F.sha2(F.concat_ws(":", F.lit(str(k)), F.col("id").cast("string")), 512)

    def b64(k: int, length: int):
        return F.substring(F.translate(F.base64(F.unhex(h(k))), "\n", ""), 1, length)

    def pick(k: int, *choices: str):
        return F.get(F.array(*map(F.lit, choices)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(choices))).cast("int"))

    def digits(k: int, length: int):
        return F.substring(F.regexp_replace(h(k), "[a-f]", "7"), 1, length)

    def name(k: int):
        return F.concat(pick(k, *WORDS[::3]), F.lit("_"), pick(k + 1, *WORDS[1::3]), F.lit("_"), pick(k + 2, *WORDS[2::3]), digits(k, 2))

    space = F.lit(" ")
    cue = F.concat(pick(1, "api_key", "token", "secret", "password", "auth_token", "access_key", "client_secret", "privateKey", "API_KEY", "Token", "credential"), pick(2, " = ", "=", ": ", " := ", " => ", '": '), pick(3, '"', "'", "", '"'))
    quote = F.when(cue.rlike("\"$"), '"').when(cue.rlike("'$"), "'").otherwise(pick(4, "", "\n", " ", ";"))
    prose = F.concat(pick(5, *WORDS), space, pick(6, *WORDS), space)
    free = pick(7, " ", "\n", ", ", ". ", " | ")
    hex_of = lambda k, length: F.substring(h(k), 1, length)
    uuid = F.concat_ws("-", hex_of(8, 8), hex_of(9, 4), hex_of(10, 4), hex_of(11, 4), hex_of(12, 12))
    kinds = [
        (hex_of(13, 40), cue, quote, 1),
        (hex_of(14, 32), cue, quote, 1),
        (hex_of(15, 64), cue, quote, 1),
        (b64(16, 40), cue, quote, 1),
        (b64(17, 64), cue, quote, 1),
        (F.concat(F.lit("AKIA"), F.upper(b64(18, 16))), F.concat(prose, pick(19, "", "id ", "key ")), free, 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(b64(20, 44), "[+/=]", "x")), F.concat(prose, pick(21, "", "'", "use ")), free, 1),
        (F.concat(pick(22, "sk-", "rk_live_", "xoxb-", "glpat-"), F.regexp_replace(b64(23, 40), "[+/=]", "Z")), F.concat(prose, pick(24, "", "with ", '"')), free, 1),
        (b64(25, 60), F.lit("Authorization: Bearer "), free, 1),
        (hex_of(26, 40), F.concat(prose, pick(27, "commit ", "rev ", "sha1 ", "revision: ", "merge ")), free, 0),
        (hex_of(28, 32), F.concat(prose, pick(29, "md5: ", "checksum ", "hash = ", "etag: \"", "digest=")), free, 0),
        (hex_of(30, 64), F.concat(prose, pick(31, "sha256:", "digest: ", "checksum = \"")), free, 0),
        (uuid, F.concat(prose, pick(32, "id=", "uuid: ", "request ", "\"guid\": \"", "")), free, 0),
        (digits(33, 16), F.concat(prose, pick(34, "", "card ", "no. ", "account ")), free, 0),
        (digits(35, 20), F.concat(prose, pick(36, "", "order ", "tracking: ", "serial=")), free, 0),
        (digits(37, 16), F.concat(prose, pick(38, "", " ", "the ")), free, 0),
        (F.concat(F.lit("/"), pick(39, *WORDS), F.lit("/"), name(40), F.lit("/"), digits(41, 4)), F.concat(prose, pick(42, "", "https://host.net", "path: ")), free, 0),
        (name(43), F.concat(prose, pick(44, "", "def ", "self.", "token = ", "key: ")), free, 0),
        (F.concat(pick(45, "your_api_key_", "example-token-", "xxxxxxxxxxxxxxxx", "changeme-secret-", "00000000000000000000"), digits(46, 4)), cue, quote, 0),
        (F.concat(F.lit("2024-0"), digits(47, 1), F.lit("-1"), digits(48, 1), F.lit("-"), name(49)), F.concat(prose, pick(50, "", "file ", "log: ")), free, 0),
        (F.concat(pick(55, *WORDS), pick(56, "!", "$", "#", "%", "&"), digits(57, 3), pick(58, "Q", "z", "X!", "?K")), pick(59, "password=", "password: ", "pwd = ", "passwd: "), pick(60, "", " ", "\n"), 1),
        (F.regexp_replace(b64(61, 14), "[0-9+/=]", "w"), pick(62, "password=", "secret: ", 'token = "'), pick(63, "", " ", "\n"), 1),
        (F.concat(F.lit("eyJ"), F.regexp_replace(b64(64, 20), "[+/=]", "a"), F.lit("."), F.regexp_replace(b64(65, 40), "[+/=]", "b"), F.lit("."), F.regexp_replace(b64(66, 43), "[+/=]", "c")), F.concat(prose, pick(67, "", "jwt ", "Bearer ")), free, 1),
        (pick(68, "required", "optional", "incorrect", "expired_already", "protected", "forgotten", "undefined", "<redacted>", "********", "${PASSWORD}"), pick(69, "password: ", "token: ", "secret = "), free, 0),
        (F.concat(pick(70, "request", "config", "self", "settings", "env"), F.lit("."), pick(71, *WORDS)), pick(72, "token = ", "password=", "secret: "), pick(73, "\n", "(", " "), 0),
        (F.concat(pick(51, *WORDS), F.lit("-"), pick(52, *WORDS), F.lit("-"), digits(53, 6)), F.concat(prose, pick(54, "", "/blog/", "see ")), free, 0),
    ]
    which = F.pmod(F.xxhash64("id"), F.lit(len(kinds)))
    column = lambda j, kind: F.coalesce(*(F.when(which == i, F.lit(k[j]) if j == 3 else k[j]) for i, k in enumerate(kinds))).cast(kind)
    made = spark.range(0, n, 1, 4).select(column(0, "string").alias("value"), column(1, "string").alias("before"), column(2, "string").alias("after"), column(3, "double").alias("label"))
    # as a scan would cut them out of their surroundings
    shown = candidates(made.select(F.struct("label", "before", "after").alias("d"), F.concat("before", "value", F.lit(" "), "after").alias("t")), "d", "t")
    return shown.where(F.col("start") >= F.length("doc_id.before") - 1).groupBy("doc_id", "value").agg(F.first("before").alias("before"), F.first("after").alias("after")).select("value", "before", "after", F.col("doc_id.label").alias("label"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> PipelineModel:
    assembler = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return PipelineModel([assembler, forest.fit(assembler.transform(featured(labelled)))])


def scan(documents: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, value, probability, is_secret for each candidate."""
    model = model or train(findings(documents.sparkSession))
    scored = model.transform(featured(candidates(documents, doc, text)))
    probability = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "start", "end", "value", probability.alias("p")).select("doc_id", "start", "end", "value", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))
