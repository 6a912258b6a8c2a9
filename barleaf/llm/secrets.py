"""Secret scan: candidates by form, false positives removed by a random forest.

Candidates are runs of at least ``LEAST`` key characters that hold a digit,
change case repeatedly or open like a known key, found in every word of the whole text.  A forest over a
candidate's length, character classes and their transitions, dictionary
coverage, path marks, and the neighbouring words scores it.

The tables hold no labels for findings, so the forest learns from labelled
findings: by default ``labelled_findings``, made by rule (random keys in the
places where keys stand, and checksums, identifiers, numbers, paths and names in
theirs); findings labelled by hand can be given in their place or beside them.

The main path is DataFrame functions and MLlib's trees: no Python on executors.
A row's candidates are found in the row; nothing is grouped before scoring.

Edge cases.  Null and empty texts have no candidates.  Repeated rows are scanned
row by row; null ids are kept; equal candidates at different places are separate
findings.  Empty tables give empty results.  ``redact`` keeps all columns and
rows and changes texts with secrets only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
TREES = 40
DEPTH = 8
SEED = 5
MARK = "[secret removed]"

_CORE = f"([A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}})"
_FORMS = "AKIA|ASIA|gh[opsu]_|glpat-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ|SG_|npm_"
_LIVELY = f"[0-9]|[a-z][A-Z].*[a-z][A-Z]|^(?:{_FORMS})"

_DICTIONARY = (
    "about above access account action active address admin after again album alert align alpha apple apply array article asset async author back base batch before begin beta block board book boot border branch "
    "browser buffer build button cache call camera case change channel chapter char check child class clean click client clock close cloud code color column command comment commit common component config connect "
    "content context control copy core count create current custom daily dark data date debug default delete deploy design detail device dialog digest direct display document domain down draft drive east edit "
    "element email enable entry error event example export factory false feature field file filter final first flag flow font footer form format frame from front full function gallery game general get global "
    "group handler hash head height hidden home host house icon image import index info init inner input install integer internal invoice item join json language last layout left letter level library light limit "
    "line link list load local lock login long look main manager map mark master match media member memory menu message meta method minute mobile mode model module month more move music name network next node "
    "note number object offset open option order other output owner page panel parent part party password path pattern people phone photo picture place plan player plugin point policy post power press price print "
    "private process product profile project property public query queue quick random range read record red region release remove render report request reset resource response rest result return review right role "
    "root route row rule run sample save scale schema school score screen script search second section select send serial server service session set shape shared shop side sign simple site size small social sort "
    "source space spec stack staff start state static status step stock stop store story stream string style submit success summary super support switch system table target task team temp template test text theme "
    "thread time title token tool top topic total track train transfer tree true type unit update upload url user util valid value vector version video view visible wait watch water week west white width window "
    "word work world write year zone the and for with"
).split()
_WORDS = "|".join(sorted({w for w in _DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))

_KEY = "(?:key|secret|token|passw|passwd|pwd|auth|credential|bearer|api|signature|passwort|contraseña|mot de passe)"
_NOT_KEY = "(?:sha|md5|commit|checksum|hash|digest|uuid|guid|isbn|issn|order|card|invoice|phone|tel|serial|version|build|rev|etag|file|page|doi|case|function|number|id|path|ref|date|date:)"
_PREFIX = f"^(?:{_FORMS})"
_PATH = "(?i)https?:|www[.]|[.](?:com|org|net|html?|js|css|png|jpe?g|pdf|json|py|txt)\\b|[a-z0-9_-]+/[a-z0-9_-]+/[a-z0-9_-]+"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_digit_letter", "f_case", "f_runs", "f_distinct", "f_hex", "f_dictionary",
    "f_vowels", "f_path", "f_slashes", "f_separators", "f_prefix", "f_key_near", "f_key_before", "f_not_key", "f_assigned", "f_quoted",
]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, word_index, nth, candidate, word, before, before2, after)``: a row per candidate."""

    def of(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            near = [F.coalesce(F.get(words, i + k), F.lit("")) for k in (-1, -2, 1)]
            cores = F.filter(F.regexp_extract_all(w, F.lit(_CORE), 1), lambda c: c.rlike(_LIVELY))
            told = F.struct(i.alias("word_index"), w.alias("word"), near[0].alias("before"), near[1].alias("before2"), near[2].alias("after"), cores.alias("cores"))
            return F.when(F.length(w) >= LEAST, F.when(w.rlike(_CORE), told))

        return F.filter(F.transform(words, one), lambda c: c.isNotNull())

    words = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\\s+")
    found = F.transform(F.array(words), of)[0]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("c"))
    rows = rows.select("doc_id", "c.*").select("*", F.posexplode("cores").alias("nth", "candidate"))
    return rows.select("doc_id", "word_index", "nth", "candidate", "word", "before", "before2", "after")


def features(found: DataFrame) -> DataFrame:
    """Adds the forest's inputs to candidates."""
    c, size = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    head = F.left("word", F.position("candidate", "word") - 1)
    near = F.lower(F.concat_ws(" ", "before2", "before", head))
    around = F.lower(F.concat_ws(" ", "before2", "before", head, "after"))
    made = {
        "f_length": size.cast("double"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_other": share("[^A-Za-z0-9]"),
        "f_digit_letter": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "f_case": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "f_runs": share("(.)\\1"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "f_hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), _WORDS, "")) / size,
        "f_vowels": share("(?i)[aeiou]"),
        "f_path": F.col("word").rlike(_PATH).cast("double"),
        "f_slashes": share("/"),
        "f_separators": share("[_-]"),
        "f_prefix": c.rlike(_PREFIX).cast("double"),
        "f_key_near": around.rlike(_KEY).cast("double"),
        "f_key_before": near.rlike(_KEY + "[a-z_-]*[\"']?\\s*[=:]").cast("double"),
        "f_not_key": near.rlike("(?:^|[^a-z])" + _NOT_KEY + "(?:[^a-z]|$)").cast("double"),
        "f_assigned": (head.rlike("[=:][\"']?$") | F.col("before").rlike("[=:]$")).cast("double"),
        "f_quoted": head.rlike("[\"']$").cast("double"),
    }
    return found.withColumns(made)


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """``(doc_id, text, label)``: findings made by rule, ``each`` per form; label 1 is a secret."""
    i = F.col("id")

    def hexed(n: int, salt: str) -> Column:
        return F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")), 512), 1, n)

    def lettered(n: int, salt: str, upper: bool = False) -> Column:
        raw = F.concat(F.base64(F.unhex(hexed(64, salt))), F.base64(F.unhex(hexed(64, salt + "b"))))
        raw = F.regexp_replace(raw, "[^A-Za-z0-9]", "")
        return F.substring(F.upper(raw) if upper else raw, 1, n)

    def pick(*words: str) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(i, F.lit(words[0])), F.lit(len(words))).cast("int"))

    def digits(n: int, salt: str) -> Column:
        return F.substring(F.regexp_replace(hexed(128, salt), "[^0-9]", ""), 1, n)

    prose = [pick("the", "of", "und", "que", "les", "thonre"), pick("in", "ea", "der", "de", "an", "reou"), pick("is", "to", "für", "y", "au", "ation.")]
    around = lambda *mid: F.concat_ws(" ", prose[0], prose[1], *mid, prose[2])
    key = pick("token", "secret", "api_key", "password", "access_token", "client_secret", "auth")
    name = pick("user", "order", "render", "profile", "config", "session", "build")
    other = pick("Account", "Template", "Factory", "Handler", "Message", "Document", "Version")
    secret = [
        around(key, F.lit("="), F.concat(F.lit('"'), hexed(40, "a"), F.lit('"'))),
        around(F.concat(key, F.lit("="), hexed(18, "b"))),
        around(F.concat(key, F.lit(": "), lettered(32, "c"))),
        around(F.concat(pick("AKIA", "ASIA"), lettered(16, "d", True))),
        around(F.concat(pick("ghp_", "sk_live_", "xoxb-", "glpat-"), lettered(36, "e"))),
        around(F.lit("Bearer"), lettered(40, "f")),
        around(F.concat(key, F.lit("='"), lettered(24, "g"), F.lit("'"))),
        around(lettered(40, "h")),
    ]
    clean = [
        around(pick("commit", "revision", "sha", "checksum:"), hexed(40, "i")),
        around(F.concat(pick("sha256:", "md5:", "etag:"), hexed(64, "j"))),
        around(F.concat_ws("-", hexed(8, "k"), hexed(4, "l"), hexed(4, "m"), hexed(4, "n"), hexed(12, "o"))),
        around(digits(16, "p")),
        around(pick("card", "order", "invoice", "isbn"), digits(18, "q")),
        around(F.concat(F.lit("/static/"), name, F.lit("/"), hexed(16, "r"), F.lit("/main.js"))),
        around(F.concat(F.lit("https://example.com/"), name, F.lit("/"), digits(6, "s"), F.lit("/"), F.lower(other), F.lit("-page-"), digits(2, "t"))),
        around(F.concat(name, other, F.lit("ById"), digits(2, "u"), other)),
        around(F.concat_ws("_", F.lit("test"), name, F.lower(other), F.lit("number"), digits(3, "v"))),
        around(F.concat(digits(4, "w"), F.lit("-12-"), digits(2, "x"), F.lit("T10-00-00-000"))),
        around(F.concat(F.lit("v"), digits(1, "y"), F.lit("_"), digits(2, "z"), F.lit("_release_"), name, F.lit("_final"))),
    ]
    rows = spark.range(0, each, 1, 1)
    made = [rows.select((i + n * each).alias("doc_id"), text.alias("text"), F.lit(label).cast("double").alias("label")) for n, (text, label) in enumerate([(t, 1) for t in secret] + [(t, 0) for t in clean])]
    return reduce(DataFrame.union, made).coalesce(1)


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """Forest over the candidates in ``findings(doc_id, text, label)``; the label holds for all of a row's."""
    rows = features(candidates(findings)).join(F.broadcast(findings.select("doc_id", "label").distinct()), "doc_id")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    return forest.fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row per candidate: where it stands, its form, the forest's score and ``is_secret``."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, doc_id, text)))
    rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    form = F.when(F.col("f_prefix") == 1, "known prefix").when(F.col("f_hex") == 1, "hex").when(F.col("f_digits") == 1, "digits").otherwise("mixed")
    return rows.select("doc_id", "word_index", "nth", form.alias("form"), "candidate", "score", (F.col("score") >= least).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MARK``."""
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("key"))
    found = scan(keyed.select(F.col("key").alias("doc_id"), F.col("row")[text].alias("text")), findings, least=least).where("is_secret")
    found = found.groupBy(F.col("doc_id").alias("found")).agg(F.sort_array(F.collect_set(F.struct(F.length("candidate"), "candidate")), False).alias("secrets"))
    joined = keyed.join(found, F.col("key").eqNullSafe(F.col("found")), "left")
    new = F.aggregate(F.transform("secrets", lambda s: s["candidate"]), F.col("row")[text], lambda t, s: F.replace(t, s, F.lit(MARK)))
    new = F.when(F.col("secrets").isNotNull(), new).otherwise(F.col("row")[text])
    return joined.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
