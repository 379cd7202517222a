"""Secret scan: regular candidates, sorted out by a random forest.

Candidates are long runs with a digit and values assigned to a secret-like name.
Features of the candidate (length, transitions between kinds of characters,
share covered by dictionary words), of its path and of the words around it go
into a random forest that was trained on labelled findings; what it rejects is a
false positive. DataFrame functions and Spark's own forest throughout.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import configure, written

LETTERS = r"A-Za-z0-9+/_.~-"
NAME = r"[\w.-]"
# Words of names for secrets; not passed, secretary, tokenizer or author.
SECRET_NAMES = (r"(?i:pass(?:word|wd|phrase|code|key)|pass(?![a-z])|pwd|secret(?!ar)|token(?!i[sz])|api[_.-]?key|access[_.-]?key"
                r"|private[_.-]?key|credential|bearer|auth(?!or(?:s?(?![a-z])|ed|ing|it)))")
ASSIGN = r"""["'`]?\]?[ \t]*+[:=]{1,3}+>?+[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?+["'`]?+"""
# Up to the closing quote, or up to a blank or bracket where no quote opened.
VALUE = r"""(?:(?<=")[^\s"]{8,}+(?=")|(?<=')[^\s']{8,}+(?=')|(?<=`)[^\s`]{8,}+(?=`)|[^\s"'<>{}()\[\],;]{8,})"""
# A whole name with a secret's word in it, up to its value; each name is passed over a fixed number of times.
NAMED = rf"(?={NAME}++{ASSIGN}{VALUE})(?={NAME}*?{SECRET_NAMES}){NAME}++{ASSIGN}"
LEAD = rf"(?<!{NAME}){NAMED}"
# A password of any length in the address of a server.
LOGIN = r"""://[^\s/:@"'<>]*+:"""
LOGIN_VALUE = r"""[^\s/?#@"'<>]++(?=@)"""
# '=' ends a name; at the end of a run it is padding unless a value follows.
PADDING = r"""(?:={1,2}(?!["'`]?[^\s"'`<>{}()\[\],;:.&]))?"""
LONG_RUN = (rf"(?<![{LETTERS}])(?=[A-Za-z+/_.~-]*[0-9])(?!(?:[{LETTERS}]*[+/~])?+{NAMED})"
            rf"[{LETTERS}]{{15,}}[A-Za-z0-9+/_]{PADDING}")
CANDIDATE = f"{LEAD}{VALUE}|{LOGIN}{LOGIN_VALUE}|{LONG_RUN}"
CONTEXT = 64  # characters kept on either side
MASK = "[SECRET]"
THRESHOLD = 0.5
#: Generated labelled findings that the forest of the query learns from.
FIT_ROWS = 6_000
# The candidate is the value of a name with a secret's word in it.
NAMED_BEFORE = rf"""{SECRET_NAMES}{NAME}*+["'`]?\]?\s*+[:=]{{1,3}}+>?+\s*+((Bearer|Basic|Token)\s++)?["'`]?"""
HASH_NAMES = r"(?i)\b(sha-?\d*|md5(sum)?|commit|checksum|digest|hash|revision|rev|etag|uuid|guid|build|version|isbn|order|id)\b"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|spec|examples?|samples?|mocks?|fixtures?|docs?|readme|vendor|lock)([/_.-]|$)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|change-?me|your[-_]|x{4,}|0{6,}|123456|abcdef|redacted|[$%{]\{|\{\{|%[(]|^\$[a-z_]+$)"
# Words that names, paths and placeholders are made of; fixed values.
DICTIONARY = (
    "the and that with this from for have not are was were will your you example sample dummy test tests value name "
    "user users admin password secret token key access private public config setting server client host mail http https "
    "www com org net path file files folder module package version release build chapter section figure table index "
    "data base image images static assets main master branch handler service model view controller utils helper common "
    "number order item page list report update change goes here place holder tion ing ment heit keit lich able ness"
).split()

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_turns", "f_vowel_turns", "f_distinct", "f_hex",
            "f_dictionary", "f_placeholder", "f_slashes", "f_dots", "f_dashes", "f_test_path", "f_secret_name", "f_hash_name",
            "f_assigned", "f_named", "f_quoted", "f_in_url", "f_login"]


def find_candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``uid, doc_id, i, candidate, before, after, start, path`` for each candidate of each whole text."""
    place = F.col(path).cast("string") if path and path in docs.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), text.alias("_t"), F.coalesce(place, F.lit("")).alias("path"))
    return _explode(found.select(F.monotonically_increasing_id().alias("uid"), "*").filter(F.col("_t").rlike(CANDIDATE)))


def _parts(text: Column) -> tuple[Column, Column]:
    """Texts between the matches, and the matches, each with the name before its value."""
    return F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _lead(match: Column) -> Column:
    """The part of a match before its candidate."""
    return F.regexp_extract(match, f"^(?:{NAME}++{ASSIGN}|{LOGIN})(?=.)", 0)


def _explode(rows: DataFrame, *keep: str) -> DataFrame:
    gaps, found = _parts(F.col("_t"))
    rows = rows.select("uid", "doc_id", "path", *keep, gaps.alias("_g"), found.alias("_c"))
    rows = rows.withColumn("_l", F.transform("_c", _lead))
    item = lambda c, i: F.struct(
        F.substr(c, F.length(F.col("_l")[i]) + 1).alias("candidate"),
        F.right(F.concat(F.right(F.col("_g")[i], F.lit(CONTEXT)), F.col("_l")[i]), F.lit(CONTEXT)).alias("before"),
        F.left(F.col("_g")[i + 1], F.lit(CONTEXT)).alias("after"),
        (F.length(F.col("_g")[i]) + F.length(F.col("_l")[i])).cast("long").alias("gap"),
    )
    each = rows.select("uid", "doc_id", "path", *keep, F.posexplode(F.transform("_c", item)).alias("i", "_x")).select(
        "uid", "doc_id", "path", *keep, "i", "_x.*")
    # Offsets are running sums over the candidates of one document.
    until = W.partitionBy("uid").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("candidate").cast("long")
    return each.withColumn("start", F.sum(F.col("gap") + size).over(until) - size).drop("gap")


def with_features(findings: DataFrame) -> DataFrame:
    """Features of rows with ``candidate, before, after, path``; nulls count as empty strings."""
    c, before, after, path = (F.coalesce(x, F.lit("")) for x in ("candidate", "before", "after", "path"))
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda kind: F.length(F.regexp_replace(c, f"[^{kind}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[^A-Za-z0-9]", "."), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1+", "$1")) / n
    low = F.lower(c)
    vowels = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", ""), "[aeiouy]", "1"), "[a-z]", "2")
    uncovered = F.regexp_replace(low, "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")
    hit = lambda x, pattern: F.when(x.rlike(pattern), 1.0).otherwise(0.0)
    values = {
        "f_length": F.length(c).cast("double"), "f_digits": share("0-9"), "f_upper": share("A-Z"), "f_lower": share("a-z"),
        "f_other": 1 - share("A-Za-z0-9"), "f_turns": runs(kinds), "f_vowel_turns": runs(vowels),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "f_hex": hit(c, "^([0-9a-f]+|[0-9A-F]+)$"),
        "f_dictionary": 1 - F.length(uncovered) / n, "f_placeholder": hit(c, PLACEHOLDER),
        "f_slashes": share("/"), "f_dots": share("."), "f_dashes": share("-"), "f_test_path": hit(path, TEST_PATH),
        "f_secret_name": hit(before, SECRET_NAMES), "f_hash_name": hit(F.right(before, F.lit(24)), HASH_NAMES),
        "f_assigned": hit(before, r"""[:=]>?\s*["'`]?$"""), "f_named": hit(before, f"{NAMED_BEFORE}$"), "f_quoted": hit(before, "[\"'`]$") * hit(after, "^[\"'`]"),
        "f_in_url": hit(before, "(https?:/*|www[.]|@)\\S*$"), "f_login": hit(before, f"{LOGIN}$"),
    }
    return findings.withColumns({k: v.cast("double") for k, v in values.items()})


def labelled_findings(spark: SparkSession, rows: int = FIT_ROWS) -> DataFrame:
    """Generated findings with labels, for when nobody has labelled any.

    Secrets: digests, mixed-case keys, prefixed keys, short and word-like passwords under a
    secret's name, and passwords in addresses.
    Not secrets: the same digests under a hash's name or in test paths, uuids, paths,
    hosts, versions, plain numbers, joined words, placeholders, and plain words
    and references to variables under a secret's name. Each stands in a text,
    prose or lines of settings, from which ``find_candidates`` takes it as in a scan; what
    else it finds there is no secret.
    """
    r = spark.range(0, rows, 1, 4).withColumn("s", F.sha2(F.concat(F.lit("finding "), F.col("id")), 256))
    pick = lambda at, n: F.pmod(F.conv(F.substring("s", at, 6), 16, 10).cast("long"), F.lit(n)).cast("int")
    one = lambda at, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), pick(at, len(xs)) + 1)
    s = F.col("s")
    mixed = F.translate(F.base64(F.unhex(s)), "+/=", "xYz")
    upper = F.upper(mixed)
    hexes = one(1, F.substring(s, 1, 40), F.substring(s, 1, 32), s, F.upper(F.substring(s, 9, 40)))
    secret = one(7, F.substring(s, 1, 40), hexes, F.substring(mixed, 1, 40), F.substring(mixed, 3, 24),
                 F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
                 F.concat(F.lit("sk_live_"), F.substring(mixed, 5, 24)))
    word = lambda at: one(at, *DICTIONARY)
    digits = lambda at, n: F.lpad(F.conv(F.substring("s", at, 12), 16, 10), n, "7")
    uuid = F.concat_ws("-", F.substring(s, 1, 8), F.substring(s, 9, 4), F.substring(s, 13, 4), F.substring(s, 17, 4), F.substring(s, 21, 12))
    named = one(13, 'token = "', "api_key: '", "password=", "secret: ", "Authorization: Bearer ", 'SECRET_KEY = "', "token: ",
                'TOKEN = "', "TOKEN=", "AWS_SECRET_ACCESS_KEY=", "export DB_PASSWORD_PROD=", "GITHUB_TOKEN=", 'CLIENT_SECRET="',
                'passphrase = "', "passwd\t= ", 'password => "', "access_key: ", 'private_key := "', "credentials: ", 'db.auth = "', "api-key: ",
                'config["password"] = "', 'password        = "', 'DB_PASS="', "db_password='", '"password": "')
    plain = one(13, "commit ", "sha1: ", "md5sum = ", 'checksum: "', "revision ", 'etag: "', "build id=", "hash ", "GIT_COMMIT=",
                "IMAGE_DIGEST=")
    prose = one(13, "see ", "in the ", " and ", "https://", "mail to x@", "file ", "number ", "from ")
    names = F.concat_ws("/", word(19), F.concat(word(25), pick(31, 90).cast("string")), F.concat(word(37), F.lit(".py")))
    host = F.concat_ws(".", F.concat(word(19), pick(31, 90).cast("string")), word(25), F.lit("example.com"))
    version = F.concat(F.lit("release-20"), pick(19, 30).cast("string"), F.lit("."), pick(25, 12).cast("string"), F.lit("-build"), pick(31, 99).cast("string"))
    joined = F.concat(word(19), word(25), word(37), word(43), pick(31, 90).cast("string"))
    holder = one(43, F.concat(F.lit("your-"), word(19), F.lit("-goes-here-1")), F.lit("xxxxxxxxxxxxxxxx1234"),
                 F.concat(word(19), F.lit("_example_123456")), F.lit("changeme00000000"), F.concat(F.lit("<"), word(19), F.lit("_placeholder1>")))
    common = one(19, "sunshine", "dragon", "monkey", "football", "shadow", "winter", "summer", "princess", "charlie", "battery", "horse", "purple")
    twin = one(25, "staple", "tiger", "rocket", "orange", "silver", "thunder", "coffee", "hunter")
    mark, figures = one(31, "!", "&", "#", "-", ".", "$", "_", ""), pick(37, 990).cast("string")
    # Passwords as people choose them, and short ones by chance.
    short = one(43, F.concat(F.initcap(common), figures, mark), F.concat(common, mark, figures), F.concat(common, figures, twin),
                F.concat(F.translate(F.initcap(common), "aeo", "430"), mark, figures), F.concat(F.initcap(common), mark, F.initcap(twin)),
                F.substring(mixed, 1, 8), F.substring(mixed, 2, 10), F.substring(mixed, 3, 12), F.substring(mixed, 4, 16))
    refer = one(43, "request.form.password", "os.environ.get", "settings.DB_PASSWORD", "string_value", "undefined", "required", "password_field",
                "self._secret", "process.env.API_KEY", "${DB_PASSWORD}", "{{secret_key}}", "%(password)s", "$DB_PASSWORD", "get_password",
                "function", F.concat(F.lit("https://"), host, F.lit("/login")), F.concat_ws("_", word(19), word(25)),
                F.concat_ws(".", word(19), word(25)), F.concat(word(19), word(25)), F.concat_ws(".", F.lit("self"), word(19), word(25)))
    blank = one(43, "password", "pass", "xxxxx", "${DB_PASS}", "secret", "your-password", "$PASSWORD", "changeme")
    kind = pick(49, 28)
    label = F.when((kind < 8) | kind.between(20, 23), 1).otherwise(0)
    address = kind.isin(23, 26)
    candidate = (F.when(kind < 8, secret).when(kind.between(20, 22), short).when(kind == 23, F.when(pick(57, 4) == 0, secret).otherwise(short))
                 .when(kind == 26, blank).when(kind > 23, refer).when(kind < 11, hexes).when(kind < 12, uuid).when(kind < 13, names).when(kind < 14, host)
                 .when(kind < 15, version).when(kind < 16, digits(19, 16)).when(kind < 17, joined).when(kind < 19, holder).otherwise(secret))
    login = F.concat(one(13, "postgres", "postgresql", "mysql", "https", "redis", "amqp", "mongodb"), F.lit("://"), one(7, "app", "admin", "root", "", "svc"), F.lit(":"))
    lead = F.when(address, login).when((kind < 8) | (kind >= 17), named).when(kind < 12, plain).otherwise(prose)
    quote = F.when(address, "@db").when(lead.endswith('"'), '"').when(lead.endswith("'"), "'").otherwise(" ")
    path = F.when(kind == 19, one(55, "tests/test_login.py", "docs/examples/auth.md", "spec/fixtures/keys.yml")).otherwise(
        one(55, "src/app/main.py", "config/settings.env", "", "", "src3", "deploy/run.sh"))
    filler = F.concat_ws(" ", word(19), word(31), word(43), F.lit(""))
    setting = F.concat(F.upper(word(31)), F.lit("_"), F.upper(word(43)), F.lit("="), word(19), F.lit("\n"))
    lines = lead.endswith("=") & (pick(57, 2) == 0)
    # The names of one-line settings are followed by nothing but the end of the line.
    text = F.when(lines, F.concat(setting, lead, candidate, F.lit("\n"), setting)).otherwise(
        F.concat(filler, lead, candidate, quote, F.lit(" "), filler))
    texts = r.select("id", text.alias("_t"), path.alias("path"), label.alias("_y"), candidate.alias("_v"))
    found = _explode(texts.select(F.col("id").alias("uid"), F.col("id").alias("doc_id"), "_t", "path", "_y", "_v"), "_y", "_v")
    # A finding of a part of the secret, or of more than it, counts as the secret.
    same = F.contains("candidate", "_v") | F.contains("_v", "candidate")
    return found.select("candidate", "before", "after", "path", F.when(same, F.col("_y")).otherwise(0).cast("double").alias("label"))


def fit_forest(findings: DataFrame, trees: int = 40, depth: int = 9, seed: int = 5) -> PipelineModel:
    """A forest from ``candidate, before, after, path, label`` rows (label 1: a secret)."""
    rows = with_features(findings.filter("label is not null"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="sqrt", probabilityCol="probability")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def judge(findings: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """``findings`` with ``score`` (probability of a secret) and ``confirmed``."""
    keep = findings.columns
    scored = model.transform(with_features(findings))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*keep, score.alias("score"), (score >= threshold).alias("confirmed"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: place, digest of the candidate, score and verdict.

    ``start`` and ``length`` are in code points of the whole text. Null and empty texts
    have no candidates; null and repeated ids and equal findings are reported row by
    row; null paths count as empty; other columns are ignored.
    """
    spark = configure(docs.sparkSession)
    model = fit_forest(labelled if labelled is not None else labelled_findings(spark))
    return judge(find_candidates(docs, path), model, threshold).select(
        "doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"),
        "score", "confirmed")


def redact(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", threshold: float = THRESHOLD,
           mask: str = MASK) -> DataFrame:
    """``docs`` with every confirmed secret in ``text`` replaced by ``mask``; all rows and columns stay."""
    spark = configure(docs.sparkSession)
    model = fit_forest(labelled if labelled is not None else labelled_findings(spark))
    columns = docs.columns
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    # Only documents with candidates are stored and joined.
    rows = docs.filter(has).select(F.struct(*columns).alias("_d"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "candidates")
    place = F.coalesce(F.col(f"_d.`{path}`").cast("string"), F.lit("")) if path and path in columns else F.lit("")
    found = _explode(rows.select("uid", F.col("_d.doc_id").cast("long").alias("doc_id"), F.col("_d.text").alias("_t"), place.alias("path")))
    confirmed = judge(found, model, threshold).filter("confirmed").groupBy("uid").agg(F.collect_set("i").alias("_i"))
    gaps, cands = _parts(F.col("_d.text"))
    joined = rows.join(confirmed, "uid", "left").select("_d", "_i", gaps.alias("_g"), cands.alias("_c"))
    kept = F.transform("_c", lambda c, i: F.concat(F.col("_g")[i], F.when(F.array_contains("_i", i), F.concat(_lead(c), F.lit(mask))).otherwise(c)))
    text = F.when(F.col("_i").isNull(), F.col("_d.text")).otherwise(
        F.concat(F.array_join(kept, ""), F.element_at("_g", -1)))
    changed = joined.select(*[text.alias("text") if c == "text" else F.col(f"_d.`{c}`").alias(c) for c in columns])
    return docs.filter(~has).select(*columns).unionByName(changed)
