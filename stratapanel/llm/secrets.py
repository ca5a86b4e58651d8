"""Secret scans: a random forest removes the false positives of a candidate search, in DataFrame operations only.

Candidates are values that follow a telling name (with or without quotes, colons or spaces between) and long runs of
key characters that hold digits and letters, or letters of both cases. The forest uses their length, character
transitions, dictionary coverage, path marks and the words around. It is trained from labelled findings; without any,
from keys of known formats and from look-alikes (checksums, identifiers, slugs, paths, dates) that are planted in the
corpus's own texts, so that context is learned as it is there. The dictionary is the corpus's own: the most frequent
hash buckets of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised
from stratapanel.llm.trees import calibrated_threshold, forest_share, located, spans

# Names that announce a secret, and words before a harmless key-like string.
NAME = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)"
PLAIN = r"(?i)(?<![a-z])(?:version|isbn|issue|page|figure|commit|revision|sha1?|sha-?256|md5|digest|checksum|hash|etag|uuid|guid|id|order|invoice|ref|serial|file|path)\W*$"
#: The rest of an identifier after a telling name, which ends where a small letter does not go on; what may stand between it and its value.
REST = r"s?(?![a-z])[A-Za-z0-9_-]*+[\"']?"
JOINED = r"(?:\s*+(?:[:=]++>?|(?<=\s)is(?=\s))\s*+(?i:bearer\s++)?|(?<=[rR])\s++)[\"']?"
#: A telling name within an identifier or path, up to its value; and the candidates: such a value, or a run of key characters. No repeat has a bound above.
LEAD = r"(?<![A-Za-z0-9+/_-])(?>[A-Za-z0-9+/_-]*?" + NAME + r"(?=s?(?![a-z])))" + REST + JOINED
CANDIDATE = LEAD + r"[^\s\"'<>,;]{6,}+|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}+"
#: Marks without which a text holds no candidate.
NEEDED = r"[0-9]|[A-Za-z+/_-]{20}|" + NAME
#: Buckets of the dictionary's word hashes, and those of them that count as words.
BUCKETS, WORDS = 1 << 17, 4096
#: Contexts that findings are planted in at most, and empty ones beside them; labelled findings at most; calibrated probability that a finding must reach.
CONTEXTS, EMPTY_CONTEXTS, FIT_ROWS, PROBABILITY = 4000, 400, 20_000, 0.98
TREES, DEPTH, LEAST_SHARE = 24, 7, 0.5
FEATURES = ("length", "digits", "upper", "lower", "others", "class_changes", "hex_only", "covered", "longest_letters", "slashes", "name_before", "plain_before", "assigned", "quoted", "path_around", "alternations", "groups", "distinct", "symbols")


@dataclass
class Scanner:
    """The fitted forest, the dictionary as a byte a bucket, and the share of trees that must agree."""

    model: object
    dictionary: bytes
    threshold: float = LEAST_SHARE


def _tokens(value: Column) -> Column:
    """Letter groups of three or more, in lower case; capitals within a word start a group."""
    apart = F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """A byte a bucket: 1 for the ``WORDS`` buckets with most words of all documents.

    Buckets are counted in each task before the shuffle, so however many words there are, a task sends one row a
    bucket at most.
    """
    buckets = F.transform(_tokens(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _bucket)
    often = docs.select(F.explode(buckets).alias("b")).groupBy("b").count().orderBy(F.desc("count"), "b").limit(WORDS).collect()
    marks = bytearray(BUCKETS)
    for b, _ in often:
        marks[b] = 1
    return bytes(marks)


def features(value: Column, before: Column, after: Column, words: bytes) -> Column:
    n = lambda p: F.regexp_count(value, F.lit(p)).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    lead, tail = F.right(F.regexp_replace(before, r"\s+", " "), F.lit(60)), F.left(after, F.lit(10))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    letters = F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x)))
    known = F.filter(_tokens(value), lambda w: F.substring(F.lit(bytearray(words)), _bucket(w) + 1, F.lit(1)) == F.lit(bytearray(b"\1")))
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w)) / F.length(value)
    return F.array(
        F.length(value).cast("double"), n("[0-9]"), n("[A-Z]"), n("[a-z]"), n("[^0-9A-Za-z]"), F.length(classes).cast("double"), flag(value.rlike("^[0-9a-f]+$")),
        covered.cast("double"), F.coalesce(letters, F.lit(0)).cast("double"), n("/"),
        flag(lead.rlike(NAME + REST + r"\s*(?:[:=]+>?|is)?\s*(?i:bearer\s)?[\"']?$")), flag(lead.rlike(PLAIN)), flag(lead.rlike(r"[:=]\s*[\"']?$")), flag(lead.rlike(r"[\"']$") & tail.rlike(r"^[\"']")), flag(lead.rlike(r"(?:https?:|www\.|[/\\.@])\S*$") | tail.rlike(r"^\.[a-z]{2,4}\b")),
        n("(?i)[aeiou][b-df-hj-np-tv-z](?=[aeiou])") / F.length(value), n("[_/+-]+"), (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).cast("double"), n(r"[^0-9A-Za-z+/_=.-]"),
    )


def with_candidates(docs: DataFrame, words: bytes, text_col: str = "text", name: str = "candidates") -> DataFrame:
    """Adds ``name``: an array of (start, end, features). Columns that start with two underscores are made and dropped."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__has", F.col("__text").rlike(NEEDED))
    pieces, matches = located(F.col("__text"), CANDIDATE)
    none = F.array().cast("array<string>")
    rows = rows.select("*", F.when(F.col("__has"), pieces).otherwise(none).alias("__pieces"), F.when(F.col("__has"), matches).otherwise(none).alias("__matches"))

    def cut(at: Column, match: Column, before: Column, after: Column) -> Column:
        lead = F.regexp_extract(match, "^" + LEAD, 0)
        value = F.substr(match, F.length(lead) + 1)
        key_like = (F.length(lead) > 0) & (F.length(value) >= 6) | value.rlike("[0-9]") & value.rlike("[A-Za-z]") | (F.length(value) >= 20) & value.rlike("[a-z][A-Z]") & ~value.rlike("[_/-]")
        return F.struct((at + F.length(lead)).alias("start"), (at + F.length(match)).alias("end"), value.alias("value"), F.concat(F.right(before, F.lit(40)), lead).alias("before"), F.left(after, F.lit(10)).alias("after"), key_like.alias("ok"))

    rows = rows.withColumn("__found", F.filter(spans(F.col("__pieces"), F.col("__matches"), cut), lambda x: x["ok"]))
    made = F.transform("__found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), features(x["value"], x["before"], x["after"], words).alias("features")))
    return rows.withColumn(name, made).drop("__pieces", "__matches", "__has", "__text", "__found")


def kinds(words: Column, h: Column) -> list[tuple[str, float, bool, Column, list[tuple[str, str]]]]:
    """(name, label, held out, value, (text before, text after)...) of each kind of key or look-alike, made of a hash and a slug of the text's words.

    Kinds that are held out are never planted for a fit; the tests measure recall and precision on them.
    """
    hexed = lambda k: F.sha2(F.concat(h.cast("string"), F.lit(f"#{k}")), 512)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(hexed(k))), "[+/=]", "")
    upper = lambda k: F.upper(mixed(k))
    left = lambda x, n: F.left(x, F.lit(n))
    digits = lambda k, n: left(F.regexp_replace(hexed(k), "[^0-9]", ""), n)
    slug = F.when(F.length(words) > 3, words).otherwise(F.lit("some-page"))
    camel = F.regexp_replace(F.initcap(F.translate(slug, "-", " ")), " ", "")
    symbol = lambda k: F.substring(F.lit("!@#$%^&*?-_.+"), 1 + F.pmod(F.xxhash64(h, F.lit(k)), F.lit(13)).cast("int"), F.lit(1))
    typed = lambda k: F.concat(left(F.lower(mixed(k)), 1 + 3), symbol(k), F.regexp_extract(F.lower(mixed(k + 50)), "([a-z][0-9]|[0-9][a-z]|[a-z]{2})", 1), left(mixed(k + 60), 2), symbol(k + 1), left(F.lower(mixed(k + 70)), 1))
    bare = [("", ""), ("key ", ""), ("see ", " here"), ("uses ", " today"), ("= ", ""), ('"', '"'), ("the ", ""), ("then ", " and")]
    named = [("password=", ""), ("password: ", " and"), ('secret = "', '"'), ("dbPassword=", ""), ("pwd:   ", ""), ("my password is ", " ok"), ("accessToken: ", ""), ("'api_key' => '", "'"), ("passphrase = ", ""), ('so secret = "', '" there')]
    plain = [("", ""), ("the ", ""), ("in ", " of"), ("see ", " here"), ("and ", ""), ("(", ")"), ("on ", "")]
    return [
        ("cloud id", 1.0, False, F.concat(F.lit("AKIA"), left(upper(1), 16)), bare),
        ("hex token", 1.0, False, left(hexed(2), 40), [('token = "', '"'), *named]),
        ("hex password", 1.0, False, left(hexed(3), 18), named),
        ("prefixed", 1.0, False, F.concat(F.lit("ghp_"), left(mixed(4), 36)), bare),
        ("hex key", 1.0, False, left(hexed(5), 32), [("api_key: ", ""), *named]),
        ("typed password", 1.0, False, typed(6), named),
        ("typed short password", 1.0, False, F.concat(left(F.lower(mixed(8)), 5), symbol(9), left(F.lower(mixed(10)), 3)), named),
        ("worded password", 1.0, False, F.concat(left(F.regexp_extract(F.concat(slug, F.lit("-hidden")), "([a-z]{4,})", 1), 7), digits(71, 1), symbol(72), left(F.lower(mixed(73)), 1)), named),
        ("broken word", 1.0, False, F.concat(left(F.lower(mixed(74)), 1), symbol(75), F.regexp_extract(F.concat(slug, F.lit("-hidden")), "([a-z]{2})", 1), F.lit("-"), left(F.lower(mixed(76)), 1), digits(77, 1), F.regexp_extract(F.concat(slug, F.lit("-lucky")), "([a-z]{3})", 1), symbol(78), left(F.lower(mixed(79)), 1)), named),
        ("bearer letters", 1.0, False, F.regexp_replace(left(mixed(11), 44), "[0-9]", "x"), [("Authorization: Bearer ", ""), ("Authorization: Bearer ", " now"), ("bearer ", "")]),
        ("dashed prefix", 1.0, False, F.concat(F.lit("sk-"), left(mixed(12), 44)), bare),
        ("grouped", 1.0, False, F.concat(F.lit("xoxb-"), digits(13, 11), F.lit("-"), left(mixed(14), 24)), bare),
        ("mixed key", 1.0, False, left(mixed(15), 40), [("aws_secret_access_key=", ""), *named]),
        ("short hex", 1.0, False, left(hexed(16), 12), named),
        ("url-safe key", 1.0, True, F.concat(F.lit("AIza"), left(mixed(17), 35)), bare),
        ("signed token", 1.0, True, F.concat(F.lit("eyJ"), left(mixed(18), 33), F.lit("_"), left(mixed(19), 40)), [("token=", ""), ("Authorization: Bearer ", "")]),
        ("registry token", 1.0, True, F.concat(F.lit("npm_"), left(mixed(20), 36)), bare),
        ("glued password", 1.0, True, F.concat(left(mixed(21), 4), digits(22, 4), symbol(23)), [("userpassword=", ""), ("clientSecret: ", ""), ("DB_PASSWORD=", "")]),
        ("commit", 0.0, False, left(hexed(31), 40), [("commit ", ""), ("revision ", " it"), ("sha1 ", "")]),
        ("checksum", 0.0, False, left(hexed(32), 32), [("md5 ", ""), ("checksum ", ""), ("etag: ", "")]),
        ("digest", 0.0, False, left(hexed(33), 64), [("sha256: ", ""), ("digest ", ""), ("hash ", "")]),
        ("uuid", 0.0, False, F.regexp_replace(left(hexed(34), 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), [("id ", ""), ("uuid: ", ""), *plain]),
        ("page address", 0.0, False, F.concat(slug, F.lit("-"), digits(35, 3)), [("https://example.org/", ".html"), ("www.example.com/", "")]),
        ("invoice", 0.0, False, F.concat(F.lit("INV-2024-"), digits(36, 8)), [("invoice ", ""), *plain]),
        ("time", 0.0, False, F.concat(F.lit("20"), digits(37, 2), F.lit("-01-31T10-20-"), digits(38, 2)), plain),
        ("path", 0.0, False, F.concat(F.lit("src/"), F.translate(slug, "-", "/"), F.lit("/"), camel, digits(39, 2)), [("file ", ".java"), ("in ", ".py"), ("", "")]),
        ("identifier", 0.0, False, F.concat(F.lit("get"), camel, F.lit("2Value")), [("call ", ""), *plain]),
        ("snake", 0.0, False, F.concat(F.translate(slug, "-", "_"), F.lit("_per_page_"), digits(40, 1)), plain),
        ("word after a name", 0.0, False, F.element_at(F.array(*map(F.lit, ("required", "missing", "forgotten", "needed", "invalid"))), 1 + F.pmod(h, F.lit(5)).cast("int")), [("password: ", ""), ("a password is ", " there"), ("secret: ", ""), ("token = ", "")]),
        ("words after a name", 0.0, False, F.concat(F.lit("the-"), slug), [("token ", ""), ("token: ", ""), ("secret=", "")]),
        ("one word after a name", 0.0, False, F.regexp_extract(F.concat(slug, F.lit("-another")), "([a-z]{6,})", 1), [("password: ", ""), ("secret is ", ""), ("credentials: ", ""), ("token: ", "")]),
        ("slug", 0.0, False, F.concat(slug, F.lit("-part-"), digits(41, 2)), plain),
        ("shouted", 0.0, False, F.concat(F.upper(slug), F.lit("-"), digits(52, 1), F.lit("-EDITION")), plain),
        ("order", 0.0, False, F.concat(left(upper(42), 3), digits(43, 10)), [("order ", ""), ("serial ", ""), ("ref ", "")]),
        ("reference", 0.0, False, F.concat(left(digits(44, 6), 4), F.lit("x"), digits(45, 8)), [("ref ", ""), ("order ", "")]),
        ("package", 0.0, True, F.concat(slug, F.lit("-"), digits(46, 1), F.lit("_"), digits(47, 1), F.lit("_"), digits(48, 2)), plain),
        ("constant", 0.0, True, F.concat(F.upper(F.translate(slug, "-", "_")), F.lit("_SIZE_"), digits(49, 2)), plain),
        ("object id", 0.0, True, left(hexed(50), 24), [("id ", ""), ("commit ", ""), ("hash: ", "")]),
        ("branch", 0.0, True, F.concat(F.lit("feature/"), slug, F.lit("-"), digits(51, 3)), [("branch ", ""), ("on ", "")]),
    ]


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: bool = False, one_of: int = 5) -> DataFrame:
    """(kind, value, before, after, label): keys and look-alikes (``kinds``) in contexts of at most ``CONTEXTS`` documents, chosen by a hash of the id.

    Each context gets about one in ``one_of`` kinds, in one of its kind's ways. An empty corpus gives empty contexts.
    """
    every = max(1, docs.count() // CONTEXTS)
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(55)), F.lit(every)) == 0).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.xxhash64(id_col, F.lit(56)).alias("h"))
    more = docs.sparkSession.range(EMPTY_CONTEXTS).select(F.lit("").alias("t"), F.xxhash64("id").alias("h"))
    words = F.split(F.col("t"), r"\s+")
    cut = F.pmod("h", F.greatest(F.size(words), F.lit(1))).cast("int")
    part = lambda at, k: F.array_join(F.slice(words, F.greatest(at, F.lit(0)) + 1, F.lit(k)), " ")
    rows = some.orderBy("h").limit(CONTEXTS).union(more).select("h", part(cut - 5, 5).alias("lead"), part(cut, 4).alias("tail"), F.lower(F.regexp_replace(part(cut, 3), r"[^\p{L}]+", "-")).alias("slug"))
    made = []
    for i, (name, label, held, value, ways) in enumerate(kinds(F.col("slug"), F.col("h"))):
        if held == held_out:
            way = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways))[F.pmod(F.xxhash64("h", F.lit(200 + i)), F.lit(len(ways))).cast("int")]
            made.append(F.struct(F.lit(name).alias("kind"), value.alias("value"), F.concat("lead", F.lit(" "), way["a"]).alias("before"), F.concat(way["b"], F.lit(" "), "tail").alias("after"), F.lit(label).alias("label")))
    return rows.select(F.explode(F.array(*made)).alias("x"), "h").where(F.pmod(F.xxhash64("h", "x.value"), F.lit(one_of)) == 0).select("x.*")


def fit(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", fit_rows: int = FIT_ROWS, text_col: str = "text") -> Scanner:
    """The scanner, fitted on at most ``fit_rows`` findings, a quarter of them kept aside for the threshold.

    ``labelled`` has (value, before, after, label): a candidate, the text on both sides, 1.0 for a secret; the most of
    ``fit_rows`` are taken by a hash. Without it findings are planted (see ``planted``). The dictionary is counted
    over all documents; an empty table gives an empty one. Other columns of ``docs`` are ignored.
    """
    rows = planted(docs, id_col, text_col) if labelled is None else labelled.select("value", "before", "after", F.col("label").cast("double"))
    words = dictionary(docs, text_col)
    rows = rows.where("value is not null and label is not null").withColumn("h", F.xxhash64("value", "before", "after"))
    found = rows.orderBy("h", "label").limit(fit_rows).select(features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), words).alias("features"), "label", "h")
    sample = materialised(found, narrow=True)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5, checkpointInterval=-1)
    aside = F.pmod("h", F.lit(4)) == 0 if labelled is None else F.lit(False)
    model = forest.fit(sample.where(~aside).select("label", array_to_vector("features").alias("vector")))
    seen = sample.where(aside).select(forest_share(model, F.col("features")).alias("p"), F.col("label").cast("int")).collect()
    return Scanner(model, words, max(LEAST_SHARE, calibrated_threshold([tuple(r) for r in seen], PROBABILITY, LEAST_SHARE)))


def find(docs: DataFrame, scanner: Scanner, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: an array of (start, end, score) in order of start, in code points.

    A null text is an empty one; repeated rows give repeated results; an empty table gives an empty one. All columns
    are kept, whatever their names, but one called ``name``, which is replaced.
    """
    plain = docs.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(docs.columns) if c != text_col})
    rows = with_candidates(plain, scanner.dictionary, text_col, "__candidates")
    scored = F.transform("__candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), forest_share(scanner.model, c["features"]).alias("score")))
    rows = rows.withColumn("__secrets", F.filter(scored, lambda s: s["score"] >= scanner.threshold))
    kept = [F.col(text_col if c == text_col else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns) if c != name]
    return rows.select(*kept, F.col("__secrets").alias(name))
