"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame operations only.

Base patterns with checks (Luhn, ranges, digit counts) always stand. Wider generators propose more spans, which may
overlap. Boosted trees score each candidate from its format and the text around it; thresholds by kind, set on rows
kept aside, select those that are redacted too. The trees learn from labels that don't depend on whether a base
pattern finds a span: positive are base spans and the same spans rewritten as base patterns miss them (``rewritten``),
negative are candidates that can't be of their kind (``refused``), and labelled examples of both are added
(``examples``). Other candidates, such as data that is written in an unusual way, have no label. The fitted trees become a column expression, so a document is scanned, scored and redacted in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised, written
from stratapanel.llm.trees import boosted_probability, calibrated_threshold, located, spans

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats and starts at the head of a run, which changes no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the generators. A card has 19 digits at most and a phone number 15, hence their bounds on digits; separators have none.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:[.,][0-9]++){3,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]*+[0-9]){11,18}(?![0-9])",
    "phone": r"(?:\+|\(|(?<![0-9]))[0-9](?:[\x20()./-]*+[0-9]){6,14}(?![0-9])",
}
#: Characters that a text must have for a kind to be looked for.
NEEDED = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Words before a span that speak for personal data.
CUES = r"(?i)(?:mail|contact|call|tel|phone|mobile|fax|card|visa|account|address|host|server|ip|from)(?:\s+(?:is|at|me|us))?\W*$"
#: Words before a span that speak for a number of another sort.
OTHER_CUES = r"(?i)(?<![a-z])(?:version|release|build|v|ids?|isbn|order|invoice|number|no|ref|serial|ticket|sku|page|chapter|section|date|on|score|lines?|pages?|dated|between)\W*$"
#: Usual groups of a phone number without a plus.
GROUPED = r"^(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}$"
DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-])?(?:19|20)[0-9]{2}(?![0-9])"
TREES, DEPTH = 12, 4
#: Calibrated probability from which a candidate is redacted; weight of the examples by that of the corpus's candidates, at least.
PROBABILITY, EXAMPLE_SHARE = 0.98, 0.1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


FEATURES = ("kind", "length", "digits", "letters", "spaces", "dots", "dashes", "parens", "plus", "at", "luhn", "in_range", "cue", "joined_before", "joined_after", "parts", "other_cue", "grouped", "ending", "longest", "date", "lone", "row")


def _features(kind: str, value: Column, before: Column, after: Column) -> Column:
    n = lambda p: F.regexp_count(value, F.lit(p)).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    digits = _digits(value)
    return F.array(
        F.lit(float(KINDS.index(kind))), F.length(value).cast("double"), n("[0-9]"), n("[A-Za-z]"), n(r"\x20"), n(r"\."), n("-"), n("[()]"), n(r"\+"), n("@"),
        flag(F.when(F.length(digits).between(1, 40), luhn(digits)).otherwise(F.lit(False))),
        flag(F.forall(F.split(value, r"[^0-9]+"), lambda p: (p == "") | p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))),
        flag(F.right(before, F.lit(24)).rlike(CUES)), flag(F.right(before, F.lit(2)).rlike(r"(?:[\p{L}0-9]|[0-9][\x20._/-])$")), flag(F.left(after, F.lit(2)).rlike(r"^(?:[\p{L}0-9]|[\x20._/-][0-9])")), n(r"[^0-9A-Za-z]+"),
        flag(F.right(before, F.lit(24)).rlike(OTHER_CUES)), flag(value.rlike(GROUPED)), flag(value.rlike(r"[^A-Za-z0-9-][A-Za-z]{2,12}$")),
        F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda p: F.length(p))).cast("double"), flag(value.rlike(DATE)), n(r"(?<![0-9])[0-9](?![0-9])"),
        flag(~value.rlike("[0-9][0-9]") & ~F.right(before, F.lit(24)).rlike(CUES)),
    )


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` (array of kind number, start, end) and ``candidates`` (the same with features and a label)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__text", text)
    rows = rows.select("*", *(F.col("__text").rlike(p).alias(f"__has{i}") for i, p in enumerate(dict.fromkeys(NEEDED.values()))))
    has = {k: F.col(f"__has{list(dict.fromkeys(NEEDED.values())).index(NEEDED[k])}") for k in KINDS}
    cut = []
    for name, patterns in (("b", BASE), ("w", WIDE)):
        for kind in KINDS:
            pieces, matches = located(F.col("__text"), patterns[kind])
            none = F.array().cast("array<string>")
            cut += [F.when(has[kind], pieces).otherwise(none).alias(f"__{name}p_{kind}"), F.when(has[kind], matches).otherwise(none).alias(f"__{name}m_{kind}")]
    rows = rows.select("*", *cut)
    base = [
        F.filter(spans(F.col(f"__bp_{kind}"), F.col(f"__bm_{kind}"), lambda at, value, *_, k=k, kind=kind: F.struct(at.alias("start"), F.lit(k).alias("kind"), (at + F.length(value)).alias("end"), accepted(kind, value).alias("ok"))), lambda s: s["ok"])
        for k, kind in enumerate(KINDS)
    ]
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = rows.withColumn("base", F.array_sort(F.transform(F.concat(*base), plain)))
    wide = [
        spans(F.col(f"__wp_{kind}"), F.col(f"__wm_{kind}"), lambda at, value, before, after, k=k, kind=kind: F.struct(at.alias("start"), F.lit(k).alias("kind"), (at + F.length(value)).alias("end"), _features(kind, value, before, after).alias("features")))
        for k, kind in enumerate(KINDS)
    ]
    rows = rows.withColumn("candidates", F.concat(*wide))
    return rows.drop(*(c for c in rows.columns if c.startswith(("__bp_", "__bm_", "__wp_", "__wm_", "__has"))))


def _on_base(candidate: Column) -> Column:
    return F.exists(F.col("base"), lambda s: (s["kind"] == candidate["kind"]) & (s["start"] < candidate["end"]) & (candidate["start"] < s["end"]))


def _meets_base(candidate: Column) -> Column:
    return F.exists(F.col("base"), lambda s: (s["start"] < candidate["end"]) & (candidate["start"] < s["end"]))


@dataclass
class Detector:
    """The fitted trees (None: no candidates to learn from) and the threshold of each kind."""

    model: object
    thresholds: tuple[float, ...]


def _named(features: Column) -> Callable[[str], Column]:
    return lambda name: features[FEATURES.index(name)]


def impossible(kind: Column, features: Column) -> Column:
    """Whether a candidate fails the check of its kind: the base checks, a host that ends in letters, separators of one sort in a card, no date or IP as a phone, nor digits that stand alone in part."""
    f, of = _named(features), lambda name: kind == KINDS.index(name)
    return (
        of("email") & (f("ending") == 0)
        | of("ip") & ((f("dots") != 3) | (f("parts") != 3) | (f("in_range") == 0))
        | of("card") & (~f("digits").between(12, 19) | (f("luhn") == 0) | ((f("spaces") > 0).cast("int") + (f("dots") > 0).cast("int") + (f("dashes") > 0).cast("int") > 1))
        | of("phone") & (~f("digits").between(7, 15) | (f("date") > 0) | (f("lone") > 2) & (f("lone") < f("digits")) | (f("dots") == 3) & (f("in_range") > 0))
    )


def refused(kind: Column, features: Column) -> Column:
    """Whether a candidate is taken as an example of none: impossible, part of a word, named otherwise, or a bare number as a phone."""
    f, phone = _named(features), kind == KINDS.index("phone")
    return impossible(kind, features) | (f("joined_before") > 0) | (f("joined_after") > 0) | (f("other_cue") > 0) & (kind != 0) | phone & ((f("parts") == 0) | (f("longest") > 6))


def rewritten(kind: Column, value: Column) -> Column:
    """A base span as people write it to hide it: (at) and (dot), no plus and country code, other separators. IPs: null."""
    host = F.regexp_replace(F.substring_index(value, "@", -1), r"\.", " (dot) ")
    some = F.pmod(F.xxhash64(value), F.lit(3))
    local = F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*", "")
    dotted = F.regexp_replace(F.regexp_replace(local, r"[()]", ""), r"[\x20-]+", ".")
    split = lambda by: F.regexp_replace(_digits(value), "([0-9]{4})(?=[0-9])", f"$1{by}")
    return (
        F.when((kind == KINDS.index("email")) & value.contains("@"), F.concat(F.substring_index(value, "@", 1), F.when(some == 0, " (at) ").when(some == 1, "[at]").otherwise(" [at] "), F.when(some == 0, host).when(some == 1, F.replace(host, F.lit(" (dot) "), F.lit("[dot]"))).otherwise(F.replace(host, F.lit(" (dot) "), F.lit(".")))))
        .when((kind == KINDS.index("phone")) & (F.length(_digits(local)).between(9, 11)) & value.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.when(some == 0, dotted).when(some == 1, F.replace(dotted, F.lit("."), F.lit("-"))).otherwise(local))
        .when(kind == KINDS.index("card"), F.when(some == 0, split(".")).when(some == 1, split("/")).otherwise(split("_")))
    )


def examples() -> list[tuple[str, str, str, int]]:
    """Labelled examples (before, value, after, kind number; -1: no personal data)."""
    words = ("see ", "the ", "then call ", "mail ", "my phone is ", "contact: ", "and ", "reach us ")
    cues, plain = ("call ", "phone: ", "tel. ", "my mobile is ", "contact "), ("we counted ", "the row ", "then ", "it shows ", "results ")
    out = []
    for i in range(240):
        before, a, b, c = words[i % 8], 201 + 37 * i % 790, 210 + 53 * i % 780, 1000 + 977 * i % 9000
        user, host, tld = f"{('ann', 'bob.lee', 'info', 'x')[i % 4]}{i if i % 3 else ''}", ("mail", "my-site", "example")[i % 3], ("com", "org", "de", "co.uk")[i % 4]
        dot = (" (dot) ", "[dot]", ".")[i % 3]
        out.append((before, f"{user}{(' (at) ', ' [at] ', '(at)', '[at]')[i // 3 % 4]}{host}{dot}{tld.replace('.', dot)}", " now", 0))
        out.append((before, (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}")[i % 5], " now", 3))
        # the same digits one by one: what stands before tells a number to call from a row of figures
        gap = (" ", "-", ".")[i % 3]
        out.append((cues[i % 5], gap.join(f"{a}{b}{c}"), " now", 3))
        out.append((plain[i % 5], gap.join(f"{a}{b}{c}"), " now", -1))
        # numbers of other sorts, which no rule of ``refused`` knows
        out.append((plain[i // 5 % 5], (f"978-{i % 10}-{10 + i % 90}-{100000 + 977 * i % 900000}-{i % 10}", f"{a}-{1000000 + 7919 * i % 9000000}-{1000000 + 104729 * i % 9000000}", f"{10 + i % 90}/{c}/{10 + a % 90}/{b}", f"{c}.{b}.{1 + i % 9}", f"{i % 10}.{c}e-{i % 10}, {b} {a} {i % 7} {c}", f"{c} {1000 + a} {2000 + b} {c} {3000 + i} {10 + i % 90}")[i % 6], " of", -1))
        other = (f"{1 + i % 9}.{i % 10}.{i}", f"{i}.{i + 1}.{i + 2}.{i + 3}.{i + 4}", f"{9 * 10**15 + 7919 * i}", f"{1990 + i % 35}-{1 + i % 12:02d}-{1 + i % 28:02d}", f"{i + 1},{a},{b}", f"{a}{b}{c}{c}", f"{1950 + i}-{1960 + i}", f"{1 + i % 28:02d}/{1 + i % 12:02d}/{1990 + i % 35}", f"{a}{b}{c}", f"{1 + i % 4}.{i % 10}.{290 + i}.{i % 7}.{i % 5}")[i % 10]
        out.append((("version ", "the ", "id ", "order ", "see ", "and ")[i // 10 % 6], other, " here", -1))
        out.append(("look ", f"{('up', 'it', 'we')[i % 3]} (at) {(f'{i}.{i + 1}', f'home.{i}', f'{i}.30')[i // 3 % 3]}", " and", -1))
    return out


def _exploded(rows: DataFrame, spans: Column, *kept: str) -> DataFrame:
    """A row ``c`` for each of the spans, with the kept columns.

    The plain generator makes Spark filter rows by the size of the array first, down to where the text is read: each
    step that makes the array then stands in the plan as often as the next ones name it, hundreds of MB on the driver.
    """
    return rows.select(*kept, F.explode_outer(spans).alias("c")).where("c is not null")


def _made(texts: DataFrame) -> DataFrame:
    """(h, kind, features, label, n) of the candidates in made texts (before, value, after, kind, n; kind -1: none)."""
    at = F.length("before")
    texts = texts.where("value is not null").select(F.col("kind").alias("is"), at.alias("start"), (at + F.length("value")).alias("end"), F.concat("before", "value", "after").alias("text"), "n")
    rows = _exploded(with_candidates(texts), F.col("candidates"), "text", "is", "start", "end", "n")
    own = F.col("c.kind") == F.col("is")
    rows = rows.where((F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end")) | (F.col("is") < 0))
    return rows.select(F.xxhash64("text", "c.start", "c.kind").alias("h"), "c.kind", "c.features", own.cast("double").alias("label"), "n")


def _labelled(docs: DataFrame, id_col: str) -> DataFrame:
    """(h, kind, features, label, seen) of the labelled candidates of all documents; seen: positive ones with the text around."""
    rows = with_candidates(docs.select(id_col, "text"))
    part = lambda start, n: F.substr("__text", (start + 1).cast("int"), n.cast("int"))
    kept = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["features"].alias("features"), F.when(_on_base(c), 1.0).when(refused(c["kind"], c["features"]) | F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])), 0.0).alias("label"), c["end"].alias("end")))
    known = F.filter(kept, lambda c: c["label"].isNotNull())
    cut = F.transform(known, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["features"].alias("features"), c["label"].alias("label"), F.when(c["label"] > 0, F.struct(part(F.greatest(c["start"] - 24, F.lit(0)), F.least(c["start"], F.lit(24))).alias("before"), part(c["start"], c["end"] - c["start"]).alias("value"), part(c["end"], F.lit(8)).alias("after"))).alias("seen")))
    return _exploded(rows, cut, id_col).select(F.xxhash64(id_col, "c.start", "c.kind").alias("h"), "c.kind", "c.features", "c.label", "c.seen")


def fit(docs: DataFrame, id_col: str = "doc_id") -> Detector:
    """Fits the trees on all labelled candidates of all documents, their rewritten forms and the examples.

    Candidates with the same features and label are one row with their number as its weight, so what the trees pass over
    grows with the forms that data takes, not with the documents. Examples weigh a tenth of the candidates at least, so
    a large corpus doesn't drown them. A quarter of the rows, by a hash of document and place,
    is kept aside; a rising fit to these turns scores into probabilities, which set each kind's threshold.
    """
    found = written(_labelled(docs, id_col), "pii-candidates").withColumn("n", F.lit(1.0))
    total, shown = found.count(), examples()
    if not total:
        return Detector(None, (2.0,) * len(KINDS))
    known = docs.sparkSession.createDataFrame(shown, "before string, value string, after string, kind int").withColumn("n", F.lit(max(1.0, EXAMPLE_SHARE * total / len(shown))))
    again = found.where("label > 0").select("seen.before", rewritten(F.col("kind"), F.col("seen.value")).alias("value"), "seen.after", "kind", "n")
    both = found.drop("seen").union(_made(again.union(known)))
    forms = both.groupBy((F.pmod("h", F.lit(4)) == 0).alias("aside"), "kind", "features", "label").agg(F.sum("n").alias("n"))
    forms = materialised(forms, narrow=True)
    train = forms.where("not aside").select("label", "n", array_to_vector("features").alias("vector"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=4, checkpointInterval=-1).fit(train)
    aside = forms.where("aside").groupBy("kind", boosted_probability(model, F.col("features")).alias("p")).agg(F.sum(F.col("label") * F.col("n")), F.sum("n")).collect()
    return Detector(model, tuple(calibrated_threshold([(p, ones, n) for kind, p, ones, n in aside if kind == k], PROBABILITY, 2.0) for k in range(len(KINDS))))


def find(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind number, end), in order of start, then kind.

    All columns are kept, whatever their names, but ``base`` and ``spans``, which are replaced. A null text is an empty one. Accepted candidates that meet a base span are left out, as that span
    stands already, and so are those that fail the check of their kind; of equal spans one is kept.
    """
    plain = docs.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(docs.columns) if c != text_col})
    rows = with_candidates(plain, text_col)
    if detector.model is None:
        rows = rows.withColumn("spans", F.col("base"))
    else:
        limit = F.array(*(F.lit(float(t)) for t in detector.thresholds))
        chosen = F.filter("candidates", lambda c: (boosted_probability(detector.model, c["features"]) >= limit[c["kind"]]) & ~impossible(c["kind"], c["features"]) & ~_meets_base(c))
        more = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        rows = rows.withColumn("spans", F.when(F.size("candidates") > 0, F.array_sort(F.array_distinct(F.concat("base", more)))).otherwise(F.col("base")))
    kept = [F.col(text_col if c == text_col else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("base", "spans")]
    return rows.select(*kept, "base", "spans")


def said(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one."""
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = span["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, name[span["kind"]])).otherwise(state["out"]).alias("out"))

    done = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; a null text stays null, all columns and rows are kept."""
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c != text_col})
    rows = find(plain, detector, text_col).withColumn(text_col, redacted(F.col(text_col), F.col("spans")))
    return rows.select(*(F.col(c if c == text_col else f"__own_{c}").alias(c) for c in docs.columns))
