"""Personal data by weak supervision. DataFrame functions only.

Candidates come from patterns. The base ones (valid e-mail addresses, IPv4 addresses, payment cards and
international phone numbers) are always kept. The others (matches that fail a base check, national phone
numbers, written-out addresses, social security numbers, secrets behind a key) are judged: format, gazetteer and
context labelers vote for, against or not at all. Expectation-maximisation over the counts of vote patterns
estimates, for each kind, how often it is personal data and how each labeler votes on either side. A logistic
classifier is then fitted to those posteriors over all candidates; its features are the span's shape, length,
characters and their variety, the words and the sign before it, and the votes, each by kind, hashed to BUCKETS.

Vote patterns are few whatever the corpus holds (3**4 votes for each of 7 kinds), and only their counts come to the
driver. The classifier's rounds run in Spark over all patterns of features with their counts; a round's gradient has
one number for each of BUCKETS features.

Defined results: a null text is empty; offsets count code points, ends are exclusive; matches of a kind do not
overlap; an added span that overlaps a base one goes; rows that repeat are found each; a null doc_id is kept; a
text without spans has zeros, an empty list and the digest of the empty text; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import release, stored

KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "contact")
BASE = KINDS[:4]

# Patterns of the kinds. Quantifiers that cannot give back are possessive, so that matching takes
# linear time and no stack on long runs; where a run could be entered midway, a match must begin it or follow
# another match. They match what the plain patterns match.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9_+/=.-]{8,}+",
    "contact": r"(?<![0-9+)])(?<!\+[0-9]{1,3}\x20)\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,}+)++",
}
#: Words that speak for a kind when they stand just before a match, in the corpus's languages.
CONTEXT = {
    "email": "mail|email|e-mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|amex|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "ssn": "ssn|social security",
    "secret": "password|passwd|pwd|token|secret|key",
    "contact": "phone|tel|call|mobile|fax|mail|contact",
}
#: How often each labeler, where it votes, is right at first, and at least: a failed format check decides.
RELIABILITY = (0.999, 0.6, 0.7, 0.7)
LEAST_RELIABLE = (0.999, 0.5, 0.5, 0.5)
#: Gazetteers: endings of domains, calling codes (of one, two and, by their first two digits, three digits), the first
#: digits of card issuers, first parts of addresses that no host has.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "eu", "uk", "info", "ch", "at", "it", "nl", "us", "ca", "mx", "ar", "co", "me", "dev", "app")
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57",
    "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35",
    "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99",
)
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35")
NO_HOSTS = ("0", "255")
#: Words that speak against every kind.
AGAINST = "version|release|isbn|issn|order|invoice|serial|section|chapter|page|doi"
# End of fixed values.


def _ip_valid(x: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        d = x.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    backwards = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(backwards, lambda x: x != ""), doubled)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, x: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    digits = _digits(x)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", _ip_valid(x))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9][0-9 -]{11}"),
        "phone": text.contains("+"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
        "secret": text.contains("=") | text.contains(":"),
        "contact": text.contains("(") | text.contains("[at]"),
    }[kind]


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and their matches (row, kind, start, end, match, before, valid).

    A text is read once. What stands between the matches comes from the same pattern, so offsets are sums of
    lengths; they are added up by a window over a row's own matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def found(kind: str) -> Column:
        pattern = PATTERNS[kind]
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        between = F.split(text, pattern, -1)
        rows = F.zip_with(between, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(40)).alias("before"), m.alias("match")))
        return F.when(_possible(kind, text), F.filter(rows, lambda x: x["match"].isNotNull()))

    read = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(found(k).alias(f"_{k}") for k in KINDS)), "matches"
    )
    every = None
    for kind in KINDS:
        own = read.select("row", F.lit(kind).alias("kind"), F.posexplode(f"_{kind}").alias("at", "m"))
        every = own if every is None else every.union(own)
    length = F.length("m.match")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + length).over(order).cast("long")
    matches = every.select("row", "kind", "m.match", "m.before", length.alias("length"), end.alias("end"))
    value = F.when(F.col("kind") == "secret", F.length(F.regexp_extract("match", r"[A-Za-z0-9_+/=.-]{8,}+$", 0))).otherwise(F.col("length"))
    return read.select("row", "doc_id"), matches.select(
        "row", "kind", (F.col("end") - value).alias("start"), "end", "match", "before", _valid(F.col("kind"), F.col("match")).alias("valid")
    )


def votes(matches: DataFrame) -> DataFrame:
    """The matches with four votes: 1 for personal data, -1 against, 0 none."""
    kind, x, before = F.col("kind"), F.col("match"), F.lower("before")
    digits = _digits(x)
    shape = (
        F.when(kind == "email", F.lit(1))
        .when(kind == "ip", F.when(F.col("valid"), 1).otherwise(-1))
        .when(kind == "card", F.when(F.col("valid"), 1).otherwise(-1))
        .when(kind == "phone", F.when(F.col("valid"), 1).otherwise(-1))
        .when(kind == "ssn", F.when(x.rlike("^(000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .when(kind == "secret", F.when(x.rlike("[0-9]") & x.rlike("[A-Za-z]{1}"), 1).otherwise(-1))
        .otherwise(1)
    )
    start2 = F.left(digits, F.lit(2))
    issued = F.left(digits, F.lit(1)).isin(*CARD_ISSUERS) | start2.isin(*CARD_ISSUERS) | F.left(digits, F.lit(4)).isin(*CARD_ISSUERS)
    listed = (
        F.when(kind == "email", F.when(F.lower(F.substring_index(x, ".", -1)).isin(*DOMAINS), 1).otherwise(0))
        .when(kind == "ip", F.when(F.substring_index(x, ".", 1).isin(*NO_HOSTS), -1).otherwise(0))
        .when(kind == "card", F.when(issued & F.length(digits).between(13, 19), 1).otherwise(-1))
        .when(kind == "phone", F.when(F.left(digits, F.lit(1)).isin(*CALLING_CODES) | start2.isin(*CALLING_CODES), 1).otherwise(0))
        .when(kind == "contact", F.when(x.rlike(r"\)\x20?555|[\[(]at[\])]"), 1).otherwise(0))
        .when(kind == "secret", F.when(F.length(F.regexp_extract(x, r"[A-Za-z0-9_+/=.-]{8,}+$", 0)) >= 16, 1).otherwise(0))
        .otherwise(0)
    )
    near = F.lit(0)
    for k in KINDS:
        near = F.when((kind == k) & before.rlike(rf"(?<!\p{{L}})(?:{CONTEXT[k]})\W{{0,12}}$"), 1).otherwise(near)
    against = F.when(before.rlike(rf"(?<!\p{{L}})(?:{AGAINST})\W{{0,12}}$|[0-9A-Za-z_/]$"), -1).otherwise(0)
    # the key of a secret is part of its match
    near = F.when(kind == "secret", 1).otherwise(near)
    return matches.select("*", F.array(shape, listed, near, against).alias("votes"))


BUCKETS = 1024


def features(voted: DataFrame) -> DataFrame:
    """The candidates with `features`, numbers below BUCKETS of what the classifier looks at."""
    x, before = F.col("match"), F.lower("before")
    length = F.greatest(F.length(x), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9")
    words = F.regexp_extract_all(before, F.lit(r"\p{L}+"), F.lit(0))
    seen = {
        "kind": F.lit(""),
        "shape": F.left(shape, F.lit(12)),
        "length": F.floor(F.log2(length)).cast("string"),
        "digits": F.floor(4 * F.length(_digits(x)) / length).cast("string"),
        "variety": F.floor(4 * F.size(F.array_distinct(F.split(x, ""))) / length).cast("string"),
        "word": F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")),
        "second word": F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")),
        "sign": F.regexp_replace(F.right(before, F.lit(1)), r"\p{L}", "a"),
        **{f"vote {i}": F.element_at("votes", i + 1).cast("string") for i in range(4)},
    }
    hashed = [F.pmod(F.xxhash64("kind", F.lit(name), value), F.lit(BUCKETS)).cast("int") for name, value in seen.items()]
    return voted.withColumn("features", F.array(*hashed))


@dataclass(frozen=True)
class SpanModel:
    """Of each kind the share of personal data and the labelers' vote rates; the classifier's weights."""

    prior: dict[str, float]
    rates: dict[str, list[dict[tuple[bool, int], float]]]
    weights: list[float]

    def probability(self, own: Column) -> Column:
        """From an array of feature numbers."""
        table = F.array(*map(F.lit, self.weights))
        return 1 / (1 + F.exp(-F.aggregate(own, F.lit(0.0), lambda a, f: a + F.element_at(table, f + 1))))


def _posterior(prior: float, rates: list[dict[tuple[bool, int], float]], vote: tuple[int, ...]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for i, v in enumerate(vote):
        yes += math.log(rates[i][True, v])
        no += math.log(rates[i][False, v])
    return 1 / (1 + math.exp(min(700.0, max(-700.0, no - yes))))


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict, dict, list[tuple[str, tuple[int, ...], float]]]:
    """Priors, vote rates and posteriors from (kind, votes, count). Labelers start out as reliable as RELIABILITY says."""
    prior, rates, soft = {}, {}, []
    for kind in KINDS:
        own = [(v, n) for k, v, n in counts if k == kind]
        p = 0.5
        r = [{(y, v): (a if (v == 1) == y else 1 - a) / 2 if v else 0.5 for y in (True, False) for v in (-1, 0, 1)} for a in RELIABILITY]
        for _ in range(rounds if own else 0):
            post = [(v, n, _posterior(p, r, v)) for v, n in own]
            total = sum(n for _, n, _ in post)
            p = min(0.9, max(0.01, (sum(n * q for _, n, q in post) + 1) / (total + 2)))
            for i in range(4):
                for y in (True, False):
                    mass = {v: 2.0 if v == (1 if y else -1) else 1.0 for v in (-1, 0, 1)}
                    for v, n, q in post:
                        mass[v[i]] += n * (q if y else 1 - q)
                    for v in mass:
                        r[i][y, v] = mass[v] / sum(mass.values())
                    right, wrong = (y, 1 if y else -1), (y, -1 if y else 1)
                    voted = r[i][right] + r[i][wrong]
                    r[i][right] = max(r[i][right], LEAST_RELIABLE[i] * voted)
                    r[i][wrong] = voted - r[i][right]
        prior[kind], rates[kind] = p, r
        soft += [(kind, v, _posterior(p, r, v)) for v, _ in own]
    return prior, rates, soft


def train(seen: DataFrame, rounds: int = 12, step: float = 1 / 12, ridge: float = 1.0) -> SpanModel:
    """Fit to candidates (kind, votes, features): at most 7 * 3**4 counts and BUCKETS numbers a round leave Spark.

    Each round moves every weight by its gradient over its curvature, times `step`, as a span has twelve features.
    """
    rows = seen.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    prior, rates, soft = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in rows))
    model = SpanModel(prior, rates, [0.0] * BUCKETS)
    if not soft:
        return model
    # from Arrow, as rows from a list would start further Python workers on the executors, beside those of the stages
    kinds, votes, q = zip(*soft, strict=True)
    named = pa.table({"kind": pa.array(kinds, pa.string()), "votes": pa.array(map(list, votes), pa.list_(pa.int32())), "q": pa.array(q, pa.float64())})
    posterior = F.broadcast(seen.sparkSession.createDataFrame(named))
    patterns = stored(seen.join(posterior, ["kind", "votes"]).groupBy("features").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s")), "patterns")
    for _ in range(rounds):
        p = model.probability(F.col("features"))
        each = patterns.select(F.explode("features").alias("f"), (F.col("s") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        for r in each.groupBy("f").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # BUCKETS at most
            model.weights[r["f"]] += step * (r["g"] - ridge * model.weights[r["f"]]) / (r["h"] + ridge)
    release(patterns)
    return model


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and the spans kept (row, kind, start, end, base)."""
    rows, matches = candidates(docs)
    voted = stored(features(votes(matches)).select("row", "kind", "start", "end", "valid", "votes", "features"), "votes")
    model = train(voted)
    sure = model.probability(F.col("features")) >= 0.5
    by_start = Window.partitionBy("row").orderBy("start", "end")
    base_end = F.max(F.when(F.col("valid"), F.col("end"))).over(by_start)
    by_end = Window.partitionBy("row").orderBy(F.col("end").desc(), F.col("start").desc())
    base_start = F.min(F.when(F.col("valid"), F.col("start"))).over(by_end)
    clear = (F.coalesce(base_end, F.lit(-1)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    spans = voted.withColumn("clear", clear).where(F.col("valid") | (sure & F.col("clear")))
    return rows, spans.select("row", "kind", "start", "end", F.col("valid").alias("base"))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows, spans = find_spans(docs)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    one = F.struct(number.alias("k"), "start", "end")
    found = spans.groupBy("row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE),
        F.collect_list(F.when(F.col("base"), one)).alias("base"),
        F.collect_list(one).alias("all"),
    )
    return rows.join(found, "row", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce(_listing(F.col("base")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listing(F.col("all")), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; n_chars, where there, follows the text.

    Texts without spans pass untouched; the others are rebuilt from what stands between their spans, of which
    those that overlap count as one.
    """
    kept = stored(docs.select(F.struct("*").alias("doc"), "text", F.monotonically_increasing_id().alias("_row")), "kept")
    numbered, spans = find_spans(kept.select(F.col("_row").alias("doc_id"), "text"))
    by_row = spans.join(numbered, "row").select(F.col("doc_id").alias("_row"), "kind", "start", "end")
    w = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = by_row.select("*", reach.alias("reach")).select(
        "_row", "kind", "end", F.greatest("start", F.coalesce("reach", F.lit(0))).alias("start"), (F.col("start") >= F.coalesce("reach", F.lit(0))).alias("new"),
        F.coalesce("reach", F.lit(0)).alias("from"),
    ).where("end > from")
    marks = first.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from", F.when(F.col("new"), F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).otherwise("").alias("mark")))).alias("marks"),
        F.max("end").alias("stop"),
    )
    text = F.col("text")
    rebuilt = F.concat(
        F.array_join(
            F.transform("marks", lambda m: F.concat(F.substring(text, m["from"].cast("int") + 1, (m["start"] - m["from"]).cast("int")), m["mark"])), ""
        ),
        F.substring(text, F.col("stop").cast("int") + 1, F.length(text)),
    )
    whole = F.col("marks").isNull()
    out = kept.join(marks, "_row", "left").withColumn("new", F.when(whole, text).otherwise(rebuilt))
    changed = {"text": F.col("new"), "n_chars": F.when(whole, F.col("doc.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("new"))}
    return out.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns))
