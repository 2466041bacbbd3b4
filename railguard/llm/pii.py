"""Personal data: high-recall candidates, boosted trees over format and context, thresholds.

Everything is DataFrame work. Generators propose spans per kind: the contract's patterns,
and looser ones beside them (spelled-out e-mail addresses, numbers without a plus). Pieces of
text between the matches give their positions; only candidates leave the scan, never texts.
Matches of a fixed pattern that pass its check (parts of an address, check digit, number of
digits) are always reported. They also teach gradient-boosted trees, which see the format of
a candidate and the words around it but not the checks: passed ones are positive, failed ones
negative. A candidate that no fixed pattern reports is added where its probability reaches a
threshold calibrated for precision on candidates set aside, and where it overlaps nothing
that is reported already.

Cases: null or empty text has no spans; repeated rows are scanned one by one; without failed
or without passed candidates nothing is added; equal starts are ordered email, ip, card, phone;
very long texts are scanned whole with patterns that never backtrack over a run; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from railguard.session import durable

KINDS = ["email", "ip", "card", "phone"]

# The contract's patterns. Runs are possessive, which changes no match: what follows a run
# cannot be part of it. A match starts at the start of a run or right after another match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser generators of the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z.+-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,5}(?![0-9])",
}
#: A character that every match has, to skip texts without one.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

BEFORE, AFTER = 32, 16
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Share of true ones above the threshold, among candidates set aside.
PRECISION = 0.98
#: Candidates set aside that a threshold is judged by at least.
LEAST_ASIDE = 20
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]

_WORDS = {
    "said_mail": "mail|contact|kontakt|correo|courriel",
    "said_phone": "phone|call|tel|mobile|fax|anruf|llam",
    "said_card": "card|visa|credit|karte|tarjeta|carte",
    "said_host": "ip|host|server|address|adresse",
}
FEATURES = [
    "kind_no", "length", "digits", "separators", "letters", "dots", "plus", "groups", "longest_group",
    "space_before", "word_after", *_WORDS,
]


def _found(kind: str, loose: bool) -> Column:
    """Matches of a pattern in ``text``: order, characters since the last one, match, context."""
    pattern = F.lit((LOOSE if loose else PATTERNS)[kind])
    parts = F.struct(
        F.split("text", (LOOSE if loose else PATTERNS)[kind], -1).alias("gaps"),
        F.regexp_extract_all("text", pattern, 0).alias("matches"),
    )

    def listed(both: Column) -> Column:
        return F.transform(
            both["matches"],
            lambda match, i: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(loose).alias("loose"),
                i.alias("i"),
                F.length(F.get(both["gaps"], i)).alias("gap"),
                match.alias("match"),
                F.lower(F.right(F.get(both["gaps"], i), F.lit(BEFORE))).alias("before"),
                F.left(F.get(both["gaps"], i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    # One element that holds both arrays, so that neither is worked out again per match.
    spans = F.get(F.transform(F.array(parts), listed), F.lit(0))
    if loose:
        needed = F.rlike("text", F.lit(r"[\[(]at[\])]")) if kind == "email" else F.rlike("text", F.lit("[0-9]{3}"))
    elif kind in NEEDS:
        needed = F.contains("text", F.lit(NEEDS[kind]))
    else:
        needed = F.rlike("text", F.lit("[0-9]"))
    return F.when(needed, spans)


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Written once: rid, ``row`` and the candidates of every document."""
    found = [_found(k, False) for k in KINDS] + [_found(k, True) for k in LOOSE]
    empty = F.filter(_found("card", False), lambda x: F.lit(False))
    kept = [F.coalesce(f, F.expr("array()").cast(_kind(docs, empty))) for f in found]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    chosen = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return durable(chosen.select(F.monotonically_increasing_id().alias("rid"), "row", F.concat(*kept).alias("found")))


def _kind(docs: DataFrame, column: Column) -> str:
    return docs.limit(0).select(F.lit("").alias("text")).select(column.alias("c")).schema["c"].dataType.simpleString()


def _passes() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.rlike("match", F.lit(_ADDRESS)))
        .when(F.col("kind") == "card", F.length(digits).between(13, 19) & F.call_function("luhn_check", digits))
        .otherwise(F.length(digits).between(9, 15))
    )


def _count(pattern: str) -> Column:
    return (F.length("match") - F.length(F.regexp_replace("match", pattern, ""))).cast("double")


def placed(found: DataFrame) -> DataFrame:
    """One row per candidate: rid, kind, start, end, base, passes and features."""
    rows = found.select("rid", F.explode("found").alias("c")).select("rid", "c.*")
    # Candidates of one document and generator, in order: few rows, whatever the text's length.
    order = Window.partitionBy("rid", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    groups = F.filter(F.split("match", "[^0-9]+"), lambda x: x != "")
    features = {
        "kind_no": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("double"),
        "length": F.length("match").cast("double"),
        "digits": _count("[0-9]"),
        "separators": _count("[ ()-]"),
        "letters": _count("[A-Za-z]"),
        "dots": _count(r"\."),
        "plus": F.startswith("match", F.lit("+")).cast("double"),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "space_before": F.rlike("before", F.lit(r"(^|\s)$")).cast("double"),
        "word_after": F.rlike("after", F.lit("^[A-Za-z0-9]")).cast("double"),
        **{name: F.rlike("before", F.lit(rf"\b(?:{words})")).cast("double") for name, words in _WORDS.items()},
    }
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - F.length("match"))
        .withColumn("passes", _passes() & ~F.col("loose"))
        .withColumn("judged", ~F.col("loose") & (F.col("kind") != "email"))
        .select("rid", "kind", "start", "end", "passes", "judged", *[v.alias(k) for k, v in features.items()])
    )


def probabilities(spans: DataFrame) -> tuple[DataFrame, dict[str, float]] | None:
    """``spans`` with the trees' probability, and the calibrated threshold of each kind.

    A kind without failed candidates set aside (e-mail addresses have no check) takes the
    threshold of all kinds together; a kind that no threshold makes precise gets none. The
    trees are fitted on all judged candidates of the corpus that are not set aside (three in
    four, by a hash), the thresholds on all that are.
    """
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    labelled = (
        spans.filter("judged OR passes")
        .withColumn("label", F.col("passes").cast("double"))
        .withColumn("mark", F.xxhash64("rid", "kind", "start"))
    )
    judged = durable(assembler.transform(labelled).select("kind", "features", "label", (F.pmod("mark", F.lit(4)) == 0).alias("aside")))
    seen = {(r["aside"], r["label"]) for r in judged.select("aside", "label").distinct().collect()}
    if len(seen) < 4:
        return None
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=11).fit(judged.filter("NOT aside"))
    p = vector_to_array(F.col("probability"))[1]
    held = trees.transform(judged.filter("aside")).select("kind", "label", p.alias("p"))
    rows = held.groupBy("kind").agg(
        F.min("label").alias("least"),
        *[F.sum(F.when(F.col("p") >= t, F.col("label")).otherwise(0)).alias(f"hit{i}") for i, t in enumerate(THRESHOLDS)],
        *[F.count(F.when(F.col("p") >= t, 1)).alias(f"all{i}") for i, t in enumerate(THRESHOLDS)],
    ).collect()

    def precise(chosen: list) -> float | None:
        for i, t in enumerate(THRESHOLDS):
            hit, reached = (sum(r[f"{name}{i}"] for r in chosen) for name in ("hit", "all"))
            if reached >= LEAST_ASIDE and hit >= PRECISION * reached:
                return t
        return None

    known = {r["kind"]: r for r in rows if r["least"] == 0}
    thresholds = {k: precise([known[k]] if k in known else rows) for k in KINDS}
    thresholds = {k: t for k, t in thresholds.items() if t is not None}
    if not thresholds:
        return None
    return trees.transform(assembler.transform(spans)).select("rid", "kind", "start", "end", "passes", p.alias("p")), thresholds


def selected(spans: DataFrame) -> DataFrame:
    """(rid, kind, start, end, base): passed spans, and added ones that overlap none of them."""
    base = spans.filter("passes").select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    scored = probabilities(spans)
    if scored is None:
        return base
    marked, thresholds = scored
    enough = F.lit(False)
    for kind, t in thresholds.items():
        enough |= (F.col("kind") == kind) & (F.col("p") >= t)
    likely = marked.filter(F.col("passes") | enough)
    by_start = Window.partitionBy("rid").orderBy("start", F.desc("passes"), F.desc("end"), "kind")
    earlier, later = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    kept = F.when(F.col("passes"), F.col("end"))
    free = (
        likely.withColumn("base_end", F.coalesce(F.max(kept).over(earlier), F.lit(0)))
        .withColumn("base_start", F.min(F.when(F.col("passes"), F.col("start"))).over(later))
        .filter(
            F.col("passes")
            | ((F.col("base_end") <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end"))))
        )
        # Of added spans that overlap each other the first, longest one stays.
        .withColumn("before_end", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .filter(F.col("passes") | (F.col("before_end") <= F.col("start")))
    )
    return free.select("rid", "kind", "start", "end", F.col("passes").alias("base"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def detected(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row``, counts per kind, digest of the fixed spans and all spans of every document."""
    found = candidates(docs, carry)
    spans = selected(durable(placed(found)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct(number.alias("no"), "start", "end", "kind", "base")
    per_doc = spans.groupBy("rid").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(entry)).alias("all"),
    )
    none = F.lit("")
    return found.select("rid", "row").join(per_doc, "rid", "left").select(
        "row",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(_joined(F.filter("all", lambda s: s["base"])), none).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), none).alias("spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detected(docs, ["doc_id"]).select("row.doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
