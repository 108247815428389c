"""Personal data by weak supervision, with DataFrame operations only.

Strict patterns give the base spans, wider ones further candidates. Five labelers (shape, check, gazetteer, context,
edge) vote on every candidate or abstain. Expectation-maximisation over the histogram of vote patterns estimates how
far each labeler can be trusted; its soft labels train a logistic span classifier over the histogram of features.
Both histograms have a fixed number of cells, whatever the corpus. Base spans always stay; the classifier adds
candidates that no base span overlaps.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans. Possessive forms, and a start where a run starts or the last match
#: ended, find the same matches as the plain patterns without trying a long run again and again. A card's pattern asks
#: for 13 digits at once: shorter runs are dropped anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:[\[(](?:\.|dot|DOT)[\])]|\x20\.\x20)\x20?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9./_-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_-])",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A text without a match of this has none of the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Gazetteers and context words of the labelers.
DOMAINS = "com org net edu gov info biz io co uk de fr es it eu us ca au ch nl".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRIES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
HINTS = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|address|host|server|from|login)\b",
    "card": r"\b(?:card|visa|mastercard|credit|debit|pay|pan)\b",
    "phone": r"\b(?:phone|tel|call|mobile|cell|fax|contact|whatsapp)\b",
}
COUNTER_HINTS = r"\b(?:order|invoice|isbn|issn|version|release|serial|sku|ref|part no)\b"
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:[^0-9]+(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ ./_-][0-9]{4}){3})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$",
}
CONTEXT = 40
RUN = 128
LABELERS = ("shape", "check", "gazetteer", "context", "edge")
FEATURES = ("shape", "check", "listed", "hint", "counter", "edge", "gaps", "long")
_SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"


def _text_sql(text: str) -> str:
    """text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str) -> Column:
    """All matches of pattern in the column text, as an array of spans in code points with their contexts.

    The matches and the text between them tell all places. Places are summed up by runs of RUN matches, so that the
    work grows with their number and not with its square.
    """
    p = _text_sql(pattern)
    return F.expr(f"""
        transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))), z ->
        transform(array(aggregate(sequence(1, CAST(ceil(size(z.m) / {RUN}D) AS INT)), array(0), (acc, c) -> array_append(acc, element_at(acc, -1)
            + aggregate(slice(z.m, (c - 1) * {RUN} + 1, {RUN}), 0, (n, x) -> n + length(x)) + aggregate(slice(z.g, (c - 1) * {RUN} + 1, {RUN}), 0, (n, x) -> n + length(x))))), starts ->
        flatten(transform(sequence(1, CAST(ceil(size(z.m) / {RUN}D) AS INT)), c ->
            aggregate(sequence((c - 1) * {RUN} + 1, least(c * {RUN}, size(z.m))), named_struct('at', element_at(starts, c), 'out', CAST(array() AS array<{_SPAN}>)), (acc, i) -> named_struct(
                'at', acc.at + length(element_at(z.g, i)) + length(element_at(z.m, i)),
                'out', array_append(acc.out, named_struct(
                    'start', acc.at + length(element_at(z.g, i)), 'end', acc.at + length(element_at(z.g, i)) + length(element_at(z.m, i)),
                    'value', element_at(z.m, i), 'left', right(element_at(z.g, i), {CONTEXT}), 'right', left(element_at(z.g, i + 1), {CONTEXT})))
            ), acc -> acc.out))))[0])[0]""")


def _none() -> Column:
    return F.expr(f"CAST(array() AS array<{_SPAN}>)")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.split(F.reverse(number), "")
    worth = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(back, lambda c, i: worth(F.coalesce(c.try_cast("int"), F.lit(0)), i)), F.lit(0), lambda a, b: a + b) % 10 == 0


def octets_fit(value: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(value, r"[^0-9]+", "."), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def holds(kind: str, value: Column) -> Column:
    """The rule beyond the pattern that a base span has to keep."""
    if kind == "ip":
        return octets_fit(value)
    n = F.length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _kept(kind: str):
    return lambda s: holds(kind, s["value"])


def _cell(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), code(observed(kind, s)).alias("code"))


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _likely(kind: str, weights: list[float]):
    """Whether the classifier takes a span for personal data."""

    def decide(s: Column) -> Column:
        seen = observed(kind, s)
        return sum((F.when(seen[f], w).otherwise(-w) for f, w in zip(FEATURES, weights[1:])), F.lit(weights[0])) >= 0

    return decide


def candidates(docs: DataFrame) -> DataFrame:
    """docs (with a column __text) plus base_<kind> and wide_<kind>, arrays of spans."""
    for kind in KINDS:
        guard = F.contains("__text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("__text").rlike(BASE[kind])
        docs = docs.withColumn(f"raw_{kind}", F.when(guard & F.col("__text").rlike(BASE[kind]), found("__text", BASE[kind])).otherwise(_none()))
    docs = docs.withColumns({f"base_{k}": F.filter(f"raw_{k}", _kept(k)) for k in KINDS}).drop(*[f"raw_{k}" for k in KINDS])
    every = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    for kind, pattern in WIDE.items():
        free = lambda s: ~F.exists("__every", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        wide = F.when(F.col("__text").rlike(pattern), found("__text", pattern)).otherwise(_none())
        docs = docs.withColumn("__every", every).withColumn(f"wide_{kind}", wide).withColumn(f"wide_{kind}", F.filter(F.filter(f"wide_{kind}", _kept(kind)), free))
    return docs.drop("__every")


def observed(kind: str, span: Column) -> dict[str, Column]:
    """What labelers and classifier see of a span, as booleans."""
    value, number = span["value"], digits(span["value"])
    near = F.lower(F.concat(span["left"], F.lit(" "), span["right"]))
    listed = {
        "email": F.element_at(F.split(F.lower(value), r"\."), -1).isin(DOMAINS),
        "ip": ~F.split(value, r"[^0-9]")[0].isin("0", "10", "127", "255"),
        "card": number.rlike(ISSUERS),
        "phone": F.concat(F.lit("+"), number).rlike(COUNTRIES),
    }[kind]
    check = {"email": ~value.rlike(r"\.\.|@-|-\.|^\."), "ip": octets_fit(value), "card": luhn(number), "phone": F.length(number).between(9, 15)}[kind]
    return {
        "shape": value.rlike(SHAPES[kind]),
        "check": check,
        "listed": listed,
        "hint": near.rlike(HINTS[kind]),
        "counter": near.rlike(COUNTER_HINTS),
        "edge": ~(span["left"].rlike(r"[A-Za-z0-9]$") | span["right"].rlike(r"^[A-Za-z0-9]")),
        "gaps": value.rlike(r"[ ().-]"),
        "long": F.length(value) > 20,
    }


def code(seen: dict[str, Column]) -> Column:
    """The observations as bits of one number."""
    bits = [F.when(seen[f], 1 << i).otherwise(0) for i, f in enumerate(FEATURES)]
    return sum(bits[1:], bits[0])


def bit(number: int, feature: str) -> bool:
    return bool(number >> FEATURES.index(feature) & 1)


def votes(number: int) -> tuple[int | None, ...]:
    """The labelers' votes on a span: 1, 0, or None for an abstention."""
    context = 1 if bit(number, "hint") else 0 if bit(number, "counter") else None
    return (int(bit(number, "shape")), int(bit(number, "check")), 1 if bit(number, "listed") else None, context, 1 if bit(number, "edge") else 0)


def reliabilities(cells: Iterable[tuple[int, float]], rounds: int = 50) -> dict[int, float]:
    """Posterior of each cell (code, count) by expectation-maximisation over independent labelers, from a majority vote."""
    cells = [(number, votes(number), n) for number, n in cells]
    belief = {}
    for number, vote, _ in cells:
        cast = [v for v in vote if v is not None]
        belief[number] = min(0.95, max(0.05, sum(cast) / len(cast)))
    for _ in range(rounds):
        mass = [1.0, 1.0]
        told: dict[tuple[int, int], list[float]] = defaultdict(lambda: [1.0, 2.0])
        for number, vote, n in cells:
            for y, p in ((1, belief[number]), (0, 1 - belief[number])):
                mass[y] += n * p
                for j, v in enumerate(vote):
                    if v is not None:
                        told[j, y][0] += n * p * v
                        told[j, y][1] += n * p
        for number, vote, _ in cells:
            odds = math.log(mass[1] / mass[0])
            for j, v in enumerate(vote):
                if v is not None:
                    yes, no = (told[j, y][0] / told[j, y][1] for y in (1, 0))
                    odds += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
            belief[number] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def classifier(cells: Iterable[tuple[int, float]], belief: dict[int, float], rounds: int = 300) -> list[float]:
    """Weights (bias first) of a logistic model of the soft labels over the features, fitted by gradient descent."""
    rows = [([1.0, *(1.0 if bit(number, f) else -1.0 for f in FEATURES)], belief[number], n) for number, n in cells]
    weights, total = [0.0] * (1 + len(FEATURES)), sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = [0.002 * w for w in weights]
        for x, p, n in rows:
            error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x)))) - p
            slope = [s + n / total * error * v for s, v in zip(slope, x)]
        weights = [w - 0.5 * s for w, s in zip(weights, slope)]
    return weights


def span_classifiers(spotted: DataFrame) -> dict[str, list[float]]:
    """Weights per kind, from all candidates of all documents."""
    cells = []
    for kind in KINDS:
        spans = F.concat(f"base_{kind}", f"wide_{kind}") if kind in WIDE else F.col(f"base_{kind}")
        cells.append(F.transform(spans, _cell(kind)))
    rows = spotted.select(F.explode(F.concat(*cells)).alias("c")).groupBy("c.kind", "c.code").agg(F.count("*").alias("n"))
    by_kind: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["kind"], r["code"])):  # 256 codes a kind at most
        by_kind[r["kind"]].append((r["code"], float(r["n"])))
    return {kind: classifier(cell, reliabilities(cell)) for kind, cell in by_kind.items()}


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are those of the base spans; spans lists all spans as kind:start:end, by kind, then
    start, in code points, joined by commas. With ``whole`` also found, an array of (kind, start, end, value). Leftmost
    matches of a kind don't overlap; kinds may. A null or empty text has none. Rows may repeat; other columns are not
    read; empty tables give no rows.
    """
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    spotted = candidates(read)
    narrow = checkpoint(spotted.drop("__text"))
    weights = span_classifiers(narrow)
    arrays, base = [], []
    for kind in KINDS:
        spans = F.col(f"base_{kind}")
        if kind in WIDE and kind in weights:
            spans = F.array_sort(F.concat(spans, F.filter(f"wide_{kind}", _likely(kind, weights[kind]))))
        base.append(F.transform(f"base_{kind}", _named(kind)))
        arrays.append(F.transform(spans, _named(kind)))

    def written(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = narrow.select(
        F.col("id").alias(id_col),
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.concat(*base)), 256).alias("base_sha256"),
        F.concat(*arrays).alias("found"),
    )
    out = out.withColumn("spans", written(F.col("found")))
    return out if whole else out.drop("found")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
