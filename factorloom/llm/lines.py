"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

A line goes when the same text, or a text within one edit (a character put in, left out or replaced), stands
earlier, by (document id, line number). Equal lines fall together by hash. For the others, two hashed keys per line
find those that share a half with another text, a key per segment of SEGMENT characters those that differ within one
segment only, and just there all variants with one character deleted are emitted as hashed keys: equal variants
join, the edit distance is verified and the earliest stays. Buckets are only ever aggregated, never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, small, table

SEGMENT = 32
#: Characters of a line, at least, of which one may be edited: a share of 5 %. Shorter lines would lose list marks and numbers.
PER_EDIT = 20
SOLID = r"[^\x20\x09-\x0D]"


def half(length: Column) -> Column:
    """At most half of the length, in steps of 8, so that neighbouring lengths mostly agree on it."""
    return F.floor(length / 16).cast("int") * 8


def _exploded(docs: DataFrame) -> DataFrame:
    """(id, t, pos, line, h): the lines of documents (id, t, text) that are not blank."""
    lines = docs.where("id IS NOT NULL").select("id", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(SOLID)).select("id", "t", "pos", "line", F.xxhash64("line").alias("h"))


def _half_keys(per_edit: int) -> Column:
    n = F.length("line")

    def both(m: Column) -> Column:
        return F.array(F.xxhash64(m, F.lit(0), F.substring("line", F.lit(1), m)), F.xxhash64(m, F.lit(1), F.substring("line", n - m + 1, m)))

    m, less = half(n), half(n - 1)
    return F.when(n >= per_edit, F.when(m == less, both(m)).otherwise(F.concat(both(m), both(less)))).otherwise(F.array().cast("array<bigint>"))


def _segments(texts: DataFrame) -> DataFrame:
    """One row per line, role and segment: 'e' for pairs in which no line is longer, or the other is, 'l' as the longer one.

    key tells the pair's shorter length, the segment and all text outside it.
    """
    n = F.length("line")
    longer = F.col("role") == "l"
    roles = texts.withColumn("role", F.explode(F.array(F.lit("e"), F.lit("l"))))
    roles = roles.withColumn("n", n - F.when(longer, 1).otherwise(0))
    at = roles.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SEGMENT))))
    width = F.least(F.lit(SEGMENT), F.col("n") - F.col("start")) + F.when(longer, 1).otherwise(0)
    at = at.withColumn("width", width)
    outside = [F.xxhash64(F.substring("line", F.lit(1), F.col("start"))), F.xxhash64(F.substring("line", F.col("start") + F.col("width") + 1, n))]
    return at.select(
        "h", "id", "pos", "role", F.xxhash64("n", "start", *outside).alias("key"), F.substring("line", F.col("start") + 1, F.col("width")).alias("part")
    )


def _variants(segments: DataFrame) -> DataFrame:
    """(h, id, pos, kind, v): v is the key of a variant; lines with one v and kind 's' differ in one character,
    'l' lines become the 'e' line of that v by one deletion."""
    size = F.length("part")
    without = lambda i: F.concat(F.substring("part", F.lit(1), i), F.substring("part", i + 2, size))
    places = F.sequence(F.lit(0), size - 1)
    own = F.array(F.struct(F.lit("e").alias("kind"), F.xxhash64("key", "part").alias("v")))
    replaced = F.transform(places, lambda i: F.struct(F.lit("s").alias("kind"), F.xxhash64("key", i, without(i)).alias("v")))
    deleted = F.array_distinct(F.transform(places, lambda i: F.struct(F.lit("l").alias("kind"), F.xxhash64("key", without(i)).alias("v"))))
    return segments.select("h", "id", "pos", F.explode(F.when(F.col("role") == "l", deleted).otherwise(F.concat(own, replaced))).alias("x")).select(
        "h", "id", "pos", "x.kind", "x.v"
    )


def _later(texts: DataFrame) -> DataFrame:
    """(h): the lines of which a text within one edit stands earlier. texts: (h, id, pos, line), one row per text."""
    segments = _segments(texts)
    shared = segments.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key")
    variants = checkpoint(_variants(segments.join(small(checkpoint(shared)), "key", "left_semi")))
    first = F.struct("id", "pos", "h")
    earliest = variants.groupBy("v").agg(*(F.min(F.when(F.col("kind") == k, first)).alias(k) for k in "sel"), F.count("*").alias("n")).where("n > 1")
    other = F.when(F.col("kind") == "s", F.col("s")).when(F.col("kind") == "e", F.col("l")).otherwise(F.col("e"))
    pairs = variants.join(earliest, "v").select("h", first.alias("own"), other.alias("other")).where("other < own")
    pairs = pairs.select("h", F.col("other.h").alias("g")).distinct()
    left, right = texts.select("h", F.col("line").alias("x")), texts.select(F.col("h").alias("g"), F.col("line").alias("y"))
    return pairs.join(left, "h").join(right, "g").where(F.levenshtein("x", "y", 1) == 1).select("h").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with text_col without its repeated lines, plus n_lines and n_dropped (columns by these names give way).

    Lines end at \\n. Blank lines always stay and are no copies of each other. The edit bound is
    one edit in a line of ``per_edit`` characters or more (any length with 1), none in shorter ones, and none at all with edits=0. A null text stays null with 0 lines. Documents with a
    null id keep all lines and are nobody's earlier copy. Rows that repeat an id count as one document: the same line at
    the same place of several of its texts is one line, which stays or goes in all of them; what one text loses, another
    one with other lines does not. A document whose lines all stand earlier keeps its row, with an empty text.
    """
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_col, text_col)])
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    lines = _exploded(texts)
    keys = _half_keys(per_edit) if edits else F.array().cast("array<bigint>")
    narrow = checkpoint(lines.select("id", "t", "pos", "h", F.hash("line").alias("g"), F.length("line").alias("n"), keys.alias("keys")))
    shared = narrow.select("h", F.explode("keys").alias("key")).groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    shared = small(checkpoint(shared.where("x <> y").select("key")))
    near = narrow.select("h", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("h").distinct()
    near = small(checkpoint(near))
    groups = narrow.groupBy("h", "g", "n").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("copies"))
    groups = groups.join(near.withColumn("near", F.lit(True)), "h", "left").where("copies > 1 OR near")
    groups = checkpoint(groups.select("h", "g", "n", "first.id", "first.pos", "copies", "near"))
    wanted = small(checkpoint(groups.where("near").select("h", "id", "pos")))
    candidates = checkpoint(lines.join(wanted, ["h", "id", "pos"], "left_semi").dropDuplicates(["h"]))
    later = _later(candidates).withColumn("later", F.lit(True))
    dropped = groups.join(later, "h", "left").where("copies > 1 OR later")
    dropped = small(checkpoint(dropped.select("h", "g", "n", F.col("id").alias("first_id"), F.col("pos").alias("first_pos"), "later")))
    gone = narrow.join(dropped, ["h", "g", "n"]).where("later OR id <> first_id OR pos <> first_pos")
    own_id, own_text, own_gone = fresh(docs, "__id", "__text", "__gone")
    gone = gone.groupBy(F.col("id").alias(own_id), F.col("t").alias(own_text)).agg(F.collect_set("pos").alias(own_gone))
    split = F.split(text_col, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), own_gone)
    text = F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get(split, i))))
    return (
        docs.join(gone, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_text)), "left")
        .withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long"), "n_dropped": F.coalesce(F.size(own_gone), F.lit(0)).cast("long"), text_col: text})
        .drop(own_id, own_text, own_gone)
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def oracle(documents: str = "documents") -> str:
    """The same by comparing all texts that share a half, as DuckDB SQL; ends in a CTE deduped (columns of documents, n_lines, n_dropped)."""
    return rf"""
WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) pos, unnest(string_split(text, chr(10))) line FROM {documents}),
texts AS (SELECT line, length(line) n, min((doc_id, pos)) f FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
halves AS (SELECT DISTINCT line, n, f, m, unnest([left(line, m) || 'p', right(line, m) || 's']) k
           FROM (SELECT *, unnest([n // 16 * 8, (n - 1) // 16 * 8]) m FROM texts WHERE n >= 20)),
pairs AS (SELECT DISTINCT a.line x, b.line y, a.f xf, b.f yf FROM halves a JOIN halves b ON a.m = b.m AND a.k = b.k AND b.n - a.n IN (0, 1) AND a.line <> b.line),
near AS (SELECT * FROM pairs WHERE CASE WHEN length(x) = length(y)
         THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) = 1
         ELSE len(list_filter(range(0, length(y)), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0 END),
later AS (SELECT y line FROM near WHERE xf < yf UNION SELECT x FROM near WHERE yf < xf),
gone AS (SELECT l.doc_id, l.pos FROM lines l JOIN texts t USING (line)
         WHERE (l.doc_id, l.pos) <> t.f OR l.line IN (SELECT line FROM later)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) txt FROM lines l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) k FROM gone GROUP BY doc_id),
deduped AS (SELECT d.* EXCLUDE (text), CASE WHEN d.text IS NOT NULL THEN coalesce(kept.txt, '') END AS text,
                   CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT n_lines, coalesce(lost.k, 0)::BIGINT n_dropped
            FROM {documents} d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id))
"""


ORACLE = oracle() + "SELECT doc_id, n_lines, n_dropped, text FROM deduped"
