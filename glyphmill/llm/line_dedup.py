"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. What is exploded is (id, position, hash), about 30 bytes a line, never a line itself.
Texts are shuffled once, whole, to meet their own list of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, beside, column, cut, hot_join

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of docs with `kept` (its text without dropped lines), `n_lines` and `n_dropped`.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of min_chars
    code points or more, held by min_docs ids or more, lose all their lines but those of the smallest id.
    Null or empty text: one empty line. Rows that repeat an id count as one document and are cut alike.
    A null id takes no part: its rows are returned whole. An empty table gives an empty table; other columns
    pass through, whatever their names (result columns replace input columns of the same name).

    A frequent line costs one row per map task to count, and its lines stay where they are (see hot_join).
    """
    row = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))
    key = F.btrim(F.col("__line"), F.lit(BLANKS))
    lines = (
        row.where(F.col("__id").isNotNull())
        .select("__id", "__key", F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
        .where(F.length("__line") >= min_chars)
        .select("__id", "__key", "__pos", key.alias("__norm"))
        .where(F.length("__norm") >= min_chars)
        .select("__id", "__key", "__pos", ascii_lower(F.col("__norm")).alias("__norm"))
        .select("__id", "__key", "__pos", F.xxhash64("__norm").alias("__h"), F.hash("__norm").alias("__g"))
    )
    lines = cut(lines)  # read again below: the texts are split and hashed once
    own, first, n = ["__h", "__g"], F.min("__id").alias("__first"), F.count("*").alias("__n")
    if min_docs == 2:
        held = lines.groupBy(*own).agg(first, F.max("__id").alias("__last"), n).where(F.col("__first") < F.col("__last"))
    else:
        held = lines.groupBy(*own, "__id").agg(n).groupBy(*own).agg(first, F.count("*").alias("__docs"), F.sum("__n").alias("__n")).where(F.col("__docs") >= min_docs)
    repeated = cut(held.select(*own, "__first", "__n"))
    dropped = hot_join(lines, repeated, own, "__n", lines.count()).where(F.col("__id") != F.col("__first")).groupBy("__id", "__key").agg(F.collect_set("__pos").alias("__drop"))
    old = beside(docs.columns, "kept", "n_lines", "n_dropped")
    # the caller's columns travel as one, so their names meet none of those made here
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"))
    found = whole.join(dropped, ["__id", "__key"], "left")
    text = F.coalesce(F.col("__row")[text_col], F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1

    def reassembled(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # a one-element array binds the split lines: captured by the inner lambda they would be split again for each line
    kept = F.get(F.transform(F.array(_lines(text)), reassembled), F.lit(0))
    made = found.select(
        "__row",
        F.when(F.col("__drop").isNull(), text).otherwise(kept).alias("kept"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return made.select(*[F.col("__row")[c].alias(c) for c in old], "kept", "n_lines", "n_dropped")


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT d.doc_id, l.pos, l.line, lower_key.k FROM documents d,
  LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) l,
  LATERAL (SELECT translate(trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k) lower_key),
held AS (SELECT k, min(doc_id) AS first_id FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT l.*, (h.k IS NOT NULL AND l.doc_id <> h.first_id) AS dropped FROM lines l LEFT JOIN held h ON l.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
