"""Line dedup over overlapping three-line windows, in DataFrame functions only.

The lines of a text are its parts between line feeds. Lines without a word
(blank ones) are kept and skipped: windows run over three consecutive lines
with words. Windows are hashed and compared over the whole corpus. The first
occurrence of a window, by (id, text hash, position), stays; the lines that
later occurrences cover are removed, where overlapping occurrences merge to one
covered span. Texts are rebuilt from the lines that stay.

Only hashes and positions are shuffled for the search, pre-aggregated to one
first occurrence per window before the shuffle; the join back to the
occurrences is by hash, with nothing gathered per hash, so that a window which
a third of all documents share is split like any other skewed join key.

Edge cases: a null text stays null and an empty one empty; texts of fewer than
three lines with words are left alone; equal rows (same id and text) count as
one document and keep the same lines; a null id is an id of its own, after all
others; an empty table gives an empty result; all columns of the input stay,
but for those named like this operator's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import let, materialize, table

WINDOW_LINES = 3


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a row key that nulls and repeated ids don't break."""
    return docs.withColumn("_id", F.col("doc_id").cast("string")).withColumn("_hash", F.xxhash64("text", F.lit(11)))


def _windows(keyed: DataFrame, lines: int) -> DataFrame:
    """(row key, window number, two hashes of the window's lines, line number of its first line, of its last line)."""
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: _has_word(s["line"]))
    runs = let(worded, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - lines + 1, F.lit(0))), lambda s, i: F.slice(w, i + 1, F.lit(lines))))
    each = keyed.where("text is not null").select("doc_id", "_id", "_hash", F.posexplode(runs))
    text = [F.col("col")[k]["line"] for k in range(lines)]
    return each.select("doc_id", "_id", "_hash", F.col("pos"), F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit("second"), *reversed(text)).alias("h2"), F.transform("col", lambda s: s["at"]).alias("covers"))


def removed_lines(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """(_id, _hash, removed): the sorted numbers of the lines that go, for documents that lose any."""
    windows = materialize(_windows(_keyed(docs), lines), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_hash"), F.col("pos"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(place > F.col("first"))
    covered = later.select("_id", "_hash", F.explode("covers").alias("at"))
    return covered.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def spans(positions: Column) -> Column:
    """Sorted line numbers as merged spans [first, last]."""
    zero = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(
        positions,
        zero,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] == x - 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), x.alias("last")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.alias("first"), x.alias("last"))))),
    )


def dedup_lines(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """The documents with repeated windows cut from ``text``, and ``n_lines`` and ``removed`` (line numbers) beside."""
    keyed = _keyed(docs.drop("_id", "_hash", "removed", "n_lines"))
    gone = removed_lines(docs, lines).withColumnsRenamed({"_id": "_gid", "_hash": "_ghash"})
    joined = keyed.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_hash") == F.col("_ghash")), "left")
    parts = F.split("text", "\n")
    both = F.struct(parts.alias("p"), F.col("removed").alias("r"))
    left = let(both, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["p"]) - 1), s["r"]), lambda i: F.get(s["p"], i)), "\n"))
    none = F.array().cast("array<int>")
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size(parts)).otherwise(0).cast("long"))
        .withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left))
        .withColumn("removed", F.coalesce("removed", none))
        .drop("_id", "_hash", "_gid", "_ghash")
    )


def clean_documents(docs: DataFrame, lines: int = WINDOW_LINES, drop_emptied: bool = False) -> DataFrame:
    """The documents with all their columns and cleaned texts; ``n_chars`` follows the text where there is one.

    ``drop_emptied``: without documents that had lines cut and have no word left.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    out = dedup_lines(packed, lines)
    if drop_emptied:
        out = out.where((F.size("removed") == 0) | _has_word(F.col("text")))

    def column(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        own = F.col("rest")[c]
        return F.when(F.size("removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own

    return out.select(*[column(c).alias(c) for c in docs.columns])


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
t AS (SELECT a.doc_id, a.k, a.line AS x, b.line AS y, c.line AS z, a.ln AS p, b.ln AS q, c.ln AS r
      FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN w c ON a.doc_id = c.doc_id AND c.k = a.k + {WINDOW_LINES - 1}),
n AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) AS nth FROM t),
g AS (SELECT DISTINCT doc_id, unnest([p, q, r]) AS ln FROM n WHERE nth > 1),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.ln) AS n_removed,
        list(CAST(l.ln AS INTEGER) ORDER BY l.ln) FILTER (g.ln IS NOT NULL) AS removed,
        string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL) AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(removed, []::INTEGER[]) AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
