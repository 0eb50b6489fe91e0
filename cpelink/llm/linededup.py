"""Line de-duplication: explode, hash, count documents per key, drop, reassemble by position.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
A key of at least ``min_chars`` code points that at least ``min_docs`` documents
hold loses its lines everywhere but in the largest document id that holds it.

Only (id, position, 16-byte hash) rows are shuffled for the counts; distinct
(key, id) pairs and the counts combine map-side, so one line in a third of all
documents costs each task one row. The text meets only the list of positions to
drop, and is shuffled only if that list is too large for a measured broadcast.

Defined cases: a null or empty text is one empty line; a null id counts as a
document smaller than all others; rows that repeat an id are one document, each
keeping its own lines; an empty table gives an empty result; a text whose lines
all go becomes the empty text; a very long text becomes as many rows as it has lines,
and is whole in one row only where its lines are joined. Other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release_scratch, scratch_count
from .textcols import SPACES, ascii_lower, carried, let, row_key, text_of, upto

MIN_CHARS = 20
MIN_DOCS = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__id, __th, __drop): the line positions each row loses; rows without any are absent."""
    mark = scratch_count(docs.sparkSession)
    text = text_of(text_col)
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACES)))
    held = (docs.select(*row_key(id_col, text), F.posexplode(_lines(text)).alias("pos", "line"))
            .withColumn("key", key).where(F.char_length("key") >= min_chars)
            .select("__id", "__th", "pos", F.unhex(F.md5("key")).alias("key")))
    held = materialize(held, "line_keys")
    frequent = (held.select("key", "__id").distinct().groupBy("key")
                .agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("keeper"))
                .where(F.col("n") >= min_docs).select("key", "keeper"))
    # written, so that its size is known: broadcast if small, else a join whose large keys AQE can split
    frequent = materialize(frequent, "frequent_lines")
    drops = (held.join(frequent, "key").where(F.col("__id") != F.col("keeper"))
             .groupBy("__id", "__th").agg(F.array_sort(F.collect_set("pos")).alias("__drop")))
    out = materialize(drops, "line_drops")
    release_scratch(docs.sparkSession, since=mark, keep=1)
    return out


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, n_dropped): each row, ``text_col`` reduced to the kept lines, as a struct, the lines it had and lost."""
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    text = text_of(F.col("__row")[text_col])
    joined = carried(docs, id_col, text_col).join(drops, ["__id", "__th"], "left")
    kept = let(_lines(text), lambda lines: F.array_join(F.transform(
        F.array_except(upto(F.size(lines)), F.col("__drop")), lambda i: lines[i]), "\n"))
    new = F.when(F.col("__drop").isNull(), text).otherwise(kept)
    return joined.select(F.col("__row").withField(f"`{text_col}`", new).alias("row"), F.size(_lines(text)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, rn, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, (h.key IS NOT NULL AND k.doc_id <> h.keeper) AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""
