"""Line de-duplication: lines that many documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, pick, tidy

#: What is stripped at the ends of a line, and the letters that are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that a line's key has at least, and documents that hold it at least, for the line to be dropped.
LEAST_LENGTH, LEAST_DOCS = 20, 3

ADDED = ("n_lines", "n_dropped", "kept")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, own (a hash of the text), pos, h1, h2: each line that is long enough, by its place and 128 bits of hash of its key."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("own"), F.posexplode(_lines(F.translate("text", UPPER, LOWER))).alias("pos", "line"))
    keys = rows.select("doc_id", "own", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).filter(F.length("key") >= least_length)
    return keys.select("doc_id", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def common_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, top (the largest doc_id that holds it) of every key that least_docs distinct doc_ids hold.

    The distinct count is two steps of partial sums, first by key and doc_id, so one line in a third of all documents
    is spread by doc_id before it meets itself as one row a task.
    """
    found = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("top"))
    return found.filter(F.col("n") >= least_docs).select("h1", "h2", "top")


def drop_common_lines(docs: DataFrame, scratch: Scratch, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All columns, and n_lines, n_dropped (long) and kept, the text without its dropped lines.

    A text is split at line feeds; a null or empty text is one empty line. A line's key is the line without white space at its ends and in lower
    case (A to Z only). Lines whose key has least_length code points and is in least_docs distinct doc_ids go,
    but from the largest of these doc_ids; all other lines stay in order, joined by line feeds. Rows that share a doc_id
    are one document in the counts, and each loses its own lines. A null doc_id counts as no document and keeps no common line. An empty table gives an
    empty one. A column of the input called as one of the new ones is kept as name__in2.

    Only hashes and places are shuffled by key; what goes is gathered by row (doc_id and a hash of the text; at most
    a text's own lines), and the texts are shuffled once, to meet it. The common keys are written to the shared folder first: lines
    then meet them in a join of two plain tables, which adaptive execution broadcasts if they are few, and splits where one line is in very many documents.
    """
    rows = tidy(docs, ["doc_id", "text"], ADDED)
    lines = keyed_lines(rows.select("doc_id", "text"), least_length)
    doomed = lines.join(scratch.save(common_lines(lines, least_docs)), ["h1", "h2"]).filter("doc_id IS NULL OR doc_id < top")
    gone = doomed.groupBy(F.col("doc_id").alias("gone_id"), F.col("own").alias("gone_own")).agg(F.collect_set("pos").alias("gone"))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_own")), "left")
    split = met.withColumn("split", _lines(F.col("text"))).withColumn("n_lines", F.size("split").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.col("split")[p]), "\n"))
    dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return split.select(*rows.columns, "n_lines", dropped.alias("n_dropped"), kept.alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's count of lines, of dropped ones, and a hash of what stays; edge cases as in drop_common_lines."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return drop_common_lines(docs, Scratch(spark, "lines")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key
  FROM line
),
common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT k.*, c.key IS NULL OR k.doc_id = c.top AS stays FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
