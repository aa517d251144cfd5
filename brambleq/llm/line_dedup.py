"""Boilerplate lines: lines that stand on many distinct sites are removed.

Every line's trimmed text is hashed (two 64-bit lanes).  Per hash, a HyperLogLog
sketch of the sites is built map-side and merged by aggregation; the estimate
settles lines that are clearly below or above ``min_sites``, and only lines
within the sketch's error of the threshold get an exact distinct count.  Lines
found to be boilerplate go back to their documents by position.

Only DataFrame functions are used.  The text itself is shuffled once, with its
flagged positions; lines travel as hashes.  The occurrences of a line are dealt over
``SALTS`` tasks wherever they are joined, so that a line on every document is no hot
key; the few hashes that they are joined with are repeated instead.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; lines are compared without white space at their ends (so ``x`` and ``x``
with a carriage return are one line), and lines blank after that are never removed;
a null site counts as no site; rows that repeat an id are told apart by their text,
and equal rows get equal results; a text of which every line goes becomes empty; an
empty table gives an empty table; extra columns are kept, and one that has an output's
name is renamed to ``<name>_input`` (``clean`` has no outputs of its own).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleq.llm._common import aside, back, give_way, materialise, quoted, table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; relative error 1.04 / sqrt(2 ** LOG_K).
LOG_K = 11


#: Tasks over which the occurrences of one line are dealt.
SALTS = 16
_BLANKS = " \t\r\x0b\x0c"


def _key() -> list[Column]:
    """A row's identity for joins: the id and the text's hash and length."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__sum"), F.octet_length("text").alias("__len")]


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per non-blank line: document key, position, hash lanes, site."""
    rows = docs.select(*_key(), quoted(site).cast("string").alias("__site"), F.posexplode(F.split("text", "\n", -1)).alias("__pos", "__line"))
    rows = rows.withColumn("__line", F.btrim("__line", F.lit(_BLANKS))).where("__line != ''")
    return rows.select("__id", "__sum", "__len", "__pos", "__site", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit("line"), "__line").alias("__h2"))


def _meet(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """``lines`` whose hash is among ``hashes`` (each once, with further columns)."""
    dealt = lines.withColumn("__salt", F.pmod(F.xxhash64("__id", "__sum", "__pos"), F.lit(SALTS)).cast("int"))
    return dealt.join(hashes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__h1", "__h2", "__salt"]).drop("__salt")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", log_k: int = LOG_K) -> DataFrame:
    """The occurrences (document key, ``__pos``) of lines on ``min_sites`` distinct sites or more."""
    lines = _lines(docs, site)
    sketches = lines.where("__site is not null").groupBy("__h1", "__h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(log_k))).alias("__sites"))
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2**log_k) * min_sites))
    found = sketches.where(F.col("__sites") > min_sites - band).select("__h1", "__h2", (F.col("__sites") >= min_sites + band).alias("__sure"))
    met = materialise(_meet(lines, found))
    near = met.where("not __sure")
    # distinct sites are combined before they move, so a hot line costs an entry per task and site
    exact = near.groupBy("__h1", "__h2").agg(F.countDistinct("__site").alias("__n")).where(F.col("__n") >= min_sites).select("__h1", "__h2")
    columns = ["__id", "__sum", "__len", "__pos"]
    return met.where("__sure").select(*columns).unionAll(_meet(near, exact).select(*columns))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the ascending positions ``gone``: the slices between them."""
    after = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, after(i) + 1, end(i) - after(i))))


def _judged(docs: DataFrame, min_sites: int, site: str, log_k: int) -> DataFrame:
    """``docs`` (no column but those named here begins with two underscores) plus ``__n_lines``,
    ``__n_removed`` and ``__kept``."""
    flagged = boilerplate(docs, min_sites, site, log_k).groupBy("__id", "__sum", "__len").agg(F.array_sort(F.collect_set("__pos")).alias("__gone"))
    a, b = docs.select("*", *_key()), flagged.select(*[F.col(c).alias(f"{c}_b") for c in ("__id", "__sum", "__len")], "__gone")
    same = a["__id"].eqNullSafe(b["__id_b"]) & (a["__sum"] == b["__sum_b"]) & (a["__len"] == b["__len_b"])
    lines = F.split("text", "\n", -1)
    return a.join(b, same, "left").select(
        *docs.columns,
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("__n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("__n_removed"),
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col("__gone")), "\n")).alias("__kept"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", log_k: int = LOG_K) -> DataFrame:
    """``docs`` plus ``__n_lines``, ``__n_removed`` and ``__kept`` (the text without its boilerplate lines)."""
    outputs = ("__n_lines", "__n_removed", "__kept")
    docs = give_way(docs, *outputs)
    needed = ("doc_id", "text", site)
    out = _judged(aside(docs, *needed), min_sites, site, log_k)
    return out.toDF(*docs.columns, *outputs)


def clean(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, columns unchanged; ``n_chars`` follows where present."""
    needed = ("doc_id", "text", site, "n_chars")
    out = _judged(aside(docs, *needed), min_sites, site, LOG_K).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out, docs, *needed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), b AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
r AS (SELECT doc_id, list(i) AS gone FROM l JOIN b USING (t) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL WHEN gone IS NULL THEN sha256(text)
            ELSE sha256(array_to_string([string_split(text, chr(10))[p] FOR p IN range(1, len(string_split(text, chr(10))) + 1) IF NOT list_contains(gone, p)], chr(10))) END AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
