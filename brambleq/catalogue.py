"""The engine's operators on the driver's tables, each beside the same result as DuckDB SQL.

The tables hold no programs, so here a table stands in for the relation that an
operator works on: orders for references, customers for declarations, parts for
a class hierarchy, events for observed types.  ``generated.py`` in ``plans`` has
queries over programs written from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambleq.functions import text as tx
from brambleq.functions import values as vl
from brambleq.operators import changes, findings, hierarchy, reports, scan, signatures, symbols

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _files(t) -> DataFrame:
    d = t("documents")
    return d.select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".php")).alias("path"), F.col("text").alias("source"))


_FILES = "(SELECT 'src/' || source || '/' || doc_id || '.php' AS path, text AS source FROM documents)"


@query(f"SELECT path, len(string_split(source, chr(10)))::BIGINT AS n_lines, list_max([strlen(x) FOR x IN string_split(source, chr(10))])::BIGINT AS longest FROM {_FILES}")
def line_index(t):
    return scan.line_index(_files(t))


@query(f"""SELECT path, i::INT AS line, (strlen(substring(x, 1, instr(x, 'ther') - 1)) + 1)::INT AS "column", 'word.ther' AS identifier, 'A word in text.' AS message
FROM (SELECT path, unnest(string_split(source, chr(10))) AS x, generate_subscripts(string_split(source, chr(10)), 1) AS i FROM {_FILES}) WHERE contains(x, 'ther')""")
def scan_findings(t):
    return scan.pattern_findings(_files(t), "ther", "word.ther", "A word in text.")


@query("SELECT doc_id AS path, max(a) AS analyze FROM (SELECT doc_id, false AS a FROM documents UNION ALL SELECT doc_id, quality = 1 FROM labels) GROUP BY 1")
def analyze_flag_merge(t):
    return scan.merge_inputs(t("documents").select(F.col("doc_id").alias("path"), F.lit(False).alias("analyze")), t("labels").select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("analyze")))


_GLOBS = ["**/1*", "https://*/a*/**", "*/page?"]
_GLOB_SQL = "|".join(tx.glob_regex(g) for g in _GLOBS).replace("'", "''")


@query(f"SELECT url AS path FROM pages WHERE NOT regexp_matches(url, '{_GLOB_SQL}')")
def glob_exclude(t):
    return scan.exclude(t("pages").select(F.col("url").alias("path")), _GLOBS)


@query("SELECT DISTINCT translate(ltrim('\\' || p_brand || '\\' || split_part(p_type, ' ', 1), '\\'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM part")
def case_fold_key(t):
    return t("part").select(tx.canonical(F.concat_ws("\\", F.lit(""), "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("key")).distinct()


@query("SELECT key, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM (SELECT source || ':' || lang AS key, doc_id, lang FROM documents) GROUP BY key")
def first_wins_index(t):
    return symbols.first_wins(t("documents").select(F.concat_ws(":", "source", "lang").alias("key"), "doc_id", "lang"), "key", ["doc_id"])


@query("SELECT source || ':' || lang AS key, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def redeclaration_sources(t):
    return symbols.redeclared(t("documents").select(F.concat_ws(":", "source", "lang").alias("key"), "doc_id"), "key", "doc_id", "doc_id")


@query("""WITH d AS (SELECT * FROM (SELECT 'class' AS kind, (p_partkey % 300)::VARCHAR AS key, CASE p_partkey % 7 WHEN 0 THEN 'stub' WHEN 1 THEN 'builtin' WHEN 2 THEN 'scan' ELSE 'project' END AS origin, p_partkey AS ord FROM part)),
k AS (SELECT * FROM d WHERE origin <> 'scan' OR key NOT IN (SELECT key FROM d WHERE origin = 'builtin'))
SELECT kind, key, origin, ord FROM k QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY CASE origin WHEN 'stub' THEN 0 WHEN 'builtin' THEN 2 ELSE 1 END, CASE origin WHEN 'stub' THEN -ord ELSE ord END) = 1""")
def index_precedence(t):
    o = F.col("p_partkey") % 7
    return symbols.index(t("part").select(F.lit("class").alias("kind"), (F.col("p_partkey") % 300).cast("string").alias("key"), F.when(o == 0, "stub").when(o == 1, "builtin").when(o == 2, "scan").otherwise("project").alias("origin"), F.col("p_partkey").alias("ord")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def unresolved_refs(t):
    return symbols.unresolved(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey AS k FROM part WHERE p_size > 25 UNION SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal > 3000) s WHERE k = l_partkey OR k = l_suppkey + 1000000)""")
def fallback_refs(t):
    known = t("part").where("p_size > 25").select(F.col("p_partkey").alias("key")).union(t("supplier").where("s_acctbal > 3000").select(F.col("s_suppkey") + 1000000))
    refs = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") + 1000000).alias("fallback"))
    return symbols.unresolved_with_fallback(refs, known, "l_partkey", "fallback").drop("fallback")


def _edges(t) -> DataFrame:
    p = t("part")
    first = p.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"), F.lit(1).alias("ord"))
    return first.union(p.where("p_partkey > 30 AND p_size = 7").select("p_partkey", F.expr("p_partkey div 3"), F.lit(2)))


_EDGES = "(SELECT p_partkey AS child, p_partkey // 2 AS parent, 1 AS ord FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, 2 FROM part WHERE p_partkey > 30 AND p_size = 7)"
_CLOSURE = f"""RECURSIVE e AS {_EDGES}, every AS (
  SELECT child AS node, child AS ancestor, '' AS path, 0 AS depth FROM (SELECT child FROM e UNION SELECT parent FROM e)
  UNION ALL SELECT every.node, e.parent, every.path || lpad(e.ord::VARCHAR, 4, '0') || '/', every.depth + 1 FROM every JOIN e ON every.ancestor = e.child),
c AS (SELECT node, ancestor, min(path) AS path, arg_min(depth, path) AS depth FROM every GROUP BY node, ancestor)"""


def _closure(t) -> DataFrame:
    return hierarchy.ancestors(_edges(t))


@query(f"WITH {_CLOSURE} SELECT node, ancestor, path, depth::INT AS depth FROM c")
def ancestor_closure(t):
    return _closure(t).select("node", "ancestor", "path", "depth")


@query(f"""WITH {_CLOSURE}, m AS (SELECT p_partkey AS owner, p_brand AS member FROM part WHERE p_size % 3 = 0)
SELECT node, member, arg_min(owner, path) AS owner FROM c JOIN m ON ancestor = owner GROUP BY 1, 2""")
def first_match_member(t):
    return hierarchy.first_member(_closure(t), t("part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("owner"), F.col("p_brand").alias("member")))


@query(f"WITH {_CLOSURE} SELECT node, bool_and(ancestor IN (SELECT p_partkey FROM part WHERE p_partkey < 50 OR p_size > 10)) AS known FROM c GROUP BY 1")
def fully_known(t):
    return hierarchy.fully_known(_closure(t), t("part").where("p_partkey < 50 OR p_size > 10").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_CLOSURE} SELECT ancestor AS node, bool_and(p_size > 5) AS closed FROM c JOIN part ON node = p_partkey WHERE depth > 0 GROUP BY 1")
def closed_descendants(t):
    return hierarchy.descendants(_closure(t), t("part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 5).alias("flag")))


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_rule(t):
    return findings.duplicate_keys(t("conversations"), ["conv_id", "role"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal < 500 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unused_private(t):
    return findings.unused(t("customer").where("c_acctbal < 500").select("c_custkey", "c_mktsegment"), t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH f AS (SELECT l_partkey, l_linenumber, l_returnflag, min({'o': l_orderkey, 's': l_suppkey}) AS first_at FROM lineitem GROUP BY 1, 2, 3)
SELECT l_partkey, l_linenumber, string_agg(l_returnflag, '|' ORDER BY first_at, l_returnflag) AS types FROM f GROUP BY 1, 2""")
def call_site_evidence(t):
    return findings.evidence(t("lineitem"), "l_partkey", "l_linenumber", "l_returnflag", ["l_orderkey", "l_suppkey"])


@query("""SELECT user_id, a AS event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['click', 'view', 'purchase', 'signup', 'logout']) AS a)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = events.user_id AND e.event_type = a)""".replace("(SELECT DISTINCT user_id FROM events)", "(SELECT DISTINCT user_id FROM events) AS events"))
def missing_arm(t):
    return findings.missing_arms(t("events").select("user_id", "event_type"), "user_id", "event_type", ["click", "view", "purchase", "signup", "logout"])


def _text(c):
    """Integers that may be absent, as text."""
    return F.coalesce(c.cast("string"), F.lit("none"))


_ARMS = "[CASE WHEN user_id % 5 = 0 THEN '?string' ELSE 'int' END, CASE WHEN value > 50 THEN 'int(' || event_id % 9 || ')' ELSE 'float' END, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'null' WHEN 2 THEN 'bool' ELSE 'string' END]"
_BASE = "CASE WHEN x IN ('true', 'false') THEN 'bool' WHEN contains(x, '(') THEN split_part(x, '(', 1) END"


@query(f"""WITH a AS (SELECT event_id, unnest(arms) AS x, generate_subscripts(arms, 1) * 2 AS i FROM (SELECT event_id, {_ARMS} AS arms FROM events)),
f AS (SELECT event_id, CASE WHEN starts_with(x, '?') THEN substring(x, 2) ELSE x END AS x, i FROM a UNION ALL SELECT event_id, 'null', i + 1 FROM a WHERE starts_with(x, '?')),
d AS (SELECT event_id, x, min(i) AS i FROM f GROUP BY 1, 2)
SELECT event_id, string_agg(x, '|' ORDER BY i) AS type FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.event_id = d.event_id AND b.x = (CASE WHEN d.x IN ('true', 'false') THEN 'bool' WHEN contains(d.x, '(') THEN split_part(d.x, '(', 1) END)) GROUP BY 1""")
def union_normalise(t):
    e = t("events")
    m = F.col("event_id") % 4
    arms = F.array(F.when(F.col("user_id") % 5 == 0, "?string").otherwise("int"), F.when(F.col("value") > 50, F.concat(F.lit("int("), (F.col("event_id") % 9).cast("string"), F.lit(")"))).otherwise("float"), F.when(m == 0, "true").when(m == 1, "null").when(m == 2, "bool").otherwise("string"))
    return e.select("event_id", vl.union_types(arms).alias("type"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN b <> 0 AND a % nullif(b, 0) = 0 THEN a // nullif(b, 0) END::VARCHAR, 'none') AS int_value, CASE WHEN b <> 0 AND a % nullif(b, 0) <> 0 THEN a::DOUBLE / b END AS float_value, coalesce((a % nullif(b, 0))::VARCHAR, 'none') AS rest, a * b + 1 AS product
FROM (SELECT l_orderkey, l_linenumber, l_partkey - 500 AS a, l_suppkey % 7 - 3 AS b FROM lineitem)""")
def fold_arith(t):
    a, b = F.col("l_partkey") - 500, F.col("l_suppkey") % 7 - 3
    d = vl.fold_divide(a, b)
    return t("lineitem").select("l_orderkey", "l_linenumber", _text(d["int_value"]).alias("int_value"), d["float_value"].alias("float_value"), _text(vl.fold_int("%", a, b)).alias("rest"), vl.fold_int("+", vl.fold_int("*", a, b), F.lit(1).cast("bigint")).alias("product"))


@query("SELECT conv_id, turn, text NOT IN ('', '0') AS truthy, (turn % 2)::VARCHAR <> '0' AS odd FROM conversations")
def php_truthy(t):
    return t("conversations").select("conv_id", "turn", vl.truthy_string(F.col("text")).alias("truthy"), vl.truthy_string((F.col("turn") % 2).cast("string")).alias("odd"))


@query("SELECT p_partkey, greatest(lo, 11) AS low, coalesce(hi::VARCHAR, 'none') AS high FROM (SELECT p_partkey, p_size::BIGINT AS lo, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::BIGINT + 5 END AS hi FROM part) WHERE hi IS NULL OR greatest(lo, 11) <= hi")
def range_narrow(t):
    lo = F.col("p_size").cast("bigint")
    hi = F.when(F.col("p_partkey") % 3 == 0, None).otherwise(lo + 5)
    return t("part").select("p_partkey", vl.narrow_range(lo, hi, ">", F.lit(10).cast("bigint")).alias("r")).where("r is not null").select("p_partkey", "r.low", _text(F.col("r.high")).alias("high"))


_LINES = f"(SELECT path, unnest(string_split(source, chr(10))) AS x, generate_subscripts(string_split(source, chr(10)), 1)::INT AS line FROM {_FILES})"


@query(f"""WITH l AS {_LINES} SELECT path, line, 'line.long' AS identifier FROM l WHERE length(x) > 120
AND NOT EXISTS (SELECT 1 FROM l m WHERE m.path = l.path AND m.line = l.line - 1 AND length(m.x) % 5 = 0)""")
def inline_ignore(t):
    ls = scan.explode_lines(_files(t))
    found = ls.where(F.length("text") > 120).select("path", "line", F.lit("line.long").alias("identifier"))
    marks = ls.where(F.length("text") % 5 == 0).select("path", (F.col("line") + 1).alias("line"), F.lit(None).cast("array<string>").alias("identifiers"))
    return findings.unmarked(found, marks)


@query("SELECT source AS path, '^Language ' || lang || '\\.$' AS message, 'doc.lang' AS identifier, count(*) AS count FROM documents GROUP BY 1, 2")
def baseline_build(t):
    return findings.build_baseline(t("documents").select(F.col("source").alias("path"), F.concat(F.lit("Language "), "lang", F.lit(".")).alias("message"), F.lit("doc.lang").alias("identifier")))


_ENTRIES = "(SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 5 END AS count FROM customer WHERE c_custkey % 2 = 0)"


def _entries(t) -> DataFrame:
    return t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_custkey") % 5).alias("count"))


@query(f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) LEFT JOIN (SELECT *, true AS e FROM {_ENTRIES}) USING (o_custkey) WHERE e IS NULL OR rn > count""")
def baseline_apply(t):
    return findings.apply_counts(t("orders").select("o_orderkey", "o_custkey"), _entries(t), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"SELECT o_custkey, count, coalesce(n, 0) AS matched FROM {_ENTRIES} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) WHERE coalesce(n, 0) < coalesce(count, 1)")
def unmatched_ignores(t):
    return findings.unmatched(_entries(t), t("orders"), ["o_custkey"])


def _doc_findings(t) -> DataFrame:
    return t("documents").select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("line"), F.lit(1).alias("column"), F.lit("doc.lang").alias("identifier"), F.concat(F.lit("Language "), "lang", F.lit(".")).alias("message"), F.when(F.col("doc_id") % 3 == 0, "warning").otherwise("error").alias("severity"))


@query("""SELECT source AS path, count(*) AS errors, '[' || string_agg('{"message":"Language ' || lang || '.","line":' || doc_id || ',"ignorable":true,"identifier":"doc.lang"}', ',' ORDER BY doc_id) || ']' AS messages FROM documents GROUP BY 1""")
def report_json(t):
    return reports.json_blocks(_doc_findings(t))


@query("SELECT 'Language ' || lang || '.' AS description, 'doc.lang' AS identifier, sha256(source || doc_id || 'Language ' || lang || '.') AS fingerprint, CASE WHEN doc_id % 3 = 0 THEN 'minor' ELSE 'major' END AS severity, source AS path, doc_id::INT AS line FROM documents")
def report_gitlab(t):
    return reports.gitlab(_doc_findings(t))


@query("SELECT source || ':' || doc_id || ':Language ' || lang || '.' AS value FROM documents")
def report_raw(t):
    return reports.raw(_doc_findings(t))


@query("SELECT '::' || CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'error' END || ' file=' || source || ',line=' || doc_id || ',col=1::Language ' || lang || '.' AS value FROM documents")
def report_github(t):
    return reports.github(_doc_findings(t))


@query("""SELECT source AS path, '<file name="' || source || '">' || string_agg('<error line="' || doc_id || '" column="1" severity="' || CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'error' END || '" message="Language ' || lang || '." source="doc.lang"/>', '' ORDER BY doc_id) || '</file>' AS value FROM documents GROUP BY 1""")
def report_checkstyle(t):
    return reports.checkstyle(_doc_findings(t))


@query("""SELECT '<testcase name="' || source || ':' || doc_id || '"><failure type="' || CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'error' END || '" message="Language ' || lang || '."/></testcase>' AS value FROM documents""")
def report_junit(t):
    return reports.junit(_doc_findings(t))


@query("SELECT count(*) FILTER (source = '(ignore)') AS errors, count(*) FILTER (source <> '(ignore)' AND doc_id % 3 <> 0) AS file_errors FROM documents")
def report_totals(t):
    return reports.totals(_doc_findings(t))


@query("""SELECT doc_id AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT doc_id, md5(text) AS a FROM documents WHERE doc_id % 10 <> 1) FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 100 = 5 THEN upper(text) || '!' ELSE text END) AS b FROM documents WHERE doc_id % 10 <> 2) USING (doc_id) WHERE a IS DISTINCT FROM b""")
def snapshot_diff(t):
    d = t("documents").select(F.col("doc_id").alias("path"), "text")
    new = F.when(F.col("path") % 100 == 5, F.concat(F.upper("text"), F.lit("!"))).otherwise(F.col("text"))
    return changes.snapshot_diff(d.where("path % 10 <> 1").select("path", F.md5("text").alias("hash")), d.where("path % 10 <> 2").select("path", F.md5(new).alias("hash")))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def invalidate(t):
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return changes.invalidated(li, (li, "l_partkey", t("part").where("p_size = 1"), "p_partkey"), (li, "l_suppkey", t("supplier").where("s_acctbal < 0"), "s_suppkey"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, g""")
def debounce(t):
    return changes.debounced(t("events").select("user_id", "ts"), "user_id", "ts", "5 minutes")


@query("""SELECT l_orderkey, l_linenumber, "start", "end" FROM (
  SELECT *, max("end") OVER w AS e, max("start") OVER w AS s FROM (SELECT l_orderkey, l_linenumber, l_partkey % 200 AS "start", l_partkey % 200 + l_quantity::BIGINT AS "end" FROM lineitem)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY "start", l_linenumber, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE e > "start" OR s = "start" """)
def overlapping_edits(t):
    e = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("bigint")).alias("end"))
    return changes.overlapping(e, ["l_orderkey"], ["l_linenumber"])


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS node, p_brand AS type, 0 AS r FROM part WHERE p_size < 3
  UNION SELECT p_partkey, type, r + 1 FROM k JOIN part ON p_partkey // 2 = node WHERE r < 3 AND p_partkey > 1)
SELECT node, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM k GROUP BY 1""")
def fixpoint_signatures(t):
    p = t("part")
    return signatures.propagate(p.where("p_size < 3").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("type")), p.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern findings over a tree of files, inline suppression and a report."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return reports.json_blocks(inline_findings(t))


def inline_findings(t) -> DataFrame:
    files = _files(t)
    found = scan.pattern_findings(files, "the", "word.the", "A common word.")
    marks = scan.explode_lines(files).where(F.length("text") % 5 == 0).select("path", (F.col("line") + 1).alias("line"), F.lit(None).cast("array<string>").alias("identifiers"))
    return findings.unmarked(found, marks)


def _generated() -> None:
    from brambleq.plans import generated, generated_types

    for made in (generated, generated_types):
        QUERIES.update(made.QUERIES)
        SQL.update(made.SQL)


_generated()
