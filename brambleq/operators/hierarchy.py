"""Closure of the class hierarchy, in the order in which members are looked up.

Edges are (``child``, ``parent``, ``ord``): own traits, parents, interfaces and
mixins in declaration order.  A closure row carries the path of branch ordinals;
a path sorts before its extensions, so the least path is depth-first pre-order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambleq.operators._tables import written


def ancestors(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(``node``, ``ancestor``, ``path``, ``depth``), each node its own ancestor at depth 0, each
    ancestor once, by the least path to it.

    Paths double: of those of up to 2k steps the least to each ancestor is kept, so a hierarchy of
    depth d takes log2(d) joins, each written out, over one row a pair of class and ancestor, however
    many ways lead there.  A hierarchy with a cycle is no valid program; its paths are walked
    without entering a class twice.  ``roots`` limits the nodes that are asked for."""
    nodes = roots.select("node") if roots is not None else edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit("").alias("path"), F.lit(0).alias("depth"))
    number = F.col("ord").cast("string")
    step = F.concat(F.when(F.col("ord") < 10**_DIGITS, F.lpad(number, _DIGITS, "0")).otherwise(F.concat(F.lit(":"), F.lpad(number, 10, "0"))), F.lit("/"))
    links = edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), step.alias("path"), F.lit(1).alias("depth"))
    known = written(_least(links))
    state = None
    while True:
        if not known.where("node = ancestor").isEmpty():
            known = _walked(links)
            break
        now = known.agg(F.count("*"), F.sum(F.xxhash64("node", "ancestor", "path").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        tail = known.select(F.col("node").alias("via"), F.col("ancestor").alias("top"), F.col("path").alias("more"), F.col("depth").alias("steps"))
        met = known.join(tail, F.col("ancestor") == F.col("via")).select("node", F.col("top").alias("ancestor"), F.concat("path", "more").alias("path"), (F.col("depth") + F.col("steps")).alias("depth"))
        known = written(_least(known.unionByName(met)))
    return own.unionByName(known if roots is None else known.join(nodes, "node", "left_semi"))


#: Digits of a branch's ordinal in a path, so that text sorts as numbers do; larger ones stand behind a colon, which follows the digits.
_DIGITS = 4


def _least(paths: DataFrame) -> DataFrame:
    return paths.groupBy("node", "ancestor").agg(F.min(F.struct("path", "depth")).alias("p")).select("node", "ancestor", "p.path", "p.depth")


def _walked(links: DataFrame) -> DataFrame:
    """The least path of those that enter no class twice, one step longer a round."""
    head = written(links.withColumn("seen", F.array("node", "ancestor")))
    known = written(_least(head))
    while True:
        step = links.select(F.col("node").alias("via"), F.col("ancestor").alias("top"), F.col("path").alias("more"))
        met = head.join(step, F.col("ancestor") == F.col("via")).where(~F.array_contains("seen", F.col("top")))
        head = written(met.select("node", F.col("top").alias("ancestor"), F.concat("path", "more").alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("top")).alias("seen")))
        if head.isEmpty():
            return known
        known = written(_least(known.unionByName(head.drop("seen"))))


def first_member(closure: DataFrame, members: DataFrame) -> DataFrame:
    """(``node``, ``member``, ``owner``): the first on the way up that declares the member.
    ``members`` is (``owner``, ``member``)."""
    found = closure.join(members, closure["ancestor"] == members["owner"])
    return found.groupBy("node", "member").agg(F.min(F.struct("path", "owner")).alias("m")).select("node", "member", F.col("m.owner").alias("owner"))


def fully_known(closure: DataFrame, declared: DataFrame) -> DataFrame:
    """(``node``, ``known``): whether all ancestors are declared (``declared``: ``node``)."""
    d = declared.select(F.col("node").alias("__d")).distinct()
    return closure.join(d, F.col("ancestor") == F.col("__d"), "left").groupBy("node").agg(F.min(F.col("__d").isNotNull()).alias("known"))


def descendants(closure: DataFrame, flags: DataFrame) -> DataFrame:
    """(``node``, ``closed``): whether all descendants, itself aside, carry the flag.
    ``flags`` is (``node``, ``flag``).  Nodes without descendants are absent."""
    f = flags.select(F.col("node").alias("__n"), F.col("flag").alias("__f"))
    below = closure.where("depth > 0").join(f, F.col("node") == F.col("__n"))
    return below.groupBy(F.col("ancestor").alias("node")).agg(F.min("__f").alias("closed"))
