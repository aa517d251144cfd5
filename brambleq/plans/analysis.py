"""A run: files to facts, facts to symbols and hierarchy, rules to findings.

One pass parses every file once; its rows are written to the shared folder and each
relation below is a filter of that table.  Rules that need one file only have run in
that pass.  The others are joins here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brambleq.functions import types as ty
from brambleq.operators import findings as fnd
from brambleq.operators import hierarchy, symbols
from brambleq.operators._tables import written
from brambleq.php.extract import DDL, worker
from brambleq.php.rules_declared import TYPED_RULES
from brambleq.php.rules_local import RULES as LOCAL
from brambleq.php.rules_local import Options
from brambleq.php.typing_pass import worker as typing_worker
from brambleq.sources import builtins

#: Rounds of inference at most.
INFER_ROUNDS = 3
COLUMNS = ["path", "line", "column", "message", "identifier", "severity", "rule_ord", "ord", "start"]


@dataclass(frozen=True)
class Joined:
    name: str
    level: int
    plan: Callable[[Run], DataFrame]


JOINED: list[Joined] = []


def rule(name: str, level: int):
    def keep(f):
        JOINED.append(Joined(name, level, f))
        return f

    return keep


class Run:
    """Relations of one run.  ``files``: (``path``, ``ord``, ``analyze``, ``stub``, ``source``)."""

    def __init__(self, files: DataFrame, options: Options = Options(), want: frozenset[str] = frozenset(), functions_complete: bool = False, rows: DataFrame | None = None, parse: DataFrame | None = None, infer: int = 0) -> None:
        """``rows``: what an earlier run made of the files that ``parse`` (paths) does not name.
        ``infer``: rounds in which calls and bodies type what declarations leave out."""
        self.infer = infer
        #: Paths whose expressions are to be typed; None: all.
        self.only: DataFrame | None = None
        self.options, self.functions_complete = options, functions_complete
        self._found: dict[str, DataFrame] = {}
        # parsing costs far more than moving text: files are dealt out whole, so that small or uneven inputs use all cores
        n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = files.select("path", "ord", "analyze", F.col("source").cast("binary").alias("source")).repartition(n, "path")
        self.files, self.want = dealt, want
        fresh = (dealt if parse is None else dealt.join(parse, "path", "left_semi")).mapInArrow(worker(options, want), DDL)
        self.rows = written(fresh if rows is None else fresh.unionByName(rows))
        origin = files.select("path", F.when(F.col("stub"), "stub").when(F.col("analyze"), "project").otherwise("scan").alias("origin"))
        self.origin = origin

    @cached_property
    def decls(self) -> DataFrame:
        """Declarations of all origins, builtins included."""
        d = self.relation("decl").join(self.origin, "path").select(F.col("res").alias("kind"), "key", "origin", "ord", "start", F.col("name").alias("fqn"), F.col("alt").alias("what"), "path", "attrs")
        b = builtins.declarations(self.rows.sparkSession)
        empty = F.lit(None).cast("map<string,string>")
        return d.unionByName(b.select("kind", "key", F.lit("builtin").alias("origin"), F.lit(0).alias("ord"), F.lit(0).alias("start"), "fqn", "what", F.lit("").alias("path"), empty.alias("attrs")))

    @cached_property
    def symbols(self) -> DataFrame:
        # a map has no order, so the winner is taken without it and it is joined back
        win = symbols.index(self.decls.drop("attrs"))
        return written(win.join(self.decls.select("kind", "key", "path", "start", "attrs").dropDuplicates(["kind", "key", "path", "start"]), ["kind", "key", "path", "start"]))

    @property
    def classes(self) -> DataFrame:
        return self.symbols.where("kind = 'class'")

    @cached_property
    def anonymous(self) -> DataFrame:
        return self._own_edges().where("child like 'class@%'").select("child", "parent", "ord", "role")

    def _own_edges(self) -> DataFrame:
        return self.relation("edge").select(F.col("owner").alias("child"), "path", F.col("key").alias("parent"), F.col("attrs")["ord"].cast("int").alias("ord"), F.col("res").alias("role"))

    @cached_property
    def edges(self) -> DataFrame:
        """(``child``, ``parent``, ``ord``, ``role``) of the winning declarations."""
        winners = self.classes.select(F.col("key").alias("child"), "path")
        named = self._own_edges().join(winners, ["child", "path"], "left_semi").select("child", "parent", "ord", "role")
        b = builtins.declarations(self.rows.sparkSession)
        given = b.where("kind = 'class'").select(F.col("key").alias("child"), F.posexplode("parents").alias("ord", "p")).select("child", F.lower("p").alias("parent"), "ord", F.lit("interface").alias("role"))
        given = given.join(winners.where("path <> ''"), "child", "left_anti")
        return written(named.unionByName(self.anonymous).unionByName(given))

    @cached_property
    def closure(self) -> DataFrame:
        nodes = self.classes.select(F.col("key").alias("node")).union(self.edges.select("child")).distinct()
        return written(hierarchy.ancestors(self.edges.select("child", "parent", "ord"), nodes))

    @cached_property
    def known(self) -> DataFrame:
        """Classes of which every ancestor is declared."""
        declared = self.classes.select(F.col("key").alias("node")).union(self.anonymous.select("child"))
        return written(hierarchy.fully_known(self.closure, declared).where("known").select("node"))

    @cached_property
    def open(self) -> DataFrame:
        """Classes below a builtin, whose members are in no table."""
        given = self.classes.where("origin = 'builtin'").select(F.col("key").alias("ancestor"))
        return written(self.closure.join(given, "ancestor", "left_semi").select("node").distinct())

    @property
    def members(self) -> DataFrame:
        return self.relation("member").select(F.col("owner"), F.col("key").alias("member"), F.col("name").alias("member_name"), F.col("res").alias("what"), F.col("alt").alias("owner_name"), F.col("attrs").alias("m"), "path", "line", "col", "start", "ord")

    def relation(self, rel: str) -> DataFrame:
        return self.rows.where(F.col("rel") == rel)

    def refs(self, kind: str) -> DataFrame:
        return self.relation("ref").where(F.col("res") == kind)

    def access(self, *kinds: str) -> DataFrame:
        return self.relation("access").where(F.col("res").isin(*kinds))

    def found_member(self, what: str) -> DataFrame:
        """(``node``, ``member``, ``owner``, ``m``): each class's members of a kind, the first on the way up."""
        if what not in self._found:
            self._found[what] = written(self._find(what))
        return self._found[what]

    def _find(self, what: str) -> DataFrame:
        m = self.members.where(F.col("what") == what)
        first = hierarchy.first_member(self.closure.select("node", "ancestor", "path"), m.select("owner", "member").distinct())
        one = m.groupBy("owner", "member").agg(F.min_by(F.struct("m", "member_name", "owner_name"), "start").alias("d"))
        return first.join(one, ["owner", "member"]).select("node", "member", "owner", "d.*")

    @cached_property
    def signatures(self) -> DataFrame:
        """(``what``, ``key``, ``member``, ``data``, ``leads``): what the winning declaration of each symbol says."""
        s = self.relation("sig").join(self.origin, "path")
        rank = F.when(F.col("origin") == "project", 0).when(F.col("origin") == "scan", 1).otherwise(2)
        one = s.groupBy(F.col("name").alias("what"), "key", F.col("alt").alias("member")).agg(F.min_by("args", F.struct(rank, "ord", "path")).alias("a"))
        return written(one.select("what", "key", "member", F.element_at("a", 1).alias("data"), F.slice("a", 2, F.size("a")).alias("leads")))

    @cached_property
    def reach(self) -> DataFrame:
        """(``path``, ``kind``, ``key``): functions, constants and classes that a file's names lead to, through
        the types of what they lead to, until nothing is new."""
        kinds = self.signatures.select("what", F.when(F.col("what").isin("function", "const"), F.col("what")).otherwise("class").alias("kind"), "key", "leads")
        lead = written(kinds.select("kind", "key", F.explode("leads").alias("to")).where("kind <> 'class' or key <> to").distinct())
        r = self.relation("ref").select("path", F.when(F.col("res") == "constant", "const").otherwise(F.col("res")).alias("kind"), "key", "alt")
        own = self.relation("edge").select("path", F.lit("class").alias("kind"), F.col("key")).union(self.relation("decl").where("res = 'class'").select("path", F.lit("class"), "key"))
        own = own.union(self.relation("decl").where("res = 'function'").select("path", F.lit("function"), "key"))
        now = written(r.select("path", "kind", "key").union(r.where("alt is not null").select("path", "kind", F.col("alt"))).union(own).distinct())
        every = new = now
        if lead.isEmpty():
            return now
        while True:
            step = new.join(lead, ["kind", "key"]).select("path", F.lit("class").alias("kind"), F.col("to").alias("key")).distinct()
            new = written(step.join(every, ["path", "kind", "key"], "left_anti"))
            if new.isEmpty():
                return every
            every = written(every.union(new))

    @cached_property
    def inferred(self) -> DataFrame:
        """(``key``, ``member``, ``data``): types of parameters and returns that nothing declares, from what calls
        hand over (in order of files and places) and bodies return; rounds end when one adds nothing."""
        spark = self.rows.sparkSession
        now = spark.createDataFrame([], "key string, member string, data string")
        for _ in range(self.infer):
            rows = self._typing(now)
            seen = rows.where("rel = 'arg'").groupBy("key", F.col("name").alias("member"), "alt", F.element_at("args", 1).alias("type")).agg(F.min(F.struct("ord", "path", "start")).alias("at"))
            listed = F.array_sort(F.collect_list(F.struct("at", "type")))
            types = seen.groupBy("key", "member", "alt").agg(F.transform(listed, lambda s: s["type"]).alias("ts"))
            told = types.where(~F.exists("ts", lambda t: t.rlike(r"\b(mixed|never|void)\b"))).select("key", "member", "alt", joined_types("ts").alias("type"))
            params = told.groupBy("key", "member").agg(F.map_from_entries(F.collect_list(F.struct("alt", "type"))).alias("p"))
            method = F.when(F.col("owner").isNotNull(), F.lower("name"))
            returns = rows.where("rel = 'return'").select("key", method.alias("member"), F.element_at("args", 1).alias("r")).where("r <> 'mixed'").groupBy("key", "member").agg(F.min("r").alias("r"))
            returns = returns.toDF("rkey", "rmember", "r")
            both = params.join(returns, (F.col("key") == F.col("rkey")) & F.col("member").eqNullSafe(F.col("rmember")), "full").select(F.coalesce("key", "rkey").alias("key"), F.coalesce("member", "rmember").alias("member"), F.to_json(F.struct(F.coalesce("p", F.create_map().cast("map<string,string>")).alias("p"), "r")).alias("data"))
            new = written(both)
            if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
                break
            now = new
        return now

    @cached_property
    def typed(self) -> DataFrame:
        """Findings and types of the pass that types every analysed file."""
        return self._typing(self.inferred if self.infer else None)

    def _typing(self, inferred: DataFrame | None) -> DataFrame:
        kind = F.when(F.col("what").isin("function", "const"), F.col("what")).otherwise("class")
        known = self.reach.join(self.signatures.withColumn("kind", kind), ["kind", "key"]).select("path", "what", "key", "member", "data")
        if inferred is not None:
            kinds = F.when(F.col("member").isNull(), "function").otherwise("class")
            known = known.unionByName(self.reach.join(inferred.withColumn("kind", kinds), ["kind", "key"]).select("path", F.lit("inferred").alias("what"), "key", "member", "data"))
        base = len(LOCAL) + len(JOINED)
        files = self.files.where("analyze") if self.only is None else self.files.where("analyze").join(self.only, "path", "left_semi")
        return written(files.groupBy("path").cogroup(known.groupBy("path")).applyInArrow(typing_worker(self.options, self.want, base), DDL))

    def findings(self) -> DataFrame:
        """All findings of the level, before suppression, one row each."""
        # an error's column layout is that of every rule
        errors = self.relation("error").select("path", "line", F.col("col").alias("column"), F.col("name").alias("message"), F.lit("phpParser.error").alias("identifier"), F.lit("error").alias("severity"), F.lit(-1).alias("rule_ord"), "ord", "start")
        local = self.relation("finding").select("path", "line", F.col("col").alias("column"), F.col("name").alias("message"), F.col("key").alias("identifier"), F.lit("error").alias("severity"), F.col("alt").cast("int").alias("rule_ord"), "ord", "start")
        flow = self.typed.where("rel = 'finding'").select("path", "line", F.col("col").alias("column"), F.col("name").alias("message"), F.col("key").alias("identifier"), F.lit("error").alias("severity"), F.col("alt").cast("int").alias("rule_ord"), "ord", "start")
        parts = [errors, local, flow]
        for k, r in enumerate(JOINED):
            if r.level <= self.options.level:
                parts.append(r.plan(self).withColumn("rule_ord", F.lit(len(LOCAL) + k)).select(*COLUMNS))
        return reduce(DataFrame.unionByName, parts)

    def _ignored(self, found: DataFrame, ignores: DataFrame) -> DataFrame:
        """Findings that no entry (``ord``, ``path``, ``message``, ``identifier``, ``count``) takes.  Entries for
        one file, whose path is a literal, meet that file's findings only; the others meet all."""
        found = written(found.withColumn("fid", F.monotonically_increasing_id()))
        e = ignores.select(F.col("ord").alias("entry"), F.col("count").alias("n"), *[F.col(c).alias(f"__{c}") for c in ("path", "message", "identifier")])
        literal = F.regexp_extract("__path", r"^\^((?:[\w/ @-]|\\[^\w])+)\$$", 1)
        e = e.withColumn("__file", F.when(literal != "", F.regexp_replace(literal, r"\\(.)", "$1")))
        exact = found.join(e.where("__file is not null"), (F.col("path") == F.col("__file")) & _matches("__"))
        loose = found.join(e.where("__file is null"), _matches("__"))
        pairs = exact.unionByName(loose).select("fid", F.struct("ord", "rule_ord", "start").alias("at"), "entry", "n")
        return found.join(fnd.settle(pairs).select("fid"), "fid", "left_anti").drop("fid")

    def report(self, ignores: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
        """Findings after inline markers, configured ignores and a baseline."""
        marks = self.relation("marker").where("res is null").select("path", F.col("name").cast("int").alias("line"), F.when(F.size("args") > 0, F.col("args")).alias("identifiers"))
        left = fnd.unmarked(self.findings(), marks)
        bad = self.relation("marker").where("res = 'bad'").select("path", "line", F.col("col").alias("column"), F.lit("Malformed list of identifiers to ignore.").alias("message"), F.lit("ignore.parseError").alias("identifier"), F.lit("error").alias("severity"), F.lit(1 << 20).alias("rule_ord"), "ord", "start")
        left = left.unionByName(bad)
        if ignores is not None:
            left = self._ignored(left, ignores)
        if baseline is not None:
            keyed = left.withColumn("__m", fnd.anchored(F.col("message")))
            entries = baseline.select("path", F.col("message").alias("__m"), "identifier", "count")
            left = fnd.apply_counts(keyed, entries, ["path", "__m", "identifier"], ["rule_ord", "start"]).drop("__m")
        return left


def _matches(entry: str) -> Column:
    """Whether a finding is one that an entry (columns behind ``entry``) means."""
    e = lambda c: F.col(f"{entry}{c}")
    return (e("path").isNull() | F.rlike(F.col("path"), e("path"))) & (e("message").isNull() | F.rlike(F.col("message"), e("message"))) & (e("identifier").isNull() | (F.col("identifier") == e("identifier")))


@F.pandas_udf(StringType())
def joined_types(texts: pd.Series) -> pd.Series:
    """The union of each row's types, in their order."""
    return texts.map(lambda ts: ty.render(ty.union(*[ty.parse_type(t) for t in ts])))


def _at(df: DataFrame, message: Column, identifier: Column | str) -> DataFrame:
    code = F.lit(identifier) if isinstance(identifier, str) else identifier
    return df.select("path", "line", F.col("col").alias("column"), message.alias("message"), code.alias("identifier"), F.lit("error").alias("severity"), "ord", "start")


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@rule("unknown-symbol", 0)
def unknown_symbol(run: Run) -> DataFrame:
    lost = symbols.unresolved(run.refs("class").where(F.col("attrs")["how"] == "fqn"), run.classes, "key")
    constants = run.symbols.where("kind = 'constant'")
    lost_constants = symbols.unresolved_with_fallback(run.refs("constant"), constants, "key", "alt")
    return _at(lost, say("unknown class `", F.col("name"), "`"), "class.notFound").unionByName(_at(lost_constants, say("unknown constant `", F.col("name"), "`"), "constant.notFound"))


@rule("function.notFound", 0)
def function_not_found(run: Run) -> DataFrame:
    lost = symbols.unresolved_with_fallback(run.refs("function"), run.symbols.where("kind = 'function'"), "key", "alt")
    shown = F.coalesce(F.regexp_extract("name", r"([^\\]*)$", 1), F.col("name"))
    out = _at(lost, say("Function ", F.when(F.col("alt").isNotNull(), shown).otherwise(F.col("name")), " not found."), "function.notFound")
    return out if run.functions_complete else out.where("false")


def _called(run: Run) -> DataFrame:
    """Calls with the function they reach: the namespaced one, else the global one."""
    f = run.symbols.where("kind = 'function' and origin <> 'builtin'").select(F.col("key").alias("__k"), F.col("fqn").alias("target"), F.col("attrs").alias("f"))
    calls = run.refs("function")
    first = calls.join(f, F.col("key") == F.col("__k")).drop("__k")
    rest = calls.where("alt is not null").join(f.select("__k"), F.col("key") == F.col("__k"), "left_anti").join(f, F.col("alt") == F.col("__k")).drop("__k")
    return first.unionByName(rest)


@rule("function.nameCase", 0)
def function_case(run: Run) -> DataFrame:
    c = _called(run)
    short, text = F.regexp_extract("target", r"([^\\]*)$", 1), F.regexp_extract(F.col("attrs")["text"], r"([^\\]*)$", 1)
    return _at(c.where((short != text) & (F.lower(short) == F.lower(text))), say("Call to function ", F.col("target"), "() with incorrect case: ", F.col("attrs")["text"]), "function.nameCase")


def _counts(df: DataFrame, given: Column, need: Column, most: Column, head: Column, identifier: str = "arguments.count") -> DataFrame:
    g, n = given.cast("int"), need.cast("int")
    m = F.when(most != "*", most.cast("int"))
    arity = F.when(m.isNull(), F.concat(F.lit("at least "), n.cast("string"))).when(m == n, m.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("-"), m.cast("string")))
    return _at(df.where((g < n) | (g > m)), say(head, " invoked with ", g.cast("string"), F.when(g == 1, " parameter, ").otherwise(" parameters, "), arity, " required."), identifier)


@rule("method.argumentsCount", 0)
def method_arguments(run: Run) -> DataFrame:
    a = run.access("method", "static_method").where(F.col("attrs")["nargs"].isNotNull())
    j = a.join(run.known, F.col("owner") == F.col("node"), "left_semi").join(run.found_member("method").select("node", "member", F.col("m").alias("d"), "member_name", "owner_name"), (F.col("owner") == F.col("node")) & (F.col("key") == F.col("member")))
    return _counts(j.where(F.col("d")["doc"].isNull()), F.col("attrs")["nargs"], F.col("d")["need"], F.col("d")["most"], say("Method ", F.col("owner_name"), "::", F.col("member_name"), "()"))


@rule("instantiation", 0)
def instantiation(run: Run) -> DataFrame:
    new = run.refs("class").where(F.col("attrs")["context"] == "new")
    j = new.join(run.classes.select("key", "what", F.col("fqn").alias("target"), F.col("attrs").alias("c")), "key")
    abstract = j.where((F.col("what") == "class") & (F.col("c")["abstract"] == "1"))
    kinds = j.where(F.col("what") != "class")
    return _at(kinds, say("Cannot instantiate ", F.col("what"), " ", F.col("target"), "."), say("new.", F.col("what"))).unionByName(_at(abstract, say("Instantiated class ", F.col("target"), " is abstract."), "new.abstract"))


@rule("inheritance.kinds", 0)
def inheritance(run: Run) -> DataFrame:
    e = run.relation("edge").join(run.classes.select("key", F.col("what").alias("kind"), F.col("fqn").alias("target"), F.col("attrs").alias("c")), "key")
    child, kind, role = F.col("attrs")["what"], F.col("kind"), F.col("res")
    label = say(F.when(F.col("attrs")["anon"] == "1", "Anonymous class").otherwise(F.concat(F.initcap(child), F.lit(" "), F.col("alt"))))
    is_ = lambda *c: reduce(lambda a, b: a & b, c)
    upper = F.initcap(kind)
    parts = [
        (is_(role == "parent", child == "class", kind != "class"), say(label, " extends ", kind, " ", F.col("target"), "."), F.concat(F.lit("class.extends"), upper)),
        (is_(role == "parent", child == "class", kind == "class", F.col("c")["final"] == "1"), say(label, " extends final class ", F.col("target"), "."), F.lit("class.extendsFinal")),
        (is_(role == "interface", child == "interface", kind != "interface"), say(label, " extends ", kind, " ", F.col("target"), "."), F.concat(F.lit("interfaceExtends."), kind)),
        (is_(role == "interface", child == "class", kind != "interface"), say(label, " implements ", kind, " ", F.col("target"), "."), F.concat(F.lit("classImplements."), kind)),
        (is_(role == "interface", child == "enum", kind != "interface"), say(label, " implements ", kind, " ", F.col("target"), "."), F.concat(F.lit("enumImplements."), kind)),
        (is_(role == "trait", kind != "trait"), say(label, " uses ", kind, " ", F.col("target"), "."), F.concat(F.lit("traitUse."), kind)),
        (is_(role == "trait", child == "interface"), say(label, " uses trait ", F.col("target"), "."), F.lit("interface.traitUse")),
    ]
    which = reduce(lambda acc, p: acc.when(p[0], F.struct(p[1].alias("m"), p[2].alias("i"))), parts[1:], F.when(parts[0][0], F.struct(parts[0][1].alias("m"), parts[0][2].alias("i"))))
    w = e.withColumn("w", which).where("w is not null")
    return _at(w, F.col("w.m"), F.col("w.i"))


@rule("instanceof.kind", 0)
def instanceof_trait(run: Run) -> DataFrame:
    j = run.refs("class").where(F.col("attrs")["context"] == "instanceof").join(run.classes.where("what = 'trait'").select("key", F.col("fqn").alias("target")), "key")
    return _at(j, say("Class ", F.col("target"), " is a trait."), "instanceof.trait")


@rule("catch.notThrowable", 0)
def catch_not_throwable(run: Run) -> DataFrame:
    throwable = run.closure.where("ancestor = 'throwable'").select(F.col("node").alias("key"))
    c = run.refs("class").where(F.col("attrs")["context"] == "catch").join(run.known.select(F.col("node").alias("key")), "key", "left_semi").join(throwable, "key", "left_anti")
    return _at(c, say("Caught class ", F.col("name"), " is not an exception."), "catch.notThrowable")


def _unknown_member(run: Run, kinds: tuple[str, ...], what: str, magic: list[str]) -> DataFrame:
    """Accesses on a fully known class that has neither the member nor a method that stands in for it."""
    a = run.access(*kinds).join(run.known, F.col("owner") == F.col("node"), "left_semi")
    have = run.found_member(what).select("node", "member")
    lost = a.join(have, (F.col("owner") == F.col("node")) & (F.col("key") == F.col("member")), "left_anti")
    if magic:
        stand = run.found_member("method").where(F.col("member").isin(*magic)).select("node").distinct()
        lost = lost.join(stand, F.col("owner") == F.col("node"), "left_anti")
    return lost


def _builtin_ancestor(run: Run) -> DataFrame:
    return run.open


@rule("class.constant", 0)
def class_constant(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("constant",), "constant", []).join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    return _at(lost, say("Access to undefined constant ", F.col("alt"), "::", F.col("name"), "."), "classConstant.notFound")


@rule("method.callExistence", 0)
def method_this(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("method",), "method", ["__call"]).where(F.col("attrs")["how"] == "this").join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    return _at(lost, say("Call to an undefined method ", F.col("alt"), "::", F.col("name"), "()."), "method.notFound")


@rule("method.callTyped", 0)
def method_typed(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("method",), "method", ["__call"]).where(F.col("attrs")["how"] != "this").join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    if run.options.level < 2:  # receivers other than $this count from level 2
        lost = lost.where("false")
    return _at(lost, say("Call to an undefined method ", F.col("alt"), "::", F.col("name"), "()."), "method.notFound")


@rule("staticMethod.callNamed", 0)
def static_named(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("static_method",), "method", ["__callstatic", "__call"]).join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    return _at(lost, say("Call to an undefined static method ", F.col("alt"), "::", F.col("name"), "()."), "staticMethod.notFound")


@rule("property.accessUndefined", 0)
def property_undefined(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("property",), "property", ["__get", "__set"]).join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    interface = run.classes.where("what in ('interface', 'enum')").select(F.col("key").alias("node"))
    lost = lost.join(interface, F.col("owner") == F.col("node"), "left_anti")
    if run.options.level < 2:
        lost = lost.where(F.col("attrs")["how"] == "this")
    return _at(lost, say("Access to an undefined property ", F.col("alt"), "::$", F.col("name"), "."), "property.notFound")


@rule("staticProperty.access", 0)
def static_property(run: Run) -> DataFrame:
    lost = _unknown_member(run, ("static_property",), "property", []).join(_builtin_ancestor(run), F.col("owner") == F.col("node"), "left_anti")
    return _at(lost, say("Access to an undefined static property ", F.col("alt"), "::$", F.col("name"), "."), "staticProperty.notFound")


@rule("method.missingImplementation", 0)
def missing_implementation(run: Run) -> DataFrame:
    """Concrete classes whose first declaration of some method on the way up is abstract."""
    concrete = run.relation("decl").where("res = 'class' and (alt = 'enum' or (alt = 'class' and attrs['abstract'] is null))").select("path", "line", "col", "start", "ord", F.col("key").alias("node"), F.col("name").alias("shown"), "alt")
    m = run.members.where("what = 'method'")
    # a concrete declaration anywhere above implements an abstract one
    have = run.closure.join(m.where(F.col("m")["abstract"].isNull()), F.col("ancestor") == F.col("owner")).select("node", "member").distinct()
    need = run.found_member("method").where((F.col("m")["abstract"] == "1") & (F.col("owner") != F.col("node"))).select("node", "member", "member_name", "owner_name", "owner")
    kinds = run.classes.select(F.col("key").alias("owner"), F.col("what").alias("of"))
    lost = need.join(have, ["node", "member"], "left_anti").join(run.known, "node", "left_semi").join(kinds, "owner")
    j = concrete.join(lost, "node")
    return _at(j, say(F.when(F.col("alt") == "enum", "Enum").otherwise("Non-abstract class"), " ", F.col("shown"), " contains abstract method ", F.col("member_name"), "() from ", F.col("of"), " ", F.col("owner_name"), "."), "method.missingImplementation")


@rule("method.overriding", 0)
def overriding(run: Run) -> DataFrame:
    """A method against the first declaration above it."""
    m = run.members.where("what = 'method' and m['doc'] is null")
    above = run.closure.where("depth > 0").join(m.select(F.col("owner").alias("ancestor"), "member"), "ancestor").groupBy("node", "member").agg(F.min(F.struct("path", "ancestor")).alias("p")).select(F.col("node").alias("owner"), "member", F.col("p.ancestor").alias("up"))
    parent = m.select(F.col("owner").alias("up"), "member", F.col("m").alias("pm"), F.col("owner_name").alias("there"))
    traits = run.classes.where("what = 'trait'").select(F.col("key").alias("up"))
    j = m.join(above, ["owner", "member"]).join(parent, ["up", "member"]).join(traits, "up", "left_anti").where(F.col("pm")["vis"] != "private")
    here = say(F.col("owner_name"), "::", F.col("member_name"), "()")
    there = say(F.col("there"), "::", F.col("member_name"), "()")
    stat, pstat = F.col("m")["static"] == "1", F.col("pm")["static"] == "1"
    stat, pstat = F.coalesce(stat, F.lit(False)), F.coalesce(pstat, F.lit(False))
    vis, pvis = F.col("m")["vis"], F.col("pm")["vis"]
    rank = lambda c: F.when(c == "public", 0).when(c == "protected", 1).otherwise(2)
    cases = [
        (F.col("pm")["final"] == "1", say("Method ", here, " overrides final method ", there, "."), "method.parentMethodFinal"),
        (~stat & pstat, say("Non-static method ", here, " overrides static method ", there, "."), "method.nonStatic"),
        (stat & ~pstat, say("Static method ", here, " overrides non-static method ", there, "."), "method.static"),
        ((rank(vis) > rank(pvis)) & (F.col("member") != "__construct"), say(F.initcap(vis), " method ", here, " overriding ", pvis, " method ", there, " should ", F.when(pvis == "public", "also be public").otherwise("be protected or public"), "."), "method.visibility"),
    ]
    parts = [_at(j.where(c), msg, code) for c, msg, code in cases]
    return reduce(DataFrame.unionByName, parts)


def _overridden(run: Run, what: str) -> DataFrame:
    """Members of a kind beside the first declaration above them: ``m`` and ``pm`` are their attributes, ``there``
    the class above.  Traits are no parents, and nothing overrides what is private."""
    m = run.members.where((F.col("what") == what) & F.col("m")["doc"].isNull())
    above = run.closure.where("depth > 0").join(m.select(F.col("owner").alias("ancestor"), "member"), "ancestor").groupBy("node", "member").agg(F.min(F.struct("path", "ancestor")).alias("p")).select(F.col("node").alias("owner"), "member", F.col("p.ancestor").alias("up"))
    parent = m.select(F.col("owner").alias("up"), "member", F.col("m").alias("pm"), F.col("owner_name").alias("there"))
    traits = run.classes.where("what = 'trait'").select(F.col("key").alias("up"))
    return m.join(above, ["owner", "member"]).join(parent, ["up", "member"]).join(traits, "up", "left_anti").where(F.col("pm")["vis"] != "private")


def _narrowed(word: str, here: Column, there: Column) -> list[tuple]:
    vis, pvis = F.col("m")["vis"], F.col("pm")["vis"]
    lead = say(F.initcap(vis), f" {word} ", here, " overriding ", pvis, f" {word} ", there)
    return [((pvis == "public") & (vis != "public"), say(lead, " should also be public.")), ((pvis == "protected") & (vis == "private"), say(lead, " should be protected or public."))]


@rule("property.overriding", 0)
def property_overriding(run: Run) -> DataFrame:
    j = _overridden(run, "property")
    here, there = say(F.col("owner_name"), "::$", F.col("member_name")), say(F.col("there"), "::$", F.col("member_name"))
    flag = lambda of, name: F.coalesce(F.col(of)[name] == "1", F.lit(False))
    stat, pstat, ro, pro = flag("m", "static"), flag("pm", "static"), flag("m", "readonly"), flag("pm", "readonly")
    hint, phint = F.col("m")["hint"], F.col("pm")["hint"]
    cases = [
        (~stat & pstat, say("Non-static property ", here, " overrides static property ", there, "."), "property.nonStatic"),
        (stat & ~pstat, say("Static property ", here, " overrides non-static property ", there, "."), "property.static"),
        (~ro & pro, say("Readwrite property ", here, " overrides readonly property ", there, "."), "property.readWrite"),
        (ro & ~pro, say("Readonly property ", here, " overrides readwrite property ", there, "."), "property.readOnly"),
        (hint.isNull() & phint.isNotNull(), say("Property ", here, " overriding property ", there, " should have native type ", phint, "."), "property.missingNativeType"),
        (hint.isNotNull() & phint.isNull(), say("Property ", here, " has native type ", hint, " but overrides property ", there, " with no native type."), "property.extraNativeType"),
        *[(c, text, "property.visibility") for c, text in _narrowed("property", here, there)],
    ]
    return reduce(DataFrame.unionByName, [_at(j.where(c), text, code) for c, text, code in cases])


@rule("classConstant.overriding", 0)
def constant_overriding(run: Run) -> DataFrame:
    j = _overridden(run, "constant").where(F.col("m")["case"].isNull())
    here, there = say(F.col("owner_name"), "::", F.col("member_name")), say(F.col("there"), "::", F.col("member_name"))
    cases = [(F.col("pm")["final"] == "1", say("Constant ", here, " overrides final constant ", there, "."), "classConstant.final"), *[(c, text, "classConstant.visibility") for c, text in _narrowed("constant", here, there)]]
    return reduce(DataFrame.unionByName, [_at(j.where(c), text, code) for c, text, code in cases])


@rule("trait.unused", 4)
def trait_unused(run: Run) -> DataFrame:
    used = run.edges.where("role = 'trait'").select(F.col("parent").alias("key")).distinct()
    t = run.relation("decl").where("res = 'class' and alt = 'trait'").join(used, "key", "left_anti").join(run.relation("file").where("attrs['analyze'] = '1'").select("path"), "path", "left_semi")
    return _at(t, say("Trait ", F.col("name"), " is used zero times and is not analysed."), "trait.unused")


def manifest() -> list[tuple[int, str]]:
    """(level, name) of every rule, in that order."""
    return sorted((r.level, r.name) for r in [*LOCAL, *JOINED, *TYPED_RULES])
