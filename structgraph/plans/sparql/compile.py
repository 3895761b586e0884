"""SPARQL algebra as DataFrames over the quad table.

A solution sequence is a DataFrame with four columns per variable: the lexical value under the variable's name, and kind, datatype and
language under ``name#k``, ``name#d``, ``name#l`` (no name of a variable has the sign). Unbound is null. Patterns become equi-joins, EXISTS
semi-joins, OPTIONAL left joins with their filter in the condition; Catalyst orders and plans them. Paths are the one iterative part.
Where variables that two sequences share may all be unbound, the rows in which one is bound on both sides are joined on it, and
only the rest, which the algebra pairs with everything, is a product. It is made in tiles, whose few values are written as a dictionary.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.model import VOCAB, XSD
from structgraph.operators.store import union_graph
from structgraph.plans.reach import closure
from structgraph.plans.sparql.parser import Iri, Lit, Parser, Select, SparqlError, Var

NUMERIC = tuple(XSD + t for t in ("integer", "decimal", "double", "float", "long", "int"))
#: Properties whose objects are integers, so that results are typed.
_INTEGER = {VOCAB + "startLine", VOCAB + "endLine"}
_PARTS = ("", "#k", "#d", "#l")
#: Rows of the left and right side in a tile of a product: their texts fit a dictionary of parquet, and the right ones' numbers a byte. Pieces
#: that a side is cut into at most, larger sides in larger ones.
TILE, MOST_PIECES = (4096, 256), 512


@dataclass
class Rel:
    """A solution sequence: its rows, all variables, those that may be unbound, and the Spark types of those known to be numbers or truth values."""

    df: DataFrame | None  # None: the one empty solution
    vars: set[str] = field(default_factory=set)
    maybe: set[str] = field(default_factory=set)
    types: dict[str, str] = field(default_factory=dict)


@dataclass
class Val:
    """An expression's value: typ is term, num, str, bool or iri; a term has kind, datatype and language columns."""

    col: Column
    typ: str
    k: Column | None = None
    d: Column | None = None
    l: Column | None = None  # noqa: E741


def _expr_vars(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, tuple):
        return set().union(*[_expr_vars(x) for x in e]) if e and e[0] != "exists" else set()
    if isinstance(e, list):
        return set().union(*[_expr_vars(x) for x in e]) if e else set()
    return set()


def _has(e, tag: str) -> bool:
    return isinstance(e, tuple) and bool(e) and (e[0] == tag or any(_has(x, tag) for x in e)) or isinstance(e, list) and any(_has(x, tag) for x in e)


class Compiler:
    def __init__(self, quads: DataFrame, dataset: list[tuple[bool, str]] = ()) -> None:
        """Over all graphs, or over those of a ``dataset`` of (named, graph): the unnamed ones make the default graph."""
        of = lambda named: quads.where(F.col("g").isin(*[g for n, g in dataset if n is named])) if any(n is named for n, _ in dataset) else quads.limit(0)
        self.quads = of(True) if dataset else quads
        self.triples = union_graph(of(False) if dataset else quads)
        self.spark = quads.sparkSession
        self.n = 0
        self.unfiltered = False  # no condition can turn a product into a join afterwards
        self.merged: dict[str, str] = {}  # variables that a join's condition finds on either side, with the mark of the right one

    # expressions ------------------------------------------------------------------------------------------------------
    def num(self, v: Val) -> Column:
        return v.col.cast("double") if v.typ in ("num", "bool") else F.expr("cast(null as double)") if v.typ == "iri" else v.col.try_cast("double")

    def text(self, v: Val) -> Column:
        return v.col.cast("string")

    def boolean(self, v: Val) -> Column:
        """Effective boolean value."""
        if v.typ == "bool":
            return v.col
        if v.typ == "num":
            return v.col != 0
        if v.typ == "term":
            n = v.col.try_cast("double")
            return F.when(v.d == XSD + "boolean", v.col == "true").when(v.d.isin(*NUMERIC), n != 0).otherwise(F.length(v.col) > 0)
        return F.length(v.col) > 0

    def ev(self, e, env: set[str]) -> Val:
        """The value of an expression over the variables of ``env``; other variables are unbound."""
        if isinstance(e, Var):
            if e.name not in env:
                null = F.lit(None).cast("string")
                return Val(null, "term", null, null, null)
            tag = self.merged.get(e.name)
            c = (lambda x: F.coalesce(F.col(x), F.col(f"{x[:-1]}{tag}`"))) if tag else F.col
            return Val(c(f"`{e.name}`"), "term", c(f"`{e.name}#k`"), c(f"`{e.name}#d`"), c(f"`{e.name}#l`"))
        if isinstance(e, Iri):
            return Val(F.lit(e.value), "iri")
        if isinstance(e, Lit):
            if e.dt in NUMERIC:
                return Val(F.lit(int(e.value) if e.dt.endswith(("integer", "int", "long")) else float(e.value)), "num")
            if e.dt == XSD + "boolean":
                return Val(F.lit(e.value == "true"), "bool")
            return Val(F.lit(e.value), "str")
        op = e[0]
        if op in ("and", "or"):
            a, b = self.boolean(self.ev(e[1], env)), self.boolean(self.ev(e[2], env))
            return Val(a & b if op == "and" else a | b, "bool")
        if op == "not":
            return Val(~self.boolean(self.ev(e[1], env)), "bool")
        if op == "cmp":
            return Val(self.compare(e[1], self.ev(e[2], env), self.ev(e[3], env)), "bool")
        if op == "in":
            left = self.ev(e[1], env)
            out = F.lit(False)
            for x in e[2]:
                out = out | self.compare("=", left, self.ev(x, env))
            return Val(out, "bool")
        if op == "arith":
            a, b = self.num(self.ev(e[2], env)), self.num(self.ev(e[3], env))
            return Val({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]], "num")
        if op == "agg":
            return self.aggregate(e, env)
        if op == "cast":
            v = self.ev(e[2][0], env)
            if e[1] in NUMERIC:
                whole = e[1].endswith(("integer", "int", "long"))
                return Val(self.text(v).try_cast("double").cast("bigint") if whole else self.num(v), "num")
            if e[1] == XSD + "boolean":
                return Val(self.text(v).try_cast("boolean"), "bool")
            if e[1] in (XSD + "string", XSD + "dateTime", XSD + "date"):
                return Val(self.text(v), "str")
            raise SparqlError(f"no cast to {e[1]}")
        if op == "call":
            return self.call(e[1], e[2], env)
        if op == "flag":
            return Val(F.coalesce(F.col(f"`{e[1]}`"), F.lit(False)), "bool")
        raise SparqlError(f"{op} cannot stand here")

    def compare(self, op: str, a: Val, b: Val) -> Column:
        x, y = (self.num(a), self.num(b)) if "num" in (a.typ, b.typ) else (self.boolean(a), self.boolean(b)) if "bool" in (a.typ, b.typ) else (self.text(a), self.text(b))
        if op in ("=", "!="):
            same = x == y
            if "num" not in (a.typ, b.typ) and "bool" not in (a.typ, b.typ):
                for t, u in ((a, b), (b, a)):
                    if t.typ == "term":
                        same = same & (t.k == "iri" if u.typ == "iri" else t.k != "iri" if u.typ == "str" else t.k.eqNullSafe(u.k) if u.typ == "term" else F.lit(True))
            return same if op == "=" else ~same
        if a.typ == b.typ == "term":
            # numbers compare as numbers, everything else by its text
            p, q = F.when(a.d.isin(*NUMERIC), self.num(a)), F.when(b.d.isin(*NUMERIC), self.num(b))
            less = F.when(p.isNotNull() & q.isNotNull(), p < q).otherwise(x < y)
            eq = F.when(p.isNotNull() & q.isNotNull(), p == q).otherwise(x == y)
            return {"<": less, "<=": less | eq, ">": ~less & ~eq, ">=": ~less}[op]
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def aggregate(self, e, env: set[str]) -> Val:
        _, name, distinct, arg, sep = e
        if arg is None:
            if distinct:
                return Val(F.count_distinct(F.struct(*[F.col(f"`{v}`") for v in sorted(env)])), "num")
            return Val(F.count(F.lit(1)), "num")
        v = self.ev(arg, env)
        if name == "COUNT":
            return Val(F.count_distinct(v.col) if distinct else F.count(v.col), "num")
        if name in ("SUM", "AVG"):
            n = self.num(v)
            return Val((F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n), "num")
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            if v.typ == "num":
                return Val(f(v.col), "num")
            if v.typ == "term":
                # numbers among themselves as numbers: their text travels with the value
                n = F.when(v.d.isin(*NUMERIC), self.num(v))
                return Val(F.coalesce(f(F.when(n.isNotNull(), F.struct(n.alias("n"), v.col.alias("t"))))["t"], f(v.col)), "str")
            return Val(f(self.text(v)), "str")
        if name == "SAMPLE":
            return Val(F.any_value(v.col, ignoreNulls=True), v.typ if v.typ != "term" else "str")
        parts = F.collect_set(self.text(v)) if distinct else F.collect_list(self.text(v))
        return Val(F.array_join(F.sort_array(parts), sep), "str")

    def call(self, name: str, args: list, env: set[str]) -> Val:
        if name == "BOUND":
            return Val(self.ev(args[0], env).col.isNotNull(), "bool")
        if name == "COALESCE":
            vs = [self.ev(a, env) for a in args]
            typ = vs[0].typ if len({v.typ for v in vs}) == 1 and vs[0].typ != "term" else "str"
            return Val(F.coalesce(*[v.col if typ != "str" else self.text(v) for v in vs]), typ)
        if name == "IF":
            c, a, b = (self.ev(x, env) for x in args)
            typ = a.typ if a.typ == b.typ and a.typ != "term" else "str"
            return Val(F.when(self.boolean(c), a.col if typ != "str" else self.text(a)).otherwise(b.col if typ != "str" else self.text(b)), typ)
        v = [self.ev(a, env) for a in args]
        s = [self.text(x) for x in v]
        n = lambda i=0: self.num(v[i])
        now = F.current_timestamp
        when = lambda: s[0].try_cast("timestamp")
        kind = lambda i=0: v[i].k if v[i].typ == "term" else F.lit("iri" if v[i].typ == "iri" else "lit")
        lit = {"bool": XSD + "boolean", "str": XSD + "string", "num": XSD + "decimal"}
        table = {
            "STR": lambda: Val(s[0], "str"), "LCASE": lambda: Val(F.lower(s[0]), "str"), "UCASE": lambda: Val(F.upper(s[0]), "str"), "STRLEN": lambda: Val(F.length(s[0]).cast("bigint"), "num"),
            "CONTAINS": lambda: Val(F.contains(s[0], s[1]), "bool"), "STRSTARTS": lambda: Val(F.startswith(s[0], s[1]), "bool"), "STRENDS": lambda: Val(F.endswith(s[0], s[1]), "bool"),
            "STRBEFORE": lambda: Val(F.when(F.contains(s[0], s[1]), F.substr(s[0], F.lit(1), F.position(s[1], s[0]) - 1)).otherwise(F.lit("")), "str"),
            "STRAFTER": lambda: Val(F.when(F.contains(s[0], s[1]), F.substr(s[0], F.position(s[1], s[0]) + F.length(s[1]))).otherwise(F.lit("")), "str"),
            "CONCAT": lambda: Val(F.concat(*s), "str"), "SUBSTR": lambda: Val(F.substr(s[0], n(1).cast("int"), n(2).cast("int")) if len(v) > 2 else F.substr(s[0], n(1).cast("int")), "str"),
            "REGEX": lambda: Val(F.rlike(s[0], F.concat(F.lit(f"(?{self.flags(args)})") if len(v) > 2 else F.lit(""), s[1])), "bool"),
            "REPLACE": lambda: Val(F.regexp_replace(s[0], F.concat(F.lit(f"(?{args[3].value})") if len(v) > 3 else F.lit(""), s[1]), s[2]), "str"),
            "ENCODE_FOR_URI": lambda: Val(F.replace(F.url_encode(s[0]), F.lit("+"), F.lit("%20")), "str"),
            "ABS": lambda: Val(F.abs(n()), "num"), "CEIL": lambda: Val(F.ceil(n()), "num"), "FLOOR": lambda: Val(F.floor(n()), "num"), "ROUND": lambda: Val(F.floor(n() + 0.5), "num"), "RAND": lambda: Val(F.rand(), "num"),
            "NOW": lambda: Val(now(), "str"), "YEAR": lambda: Val(F.year(when()), "num"), "MONTH": lambda: Val(F.month(when()), "num"), "DAY": lambda: Val(F.day(when()), "num"),
            "HOURS": lambda: Val(F.hour(when()), "num"), "MINUTES": lambda: Val(F.minute(when()), "num"), "SECONDS": lambda: Val(F.second(when()), "num"), "TZ": lambda: Val(F.regexp_extract(s[0], r"(Z|[+-]\d\d:\d\d)$", 1), "str"),
            "ISIRI": lambda: Val(kind() == "iri", "bool"), "ISURI": lambda: Val(kind() == "iri", "bool"), "ISLITERAL": lambda: Val(kind() == "lit", "bool"), "ISBLANK": lambda: Val(kind() == "bnode", "bool"),
            "ISNUMERIC": lambda: Val(v[0].d.isin(*NUMERIC) if v[0].typ == "term" else F.lit(v[0].typ == "num"), "bool"),
            "DATATYPE": lambda: Val(v[0].d if v[0].typ == "term" else F.lit(lit.get(v[0].typ)), "iri"), "LANG": lambda: Val(F.coalesce(v[0].l, F.lit("")) if v[0].typ == "term" else F.lit(""), "str"),
            "LANGMATCHES": lambda: Val(F.when(s[1] == "*", s[0] != "").otherwise(F.lower(s[0]).startswith(F.lower(s[1]))), "bool"),
            "SAMETERM": lambda: Val(s[0].eqNullSafe(s[1]) & kind(0).eqNullSafe(kind(1)), "bool"), "IRI": lambda: Val(s[0], "iri"), "URI": lambda: Val(s[0], "iri"),
            "STRDT": lambda: Val(s[0], "term", F.lit("lit"), s[1], F.lit(None).cast("string")), "STRLANG": lambda: Val(s[0], "term", F.lit("lit"), F.lit(None).cast("string"), s[1]),
            "BNODE": lambda: Val(F.concat(F.lit("_:"), s[0] if s else F.uuid()), "term", F.lit("bnode"), F.lit(None).cast("string"), F.lit(None).cast("string")),
            "UUID": lambda: Val(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"), "STRUUID": lambda: Val(F.uuid(), "str"),
            "MD5": lambda: Val(F.md5(s[0]), "str"), "SHA1": lambda: Val(F.sha1(s[0]), "str"), "SHA256": lambda: Val(F.sha2(s[0], 256), "str"), "SHA384": lambda: Val(F.sha2(s[0], 384), "str"), "SHA512": lambda: Val(F.sha2(s[0], 512), "str"),
        }
        if name not in table:
            raise SparqlError(f"unknown function {name}")
        return table[name]()

    @staticmethod
    def flags(args: list) -> str:
        return "".join(c for c in args[2].value if c in "imsx")

    # solutions --------------------------------------------------------------------------------------------------------
    @staticmethod
    def columns(names) -> list[str]:
        return [v + p for v in sorted(names) for p in _PARTS]

    def bound(self, df: DataFrame, name: str, v: Val) -> DataFrame:
        null = F.lit(None).cast("string")
        if v.typ == "term":
            parts = (self.text(v), v.k, v.d, v.l)
        elif v.typ == "iri":
            parts = (self.text(v), F.lit("iri"), null, null)
        else:
            parts = (self.text(v), F.lit("lit"), F.lit(XSD + {"num": "decimal", "bool": "boolean", "str": "string"}[v.typ]), null)
        ok = parts[0].isNotNull()
        return df.withColumns({name + p: parts[0] if p == "" else F.when(ok, c) for p, c in zip(_PARTS, parts)})

    def rows(self, names: list[str], rows: list[list]) -> Rel:
        data = []
        for r in rows:
            flat: list = []
            for t in r:
                flat += [None] * 4 if t is None else [t.value, "iri", None, None] if isinstance(t, Iri) else [t.value, "lit", t.dt, t.lang]
            data.append(tuple(flat))
        schema = ", ".join(f"`{n + p}` string" for n in names for p in _PARTS)
        maybe = {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}
        return Rel(self.spark.createDataFrame(data, schema), set(names), maybe)

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("#unit"))

    def join(self, a: Rel, b: Rel, how: str = "inner", on: list = (), keep: bool = True) -> Rel:
        """Compatible merge of two sequences; ``on`` has expressions over both for the condition. ``how`` may also be "minus"."""
        if a.df is None and how == "inner" and not on:
            return b
        if b.df is None and not on and how != "minus":
            return a
        left = a.df if a.df is not None else self.unit()
        shared = sorted(a.vars & b.vars)
        self.n += 1
        tag = f"#r{self.n}"
        taken = {v + p for v in shared for p in _PARTS}
        right = b.df.select(*[F.col(f"`{c}`").alias(c + tag if c in taken else c) for c in self.columns(b.vars)]) if b.df is not None else self.unit()
        loose = [v for v in shared if v in a.maybe or v in b.maybe]
        same = {v: (F.col(f"`{v}`") == F.col(f"`{v}{tag}`")) & (F.col(f"`{v}#k`") == F.col(f"`{v}#k{tag}`")) for v in shared}
        free = {v: F.col(f"`{v}`").isNull() | F.col(f"`{v}{tag}`").isNull() for v in loose}
        rest = F.lit(True)
        if how == "minus":
            # solutions that share no bound variable are not taken away
            both = F.lit(False)
            for v in shared:
                both = both | (F.col(f"`{v}`").isNotNull() & F.col(f"`{v}{tag}`").isNotNull())
            rest, how = both, "left_anti"
        self.merged = dict.fromkeys(loose, tag)
        for e in on:
            rest = rest & F.coalesce(self.boolean(self.ev(e, a.vars | b.vars)), F.lit(False))
        self.merged = {}
        pivot = loose[0] if loose and len(loose) == len(shared) else None
        for v in shared:
            if v != pivot:
                rest = rest & (same[v] | free[v] if v in free else same[v])
        if pivot is None:
            joined = left.join(right, rest, how)
        else:
            joined = self.split_join(left, right, f"`{pivot}`", f"`{pivot}{tag}`", same[pivot] & rest, rest, how, pivot in a.maybe, pivot in b.maybe)
        if not keep:
            return Rel(joined, a.vars, a.maybe, a.types)
        names = a.vars | b.vars
        out = []
        for v in sorted(names):
            for p in _PARTS:
                c = F.col(f"`{v}{p}`")
                out.append((F.coalesce(c, F.col(f"`{v}{p}{tag}`")) if v in loose else c).alias(v + p))
        maybe = (a.maybe & b.maybe) | (a.maybe - b.vars) | (b.maybe - a.vars)
        if how == "left":
            maybe = a.maybe | (b.vars - a.vars) | (a.maybe & b.vars)
        types = {v: t for v, t in ({**b.types, **a.types}).items() if v not in shared or a.types.get(v) == b.types.get(v) or how == "left" and v in a.types and v not in a.maybe}
        return Rel(joined.select(*out), names, maybe, types)

    def product(self, left: DataFrame, right: DataFrame, rest: Column) -> DataFrame:
        """All pairs that ``rest`` holds for, in one task a tile: rows of few values on either side, which a columnar file holds as a dictionary
        and short runs, where rows of all values would be written out one by one."""
        sides = left.select(F.lit(0).alias("side")).unionByName(right.select(F.lit(1).alias("side")))
        rows = dict(map(tuple, sides.groupBy("side").count().collect()))
        left, right = (df.repartition(min(MOST_PIECES, -(-rows.get(i, 1) // TILE[i]))) for i, df in enumerate((left, right)))
        return left.join(right.hint("shuffle_replicate_nl") if self.unfiltered else right, rest, "inner")

    def split_join(self, left: DataFrame, right: DataFrame, x: str, y: str, equal: Column, rest: Column, how: str, left_loose: bool, right_loose: bool) -> DataFrame:
        """A join whose one key may be null, which fits everything: bound rows meet bound rows by the key, the others by ``rest`` alone."""
        bound_l, open_l = left.where(f"{x} IS NOT NULL") if left_loose else left, left.where(f"{x} IS NULL") if left_loose else None
        bound_r, open_r = right.where(f"{y} IS NOT NULL") if right_loose else right, right.where(f"{y} IS NULL") if right_loose else None
        if how in ("inner", "left"):
            out = bound_l.join(bound_r, equal, "inner")
            if open_r is not None:
                out = out.unionByName(self.product(bound_l, open_r, rest))
            if open_l is not None:
                out = out.unionByName(self.product(open_l, right, rest) if how == "inner" else open_l.join(right, rest, how))
            if how == "left":
                alone = bound_l.join(bound_r, equal, "left_anti")
                alone = alone.join(open_r, rest, "left_anti") if open_r is not None else alone
                out = out.unionByName(alone, allowMissingColumns=True)
            return out
        if how == "left_semi":
            out = bound_l.join(bound_r, equal, "left_semi")
            if open_r is not None:
                out = out.unionByName(bound_l.join(bound_r, equal, "left_anti").join(open_r, rest, "left_semi"))
            return out if open_l is None else out.unionByName(open_l.join(right, rest, "left_semi"))
        out = bound_l.join(bound_r, equal, "left_anti")
        out = out.join(open_r, rest, "left_anti") if open_r is not None else out
        return out if open_l is None else out.unionByName(open_l.join(right, rest, "left_anti"))

    # patterns ---------------------------------------------------------------------------------------------------------
    def pattern(self, s, p, o, graph) -> Rel:
        df = self.triples if graph is None else self.quads
        names: dict[str, list[str]] = {}
        test = F.lit(True)
        if graph is not None:
            if isinstance(graph, Var):
                names.setdefault(graph.name, []).append("g")
            else:
                test = test & (F.col("g") == graph.value)
        for term, c in ((s, "s"), (p, "p"), (o, "o")):
            if isinstance(term, Var):
                names.setdefault(term.name, []).append(c)
            elif isinstance(term, Iri):
                test = test & (F.col(c) == term.value)
                if c == "o":
                    test = test & (F.col("o_kind") == "iri")
            else:
                test = test & (F.col("o_kind") == "lit")
                if term.dt in NUMERIC:
                    # one value has many spellings
                    test = test & (F.col("o_dt") == term.dt) & (F.col("o").try_cast("double") == float(term.value))
                elif term.lang:
                    test = test & (F.col("o") == term.value) & (F.lower("o_lang") == term.lang)
                else:
                    test = test & (F.col("o") == term.value) & (F.col("o_dt") == term.dt)
        out = []
        null = F.lit(None).cast("string")
        for v, cs in names.items():
            for c in cs[1:]:
                test = test & (F.col(cs[0]) == F.col(c))
            c = cs[0]
            kinds = (F.col("o_kind"), F.col("o_dt"), F.col("o_lang")) if c == "o" else (F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri"), null, null)
            out += [F.col(c).alias(v), kinds[0].alias(v + "#k"), kinds[1].alias(v + "#d"), kinds[2].alias(v + "#l")]
        types = {o.name: "bigint"} if isinstance(o, Var) and isinstance(p, Iri) and p.value in _INTEGER else {}
        hit = df.where(test).select(*out) if out else df.where(test).select(F.lit(1).alias("#unit")).limit(1)
        return Rel(hit, set(names), set(), types)

    def edges(self, path, graph) -> DataFrame:
        """(g, src, dst) of a path without repetition at its top; g is the graph where a variable stands for it, else null."""
        each = isinstance(graph, Var)
        q = self.triples if graph is None else self.quads.where(F.col("g") == graph.value) if isinstance(graph, Iri) else self.quads
        home = F.col("g") if each else F.lit(None).cast("string").alias("g")
        if isinstance(path, Iri):
            return q.where(F.col("p") == path.value).select(home, F.col("s").alias("src"), F.col("o").alias("dst"))
        op = path[0]
        if op == "inv":
            return self.edges(path[1], graph).select("g", F.col("dst").alias("src"), F.col("src").alias("dst"))
        if op == "alt":
            out = self.edges(path[1][0], graph)
            for p in path[1][1:]:
                out = out.unionByName(self.edges(p, graph))
            return out
        if op == "seq":
            out = self.edges(path[1][0], graph)
            for p in path[1][1:]:
                nxt = self.edges(p, graph).select(F.col("g").alias("g2"), F.col("src").alias("mid"), F.col("dst").alias("end"))
                meet = F.col("dst") == F.col("mid")
                out = out.join(nxt, meet & (F.col("g") == F.col("g2")) if each else meet).select("g", "src", F.col("end").alias("dst"))
            return out
        if op == "not":
            forward, back = [x for x in path[1] if isinstance(x, str)], [x[1] for x in path[1] if not isinstance(x, str)]
            parts = []
            if forward:
                parts.append(q.where(~F.col("p").isin(*forward)).select(home, F.col("s").alias("src"), F.col("o").alias("dst")))
            if back:
                parts.append(q.where(~F.col("p").isin(*back)).select(home, F.col("o").alias("src"), F.col("s").alias("dst")))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if op == "rep":
            return self.repeated(self.edges(path[2], graph), path[1], None, None, each)
        raise SparqlError(f"no path {op}")

    @staticmethod
    def repeated(edges: DataFrame, mode: str, sources: DataFrame | None, targets: DataFrame | None, each: bool = False) -> DataFrame:
        """(g, src, dst) of one or more (``+``), any (``*``) or at most one (``?``) steps, from ``sources`` or into ``targets`` (one column
        node) where they are given; then only nodes in touch with them are walked, from the side that is given. With both ends free the
        result has a row for every connected pair. With ``each`` a path stays in its graph."""
        sep = "\x1f"
        null = F.lit(None).cast("string")
        if each:
            edges = edges.select(F.concat_ws(sep, "g", "src").alias("src"), F.concat_ws(sep, "g", "dst").alias("dst"), F.col("g"))
            graphs = edges.select("g").distinct()
        edges = edges.select("src", "dst")
        back = targets is not None
        given = targets if back else sources
        if given is not None and each:
            given = given.join(graphs, F.lit(True)).select(F.concat_ws(sep, "g", "node").alias("node"))
        ends = given.select("node").distinct() if given is not None else edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        near, far = ("dst", "src") if back else ("src", "dst")
        if mode == "?":
            pairs = edges.distinct().join(ends.withColumnRenamed("node", near), near, "left_semi").select("src", "dst")
        else:
            found = closure(edges.select(F.col(near).alias("src"), F.col(far).alias("dst")), ends)
            pairs = found.select(F.col("start").alias(near), F.col("node").alias(far)).select("src", "dst")
        if mode != "+":
            pairs = pairs.unionByName(ends.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
        if not each:
            return pairs.select(null.alias("g"), "src", "dst")
        plain = lambda c: F.substring(F.col(c), F.length(F.substring_index(c, sep, 1)) + 2, F.lit(1 << 30)).alias(c)
        return pairs.select(F.substring_index("src", sep, 1).alias("g"), plain("src"), plain("dst"))

    def path(self, rel: Rel, s, p, o, graph) -> Rel:
        each = isinstance(graph, Var)
        if isinstance(p, tuple) and p[0] == "rep":
            ends = {}
            for side, t in (("sources", s), ("targets", o)):
                if isinstance(t, Var):
                    if rel.df is not None and t.name in rel.vars and t.name not in rel.maybe:
                        ends[side] = rel.df.select(F.col(f"`{t.name}`").alias("node")).distinct()
                else:
                    ends[side] = self.spark.createDataFrame([(t.value,)], "node string")
            # a constant end is the smaller one
            use = "sources" if "sources" in ends and ("targets" not in ends or not isinstance(s, Var)) else "targets"
            pairs = self.repeated(self.edges(p[2], graph), p[1], ends.get("sources") if use == "sources" else None, ends.get("targets") if use == "targets" else None, each)
            other = "targets" if use == "sources" else "sources"
            if other in ends:  # the end that was not walked from
                col = "dst" if other == "targets" else "src"
                pairs = pairs.join(ends[other].withColumnRenamed("node", col), col, "left_semi").select("g", "src", "dst")
        else:
            pairs = self.edges(p, graph)
        test = F.lit(True)
        out = []
        null = F.lit(None).cast("string")
        kinds = self.triples.select(F.col("o").alias("dst"), "o_kind", "o_dt", "o_lang").where("o_kind <> 'iri'").distinct() if isinstance(o, Var) else None
        if kinds is not None:
            pairs = pairs.join(kinds, "dst", "left")
        names: dict[str, str] = {}
        for t, c in ((graph, "g"),) * each + ((s, "src"), (o, "dst")):
            if not isinstance(t, Var):
                test = test & (F.col(c) == t.value)
            elif t.name in names:
                test = test & (F.col(names[t.name]) == F.col(c))
            else:
                names[t.name] = c
                k = (F.coalesce("o_kind", F.lit("iri")), F.col("o_dt"), F.col("o_lang")) if c == "dst" else (F.lit("iri"), null, null)
                out += [F.col(c).alias(t.name), k[0].alias(t.name + "#k"), k[1].alias(t.name + "#d"), k[2].alias(t.name + "#l")]
        found = pairs.where(test)
        return self.join(rel, Rel(found.select(*out) if out else found.select(F.lit(1).alias("#unit")).limit(1), set(names)))

    def bgp(self, rel: Rel, triples: list, graph, filters: list) -> Rel:
        simple = [t for t in triples if isinstance(t[1], Var | Iri)]
        paths = [t for t in triples if not isinstance(t[1], Var | Iri)]
        while simple:
            known = rel.vars
            of = lambda t: {x.name for x in t if isinstance(x, Var)}
            # a pattern that shares a variable comes first, among those the one with most constants
            t = min(simple, key=lambda t: (bool(known) and not of(t) & known, len(of(t))))
            simple.remove(t)
            rel = self.join(rel, self.pattern(*t, graph))
        for e in list(filters):
            if paths and not _has(e, "exists") and _expr_vars(e) and _expr_vars(e) <= rel.vars - rel.maybe:
                rel = Rel(rel.df.where(self.boolean(self.ev(e, rel.vars))), rel.vars, rel.maybe, rel.types)
        for t in paths:
            rel = self.path(rel, *t, graph)
        return rel

    def group(self, elements: list, graph=None, filters_out: list | None = None) -> Rel:
        """The solutions of a group. With ``filters_out`` its own filters are handed to the caller, who joins it as optional."""
        rel = Rel(None)
        filters = [e[1] for e in elements if e[0] == "filter"]
        for e in elements:
            match e:
                case ("bgp", triples):
                    rel = self.bgp(rel, triples, graph, filters if filters_out is None else [])
                case ("filter", _):
                    pass
                case ("group", inner):
                    rel = self.join(rel, self.group(inner, graph))
                case ("subselect", q):
                    rel = self.join(rel, self.select(q, graph, final=False))
                case ("union", groups):
                    rel = self.join(rel, self.union([self.group(x, graph) for x in groups]))
                case ("optional", inner):
                    on: list = []
                    rel = self.join(rel, self.group(inner, graph, on), "left", on)
                case ("minus", inner):
                    b = self.group(inner, graph)
                    if rel.vars & b.vars:
                        rel = self.join(rel, b, "minus", keep=False)
                case ("graph", g, inner):
                    rel = self.join(rel, self.group(inner, g))
                case ("bind", expr, name):
                    df = rel.df if rel.df is not None else self.unit()
                    v = self.ev(expr, rel.vars)
                    types = rel.types | ({name: self.type_of(df, v)} if v.typ in ("num", "bool") else {})
                    rel = Rel(self.bound(df, name, v), rel.vars | {name}, rel.maybe | {name}, types)
                    rel.df = rel.df.select(*[f"`{c}`" for c in self.columns(rel.vars)])
                case ("values", names, rows):
                    rel = self.join(rel, self.rows(names, rows))
                case _:
                    raise SparqlError(f"no pattern {e[0]}")
        if filters_out is not None:
            plain = [f for f in filters if not _has(f, "exists")]
            filters_out += plain
            filters = [f for f in filters if _has(f, "exists")]
        return self.filtered(rel, filters, graph)

    def filtered(self, rel: Rel, filters: list, graph) -> Rel:
        for f in filters:
            for part in self.conjuncts(f):
                negated, e = False, part
                while e[0] == "not" if isinstance(e, tuple) else False:
                    negated, e = not negated, e[1]
                if isinstance(e, tuple) and e[0] == "exists":
                    on: list = []
                    inner = self.group(e[1], graph, on)
                    rel = self.join(rel, inner, "left_anti" if negated else "left_semi", on, keep=False)
                elif _has(part, "exists"):
                    rel = self.marked(rel, part, graph)
                else:
                    df = rel.df if rel.df is not None else self.unit()
                    rel = Rel(df.where(self.boolean(self.ev(part, rel.vars))), rel.vars, rel.maybe, rel.types)
        return rel

    def marked(self, rel: Rel, e, graph) -> Rel:
        """Rows for which a condition with EXISTS among its parts holds: every EXISTS becomes a flag, decided once per distinct solution of
        the variables it shares and joined back by them."""
        df = rel.df if rel.df is not None else self.unit()
        flags: list[str] = []

        def flagged(x):
            nonlocal df
            if isinstance(x, list):
                return [flagged(y) for y in x]
            if not isinstance(x, tuple) or not x:
                return x
            if x[0] != "exists":
                return tuple(flagged(y) for y in x)
            on: list = []
            inner = self.group(x[1], graph, on)
            self.n += 1
            flag = f"#e{self.n}"
            shared = sorted(rel.vars & (inner.vars | _expr_vars(on)))
            if not shared:
                hit = inner.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(flag)) if inner.df is not None else self.unit().select(F.lit(True).alias(flag))
                df = df.crossJoin(F.broadcast(hit))  # one row
            else:
                cols = self.columns(shared)
                each = Rel(df.select(*[F.col(f"`{c}`") for c in cols]).distinct(), set(shared), rel.maybe & set(shared))
                hit = self.join(each, inner, "left_semi", on, keep=False).df
                hit = hit.select(*[F.col(f"`{c}`").alias(c + flag) for c in cols], F.lit(True).alias(flag))
                test = F.lit(True)
                for c in cols:
                    test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}{flag}`"))
                df = df.join(hit, test, "left").drop(*[c + flag for c in cols])
            flags.append(flag)
            return ("flag", flag)

        test = flagged(e)
        return Rel(df.where(self.boolean(self.ev(test, rel.vars))).drop(*flags), rel.vars, rel.maybe, rel.types)

    @staticmethod
    def type_of(df: DataFrame, v: Val) -> str:
        return df.select(v.col.alias("x")).schema["x"].dataType.simpleString()

    def conjuncts(self, e) -> list:
        return self.conjuncts(e[1]) + self.conjuncts(e[2]) if isinstance(e, tuple) and e[0] == "and" else [e]

    def union(self, parts: list[Rel]) -> Rel:
        names = set().union(*[p.vars for p in parts])
        null = F.lit(None).cast("string")
        dfs = [(p.df if p.df is not None else self.unit()).select(*[F.col(f"`{v}{x}`") if v in p.vars else null.alias(v + x) for v in sorted(names) for x in _PARTS]) for p in parts]
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
        maybe = set().union(*[p.maybe for p in parts]) | {v for v in names if any(v not in p.vars for p in parts)}
        kinds = {v: {p.types.get(v) for p in parts if v in p.vars} for v in names}
        return Rel(out, names, maybe, {v: next(iter(k)) for v, k in kinds.items() if len(k) == 1 and None not in k})

    # forms ------------------------------------------------------------------------------------------------------------
    def select(self, q: Select, graph=None, final: bool = True):
        rel = self.group(q.where, graph)
        if q.values:
            rel = self.join(rel, self.rows(*q.values))
        df = rel.df if rel.df is not None else self.unit()
        env = set(rel.vars)
        if not q.items and q.form == "select" and not q.group:
            q.items = [(v, None) for v in sorted(env) if not v.startswith("_")]
        grouped = bool(q.group) or any(_has(e, "agg") for _, e in q.items) or any(_has(h, "agg") for h in q.having)
        typed: dict[str, str] = {}
        if grouped:
            keys: list[str] = []
            for i, (alias, e) in enumerate(q.group):
                if isinstance(e, Var):
                    if e.name not in env:
                        df = self.bound(df, e.name, self.ev(e, env))
                        env.add(e.name)
                    keys.append(e.name)
                else:
                    name = alias or f"#g{i}"
                    df = self.bound(df, name, self.ev(e, env))
                    env.add(name)
                    keys.append(name)
            aggs: dict[str, Val] = {n: self.ev(e, env) for n, e in q.items if e is not None}
            extra = {f"#h{i}": self.boolean(self.ev(h, env)) for i, h in enumerate(q.having)}
            order = {f"#o{i}": self.ev(e, env) for i, (_, e) in enumerate(q.order) if _has(e, "agg")}
            cols = [v.col.alias("#a" + n) for n, v in aggs.items()] + [c.alias(n) for n, c in extra.items()] + [v.col.alias(n) for n, v in order.items()]
            df = df.groupBy(*[F.col(f"`{c}`") for c in self.columns(keys)]).agg(*(cols or [F.count(F.lit(1)).alias("#n")]))
            for n in extra:
                df = df.where(F.col(n))
            names = set(keys)
            for n, v in aggs.items():
                if v.typ == "num":
                    typed[n] = "#a" + n
                df = self.bound(df, n, Val(F.col("#a" + n), v.typ if v.typ != "term" else "str"))
                names.add(n)
            env = names
        else:
            for n, e in q.items:
                if e is not None:
                    v = self.ev(e, env)
                    df = self.bound(df, n, v)
                    if v.typ in ("num", "bool"):
                        df = df.withColumn("#a" + n, v.col)
                        typed[n] = "#a" + n
                    env.add(n)
                elif n not in env:
                    df = self.bound(df, n, self.ev(Var(n), set()))
                    env.add(n)
        chosen = [n for n, _ in q.items]
        types = {n: rel.types[n] for n in chosen if n in rel.types and n not in typed}
        sort = []
        for i, (down, e) in enumerate(q.order):
            if isinstance(e, Var) and e.name in typed:
                c = F.col(f"`{typed[e.name]}`")
            elif isinstance(e, Var) and e.name in rel.types:
                c = F.col(f"`{e.name}`").try_cast(rel.types[e.name])
            elif grouped and _has(e, "agg"):
                c = F.col(f"#o{i}")
            else:
                v = self.ev(e, env)
                c = v.col
                if v.typ == "term":
                    sort.append((F.when(v.d.isin(*NUMERIC), self.num(v)), down))
            sort.append((c, down))
        keep = [f"`{c}`" for c in self.columns(chosen)] + [f"`{t}`" for t in typed.values()]
        if q.distinct:
            if all(isinstance(e, Var) and e.name in chosen for _, e in q.order):
                df = df.select(*keep).distinct()
            else:
                df = df.dropDuplicates([c.strip("`") for c in keep])
        if sort:
            df = df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in sort])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        if not final:
            types |= {n: df.schema[t].dataType.simpleString() for n, t in typed.items()}
            return Rel(df.select(*[f"`{c}`" for c in self.columns(chosen)]), set(chosen), {n for n in chosen if n in rel.maybe or n not in rel.vars}, types)
        return df.select(*[F.col(f"`{typed[n]}`").alias(n) if n in typed else F.col(f"`{n}`").try_cast(types[n]).alias(n) if n in types else F.col(f"`{n}`") for n in chosen])

    def run(self, q: Select) -> DataFrame:
        self.unfiltered = not (_has(q.where, "filter") or _has(q.where, "subselect"))
        if q.form == "select":
            return self.select(q)
        if q.form == "describe" and not q.where:
            names = [t.value for t in q.template if isinstance(t, Iri)]
            return self.triples.where(F.col("s").isin(*names) | (F.col("o").isin(*names) & (F.col("o_kind") == "iri")))
        rel = self.group(q.where)
        df = rel.df if rel.df is not None else self.unit()
        if q.form == "ask":
            return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        if q.form == "construct":
            return instantiate(self, Rel(df, rel.vars, rel.maybe), [(None, *t) for t in q.template], "").drop("g").distinct()
        nodes = [df.select(F.col(f"`{t.name}`").alias("n")) if isinstance(t, Var) else self.spark.createDataFrame([(t.value,)], "n string") for t in q.template]
        wanted = nodes[0]
        for n in nodes[1:]:
            wanted = wanted.unionByName(n)
        wanted = wanted.distinct()
        return self.triples.join(wanted, F.col("s") == F.col("n"), "left_semi").unionByName(self.triples.where("o_kind = 'iri'").join(wanted, F.col("o") == F.col("n"), "left_semi")).distinct()


def instantiate(c: Compiler, rel: Rel, template: list[tuple], graph: str) -> DataFrame:
    """Quads of a template for every solution; a quad with an unbound part is left out."""
    null = F.lit(None).cast("string")
    out = None
    for g, s, p, o in template:
        def part(t, which: str = ""):
            if isinstance(t, Var):
                return F.col(f"`{t.name}{which}`") if t.name in rel.vars else null
            if which == "":
                return F.lit(t.value)
            return F.lit({"#k": "iri" if isinstance(t, Iri) else "lit", "#d": getattr(t, "dt", None), "#l": getattr(t, "lang", None)}[which]).cast("string")

        row = rel.df.select(
            (part(g) if g is not None else F.lit(graph)).alias("g"), part(s).alias("s"), part(p).alias("p"), part(o).alias("o"), part(o, "#k").alias("o_kind"), part(o, "#d").alias("o_dt"), part(o, "#l").alias("o_lang")
        ).where("g IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else c.quads.limit(0)


def query(quads: DataFrame, text: str) -> DataFrame:
    """The result of a SPARQL query over a quad table. SELECT gives a column per variable, null where unbound, numbers typed; ASK
    one row (ask); CONSTRUCT and DESCRIBE triples. Well-known prefixes need no declaration."""
    q = Parser(text).query()
    return Compiler(quads, q.dataset).run(q)
