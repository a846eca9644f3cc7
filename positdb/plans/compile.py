"""Compiles a search to one lazy DataFrame.

Every pattern is a scan of the partitions whose roles hold the pattern's, with filters and an optional snapshot; patterns
are joined from left to right on what they share; conditions follow as filters, which the optimiser moves into scans and
joins where the meaning allows (never below a snapshot).

Columns of the joined table: ``i_x`` the thing or posit of variable x; ``x_pid`` and the value columns of a value
variable (prefix ``v_x_``) or the time columns of a time variable (``t_x_``); ``pid_k`` and ``member_k``, pattern k's posit and
union members, for the order of rows.
"""

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from positdb.errors import ExecutionError
from positdb.functions import times, values
from positdb.functions.times import Time
from positdb.functions.values import Value
from positdb.operators import temporal
from positdb.plans.syntax import Condition, Pattern, Search
from positdb.sources.store import Bounds, PositStore

VALUE_FIELDS = ("vt", "v_text", "v_key", "v_num", "v_cert", "v_prec", "v_lo", "v_hi")
TIME_FIELDS = ("t_prec", "t_lo", "t_hi", "t_text")
ORDERING = {"<", "<=", ">", ">="}


@dataclass
class Binding:
    """What a variable of a script stands for before a search: a list of ids or a table of them."""

    ids: list[int] | DataFrame
    added: bool = False  # by ``add posit``: then even ``+x`` is held to it


@dataclass
class Compiled:
    df: DataFrame  # result: display texts and ids, with ``<column>__type``
    typed: DataFrame  # result in types of its own
    joined: DataFrame  # before projection
    kinds: dict[str, str]
    columns: tuple[str, ...]
    limit: int | None


@dataclass
class Compiler:
    store: PositStore
    scope: dict[str, Binding]
    kinds: dict[str, str] = field(default_factory=dict)  # variable -> thing, value or time
    types: dict[str, set[int]] = field(default_factory=dict)  # of value variables
    orders: list[str] = field(default_factory=list)
    bound: DataFrame | None = None
    where: tuple[Condition, ...] = ()

    # -- patterns --------------------------------------------------------------------------------------------------
    def kind(self, name: str, kind: str) -> bool:
        """Registers a variable; whether it was there before."""
        before = self.kinds.setdefault(name, kind)
        if before != kind:
            raise ExecutionError(f"Variable '{name}' stands for a {before} and a {kind}")
        return name in self.types or f"!{name}" in self.kinds

    def held(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` where ``column`` is one of the ids that the script bound ``name`` to."""
        ids = self.scope[name].ids
        if isinstance(ids, list):
            return df.where(F.col(column).isin(ids)) if ids else df.where(F.lit(False))
        return df.join(ids.toDF("__id"), F.col(column) == F.col("__id"), "left_semi")

    def bounds(self, p: Pattern) -> Bounds:
        """What conditions and literals say of a pattern's posits before any snapshot is taken."""
        low: dict[str, list] = {"begin": [], "number": [], "certainty": []}
        high: dict[str, list] = {"begin": [], "number": [], "certainty": []}
        ends: list[int] = []
        if isinstance(p.time, Time):
            low["begin"].append(p.time.lo), high["begin"].append(p.time.lo)
        if isinstance(p.as_of, Time):
            high["begin"].append(p.as_of.hi)
        for c in self.where if p.as_of is None else ():
            right = c.right
            if not isinstance(right, Value) or c.var not in (p.time, p.value):
                continue
            if c.var == p.time and right.vt == values.TIME:
                t, field = right.time, "begin"
                below, above = (t.lo, t.lo) if c.op == "=" else (t.hi, t.hi)
                if c.op == ">=":
                    ends.append(t.lo)
                    continue
            elif c.var == p.value and right.vt in values.NUMBERS and right.num is not None:
                field, below, above = "number", right.num, right.num
            elif c.var == p.value and right.vt == values.CERTAINTY:
                field, below, above = "certainty", right.cert, right.cert
            else:
                continue
            if c.op in (">", ">=", "="):
                low[field].append(below)
            if c.op in ("<", "<=", "="):
                high[field].append(above)
        return Bounds(*[(max(low[f], default=None), min(high[f], default=None)) for f in ("begin", "number", "certainty")], max(ends, default=None))

    def scan(self, p: Pattern) -> tuple[DataFrame, set[int], tuple[str, ...]]:
        """Candidates with their things in ``s_0``, ``s_1``, ..., their value types, and the roles if all have the same.

        Filters on value and identity are not yet applied.
        """
        slots = p.slots or ()
        sets = self.store.matching(s.role for s in slots if s.role)
        roles = tuple(sets[0].split("|")) if len(sets) == 1 else ()
        df = self.store.posits(sets, self.bounds(p))
        if isinstance(p.time, Time):
            df = df.where((F.col("t_prec") == p.time.prec) & (F.col("t_lo") == p.time.lo))
        if isinstance(p.as_of, Time):
            # One set of roles: its things tell sets of appearances apart.
            df = temporal.snapshot(df, p.as_of.hi, [F.col("apps").getItem(r) for r in roles] or ["aset_key"])
        if isinstance(p.value, Value):
            df = df.where((F.col("vt") == p.value.vt) & (F.col("v_key") == p.value.key))
        for i, s in enumerate(slots):
            if s.role:
                df = df.withColumn(f"s_{i}", F.col("apps").getItem(s.role))
            else:
                df = df.withColumn(f"s_{i}", F.explode(F.map_values("apps")))
        return df.drop("apps"), set().union(*[self.store.types[s] for s in sets]) if sets else set(), roles

    def pattern(self, k: int, p: Pattern) -> None:
        df, vts, roles = self.scan(p)
        slots = p.slots or ()
        before = set(self.kinds)
        unions = [(i, s) for i, s in enumerate(slots) if len(s.names) > 1]
        named = [(i, s) for i, s in enumerate(slots) if len(s.names) == 1]
        for i, s in named:
            name = s.names[0]
            inside = name in before or any(t.names == s.names for _, t in named if _ < i) or name == p.var
            if not s.fresh and not inside and name not in self.scope:
                raise ExecutionError(f"Variable '{name}' is used as a recall but is not bound in a prior command")
            if name not in before and name in self.scope and (not s.fresh or self.scope[name].added):
                df = self.held(df, f"s_{i}", name)
            self.kind(name, "thing")
        branches = []
        bound = {c[2:] for c in self.bound.columns if c.startswith("i_")} if self.bound is not None else set()
        spread = bool(unions) and all(n in bound for _, s in unions for n in s.names)
        if spread:
            # All members are bound: each row asks for them in turn, in one join, instead of a plan for each of them.
            columns = {f"!{i}": f"s_{i}" for i, _ in unions}
            for i, s in named:
                if s.names[0] in columns:
                    df = df.where(F.col(columns[s.names[0]]) == F.col(f"s_{i}"))
                else:
                    columns[s.names[0]] = f"s_{i}"
            number = F.lit(0)
            for i, s in unions:
                members = [F.struct(F.lit(n).alias("n"), F.col(f"i_{name}").alias("thing")) for n, name in enumerate(s.names)]
                self.bound = self.bound.withColumn("__u", F.explode(F.array(*members))).withColumn(f"i_!{i}", F.col("__u.thing")).withColumn(f"__n_{i}", F.col("__u.n")).drop("__u")
                number = number * len(s.names) + F.col(f"__n_{i}")
            self.bound = self.bound.withColumn(f"member_{k}", number).drop(*[f"__n_{i}" for i, _ in unions])
            branches.append((df, columns))
        for choice in () if spread else product(*[s.names for _, s in unions]):
            one, columns = df, {}
            for (i, s), name in zip(unions, choice):
                if name not in before and name in self.scope:
                    one = self.held(one, f"s_{i}", name)
            for i, name in [(i, s.names[0]) for i, s in named] + [(i, n) for (i, _), n in zip(unions, choice)]:
                if name in columns:
                    one = one.where(F.col(columns[name]) == F.col(f"s_{i}"))  # the same thing in both roles
                else:
                    columns[name] = f"s_{i}"
            branches.append((one, columns))
        for _, s in [*named, *unions]:
            for name in s.names:
                self.kind(name, "thing")
        if p.var:
            self.kind(p.var, "thing")
        value = p.value if isinstance(p.value, str) else None
        time = p.time if isinstance(p.time, str) else None
        if value and value == time:
            raise ExecutionError(f"Variable '{value}' stands for a value and a time")
        if value:
            self.kind(value, "value")
            self.types[value] = self.types.get(value, set()) | vts
        if time:
            self.kind(time, "time")
        if isinstance(p.as_of, str) and (self.bound is None or self.kinds.get(p.as_of) != "time" or p.as_of not in before):
            raise ExecutionError(f"'as of {p.as_of}' needs a time variable of an earlier pattern")
        out = None
        for n, (one, columns) in enumerate(branches):
            joined = self.join(k, p, one, columns, value, time, roles)
            if spread:
                joined = joined.drop(*[f"i_!{i}" for i, _ in unions])
            elif unions:
                joined = joined.withColumn(f"member_{k}", F.lit(n))
            out = joined if out is None else out.unionByName(joined, allowMissingColumns=True)
        self.orders += [f"pid_{k}", *([f"member_{k}"] if unions else [])]
        self.bound = out

    def join(self, k: int, p: Pattern, df: DataFrame, columns: dict[str, str], value: str | None, time: str | None, roles: tuple[str, ...]) -> DataFrame:
        # Things of the row before settle the set of appearances: then its history is carried along, without pairs.
        settled = isinstance(p.as_of, str) and p.slots and sorted(s.role or "" for s in p.slots) == list(roles) and not p.var
        settled = settled and len(columns) == len(p.slots) and all(f"i_{name}" in self.bound.columns for name in columns)
        settled = settled and not any(f"x_{v}_pid" in self.bound.columns for v in (value, time) if v)
        if isinstance(p.as_of, str) and not settled:
            df = temporal.validity(df, [F.col(c) for c in columns.values()] if sorted(s.role or "" for s in p.slots or ()) == list(roles) and len(columns) == len(roles) else ["aset_key"])
        here = {f"i_{name}": F.col(c) for name, c in columns.items()}
        keep = df
        if p.var:
            if f"i_{p.var}" in here:
                keep = keep.where(here[f"i_{p.var}"] == F.col("posit_id"))
            here[f"i_{p.var}"] = F.col("posit_id")
        here[f"pid_{k}"] = F.col("posit_id")
        if value:
            here |= {f"x_{value}_pid": F.col("posit_id")} | {f"v_{value}_{c}": F.col(c) for c in VALUE_FIELDS}
        if time:
            here |= {f"x_{time}_pid": F.col("posit_id")} | {f"t_{time}_{c}": F.col(c) for c in TIME_FIELDS}
        if isinstance(p.as_of, str):
            here |= {"__lo": F.col("t_lo"), "__prec": F.col("t_prec")} if settled else {"__lo": F.col("t_lo"), "__next": F.col("next_lo")}
        right = keep.select(*[c.alias(n) for n, c in here.items()])
        if self.bound is None:
            return right
        left = self.bound
        # things, posits, and the posits that value and time variables were read from
        shared = [c for c in right.columns if c in left.columns and c.startswith(("i_", "x_"))]
        repeated = [c for c in right.columns if c in left.columns and c not in shared]
        right = right.drop(*repeated)
        if settled:
            return temporal.carried(left, f"t_{p.as_of}_t_hi", right, shared, "__lo", "__prec", f"pid_{k}").drop("__lo", "__prec")
        r = right.toDF(*[f"__r_{c}" if c in shared else c for c in right.columns])
        on = [F.col(c) == F.col(f"__r_{c}") for c in shared]
        if isinstance(p.as_of, str):
            on.append(temporal.valid_at(F.col(f"t_{p.as_of}_t_hi"), F.col("__lo"), F.col("__next")))
        if not on:
            return left.crossJoin(r)
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        return left.join(r, condition).drop(*[f"__r_{c}" for c in shared], "__lo", "__next")

    # -- conditions ------------------------------------------------------------------------------------------------
    def value(self, name: str, column: str) -> Column:
        return F.col(f"v_{name}_{column}")

    def span(self, name: str) -> tuple[Column, Column, Column]:
        """Precision and interval of a time variable, or of the times among a value variable's values."""
        if self.kinds[name] == "time":
            return tuple(F.col(f"t_{name}_{c}") for c in ("t_prec", "t_lo", "t_hi"))
        return tuple(self.value(name, c) for c in ("v_prec", "v_lo", "v_hi"))

    def no_order(self, types: set[int], numbers: bool) -> None:
        """Raises if values of these types can't be ordered against numbers (or certainties)."""
        if numbers and values.CERTAINTY in types:
            raise ExecutionError("Ordering comparison between a certainty and a number; a certainty needs a percent sign (%)")
        if types - values.NUMBERS - {values.CERTAINTY}:
            raise ExecutionError("Ordering comparison not allowed for this type")

    def condition(self, c: Condition) -> Column:
        left, right = self.kinds.get(c.var), c.right
        if isinstance(right, Value) and right.vt == values.TIME:
            if left == "thing":
                raise ExecutionError(f"Unknown variable in predicate: {c.var}")
            if left is None:
                return F.lit(False)  # no time to compare
            t = right.time
            return times.compare(c.op, self.span(c.var), (t.prec, t.lo, t.hi))
        if isinstance(right, str) and left == "time" and self.kinds.get(right) == "time":
            return times.compare(c.op, self.span(c.var), self.span(right))
        for name, kind in ((c.var, left), (right, self.kinds.get(right) if isinstance(right, str) else "value")):
            if kind in (None, "thing"):
                raise ExecutionError(f"Unknown variable in predicate: {name}")
        if left == "time" or isinstance(right, str) and self.kinds[right] == "time":
            raise ExecutionError(f"'{c.var}' and its counterpart are not both times")
        order = c.op in ORDERING
        op = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__"}[c.op]
        if isinstance(right, str):
            a, b = self.types[c.var], self.types[right]
            if order:
                mixed = {values.CERTAINTY in a, values.CERTAINTY in b} if a and b else {False}
                if mixed == {True, False} or any(values.CERTAINTY in x and x & values.NUMBERS for x in (a, b)):
                    raise ExecutionError("Ordering comparison not allowed between a certainty and a number; a certainty needs a percent sign (%)")
                self.no_order(a | b, numbers=False)
            if not order and a <= values.NUMBERS and b <= values.NUMBERS:
                return self.value(c.var, "v_key") == self.value(right, "v_key")  # the same text for equal numbers
            if not order and not (a & values.NUMBERS and b & values.NUMBERS):
                return self.value(c.var, "v_text") == self.value(right, "v_text")
            number = getattr(self.value(c.var, "v_num"), op)(self.value(right, "v_num"))
            certainty = getattr(self.value(c.var, "v_cert"), op)(self.value(right, "v_cert"))
            if order:
                return F.coalesce(number, certainty)
            return F.coalesce(number, self.value(c.var, "v_text") == self.value(right, "v_text"))
        if right.vt in values.NUMBERS:
            if order:
                self.no_order(self.types[c.var], numbers=True)
            if right.num is None:
                raise ExecutionError(f"{right.text} has more digits than comparisons support")
            return getattr(self.value(c.var, "v_num"), op)(F.lit(right.num).cast(values.NUMBER))
        if right.vt == values.CERTAINTY:
            return getattr(self.value(c.var, "v_cert"), op)(F.lit(right.cert))
        if order:
            raise ExecutionError("Ordering comparison not allowed for strings")
        return (self.value(c.var, "vt") == right.vt) & (self.value(c.var, "v_key") == right.key)

    # -- result ----------------------------------------------------------------------------------------------------
    def shown(self, name: str) -> list[Column]:
        kind = self.kinds[name]
        if kind == "thing":
            return [F.col(f"i_{name}").alias(name), F.lit("Thing").alias(f"{name}__type")]
        if kind == "time":
            return [F.col(f"t_{name}_t_text").alias(name), F.lit("Time").alias(f"{name}__type")]
        names = F.create_map(*[F.lit(x) for pair in values.NAMES.items() for x in pair])
        return [self.value(name, "v_text").alias(name), F.element_at(names, self.value(name, "vt").cast("int")).alias(f"{name}__type")]

    def typed(self, name: str) -> Column:
        kind, types = self.kinds[name], self.types.get(name, set())
        if kind == "thing":
            out = F.col(f"i_{name}")
        elif kind == "time":
            out = times.timestamp(F.col(f"t_{name}_t_lo"))
        elif types == {values.INTEGER}:
            out = self.value(name, "v_num").cast("long")
        elif types and types <= values.NUMBERS:
            out = self.value(name, "v_num")
        elif types == {values.CERTAINTY}:
            out = self.value(name, "v_cert")
        elif types == {values.TIME}:
            out = times.timestamp(self.value(name, "v_lo"))
        else:
            out = self.value(name, "v_text")
        return out.alias(name)

    def search(self, s: Search) -> Compiled:
        self.where = s.where
        for k, p in enumerate(s.patterns):
            self.pattern(k, p)
        df = self.bound
        for c in s.where:
            df = df.where(self.condition(c))
        if missing := [n for n in s.returned if n not in self.kinds]:
            raise ExecutionError(f"Unknown variable in return: {missing[0]}")
        rows = df.orderBy(*self.orders).limit(s.limit) if s.limit is not None else df
        names = tuple(dict.fromkeys(s.returned))
        return Compiled(rows.select(*[c for n in names for c in self.shown(n)]), rows.select(*[self.typed(n) for n in names]), df, dict(self.kinds), names, s.limit)
