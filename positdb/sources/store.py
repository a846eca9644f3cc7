"""The store of posits: in memory or in a folder of Parquet files.

Posits are rows of one table, partitioned by their set of roles, so that a pattern's roles prune partitions.  Scripts
add few rows, which wait on the driver until they are read or written; tables are added as DataFrames (``add_frame``).
The catalog (roles, and the value types seen for each set of roles) is small and lives on the driver.
"""

import datetime as dt
import math
import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from positdb.errors import DataCorruption, ExecutionError, PersistenceError
from positdb.functions import times, values
from positdb.functions.times import Time
from positdb.functions.values import Value
from positdb.sources import ledger

RESERVED = ("posit", "ascertains", "thing", "classification")
SCHEMA = f"posit_id long, aset_key string, role_set string, apps map<string,long>, {values.COLUMNS}, t_prec tinyint, t_lo long, t_hi long, t_text string"
COLUMNS = ["posit_id", "aset_key", "role_set", "apps", *[c.split()[0] for c in values.COLUMNS.split(", ")], "t_prec", "t_lo", "t_hi", "t_text"]
IDENTITY = ["aset_key", "vt", "v_key", "t_prec", "t_lo"]


def aset_key(apps: Column) -> Column:
    """Canonical text of a set of appearances; maps themselves can't be grouped or joined on."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(apps)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def role_set(apps: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(apps)), "|")


@dataclass(frozen=True)
class Bounds:
    """Closed ranges outside which a reader wants no posits, None for open.

    Where times begin, numbers, certainties; and what times end at or after.
    """

    begin: tuple[int | None, int | None] = (None, None)
    number: tuple[Decimal | None, Decimal | None] = (None, None)
    certainty: tuple[int | None, int | None] = (None, None)
    ends: int | None = None


def between(column: Column, low, high) -> Column:
    """Whether a column is in a closed range; None for an open end."""
    out = F.lit(True)
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high)
    return out


@dataclass
class Shred:
    """How rows of a table become posits: a thing for each role, a value, a time and the posit's own id."""

    source: DataFrame
    appearances: dict[str, Column]
    vt: int
    value: Column
    posit_id: Column
    time: Column | None = None  # a timestamp without zone; None for the beginning of time
    prec: int = times.MOMENT
    repeats: bool = False  # rows may give equal posits, of which the smallest id stays

    @property
    def roles(self) -> str:
        return "|".join(sorted(self.appearances))

    def _within(self, bounds: Bounds) -> Column:
        """A condition on the table's own columns that no posit within ``bounds`` fails; it may hold for others."""
        out = F.lit(True)
        kind = lambda c: self.source.select(c.alias("c")).schema["c"].dataType
        begin = list(bounds.begin)
        if bounds.ends is not None:
            first = bounds.ends - (times.DAY - 1) * int(self.prec == times.DATE)
            begin[0] = first if begin[0] is None else max(begin[0], first)
        if self.time is not None and begin != [None, None]:
            of, ends = kind(self.time), []
            # Local times of a type with zone may repeat an hour: a day's margin.
            margin = times.DAY if isinstance(of, T.TimestampType) else 0
            for at, sign in zip(begin, (-1, 1)):
                shown = None if at is None else at + sign * margin
                if shown is None or not -62_135_596_800_000_000 + times.DAY < shown < 253_402_300_800_000_000 - times.DAY:
                    ends.append(None)  # beyond the calendar of tables
                else:
                    ends.append(F.lit(str(times.EPOCH + dt.timedelta(microseconds=shown))).cast("timestamp_ntz").cast(of))
            if isinstance(of, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                out = out & between(self.time, *ends)
        if self.vt in values.NUMBERS and bounds.number != (None, None):
            of, (low, high) = kind(self.value), bounds.number
            if isinstance(of, T.IntegralType):
                out = out & between(self.value, None if low is None else math.floor(low), None if high is None else math.ceil(high))
            elif isinstance(of, (T.DoubleType, T.FloatType)):
                slack = lambda x, sign: None if x is None else float(x) + sign * (1e-6 * abs(float(x)) + 1e-6)
                out = out & between(self.value, slack(low, -1), slack(high, 1))
        if self.vt == values.CERTAINTY and bounds.certainty != (None, None):
            low, high = bounds.certainty  # shares beyond 100 percent saturate
            out = out & between(self.value, None if low is not None and low <= -100 else low, None if high is not None and high >= 100 else high)
        return out

    def frame(self, bounds: Bounds | None = None) -> DataFrame:
        """The posits; with ``bounds`` others may be left out, by conditions that reach the table's reader."""
        if bounds and bounds != Bounds():
            # Equal posits are all within the bounds or all outside, so repeats are dropped afterwards.
            return replace(self, source=self.source.where(self._within(bounds))).frame()
        if self.repeats:
            return deduplicated(replace(self, repeats=False).frame())
        names = sorted(self.appearances)
        apps = F.create_map(*[x for r in names for x in (F.lit(r), self.appearances[r].cast("long"))])
        key = F.concat_ws("|", *[F.concat(F.lit(f"{r}="), self.appearances[r].cast("string")) for r in names])
        if self.time is None:
            prec, lo, hi, text = (F.lit(x) for x in (times.BOT, times.LOWEST, times.LOWEST, "BOT"))
        else:
            prec, lo = F.lit(self.prec), times.micros(self.time)
            hi, text = lo + (times.DAY - 1) * int(self.prec == times.DATE), times.shown(prec, lo)
        head = [self.posit_id.cast("long").alias("posit_id"), key.alias("aset_key"), F.lit(self.roles).alias("role_set"), apps.alias("apps")]
        tail = [prec.cast("tinyint").alias("t_prec"), lo.cast("long").alias("t_lo"), hi.cast("long").alias("t_hi"), text.alias("t_text")]
        return self.source.select(*head, *values.columns(self.vt, self.value), *tail)


def deduplicated(posits: DataFrame) -> DataFrame:
    """One posit for each set of appearances, value and time: that with the smallest id."""
    others = F.struct(*[F.col(c) for c in COLUMNS if c not in IDENTITY])
    found = posits.groupBy(*IDENTITY).agg(F.min_by(others, "posit_id").alias("o"))
    return found.select(*IDENTITY, "o.*").select(COLUMNS)


@dataclass
class PositStore:
    spark: SparkSession
    path: str | None = None
    roles: dict[str, int] = field(default_factory=dict)
    types: dict[str, set[int]] = field(default_factory=dict)
    last_id: int = 0

    def __post_init__(self) -> None:
        self.lock = threading.RLock()
        self.rows: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.frames: list[tuple[DataFrame | Shred, dict[str, set[int]]]] = []

    @classmethod
    def in_memory(cls, spark: SparkSession) -> "PositStore":
        store = cls(spark)
        for name in RESERVED:
            store.add_role(name)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "PositStore":
        """A store that writes what is added to ``path``; what is there already is restored.

        The ledger is verified: a posit that was changed, lost or added past the ledger raises ``DataCorruption``.
        """
        store = cls(spark, path.rstrip("/"))
        if store._exists("role"):
            store.roles = {r.role: r.role_id for r in store._read("role").collect()}
            store.last_id = max(store.roles.values(), default=0)
        if store._exists("posit"):
            posits = store._read("posit").select(COLUMNS)
            kinds = posits.groupBy("role_set").agg(F.collect_set("vt").alias("vt"), F.max("posit_id").alias("last"), F.max(F.array_max(F.map_values("apps"))).alias("thing")).collect()
            store.types = {r.role_set: set(r.vt) for r in kinds}
            store.last_id = max([store.last_id, *(max(r.last, r.thing) for r in kinds)])
            store.frames.append((posits, store.types))
            state = ledger.verify(store)
            if state["mismatches"] or state["entries"] != posits.count():
                raise DataCorruption(f"{path}: {state['mismatches']} of {state['entries']} ledger entries don't fit the posits, the first of posit {state['first']}")
        for name in RESERVED:
            store.add_role(name)
        return store

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:
            raise PersistenceError(f"{self.path}/{name} can't be read: {e}") from e

    # -- catalog ---------------------------------------------------------------------------------------------------
    def new_thing(self) -> int:
        self.last_id += 1
        return self.last_id

    def add_role(self, name: str) -> int:
        name = name.strip()
        if not name:
            raise ExecutionError("A role needs a name")
        if name not in self.roles:
            self.roles[name] = self.new_thing()
            if self.path:
                self.spark.createDataFrame([(self.roles[name], name, name in RESERVED)], "role_id long, role string, reserved boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/role")
        return self.roles[name]

    def role_table(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n, n in RESERVED) for n, i in self.roles.items()], "role_id long, role string, reserved boolean")

    def matching(self, roles: Iterable[str]) -> list[str]:
        """The sets of roles that hold all of ``roles``."""
        wanted = set(roles)
        if unknown := sorted(wanted - set(self.roles)):
            raise ExecutionError(f"Unknown role '{unknown[0]}'")
        return sorted(s for s in self.types if wanted <= set(s.split("|")))

    # -- adding ----------------------------------------------------------------------------------------------------
    def insert(self, posits: list[tuple[dict[str, int], Value, Time]]) -> list[int]:
        """Add posits; returns their ids, those of equal posits where there are such."""
        keyed = []
        for apps, value, time in posits:
            for role in apps:
                if role not in self.roles:
                    raise ExecutionError(f"Unknown role '{role}'")
            key = "|".join(f"{r}={apps[r]}" for r in sorted(apps))
            keyed.append(((key, value.vt, value.key, time.prec, time.lo), apps, value, time))
        missing = {k for k, *_ in keyed if k not in self.known}
        if missing and self.frames:
            wanted = self.spark.createDataFrame(sorted(missing), "aset_key string, vt tinyint, v_key string, t_prec tinyint, t_lo long")
            for frame, _ in self.frames:
                frame = frame.frame() if isinstance(frame, Shred) else frame
                found = frame.join(F.broadcast(wanted), IDENTITY).groupBy(*IDENTITY).agg(F.min("posit_id").alias("id")).collect()  # as many as the script has posits
                self.known.update({tuple(r[c] for c in IDENTITY): r.id for r in found})
        ids, fresh = [], []
        for key, apps, value, time in keyed:
            if key not in self.known:
                self.known[key] = self.new_thing()
                roles = "|".join(sorted(apps))
                self.types.setdefault(roles, set()).add(value.vt)
                fresh.append((self.known[key], key[0], roles, apps, *value.row(), time.prec, time.lo, time.hi, time.text))
            ids.append(self.known[key])
        if self.path:
            self.known = {}  # found again in the files
        if fresh and self.path:
            added = self.spark.createDataFrame(fresh, SCHEMA).coalesce(1)
            added.write.mode("append").partitionBy("role_set").parquet(f"{self.path}/posit")
            ledger.append(self, fresh)
            self.frames = [(self._read("posit").select(COLUMNS), self.types)]
        else:
            self.rows += fresh
        return ids

    def add_frame(self, posits: DataFrame, kinds: dict[str, set[int]], unique: bool = False) -> None:
        """Add a table of posits with ids of its own; ``kinds``: its sets of roles with their value types.

        Of equal posits the smallest id stays, and posits that the store has already are left out, unless the caller
        knows that there are none (``unique``).  In a store with a path every added posit gets an entry in the ledger.
        """
        posits = posits.select(COLUMNS)
        if not unique:
            posits = deduplicated(posits)
            known = [s for s in kinds if s in self.types]
            if known:
                posits = posits.join(self.posits(known).select(*IDENTITY), IDENTITY, "left_anti").select(COLUMNS)
        for roles, vts in kinds.items():
            for role in roles.split("|"):
                self.add_role(role)
            self.types.setdefault(roles, set()).update(vts)
        if self.path:
            # Written apart first: the ledger chains what was written, and a failed write leaves the store as it was.
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            posits.write.partitionBy("role_set").parquet(staged)
            added = self.spark.read.schema(SCHEMA).parquet(staged)
            self.last_id = max(self.last_id, added.agg(F.max("posit_id")).first()[0] or 0)
            ledger.append_frame(self, added)
            added.select(COLUMNS).write.mode("append").partitionBy("role_set").parquet(f"{self.path}/posit")
            self._delete(staged)
            self.frames = [(self._read("posit").select(COLUMNS), self.types)]
        else:
            self.frames.append((posits, {k: set(v) for k, v in kinds.items()}))

    def shred(self, *shreds: Shred, unique: bool = False) -> "PositStore":
        """Add shredded tables; ``unique``: their rows are known to give posits that differ from each other and from others."""
        for s in shreds:
            if self.path or not unique and s.roles in self.types:
                self.add_frame(s.frame(), {s.roles: {s.vt}}, unique)
                continue
            for role in s.roles.split("|"):
                self.add_role(role)
            self.types.setdefault(s.roles, set()).add(s.vt)
            self.frames.append((replace(s, repeats=not unique), {s.roles: {s.vt}}))
        return self

    # -- reading ---------------------------------------------------------------------------------------------------
    def posits(self, role_sets: list[str] | None = None, bounds: Bounds | None = None) -> DataFrame:
        """All posits, or those of the given sets of roles: other tables aren't even planned.

        With ``bounds``, posits outside them may be left out.
        """
        parts = []
        for f, kinds in self.frames:
            if isinstance(f, Shred):
                if role_sets is None or f.roles in role_sets:
                    parts.append(f.frame(bounds))
            elif role_sets is None:
                parts.append(f)
            elif wanted := [s for s in role_sets if s in kinds]:
                parts.append(f.where(F.col("role_set").isin(wanted)))
        rows = self.rows if role_sets is None else [r for r in self.rows if r[2] in set(role_sets)]
        if rows or not parts:
            parts.append(self.spark.createDataFrame(rows, SCHEMA))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def involving(self, thing: int) -> DataFrame:
        """The posits in which a thing appears, in whatever role."""
        return self.posits().where(F.array_contains(F.map_values("apps"), F.lit(thing).cast("long")))

    def listing(self) -> DataFrame:
        """posit_id and a readable line for every posit."""
        return listing(self.posits())


def listing(posits: DataFrame) -> DataFrame:
    name = F.element_at(F.create_map(*[F.lit(x) for pair in values.NAMES.items() for x in pair]), F.col("vt").cast("int"))
    things = F.array_join(F.transform(F.array_sort(F.map_entries("apps")), lambda e: F.concat(F.lit("("), e["value"].cast("string"), F.lit(", "), e["key"], F.lit(")"))), ", ")
    line = F.concat(F.col("posit_id").cast("string"), F.lit(" [{"), things, F.lit("}, "), F.col("v_text"), F.lit("::<"), name, F.lit(">, "), F.col("t_text"), F.lit("]"))
    return posits.select("posit_id", line.alias("line"))
