"""Runs scripts against a store."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from positdb.errors import ExecutionError
from positdb.functions import times
from positdb.plans.compile import Binding, Compiled, Compiler
from positdb.plans.syntax import AddPosit, AddRole, Search, parse
from positdb.sources.store import PositStore


@dataclass
class Result:
    """Result of one search; nothing has run yet."""

    search: str
    compiled: Compiled

    @property
    def columns(self) -> list[str]:
        return list(self.compiled.columns)

    @property
    def df(self) -> DataFrame:
        """Ids, and values and times as they are displayed; ``<column>__type`` names each cell's type."""
        return self.compiled.df

    @property
    def typed(self) -> DataFrame:
        """Columns in types of their own: long, string, decimal, timestamp."""
        return self.compiled.typed

    def rows(self) -> list[list[str]]:
        return [[str(r[c]) for c in self.columns] for r in self.df.collect()]

    def collect(self) -> "Rows":
        found = self.df.collect()
        rows = [[str(r[c]) for c in self.columns] for r in found]
        types = [[r[f"{c}__type"] for c in self.columns] for r in found]
        return Rows(self.columns, rows, types, len(rows), self.compiled.limit is not None and len(rows) >= self.compiled.limit, self.search)

    def iterate(self) -> Iterator[list[str]]:
        """Rows one by one, a partition at a time on the driver."""
        for row, _ in self.iterate_typed():
            yield row

    def iterate_typed(self) -> Iterator[tuple[list[str], list[str]]]:
        """Rows one by one, each with the types of its cells."""
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            yield [str(r[c]) for c in self.columns], [r[f"{c}__type"] for c in self.columns]


@dataclass
class Rows:
    columns: list[str]
    rows: list[list[str]]
    row_types: list[list[str]]
    row_count: int
    limited: bool
    search: str = ""


class Engine:
    def __init__(self, store: PositStore | SparkSession) -> None:
        self.store = store if isinstance(store, PositStore) else PositStore.in_memory(store)

    def commands(self, script: str) -> Iterator[Result]:
        """Runs the commands of a script in order and yields a lazy result for each search.

        Variables live as long as the script.  ``add posit`` collects things and posits in them; what a search bound
        can be recalled by later commands, ``+x`` in a later search starts anew.
        """
        scope: dict[str, Binding] = {}
        for command in parse(script, times.now()):
            if isinstance(command, (AddRole, AddPosit)):
                with self.store.lock:  # scripts of several threads may share a store
                    if isinstance(command, AddRole):
                        for name in command.names:
                            self.store.add_role(name)
                    else:
                        self._add(command, scope)
            else:
                yield self._search(command, scope)

    def run(self, script: str) -> list[Result]:
        return list(self.commands(script))

    def execute(self, script: str) -> None:
        """Runs a script and prints its results."""
        for result in self.commands(script):
            found = result.collect()
            print("\t".join(found.columns))
            for row in found.rows:
                print("\t".join(row))
            print(f"({found.row_count} rows{', limited' if found.limited else ''})")

    def execute_collect_multi(self, script: str) -> list[Rows]:
        return [r.collect() for r in self.commands(script)]

    def execute_collect(self, script: str) -> Rows:
        """Rows of all searches together, columns of the first; limited only says something for a single search."""
        found = self.execute_collect_multi(script)
        if not found:
            return Rows([], [], [], 0, False)
        rows, types = ([x for f in found for x in getattr(f, name)] for name in ("rows", "row_types"))
        return Rows(found[0].columns, rows, types, len(rows), len(found) == 1 and found[0].limited, found[0].search)

    # --------------------------------------------------------------------------------------------------------------
    def _ids(self, scope: dict[str, Binding], name: str) -> list[int]:
        if name not in scope:
            raise ExecutionError(f"Variable '{name}' is used as a recall but is not bound in a prior command")
        ids = scope[name].ids
        if isinstance(ids, DataFrame):  # new posits are made on the driver, one for each of these
            ids = sorted(r[0] for r in ids.collect())
            scope[name] = Binding(ids)
        return ids

    def _add(self, command: AddPosit, scope: dict[str, Binding]) -> None:
        """Adds a command's posits in one insert, or in several where a posit appears in a later one."""
        waiting: list[tuple[str | None, list[tuple]]] = []  # posit variable, posits

        def insert() -> None:
            ids = iter(self.store.insert([x for _, posits in waiting for x in posits]))
            for var, posits in waiting:
                made = [next(ids) for _ in posits]
                if var:
                    before = self._ids(scope, var) if var in scope else []
                    scope[var] = Binding(list(dict.fromkeys([*before, *made])), True)
            waiting.clear()

        for p in command.posits:
            things: list[list[int]] = []
            roles = [role for _, _, role in p.appearances]
            if len(set(roles)) < len(roles):
                raise ExecutionError("A role can appear once in a posit")
            if {name for _, name, _ in p.appearances} & {var for var, _ in waiting}:
                insert()
            for fresh, name, role in p.appearances:
                if role not in self.store.roles:
                    raise ExecutionError(f"Unknown role '{role}'")
                if fresh:
                    made = self.store.new_thing()
                    before = self._ids(scope, name) if name in scope else []
                    scope[name] = Binding([*before, made], True)
                    things.append([made])
                else:
                    things.append(self._ids(scope, name))
            waiting.append((p.var, [(dict(zip(roles, one)), p.value, p.time) for one in product(*things)]))
        insert()

    def _search(self, search: Search, scope: dict[str, Binding]) -> Result:
        compiled = Compiler(self.store, scope).search(search)
        for name, kind in compiled.kinds.items():
            if kind == "thing":
                added = name in scope and scope[name].added
                if not added:
                    scope[name] = Binding(compiled.joined.select(f"i_{name}").where(f"i_{name} is not null").distinct())
        return Result(search.text, compiled)
