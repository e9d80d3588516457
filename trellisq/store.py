"""The graph store: add triples, match patterns, run SPARQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .deadline import deadline
from .functions import values as V
from .functions.terms import Blank, Iri, Literal, Term, Var, encode, from_python
from .functions.values import Shape
from .operators import relation as R
from .operators.translate import Translator
from .plans import algebra as A
from .plans.algebra import Triple
from .plans.parser import parse
from .sources import ntriples
from .sources.dictionary import Dictionary, EncodedTable
from .sources.parsers import parser_for
from .sources.store_sources import MappedTables, Source, TripleTable

SCHEMA = "s string, p string, o string"
#: Additions of a level that are put together as one of the next.
FANOUT = 8
#: Triples of a file that ``write`` makes, about.
FILE_ROWS = 500_000
#: Rows that one task holds at a time, about: the number of tasks grows with the
#: rows, whatever spark.sql.shuffle.partitions is.
TASK_ROWS = 500_000
#: An addition of so many triples at most is looked up in what is held by a scan.
FEW = 10_000
#: Columns that tell an index's children, by the index's name.
INDEXES = {"root": ("", "p"), "s": ("s", "p"), "p": ("p", "s"), "o": ("o", "p"), "sp": ("sp", "o"), "so": ("so", "p"), "po": ("po", "s")}


def _tasks(rows: int) -> int:
    return -(-rows // TASK_ROWS) or 1


class StoreClosed(RuntimeError):
    """The store was closed."""


class GraphStore:
    """A set of triples, or tables seen as one. Sets only grow: there is no
    delete. What ``add`` returns from is seen by the next query. After
    ``close`` every call raises. ``timeout``: seconds after which a call that
    waits for Spark ends in a TimeoutError."""

    def __init__(self, spark: SparkSession, source: Source | None = None, timeout: float | None = None):
        self.spark, self.closed, self.timeout = spark, False, timeout
        self.source: Source = source or TripleTable(spark.createDataFrame([], SCHEMA))
        #: What was added, by level; a level's additions are about equally large.
        self.levels: list[list[DataFrame]] = [[self.source.df]] if isinstance(self.source, TripleTable) and source else []
        #: How many triples were added, repeated ones too; None: not counted yet.
        self.given: int | None = None if source else 0

    @classmethod
    def over_tables(cls, spark: SparkSession, folder: str) -> GraphStore:
        return cls(spark, MappedTables(spark, folder))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GraphStore:
        """A store that ``write`` wrote."""
        return cls(spark, TripleTable(spark.read.parquet(path)))

    def write(self, path: str) -> None:
        """All triples as Parquet, dealt by ranges of (predicate, subject) and sorted:
        a scan skips files and row groups by either, and a frequent predicate is
        spread over as many files as it needs."""
        self._open()
        table = self.source.triples().select("p", "s", "o")
        files = -(-table.count() // FILE_ROWS) or 1
        table.repartitionByRange(files, "p", "s").sortWithinPartitions("p", "s").write.parquet(path)

    def write_ntriples(self, path: str) -> None:
        """All triples as a folder of N-Triples files."""
        self._open()
        ntriples.lines(self.source.triples()).write.text(path)

    def encoded(self) -> GraphStore:
        """The same triples with terms as numbers, for joins that compare numbers.
        It takes no additions."""
        self._open()
        return GraphStore(self.spark, EncodedTable(self.source.triples()), self.timeout)

    def dictionary(self) -> Dictionary:
        self._open()
        return self.source.dictionary if isinstance(self.source, EncodedTable) else Dictionary.of(self.source.triples())

    def _open(self) -> None:
        if self.closed:
            raise StoreClosed("the store is closed")

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> GraphStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _given(self) -> int:
        """Rows of the source, or a few more."""
        return self.source.triples().count() if self.given is None else self.given

    # ---- adding

    def _add(self, more: DataFrame, n: int | None = None) -> None:
        """``n``: the number of rows, or a few more, if it is known."""
        self._open()
        if not isinstance(self.source, TripleTable):
            raise ValueError("tables seen as triples can't be added to")
        fresh = more.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        with deadline(self.spark, self.timeout):
            n = more.count() if n is None else n
            given = self._given()
        if not self.levels:
            fresh = fresh.repartition(_tasks(n), "s", "p", "o").dropDuplicates(["s", "p", "o"])
        else:
            held, rows = self.source.df, n + given
            if n <= FEW:
                key = F.xxhash64("s", "p", "o")
                held, rows = held.withColumn("key", key).join(F.broadcast(fresh.select(key.alias("key"))), "key", "left_semi"), 2 * n
            both = held.select("s", "p", "o", F.lit(True).alias("held")).unionAll(fresh.withColumn("held", F.lit(False)))
            told = both.repartition(_tasks(rows), "s", "p", "o").groupBy("s", "p", "o").agg(F.max("held").alias("held"))
            fresh = told.where("NOT held").drop("held")
        levels = [list(x) for x in self.levels] or [[]]
        with deadline(self.spark, self.timeout):
            levels[0].append(cut(fresh))
            for i, level in enumerate(levels):
                if len(level) < FANOUT:
                    break
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(cut(reduce(DataFrame.unionAll, level)))
                level.clear()
        self.levels, self.given = levels, given + n
        self.source = TripleTable(reduce(DataFrame.unionAll, [x for level in levels for x in level]))

    def add(self, triples: Iterable[tuple[object, object, object]]) -> None:
        """Add (s, p, o): terms, or Python values, of which strings are canonical
        texts. An exception of the iterable leaves the store as it was."""
        rows = [tuple(encode(from_python(x)) for x in t) for t in triples]
        for s, p, _ in rows:
            if s[:1] not in "_" and not s[:1].isalpha() or not p[:1].isalpha():
                raise ValueError(f"{s} {p} can't stand before an object")
        if rows:
            self._add(self.spark.createDataFrame(rows, SCHEMA), len(rows))

    def add_frame(self, triples: DataFrame) -> None:
        """Add (s, p, o) rows in canonical text."""
        self._add(triples)

    def load_ntriples(self, path: str, bnode_scope: str = "global", **options: str) -> None:
        """Add a file's triples; with ``bnode_scope='per_load'`` its blank labels
        are other nodes than equal labels elsewhere."""
        self.load(path, "nt", bnode_scope, **options)

    def load(self, path: str, format: str | None = None, bnode_scope: str = "global", **options: str) -> None:
        """Add the triples of a file or folder that a registered parser reads, by
        the name's suffix or by ``format``."""
        self._open()
        if bnode_scope not in ("global", "per_load"):
            raise ValueError("bnode_scope is global or per_load")
        scope = f"l{uuid.uuid4().hex[:12]}_" if bnode_scope == "per_load" else ""
        parser = parser_for(path, format)
        more = parser(self.spark, path, scope=scope, **options)
        with deadline(self.spark, self.timeout):
            n = self.spark.read.text(path).count() if parser is ntriples.read else None
        self._add(more, n)

    # ---- patterns

    def match(self, patterns: Iterable[tuple[object, object, object]], select: list[str] | None = None, budget: int | None = None) -> DataFrame:
        """Solutions of a conjunction of patterns, a column a variable (in order of
        appearance, or those of ``select``); duplicates stay. No pattern: no rows.
        ``budget`` bounds the number of solutions."""
        self._open()
        triples = [Triple(*(x if isinstance(x, Var) else from_python(x) for x in p)) for p in patterns]
        if not triples:
            return self.spark.range(0).select()
        free = [x for x in (triples[0].s, triples[0].p, triples[0].o) if isinstance(x, Var)]
        if len(triples) == 1 and len(set(free)) == 3 and isinstance(self.source, MappedTables):
            found = self.source.rows(triples[0])
        else:
            found = Translator(self.source).run(A.Bgp(triples))
        df = self._result(found, select if select is not None else A.visible(A.Bgp(triples)))
        return df if budget is None else df.limit(budget)

    def match_within(self, patterns: Iterable[tuple[object, object, object]], budget: int) -> tuple[list[Row], bool]:
        """At most ``budget`` solutions, and whether they are all."""
        with deadline(self.spark, self.timeout):
            rows = self.match(list(patterns), budget=budget + 1).take(budget + 1)
        return rows[:budget], len(rows) <= budget

    def count(self, patterns: Iterable[tuple[object, object, object]], budget: int | None = None) -> int | None:
        """How many solutions; None if ``budget`` is too small to count them."""
        with deadline(self.spark, self.timeout):
            n = self.match(list(patterns), budget=None if budget is None else budget + 1).count()
        return None if budget is not None and n > budget else n

    def _triple(self, s: object, p: object, o: object) -> Triple:
        """None is a wildcard, independent of others; variables are refused."""
        if any(isinstance(x, Var) for x in (s, p, o)):
            raise ValueError("use None for a wildcard")
        return Triple(*(Var(n) if x is None else from_python(x) for n, x in zip("spo", (s, p, o), strict=True)))

    def find(self, s: object = None, p: object = None, o: object = None) -> DataFrame:
        """The triples (s, p, o) in canonical text that fit."""
        self._open()
        triple = self._triple(s, p, o)
        found = self.source.scan(triple).shaped(dict.fromkeys("spo", Shape("any")))
        nodes = zip("spo", (triple.s, triple.p, triple.o), strict=True)
        return found.df.select(*[F.col(R.column(n)).alias(n) if isinstance(x, Var) else F.lit(encode(x)).alias(n) for n, x in nodes])

    def contains(self, s: object = None, p: object = None, o: object = None) -> bool:
        with deadline(self.spark, self.timeout):
            return bool(self.find(s, p, o).take(1))

    def statistic(self, s: object = None, p: object = None, o: object = None) -> int:
        with deadline(self.spark, self.timeout):
            return self.find(s, p, o).count()

    def size(self) -> int:
        return self.statistic()

    def children(self, index: str = "root", **fixed: object) -> DataFrame:
        """The different terms below an index entry, e.g. ``children('sp', s=..., p=...)``;
        none for an entry that isn't there."""
        if index not in INDEXES or set(fixed) != set(INDEXES[index][0]):
            raise ValueError(f"the index is one of {', '.join(INDEXES)}, with its terms fixed")
        return self.find(**fixed).select(F.col(INDEXES[index][1]).alias("child")).distinct()

    def vertices_by_type(self) -> dict[str, int]:
        """How many entries each index has."""
        with deadline(self.spark, self.timeout):
            return self.vertex_counts().first().asDict()

    def vertex_counts(self) -> DataFrame:
        return self._different({name: fixed for name, (fixed, _) in INDEXES.items()})

    def edges_by_type(self) -> dict[str, int]:
        """How many children the entries of each index have together."""
        with deadline(self.spark, self.timeout):
            return self.edge_counts().first().asDict()

    def edge_counts(self) -> DataFrame:
        return self._different({name: fixed + child for name, (fixed, child) in INDEXES.items()})

    def _different(self, columns: dict[str, str]) -> DataFrame:
        """A row with the number of different values of each name's columns, 1 for none.
        Rows are dealt evenly first, so that a frequent term leaves each task once."""
        self._open()
        wanted = {name: "".join(c for c in "spo" if c in cs) for name, cs in columns.items()}
        sets = [x for x in dict.fromkeys(wanted.values()) if x]
        with deadline(self.spark, self.timeout):
            tasks = _tasks(self._given() * len(sets))
        dealt = self.source.triples().withColumn("part", F.pmod(F.xxhash64("s", "p", "o"), F.lit(64 * tasks))).repartition(tasks, "part")
        nothing = F.lit(None).cast("string")
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("of"), *[(F.col(c) if c in x else nothing).alias(c) for c in "spo"]) for x in sets]))
        rows = dealt.select("part", each.alias("row")).select("part", "row.*").where(" AND ".join(f"({c} IS NOT NULL OR NOT contains(of, '{c}'))" for c in "spo"))
        once = rows.distinct().drop("part").repartition(tasks, "of", "s", "p", "o").distinct()
        return once.agg(*[(F.count(F.when(F.col("of") == x, 1)) if x else F.lit(1).cast("long")).alias(name) for name, x in wanted.items()])

    # ---- SPARQL

    def sparql(self, query: str) -> DataFrame:
        """The solutions of a SELECT query (a column a variable; an ASK query gives
        one boolean, ``ask``). Native columns keep their types, IRIs are strings,
        other terms are in canonical text; unbound is NULL."""
        self._open()
        kind, plan = parse(query)
        if kind == "ask":
            found = Translator(self.source).run(plan)
            return found.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        names = [n for n in A.visible(plan) if not n.startswith(".")]
        return self._result(Translator(self.source).run(plan), names)

    def rows(self, query: str) -> Iterator[Row]:
        """The solutions one by one, a partition at a time."""
        return self.sparql(query).toLocalIterator()

    def explain(self, query: str) -> None:
        self.sparql(query).explain("formatted")

    @staticmethod
    def _result(found: R.Relation, names: list[str]) -> DataFrame:
        return found.df.select(*[(V.generic(v) if (v := found.value(n)).kind == "key" else v.col).alias(n) for n in names])


__all__ = ["Blank", "GraphStore", "Iri", "Literal", "StoreClosed", "Term", "Var"]
