"""Where triples come from: a table of triples, or tables seen as triples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.terms import RDF, Blank, Iri, Literal, Var, encode
from ..functions.values import Shape, Value
from ..operators.relation import Info, Relation, column, empty
from ..plans.algebra import Triple
from .mapping import BASE, TABLES, Table

TYPE = RDF + "type"


class Source(Protocol):
    spark: SparkSession

    def scan(self, triple: Triple) -> Relation: ...
    def star_key(self, triple: Triple) -> str | None: ...
    def star(self, triples: list[Triple]) -> Relation: ...
    def triples(self) -> DataFrame: ...
    def resources(self) -> DataFrame: ...


def bind(df: DataFrame, parts: list[tuple[object, Value]]) -> Relation:
    """Rows of ``df`` with each (node, value) matched: constants filter, variables
    bind, and a variable that stands twice has to agree."""
    bound: dict[str, Value] = {}
    tests: list[Column] = []
    for node, value in parts:
        if isinstance(node, Var):
            if node.name in bound:
                first = bound[node.name]
                if first.shape.joins_raw(value.shape):
                    tests.append(first.col == value.col)
                else:
                    tests.append(V.generic(first) == V.generic(value))
            else:
                bound[node.name] = value
        else:
            tests.append(_is(value, node))
    # A test of a computed key would have it computed where nobody asks for it.
    tests += [v.col.isNotNull() for _, v in parts if not v.sure]
    df = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return Relation(df.select(*[v.col.alias(column(n)) for n, v in bound.items()]), {n: Info(v.shape) for n, v in bound.items()})


def _is(value: Value, term: object) -> Column:
    """Whether a column holds a term; on raw columns, so that scans are pruned."""
    if value.kind == "key":
        text = term.value if isinstance(term, Iri) else ""
        if not text.startswith(value.shape.prefix):
            return F.lit(False)
        key = text[len(value.shape.prefix) :]
        return value.col == F.lit(key).try_cast("bigint") if _whole(key) else value.col.cast("string") == F.lit(key)
    if value.kind == "any" or value.kind == "iri":
        return value.col == F.lit(encode(term))
    wanted = V.constant(term)
    return value.col == wanted.col if wanted.kind == value.kind else F.lit(False)


def _whole(key: str) -> bool:
    return key.isascii() and key.isdigit() and str(int(key)) == key and len(key) < 19


class TripleTable:
    """Triples (s, p, o) in canonical text; a set."""

    def __init__(self, df: DataFrame):
        self.spark, self.df = df.sparkSession, df.select("s", "p", "o")

    def scan(self, triple: Triple) -> Relation:
        nodes = (triple.s, triple.p, triple.o)
        if isinstance(triple.s, Literal) or isinstance(triple.p, (Literal, Blank)):
            return empty(self.spark, [n.name for n in nodes if isinstance(n, Var)])
        return bind(self.df, [(n, Value(F.col(c), Shape("any"))) for n, c in zip(nodes, "spo", strict=True)])

    def star_key(self, triple: Triple) -> str | None:
        return None

    def star(self, triples: list[Triple]) -> Relation:
        raise NotImplementedError

    def triples(self) -> DataFrame:
        return self.df

    def resources(self) -> DataFrame:
        """Every term that is a subject or an object, once."""
        return self.df.select(F.col("s").alias("node")).union(self.df.select("o")).distinct()


class MappedTables:
    """Parquet tables of a folder, seen as triples; nothing is written."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table] = TABLES, read: Callable[[str], DataFrame] | None = None):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self.read = read or (lambda name: spark.read.parquet(f"{self.folder}/{name}.parquet"))
        self.frames: dict[str, DataFrame] = {}

    def frame(self, table: Table) -> DataFrame:
        """The table's rows with their key as ``_key``; read once a store."""
        if table.name not in self.frames:
            df = self.read(table.name)
            if table.name == "conversations":
                turn = Window.partitionBy("conv_id").orderBy("turn")
                df = df.withColumn("next_turn", F.concat_ws("/", "conv_id", F.lead("turn").over(turn)))
                df = df.withColumn("next_turn", F.when(F.col("next_turn").contains("/"), F.col("next_turn")))
            self.frames[table.name] = df.withColumn("_key", table.key_column())
        return self.frames[table.name]

    def check_keys(self) -> None:
        """ValueError if a table's key names several rows: the triples would not be
        a set then. A pass over all tables, so it is left to the caller."""
        for table in self.tables.values():
            keys = self.frame(table).select("_key")
            twice = keys.groupBy("_key").count().where("_key IS NOT NULL AND count > 1").take(1)
            if twice:
                raise ValueError(f"{table.name}: the key {twice[0][0]} names several rows")

    def subject(self, table: Table) -> Value:
        return Value(F.col("_key"), Shape("key", f"{BASE}{table.subject_table}/"), table.fingerprint)

    def objects(self, table: Table) -> dict[str, Value]:
        """Predicate IRI -> object of each of the table's predicates."""
        kinds = dict(self.frame(table).dtypes)
        out = {f"{BASE}{table.name}#{c}": Value(F.col(c), V.shape_of(kinds[c])) for c in table.columns}
        for c, target in table.refs.items():
            out[f"{BASE}{table.name}#ref-{c}"] = Value(F.col(c), Shape("key", f"{BASE}{target}/"))
        for name, (c, target) in table.derived.items():
            out[f"{BASE}{table.name}#{name}"] = Value(F.col(c), Shape("key", f"{BASE}{target}/"))
        if not table.subject:
            out[TYPE] = Value(F.lit(f"{BASE}{table.name}"), Shape("iri"), True)
        return out

    def _owner(self, predicate: str) -> Table | None:
        name = predicate.removeprefix(BASE).partition("#")[0]
        table = self.tables.get(name) if predicate.startswith(BASE) else None
        return table if table is not None and predicate in self.objects(table) else None

    def star_key(self, triple: Triple) -> str | None:
        """The table that answers a pattern alone; patterns on one subject with
        the same table are one scan, since keys are unique."""
        if not isinstance(triple.p, Iri):
            return None
        if triple.p.value == TYPE and isinstance(triple.o, Iri):
            name = triple.o.value.removeprefix(BASE)
            return name if name in self.tables and triple.o.value.startswith(BASE) and not self.tables[name].subject else None
        table = self._owner(triple.p.value)
        return table.name if table else None

    def star(self, triples: list[Triple]) -> Relation:
        """One scan for patterns on one subject and one table."""
        table = self.tables[self.star_key(triples[0])]
        objects = self.objects(table)
        return bind(self.frame(table), [(triples[0].s, self.subject(table)), *((t.o, objects[t.p.value]) for t in triples)])

    def scan(self, triple: Triple) -> Relation:
        if self.star_key(triple) is not None:
            return self.star([triple])
        names = list(dict.fromkeys(n.name for n in (triple.s, triple.p, triple.o) if isinstance(n, Var)))
        parts = []
        if isinstance(triple.p, (Var, Iri)):
            for table in self.tables.values():
                if isinstance(triple.s, (Literal, Blank)) or isinstance(triple.s, Iri) and not triple.s.value.startswith(f"{BASE}{table.subject_table}/"):
                    continue
                for iri, value in self.objects(table).items():
                    if isinstance(triple.p, Var) or triple.p.value == iri:
                        nodes = [(triple.s, self.subject(table)), (triple.p, Value(F.lit(iri), Shape("iri"), True)), (triple.o, value)]
                        parts.append(bind(self.frame(table), nodes))
        if not parts:
            return empty(self.spark, names)
        if len(parts) == 1:
            return parts[0]
        whole = [r.shaped(dict.fromkeys(names, Shape("any"))) for r in parts]
        df = reduce(DataFrame.unionByName, [r.df.select(*[column(n) for n in names]) for r in whole])
        return Relation(df, {n: Info(Shape("any")) for n in names})

    def rows(self, triple: Triple) -> Relation:
        """``scan`` of a pattern of three different variables, for results that are
        returned whole: a table is read once, and a row's triples lie together, so
        that its subject takes little space more than once."""
        parts = []
        for table in self.tables.values():
            objects = self.objects(table)
            near = {iri: v for iri, v in objects.items() if iri.partition("#")[2] not in table.derived}
            subject, df = self.subject(table), self.frame(table)
            df = df if subject.sure else df.where(subject.col.isNotNull())
            each = F.array(*[F.struct(F.lit(iri).alias("p"), V.generic(v).alias("o")) for iri, v in near.items()])
            dealt = df.select(V.generic(subject).alias("s"), each.alias("each")).select("s", F.explode("each").alias("po"))
            parts.append(dealt.select("s", "po.p", "po.o").where("o IS NOT NULL"))
            for iri in objects.keys() - near.keys():
                # Its key may need a window, which the other columns are kept out of.
                one = bind(self.frame(table), [(Var("s"), subject), (Var("p"), Value(F.lit(iri), Shape("iri"), True)), (Var("o"), objects[iri])])
                parts.append(one.shaped(dict.fromkeys("spo", Shape("any"))).df.toDF("s", "p", "o"))
        names = [n.name for n in (triple.s, triple.p, triple.o)]
        return Relation(reduce(DataFrame.unionAll, parts).toDF(*map(column, names)), {n: Info(Shape("any")) for n in names})

    def triples(self) -> DataFrame:
        """All triples in canonical text; every column of every table is read."""
        everything = self.scan(Triple(Var("s"), Var("p"), Var("o"))).shaped(dict.fromkeys("spo", Shape("any")))
        return everything.df.toDF("s", "p", "o")

    def resources(self) -> DataFrame:
        all_triples = self.triples()
        return all_triples.select(F.col("s").alias("node")).union(all_triples.select("o")).distinct()
