"""Numbers for terms, and a store whose joins compare numbers.

A term's number is a 64-bit hash of its text. Where two terms share a hash, or
a hash is 0, which no term has, the later term takes the hash of its text and
its place among them; such terms are so rare that they are kept on the driver.
So numbers are the same in every store, and a constant's number needs no
lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.terms import Blank, Literal, Var, encode
from ..functions.values import Shape
from ..operators import relation as R
from ..operators.relation import Info, Relation, column
from ..plans import rewrite
from ..plans.algebra import Triple

#: By the birthday bound, ten billion terms have three collisions; more than this
#: many mean that the numbers aren't hashes of different terms.
MOST_MOVED = 10_000


class Dictionary:
    """``terms``: (id long, term string), both unique; no id is 0."""

    def __init__(self, terms: DataFrame, moved: dict[str, int] | None = None):
        self.spark, self.terms, self.moved = terms.sparkSession, terms.select("id", "term"), moved or {}

    @classmethod
    def of(cls, triples: DataFrame, bits: int = 64) -> Dictionary:
        """The terms of (s, p, o) rows. ``bits``: width of the first hash."""
        each = reduce(DataFrame.unionAll, [triples.select(F.col(c).alias("term")) for c in "spo"]).where("term IS NOT NULL")
        # One exchange makes terms different and finds those that share a number.
        sharing = each.groupBy(cls._hash(F.col("term"), bits).alias("id")).agg(F.collect_set("term").alias("terms"))
        ranked = sharing.select("id", F.posexplode(F.array_sort("terms")).alias("at", "term"))
        later = (F.col("at") > 0) | (F.col("id") == 0)
        told = cut(ranked.select(F.when(later, F.xxhash64("term", F.col("at") + 1)).otherwise(F.col("id")).alias("id"), "term", later.alias("later")))
        moved = told.where("later").select("term", "id").limit(MOST_MOVED + 1).collect()
        if len(moved) > MOST_MOVED:
            raise ValueError("too many terms share a number")
        if moved and told.join(F.broadcast(told.where("later").select("id")), "id", "left_semi").groupBy("id").count().where("count > 1").take(1):
            raise ValueError("a term's second number is taken too")
        made = cls(told.select("id", "term"), {r["term"]: r["id"] for r in moved})
        made.bits = bits
        return made

    bits = 64

    @staticmethod
    def _hash(term: Column, bits: int) -> Column:
        return F.xxhash64(term) if bits == 64 else F.xxhash64(term).bitwiseAND((1 << bits) - 1)

    def number(self, term: Column) -> Column:
        """The number of a term that the dictionary holds."""
        number = self._hash(term, self.bits)
        for text, id_ in self.moved.items():
            number = F.when(term == text, F.lit(id_)).otherwise(number)
        return number

    def encode(self, frame: DataFrame, *columns: str) -> DataFrame:
        """``frame`` with these columns of held terms as their numbers."""
        return frame.withColumns({c: self.number(F.col(c)) for c in columns})

    def decode(self, frame: DataFrame, *columns: str) -> DataFrame:
        """``frame`` with these columns of numbers as terms; an unknown one is NULL."""
        names = frame.columns
        for c in columns:
            frame = frame.join(self.terms.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term")), c, "left").drop(c).withColumnRenamed(f"{c}_term", c)
        return frame.select(*names)

    def id_of(self, term: str) -> int | None:
        """A term's number, None if it isn't held. Nothing is added by asking."""
        row = self.terms.where((F.col("id") == self.number(F.lit(term))) & (F.col("term") == term)).select("id").first()
        return row[0] if row else None

    def term_of(self, id_: int) -> str | None:
        row = self.terms.where(F.col("id") == id_).select("term").first()
        return row[0] if row else None

    def contains(self, term: str) -> bool:
        return self.id_of(term) is not None

    def blanks(self) -> DataFrame:
        """(id, term) of the blank nodes."""
        return self.terms.where(F.col("term").startswith("_:"))

    def size(self) -> int:
        return self.terms.count()


class EncodedTable:
    """Triples of numbers; patterns are joined on them, and results decoded."""

    def __init__(self, triples: DataFrame, dictionary: Dictionary | None = None):
        self.spark = triples.sparkSession
        self.dictionary = dictionary or Dictionary.of(triples)
        self.ids = cut(self.dictionary.encode(triples.select("s", "p", "o"), "s", "p", "o"))

    def _scan(self, triple: Triple) -> Relation:
        nodes = (triple.s, triple.p, triple.o)
        if isinstance(triple.s, Literal) or isinstance(triple.p, (Literal, Blank)):
            names = list(dict.fromkeys(n.name for n in nodes if isinstance(n, Var)))
            return Relation(self.ids.limit(0).select(*[F.col("s").alias(column(n)) for n in names]), {n: Info(Shape("id")) for n in names})
        bound: dict[str, Column] = {}
        tests = []
        for node, c in zip(nodes, "spo", strict=True):
            if not isinstance(node, Var):
                tests.append(F.col(c) == self.dictionary.number(F.lit(encode(node))))
            elif node.name in bound:
                tests.append(bound[node.name] == F.col(c))
            else:
                bound[node.name] = F.col(c)
        df = self.ids.where(reduce(lambda a, b: a & b, tests)) if tests else self.ids
        return Relation(df.select(*[c.alias(column(n)) for n, c in bound.items()]), {n: Info(Shape("id")) for n in bound})

    def bgp(self, triples: list[Triple]) -> Relation:
        """Solutions of the patterns, joined by numbers, then decoded."""
        units = rewrite.ordered([[t] for t in dict.fromkeys(triples)])
        found = reduce(R.join, [self._scan(u[0]) for u in units])
        df = self.dictionary.decode(found.df, *[column(n) for n in found.vars])
        return Relation(df, {n: Info(Shape("any")) for n in found.vars})

    def scan(self, triple: Triple) -> Relation:
        return self.bgp([triple])

    def star_key(self, triple: Triple) -> str | None:
        return None

    def star(self, triples: list[Triple]) -> Relation:
        raise NotImplementedError

    def triples(self) -> DataFrame:
        return self.dictionary.decode(self.ids, "s", "p", "o")

    def resources(self) -> DataFrame:
        ids = self.ids.select(F.col("s").alias("node")).union(self.ids.select("o")).distinct()
        return self.dictionary.decode(ids, "node")

