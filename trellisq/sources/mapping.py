"""How tables are seen as triples.

A row is the subject ``base/table/key``; each column gives a triple with the
predicate ``base/table#column``, and each foreign key one more with
``base/table#ref-column`` whose object is the other row's subject. NULL gives
no triple. ``rdf:type`` is ``base/table``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "http://data/"


@dataclass(frozen=True)
class Table:
    """``key``: the columns whose values, joined by '/', name a row; they must be
    unique. ``refs``: column -> (table, its subject prefix). ``derived``: predicate
    local name -> (SQL expression of an object's key, subject table)."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    refs: dict[str, str] = field(default_factory=dict)
    subject: str = ""
    derived: dict[str, tuple[str, str]] = field(default_factory=dict)
    fingerprint: bool = False

    @property
    def subject_table(self) -> str:
        return self.subject or self.name

    def key_column(self) -> Column:
        if self.fingerprint:  # no smaller set of columns is unique
            # Each value's length stands before it, so that different rows differ.
            texts = [F.col(c).cast("string") for c in self.key]
            return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)
        if len(self.key) == 1:
            return F.col(self.key[0])
        return F.concat_ws("/", *[F.col(c).cast("string") for c in self.key])


def _table(name: str, key: str, columns: str, **more: object) -> Table:
    return Table(name, tuple(key.split()), tuple(columns.split()), **more)  # type: ignore[arg-type]


_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"

#: The driver's tables.
TABLES = {
    t.name: t
    for t in (
        _table("region", "r_regionkey", "r_regionkey r_name"),
        _table("nation", "n_nationkey", "n_nationkey n_name n_regionkey", refs={"n_regionkey": "region"}),
        _table("customer", "c_custkey", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", refs={"c_nationkey": "nation"}),
        _table("supplier", "s_suppkey", "s_suppkey s_name s_nationkey s_acctbal", refs={"s_nationkey": "nation"}),
        _table("part", "p_partkey", "p_partkey p_name p_brand p_type p_size p_retailprice"),
        _table("orders", "o_orderkey", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", refs={"o_custkey": "customer"}),
        _table("lineitem", _LINE, _LINE, refs={"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, fingerprint=True),
        _table("events", "event_id", "event_id ts user_id event_type value props", derived={"user": ("user_id", "user")}),
        _table("documents", "doc_id", "doc_id text lang source n_chars"),
        _table("labels", "doc_id", "doc_id quality toxic", subject="documents"),
        _table("pages", "page_id", "page_id url html"),
        _table("benchmark", "item_id", "item_id text"),
        _table("embeddings", "vec_id", "vec_id label"),
        _table("conversations", "conv_id turn", "conv_id turn role text", derived={"next": ("next_turn", "conversations")}),
    )
}
