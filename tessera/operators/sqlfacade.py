"""SQL over registered tables: named views, a plan check, typed and capped results.

A statement is parsed, not searched for words: only the plans of queries pass (selection, join, aggregation, window, set
operation, sort, limit, subquery), and only relations that were registered can be read. Commands (DDL, SET, ADD JAR,
INSERT), file paths as tables (parquet.`/x`), table functions other than range and explode, and functions that reach
outside (reflect, java_method, input files) are refused before anything runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 10_000
_REACH = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_catalog current_database current_user version".split())
_TVF = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
_NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation"
    " UnresolvedHaving With UnresolvedWith CTERelationDef WithWindowDefinition UnresolvedInlineTable OneRowRelation LateralJoin Generate Pivot UnresolvedPivot Unpivot UnresolvedUnpivot"
    " Window UnresolvedTableValuedFunction UnresolvedTVFAliases LocalRelation Range Sample RepartitionByExpression SetOperation UnresolvedHint Tail".split()
)


class Refused(ValueError):
    """The statement isn't a query over registered tables."""


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Database:
    """Registered tables of one session; `prefix` keeps several documents' tables apart."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kinds = spark, {}

    def register(self, name: str, df: DataFrame, prefix: str = "", kind: str = "table") -> str:
        name = f"{prefix}_{name}" if prefix else name
        df.createOrReplaceTempView(quote(name))
        self.kinds[name.lower()] = kind
        return name

    def register_document(self, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
        return [self.register(n, t, prefix) for n, t in tables.items()]

    def _walk(self, plan, local: frozenset) -> None:  # noqa: ANN001
        name = plan.getClass().getSimpleName()
        if name not in _NODES:
            raise Refused(f"{name} isn't allowed in a query")
        if name == "UnresolvedWith":
            named = plan.cteRelations()
            for i in range(named.size()):
                pair = named.apply(i)
                local = local | {pair._1().lower()}
                self._walk(pair._2(), local)
        if name == "UnresolvedRelation":
            parts = [plan.multipartIdentifier().apply(i) for i in range(plan.multipartIdentifier().size())]
            if len(parts) != 1 or parts[0].lower() not in local | set(self.kinds):
                raise Refused(f"{'.'.join(parts)} isn't a registered table")
        if name == "UnresolvedTableValuedFunction" and plan.name().apply(plan.name().size() - 1).lower() not in _TVF:
            raise Refused("this table function isn't allowed")
        self._expressions(plan.expressions(), local)
        for i in range(plan.children().size()):
            self._walk(plan.children().apply(i), local)

    def _expressions(self, found, local: frozenset) -> None:  # noqa: ANN001
        for i in range(found.size()):
            e = found.apply(i)
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                parts = e.nameParts()
                if parts.apply(parts.size() - 1).lower() in _REACH:
                    raise Refused("this function isn't allowed")
            if hasattr(e, "plan") and "plan" in dir(e) and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                self._walk(e.plan(), local)
            self._expressions(e.children(), local)

    def check(self, sql: str) -> None:
        if not sql.strip():
            raise Refused("empty statement")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise Refused(f"can't be parsed: {str(e)[:200]}") from e
        self._walk(plan, frozenset())

    def query(self, sql: str) -> DataFrame:
        """Any query, uncapped, as a typed DataFrame."""
        self.check(sql)
        return self.spark.sql(sql)

    def execute(self, sql: str, max_rows: int = 1000) -> tuple[DataFrame, bool]:
        """At most min(max_rows, MAX_ROWS) rows, in the query's order, and whether rows were left out."""
        n = min(max_rows, MAX_ROWS)
        df = self.query(sql)
        rows = df.limit(n + 1).take(n + 1)
        return self.spark.createDataFrame(rows[:n], df.schema), len(rows) > n

    def list_tables(self) -> DataFrame:
        rows = [(n, k, len(self.spark.table(quote(n)).columns)) for n, k in sorted(self.kinds.items())]
        return self.spark.createDataFrame(rows, "name string, kind string, n_columns int")

    def describe_table(self, name: str, sample: int = 5) -> dict:
        if name.lower() not in self.kinds:
            raise Refused(f"{name} isn't a registered table")
        df = self.spark.table(quote(name))
        return {"name": name, "columns": [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "row_count": df.count(), "sample": [r.asDict() for r in df.limit(sample).collect()]}


def safe_name(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_") or "document"


def with_total(df: DataFrame, k: int, *order: object) -> DataFrame:
    """Top k with the number of all rows beside them."""
    total = df.agg(F.count(F.lit(1)).alias("total_matches"))
    return df.orderBy(*order).limit(k).crossJoin(total)
