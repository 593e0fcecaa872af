"""The table rules of the schema, run over a set of tables in one aggregation.

Each table is scanned once. A row gives a short list of marks: its keys, the references it makes,
the references that it serves as a parent, and the row rules that it breaks. A mark is a rule number,
a role and a value; marks are counted by rule and value, combined before the only shuffle, so a
value that a third of a table holds is one row per task by then. What is broken follows from the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headgrid import schema
from headgrid.operators.quality import dq_overlap, union_all

#: Roles of a mark: holder of a key, child and parent of a reference, row that breaks a rule.
HOLDER, CHILD, PARENT, BROKEN = 0, 1, 2, 3


def table_conditions(name: str, columns: list[str]) -> dict[str, str]:
    """Every row rule of a table whose column it has: domains, NOT NULL, text lengths."""
    rules = dict(schema.CHECKS.get(name, {}))
    rules |= {f"{c}_not_null": f"`{c}` is not null" for c in schema.NOT_NULL[name] if c in columns}
    rules |= {f"{c}_length": f"length(`{c}`) <= {n}" for c, n in schema.TEXT_LIMITS.get(name, {}).items() if c in columns}
    return rules


def key_rules(name: str) -> dict[str, list[str]]:
    """Columns that must be unique in a table, by rule."""
    return {f"unique_{'_'.join(k)}": k for k in [[schema.PRIMARY_KEY[name]], *schema.UNIQUE_KEYS.get(name, [])]}


def references(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(child, rule, column, parent) of the references between tables that are given."""
    return [
        (child, f"{column}_in_{parent}", column, parent)
        for child, column, parent in schema.FOREIGN_KEYS
        if child in tables and parent in tables and column in tables[child].columns
    ]


class _Marks:
    """Numbers the rules and collects the marks that a row of each table gives."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.of_table: dict[str, list[Column]] = {}

    def rule(self, table: str, rule: str) -> int:
        if (table, rule) not in self.rules:
            self.rules.append((table, rule))
        return self.rules.index((table, rule))

    def add(self, scanned: str, number: int, role: int, values: list[Column], given: Column | None = None) -> None:
        mark = F.struct(
            F.lit(number).alias("number"), F.lit(role).cast("byte").alias("role"), F.array(*[v.cast("string") for v in values]).alias("value")
        )
        self.of_table.setdefault(scanned, []).append(mark if given is None else F.when(given, mark))

    def broken(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(table, rule, key, n_rows) of what is broken."""
        parts = []
        for name, marks in self.of_table.items():
            found = F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")
            parts.append(tables[name].select(found).select("m.*"))
        counts = [F.count_if(F.col("role") == role).alias(n) for n, role in (("held", HOLDER), ("used", CHILD), ("known", PARENT), ("bad", BROKEN))]
        sums = union_all(parts).groupBy("number", "value").agg(*counts)
        found = sums.where("held > 1 or bad > 0 or (used > 0 and known = 0)")
        names = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(r).alias("rule")) for t, r in self.rules])
        key = F.concat_ws("/", F.transform("value", lambda v: F.coalesce(v, F.lit("-"))))
        return found.withColumn("of", F.get(names, F.col("number"))).select(
            "of.table", "of.rule", key.alias("key"), (F.col("held") + F.col("used") + F.col("bad")).alias("n_rows")
        )


def _mark_table(marks: _Marks, name: str, table: DataFrame) -> None:
    key = F.col(schema.PRIMARY_KEY[name])
    for rule, condition in table_conditions(name, table.columns).items():
        marks.add(name, marks.rule(name, rule), BROKEN, [key], ~F.expr(condition))
    for rule, columns in key_rules(name).items():
        marks.add(name, marks.rule(name, rule), HOLDER, [F.col(c) for c in columns])
    if name == "forecast_versions":
        working = F.col("status") == "working"
        marks.add(name, marks.rule(name, "one_working_version"), HOLDER, [F.col("status")], working)


def _mark_references(marks: _Marks, tables: dict[str, DataFrame]) -> None:
    for child, rule, column, parent in references(tables):
        number, key = marks.rule(child, rule), F.col(schema.PRIMARY_KEY[parent])
        marks.add(child, number, CHILD, [F.col(column)], F.col(column).isNotNull())
        marks.add(parent, number, PARENT, [key], key.isNotNull())


def check_table(name: str, table: DataFrame) -> DataFrame:
    """Row rules and unique keys of one table as ``(table, rule, key, n_rows)``.

    ``key`` is the primary key for a row rule, and the doubled value for a unique key; its parts are
    joined by `/`, `-` for NULL. NULLs are equal in a key. ``n_rows``: rows that break the rule.
    """
    marks = _Marks()
    _mark_table(marks, name, table)
    return marks.broken({name: table})


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Values without a parent row, in the references between those of ``tables`` that are given."""
    marks = _Marks()
    _mark_references(marks, tables)
    return marks.broken(tables)


def check_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """Row rules, keys and references of all ``tables``: one scan of each, one shuffle for all."""
    marks = _Marks()
    for name, table in tables.items():
        _mark_table(marks, name, table)
    _mark_references(marks, tables)
    return marks.broken(tables)


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """All rule violations of a set of tables, overlaps included."""
    parts = [check_rules(tables)]
    if "forecast_entries" in tables:
        found = dq_overlap(tables["forecast_entries"])
        key = F.concat_ws("/", "version_id", "subject_key", F.col("valid_from").cast("string")).alias("key")
        parts.append(found.select(F.lit("forecast_entries").alias("table"), F.lit("no_overlap").alias("rule"), key, "n_rows"))
    return union_all(parts)
