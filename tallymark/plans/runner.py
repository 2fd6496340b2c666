"""The daily run: layer by layer, models are built and stored, then tested; an error stops what comes after."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tallymark import contracts as C
from tallymark.operators import events as E
from tallymark.operators import staging as staging_days
from tallymark.plans import checks as K
from tallymark.plans import gold as G
from tallymark.plans import reports as R

log = logging.getLogger(__name__)
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """A data test: the rows that break it. One that looks at a row of one table alone says so by ``bad``, one on keys that occur
    more than once by ``key``: these run together (``broken``)."""

    name: str
    rows: Callable[[Tables], DataFrame]
    severity: str = "error"
    table: str | None = None
    bad: Callable[[], Column] | None = None
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layer:
    name: str
    models: dict[str, Callable[[Tables], DataFrame]]
    checks: list[Check] = field(default_factory=list)


class CheckFailed(RuntimeError):
    pass


def _row(name: str, table: str, bad: Callable[[], Column], severity: str = "error") -> Check:
    return Check(name, lambda t: t[table].where(bad()), severity, table, bad)


def _unique(name: str, table: str, *columns: str) -> Check:
    return Check(name, lambda t: K.unique(t[table], *columns), table=table, key=columns)


def _keys(table: str, *columns: str) -> list[Check]:
    return [check for c in columns for check in (_unique(f"{table}.{c} unique", table, c), *_filled(table, c))]


def _filled(table: str, *columns: str) -> list[Check]:
    return [_row(f"{table}.{c} not null", table, lambda c=c: F.col(c).isNull()) for c in columns]


def _one_of(table: str, column: str, *values: str, severity: str = "error") -> Check:
    return _row(f"{table}.{column} accepted", table, lambda: F.col(column).isNotNull() & ~F.col(column).isin(*values), severity)


def _grain(table: str, *columns: str) -> Check:
    return _unique(f"{table} grain", table, *columns)


def _link(child: str, column: str, parent: str, parent_column: str | None = None) -> Check:
    return Check(f"{child}.{column} in {parent}", lambda t: K.foreign_key(t[child], column, t[parent], parent_column or column))


def _rule(table: str, rule: str) -> Check:
    return _row(f"{table}: {rule}", table, lambda: ~F.coalesce(F.expr(rule), F.lit(False)))


def broken(tables: Tables, checks: list[Check]) -> set[str]:
    """The names of the checks that some rows break. All tests on rows of a table are counted in one aggregate of it, each set
    of key columns in one more however many tests name it, and both come with one query a table; the others ask for a first row."""
    found = set()
    for table in dict.fromkeys(c.table for c in checks if c.table):
        df, mine, parts = tables[table], [c for c in checks if c.table == table], []
        if by_row := [c for c in mine if c.bad]:
            counts = df.agg(*[F.count_if(F.coalesce(c.bad(), F.lit(False))).alias(f"_{i}") for i, c in enumerate(by_row)])
            parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"_{i}").alias("n")) for i, c in enumerate(by_row)]))))
        for key in dict.fromkeys(c.key for c in mine if c.key):
            names = F.array(*[F.lit(c.name) for c in mine if c.key == key])
            parts.append(df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.explode(names).alias("name"), "n"))
        found |= {r["name"] for r in reduce(DataFrame.unionByName, parts).collect() if r["n"]}
    return found | {c.name for c in checks if not c.table and not c.rows(tables).isEmpty()}


#: Days that landed and staged rows are held against each other: more than the look-back, so that it cannot hide a loss.
RECON_DAYS = 7
SUMS = ("total_quantity", "gross_amount", "net_amount", "cost_amount", "shipping_amount")


def layers(as_of=None) -> list[Layer]:
    """The models and their tests. The tables ``orders`` and ``quality_events`` are given (landed, not yet deduplicated)."""
    now = F.current_timestamp() if as_of is None else as_of
    recent = lambda df, at: df.where(staging_days.lookback(F.col(at), now, RECON_DAYS))
    recon = lambda t, raw, staged, at, key: staging_days.reconcile(recent(t[raw], at), recent(t[staged], at), at, key)
    staging = Layer(
        "staging",
        {"stg_orders": lambda t: G.dedup_orders(t["orders"]), "stg_quality_events": lambda t: G.dedup_events(t["quality_events"])},
        [
            *_keys("stg_orders", "raw_id", "id", "order_id"),
            *_filled("stg_orders", "received_at", "has_clean_error", "has_schema_drift"),
            Check("stg_orders error rate, latest day", lambda t: R.gate(t["stg_orders"], "has_clean_error", C.GATE_THRESHOLD, "received_at")),
            Check("stg_orders error rate, all", lambda t: R.gate(t["stg_orders"], "has_clean_error", C.MONITOR_THRESHOLD), "warn"),
            *_keys("stg_quality_events", "id"),
            *_filled("stg_quality_events", "raw_id", "order_id", "event_type", "to_state", "event_at"),
            _one_of("stg_quality_events", "event_type", *C.EVENT_TYPES, severity="warn"),
            _one_of("stg_quality_events", "to_state", C.CLEAN, C.QUARANTINED, C.PROMOTED, C.RE_QUARANTINED, C.REJECTED, severity="warn"),
            Check("stg_orders matches what landed", lambda t: recon(t, "orders", "stg_orders", "received_at", "raw_id")),
            Check("stg_quality_events matches what landed", lambda t: recon(t, "quality_events", "stg_quality_events", "event_at", "id")),
        ],
    )
    intermediate = Layer(
        "intermediate",
        {"int_order_states": lambda t: E.with_effective_state(t["stg_orders"], t["stg_quality_events"]), "int_orders": lambda t: E.clean_side(t["int_order_states"]), "int_orders_quarantine": lambda t: E.quarantine_side(t["int_order_states"]), "int_order_items": lambda t: G.order_items(t["int_orders"])},
        [
            *_keys("int_orders", "raw_id", "order_id"),
            *_filled("int_orders", "received_at", "has_clean_error", "effective_quality_state"),
            _one_of("int_orders", "effective_quality_state", C.CLEAN, C.PROMOTED),
            *_keys("int_orders_quarantine", "raw_id", "order_id"),
            *_filled("int_orders_quarantine", "effective_quality_state", "quarantined_at"),
            _one_of("int_orders_quarantine", "effective_quality_state", C.QUARANTINED, C.REJECTED),
            *_keys("int_order_items", "int_order_item_key"),
            *_filled("int_order_items", "raw_id", "order_id", "item_index"),
            _link("int_order_items", "raw_id", "int_orders"),
            _grain("int_order_items", "raw_id", "item_index"),
            Check("orders split is a partition", lambda t: K.split_is_partition(t["stg_orders"], t["int_orders"], t["int_orders_quarantine"])),
            _row("no unpromoted dirty order", "int_orders", lambda: F.col("has_clean_error") & (F.col("effective_quality_state") != C.PROMOTED)),
            Check("quality state resolved", lambda t: K.state_resolved(t["int_orders"].unionByName(t["int_orders_quarantine"], allowMissingColumns=True), now), "warn"),
            Check("initial event shares the order's instant", lambda t: K.initial_event_time(t["stg_orders"], t["stg_quality_events"]), "warn"),
        ],
    )
    marts = Layer(
        "marts",
        {
            "dim_customer": lambda t: G.dim_customer(t["int_orders"]),
            "dim_product": lambda t: G.dim_product(t["int_order_items"], t["int_orders"]),
            "fct_order_items": lambda t: G.fct_order_items(t["int_order_items"], t["int_orders"]),
            "fct_orders": lambda t: G.fct_orders(t["int_orders"], t["int_order_items"]),
        },
        [
            *_keys("dim_customer", "customer_id"),
            *_keys("dim_product", "product_id"),
            *_keys("fct_orders", "order_id"),
            *_filled("fct_orders", "customer_id", *G.COUNTERS, "effective_quality_state", "raw_id"),
            _link("fct_orders", "customer_id", "dim_customer"),
            _one_of("fct_orders", "effective_quality_state", C.CLEAN, C.PROMOTED),
            *_keys("fct_order_items", "order_item_key"),
            *_filled("fct_order_items", "order_id", "item_index", "product_id", "customer_id"),
            _link("fct_order_items", "order_id", "fct_orders"),
            _link("fct_order_items", "product_id", "dim_product"),
            _link("fct_order_items", "customer_id", "dim_customer"),
            _grain("fct_order_items", "order_id", "item_index"),
            Check("fct_orders is a complete projection", lambda t: K.complete_projection(t["int_orders"], t["fct_orders"])),
            Check("fct_orders rollup matches items", lambda t: K.rollup_matches(t["fct_orders"], G.item_rollup(t["fct_order_items"]), "order_id", G.COUNTERS, SUMS)),
            Check("product attributes stable", lambda t: K.attributes_stable(t["int_order_items"], "product_id", ("product_name", "category", "sub_category", "brand", "condition")), "warn"),
        ],
    )
    reports = Layer(
        "reports",
        {
            "rpt_quality_events_daily": lambda t: R.quality_events_daily(t["stg_quality_events"]),
            "rpt_quality_backlog": lambda t: R.quality_backlog(t["int_orders_quarantine"]),
            "rpt_sales_daily_by_category": lambda t: R.sales_daily_by_category(t["fct_order_items"], t["dim_product"], t["fct_orders"]),
        },
        [
            *_filled("rpt_quality_events_daily", "event_date", "rule_version"),
            _row("initial evaluations are not negative", "rpt_quality_events_daily", lambda: F.col("initial_evaluations") < 0),
            _grain("rpt_quality_events_daily", "event_date", "rule_version"),
            _row("initial events split", "rpt_quality_events_daily", lambda: F.expr("initial_clean + initial_quarantined <> initial_evaluations")),
            *_filled("rpt_quality_backlog", "quarantined_date", "rule_version", "state", "code"),
            _one_of("rpt_quality_backlog", "state", C.QUARANTINED, C.REJECTED),
            _grain("rpt_quality_backlog", "quarantined_date", "rule_version", "state", "code"),
            _rule("rpt_quality_backlog", "orders_primary_code <= orders_with_code"),
            Check("backlog balances", lambda t: K.backlog_balances(t["rpt_quality_backlog"], t["int_orders_quarantine"])),
            *_filled("rpt_sales_daily_by_category", "order_date", "category"),
            _grain("rpt_sales_daily_by_category", "order_date", "category", "is_returned"),
            *[_rule("rpt_sales_daily_by_category", r) for r in ("orders <= items", "customers <= orders", "items_missing_amount <= items", "items_missing_cost <= items and items_missing_shipping <= items")],
            Check("sales lose no item", lambda t: K.no_item_loss(t["rpt_sales_daily_by_category"], t["fct_order_items"])),
        ],
    )
    return [staging, intermediate, marts, reports]


#: Tables stored by day of the order; large days are split over tasks, small ones share them.
BY_DAY = {"fct_orders": "order_date", "fct_order_items": "order_date", "rpt_sales_daily_by_category": "order_date"}
#: Tables whose days are replaced one by one: (the table read, its instant; own instant, partition, cluster keys).
INCREMENTAL = {
    "stg_orders": ("orders", "received_at", "received_at", "day", ["raw_id"]),
    "stg_quality_events": ("quality_events", "event_at", "event_at", "day", ["raw_id"]),
    "rpt_quality_events_daily": ("stg_quality_events", "event_at", "event_date", "event_date", ["rule_version"]),
}


@dataclass(frozen=True)
class Days:
    """The days that an incremental run replaces: those since ``lookback`` days before ``as_of``, or [start, end)."""

    as_of: Column = field(default_factory=F.current_timestamp)
    lookback: int = C.LOOKBACK_DAYS
    start: dt.date | None = None
    end: dt.date | None = None

    def hold(self, at: str) -> Column:
        if self.start is not None:
            return staging_days.day_range(F.col(at), self.start, self.end)
        return staging_days.lookback(F.col(at), self.as_of, self.lookback)


def store(df: DataFrame, path: str, day: str | None = None) -> None:
    if day is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(path)


def build(spark: SparkSession, name: str, model: Callable[[Tables], DataFrame], tables: Tables, path: str, days: Days | None) -> DataFrame:
    """The stored model. An incremental one is built from the days wanted and replaces these; all, where there is no
    table yet or no days are given."""
    if name not in INCREMENTAL:
        store(model(tables), path, BY_DAY.get(name))
        return spark.read.parquet(path)
    source, read_at, at, day, cluster = INCREMENTAL[name]
    if days is None or not staging_days.days_of(spark, path, day):
        staging_days.overwrite_all(model(tables), path, at, cluster, day)
    else:
        staging_days.overwrite_days(model(tables | {source: tables[source].where(days.hold(read_at))}), path, at, cluster, day)
    out = spark.read.parquet(path)
    return out.drop(day) if day != at else out


def require_landed(offered: DataFrame, landed: DataFrame, key: str = "batch", least: float = 1.0) -> None:
    """Raises CheckFailed unless every batch landed: one of which a number is not known has not."""
    bad = staging_days.landing_gate(offered, landed, key, least).where("verdict <> 'pass'")
    if some := bad.orderBy(key).limit(20).collect():
        said = "; ".join(f"{r[key]}: {r['verdict']}, {r['landed']} of {r['offered']}" for r in some)
        raise CheckFailed(f"landing: {said}{' ...' * (len(some) == 20)}")


def run(spark: SparkSession, tables: Tables, root: str, plan: list[Layer] | None = None, days: Days | None = None, gate: Callable[[], None] | None = None, keep_from: dt.date | None = None) -> tuple[Tables, dict[str, str]]:
    """Builds every layer under ``root`` and tests it before the next. Returns the tables and each test's outcome;
    raises CheckFailed after all of a layer's tests ran, if one of severity error found rows. With ``days`` the
    incremental tables replace these days only; a run over late rows then equals a full one. A ``gate`` (``require_landed``)
    is asked before anything is built. When all tests have passed, the stored days before ``keep_from`` are deleted."""
    tables, outcome = dict(tables), {}
    if gate is not None:
        gate()
    for layer in plan or layers():
        for name, model in layer.models.items():
            tables[name] = build(spark, name, model, tables, f"{root}/{name}", days)
        failed, bad = [], broken(tables, layer.checks)
        for check in layer.checks:
            outcome[check.name] = ("fail" if check.severity == "error" else "warn") if check.name in bad else "pass"
            if check.name in bad:
                log.warning("%s: %s", outcome[check.name], check.name)
                failed += [check.name] if check.severity == "error" else []
        if failed:
            raise CheckFailed(f"{layer.name}: {'; '.join(failed)}")
    if keep_from is not None:
        for name in [n for n in tables if n in BY_DAY or n in INCREMENTAL]:
            day = BY_DAY.get(name) or INCREMENTAL[name][3]
            if staging_days.expire_days(spark, f"{root}/{name}", keep_from, day):
                out = spark.read.schema(tables[name].schema if day in tables[name].columns else StructType([*tables[name].schema, StructField(day, DateType())])).parquet(f"{root}/{name}")
                tables[name] = out.select(*tables[name].columns)
    return tables, outcome


def try_all(jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Runs every job; raises at the end if any failed, so that one table's trouble doesn't hold up the others."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as e:  # noqa: BLE001 - all are reported together
            failed[name] = e
    if failed:
        raise ExceptionGroup(f"failed: {', '.join(failed)}", list(failed.values()))
    return done
