"""The cleaning batch wired as stage tables, shared by every registered query.

``CleaningBatch(spark, tables, key)`` builds each stage on first use, writes it as parquet under
the session's checkpoint folder and re-reads it (see :mod:`tillroll.sources.stage`). One batch
per (Spark application, input) is memoised by :func:`batch_for`, so the ~90 registered
queries build the fact table and marts once.
"""

from __future__ import annotations

import copy
import dataclasses
import functools
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import marts, quality, reconcile
from tillroll.operators.lookup import Lookup, lookup
from tillroll.operators.perkey import Keep, likely_with
from tillroll.plans import segments
from tillroll.sources.stage import StageStore, files_fingerprint, input_fingerprint
from tillroll.sources.tables import CUSTOMER_COLS, STORE_COLS, fixture_tables


@dataclass(frozen=True)
class Options:
    """What a batch may do beyond the reference: the products' repaired categories in the fact
    (B7), the corrected stores' own city, state and region in the fact (B6), approximate distinct
    counts in the marts."""

    clean_categories: bool = False
    refresh_store_attrs: bool = False
    approx: bool = False


def side_by_side(spark: SparkSession, *builds: Callable) -> list:
    """What ``builds`` return, run at the same time: stages that do not need each other share the cluster instead of
    leaving it idle at each one's last tasks."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(b)) for b in builds]]


class CleaningBatch:
    """The staged cleaning batch over six source tables.

    ``tables`` is a :class:`RetailTables`, or a function ``stage -> RetailTables`` that derives the
    sources and stages each one as it goes (the fixture mapping). Real source tables are plain
    scans and are used as they are. Stages are found again by ``key`` and the tables' fingerprint; a
    function gives its own in ``inputs``. Stages that :class:`Options` change have names of their own.
    """

    def __init__(self, spark: SparkSession, tables, key: str, inputs: str | None = None, options: Options = Options()):
        self.spark = spark
        self.options = options
        self._lookups: dict[str, Lookup | None] = {}
        self._looking = threading.RLock()
        if inputs is None and not callable(tables):
            inputs = input_fingerprint([getattr(tables, f.name) for f in dataclasses.fields(tables)])
        self.store = StageStore(spark, key, inputs or "")
        if callable(tables):
            tables = tables(self._stage_source)
        self.t = tables

    def _stage_source(self, name: str, df: DataFrame) -> DataFrame:
        # Derived sources are staged once, so every later plan reads plain dimension scans, as
        # it would over real source tables.
        return self.store.stage(f"src_{name}", lambda: df, packed=name == "orders")

    def variant(self, **options) -> CleaningBatch:
        """This batch with other options; it shares the sources and every stage the options leave alone."""
        other = copy.copy(self)
        other.options = dataclasses.replace(self.options, **options)
        return other

    def _stage(self, name: str, build, lookup_by: str | None = None, depends: tuple[str, ...] = ("clean_categories",),
               partition_by: str | None = None, observe: dict[str, str] | None = None, packed: bool = False) -> DataFrame:
        """The stage ``name`` as the options that it ``depends`` on make it."""
        return self.store.stage(self._named(name, depends), build, lookup_by, partition_by, observe, packed)

    def _named(self, name: str, depends: tuple[str, ...]) -> str:
        return "-".join([name, *(o for o in depends if getattr(self.options, o))])

    def keeper(self, prefix: str, depends: tuple[str, ...] = ("clean_categories", "refresh_store_attrs")) -> Keep:
        """Where an operator's written tables go: with the stages, under names of their own."""
        return lambda name, df: self._stage(f"{prefix}.{name}", lambda: df, depends=depends)

    # -- C1–C6 ------------------------------------------------------------------------------
    def cust_order_totals(self) -> DataFrame:
        return self.order_totals().select("customer_id", "order_id", "totalamount")

    def order_totals(self) -> DataFrame:
        """C1 and the spread of each order's stores and dates: the one grouping of the order lines."""
        return self._stage("order_totals", lambda: reconcile.order_totals(self.t.orders), depends=())

    def order_payment_totals(self) -> DataFrame:
        return self.payments_per_order().select("order_id", "paymenttotal")

    def payments_per_order(self) -> DataFrame:
        """C2 and the payment summary: the one grouping of the payments."""
        return self._stage("payments_per_order", lambda: marts.payments_per_order(self.t.payments), depends=())

    def payment_summary(self) -> DataFrame:
        return self.payments_per_order().select("order_id", *marts.SUMMARY_COLS)

    def matched_orders(self) -> DataFrame:
        return reconcile.matched_orders(self.cust_order_totals(), self.order_payment_totals())

    def orders_not_matching(self) -> DataFrame:
        return reconcile.orders_not_matching(self.cust_order_totals(), self.order_payment_totals())

    def unmatched_orders(self) -> DataFrame:
        """C4 as C5 has written it, for the summary of checks."""
        return self.keeper("remaining_orders", ())("orders_not_matching", self.orders_not_matching())

    def mixed_orders(self) -> DataFrame:
        """The orders that are ``MIXED``, and which of them have several stores: the one grouping of C1 by order."""
        return self._stage("mixed_orders", lambda: reconcile.order_spread(self.order_totals(), self.keeper("mixed_orders", ())), depends=())

    def remaining_orders(self) -> DataFrame:
        return reconcile.remaining_orders(self.orders_not_matching(), self.t.orders, self.keeper("remaining_orders", ()))

    def reconciled_orders(self) -> DataFrame:
        # C7's stage computes C6 and C7 together (reconcile.reconciled_integrated)
        return reconcile.reconciled_orders(self.t.orders, self.matched_orders(), self.remaining_orders())

    def lookups(self) -> reconcile.Lookups:
        """The dimensions whose attributes need no join."""
        dims = {"products": (self._products(), ["product_id", "category"], ("clean_categories",)),
                "stores": (self.t.stores, STORE_COLS, ()), "customers": (self.t.customers, CUSTOMER_COLS, ())}
        at = {name: self._named(name, depends) for name, (_, _, depends) in dims.items()}
        with self._looking:
            new = [name for name in dims if at[name] not in self._lookups]

            def made(name: str) -> Lookup | None:
                dim, (key, *attrs), depends = dims[name]
                return lookup(dim, key, attrs, name, self.keeper("lookups", depends))

            if new:
                found = side_by_side(self.spark, *[functools.partial(made, name) for name in new])
                self._lookups |= {at[name]: x for name, x in zip(new, found)}
        return {name: self._lookups[at[name]] for name in dims}

    # -- C7–C12 ------------------------------------------------------------------------------
    def integrated_orders(self) -> DataFrame:
        return reconcile.copies(self.integrated_lines().select(*reconcile.FACT_COLS, reconcile.COPIES))

    def integrated_lines(self) -> DataFrame:
        """C7 with each line once, the number of its copies, its order's payment summary and whether its order is ``MIXED``."""
        t = self.t

        def build() -> DataFrame:
            mixed = self.mixed_orders().select("order_id").withColumn(reconcile.MIXED, F.lit(True))
            lines = reconcile.reconciled_integrated(t.orders, self.matched_orders(), self.remaining_orders(), t.reviews, self._products(),
                                                    t.stores, t.customers, [self.payment_summary(), mixed], self.keeper("integrated_orders", ()), self.lookups())
            return lines.withColumn(reconcile.MIXED, F.coalesce(reconcile.MIXED, F.lit(False)))

        return self._stage("integrated_orders", build, packed=True)

    def multi_store_lines(self) -> DataFrame:
        # read only by C9's insert, which is staged
        return reconcile.multi_store_lines(self.t.orders, self.keeper("multi_store_lines", ()), self.mixed_orders().where("_several").select("order_id"))

    def multi_store_insert(self) -> DataFrame:
        t = self.t
        return self._stage("multi_store_insert", lambda: reconcile.multi_store_insert(
            self.multi_store_lines(), self._products(), t.payments, t.customers, t.reviews, t.stores, self.keeper("multi_store_insert", ()),
            self.payments_per_order().select("order_id", F.col("_np").alias("_n2")), self.lookups()), packed=True)

    def append_multi_store(self) -> DataFrame:
        return reconcile.append_multi_store(self.integrated_orders(), self.multi_store_insert())

    def multi_store_records(self) -> DataFrame:
        return reconcile.multi_store_records(self.multi_store_insert())

    def finalised_records(self) -> DataFrame:
        return self.settled_lines().select(*reconcile.FACT_COLS).unionByName(self.finalised_mixed())

    def settled_lines(self) -> DataFrame:
        """C11's rows of the orders that are not ``MIXED``, with the payment summary: C9 and C10 have no row of such an order,
        so the set difference only removes their repeated lines (copies of a line make no difference to it)."""
        lines = self.integrated_lines().where(~F.col(reconcile.MIXED)).select(*reconcile.FACT_COLS, *marts.SUMMARY_COLS)
        return reconcile.unrepeated(lines, reconcile.FACT_COLS, self.keeper("settled_lines", ("clean_categories",)))

    def finalised_mixed(self) -> DataFrame:
        """C11's other rows: those of ``MIXED`` orders, and of C9's insert."""
        def build() -> DataFrame:
            lines, insert = side_by_side(self.spark, self.integrated_lines, self.multi_store_insert)
            return reconcile.finalised_with_insert(lines.where(reconcile.MIXED), insert, self.keeper("finalised_records"))

        return self._stage("finalised_mixed", build, packed=True)

    def store_fixed(self) -> DataFrame:
        """F8 after D3 only (the state the reference's D4 and D5 read): the fact stage with each
        line's bill date from before D6 — a projection, no recomputation."""
        return self._before_date_fix().select(*reconcile.FACT_COLS)

    def _before_date_fix(self) -> DataFrame:
        return self.fact_with_payments().select(*[
            F.col(reconcile.BILL_DATE_BEFORE_FIX).alias(c) if c == "bill_date_timestamp" else F.col(c)
            for c in (*reconcile.FACT_COLS, reconcile.MIXED)])

    def stores_fixed_of_finalised(self) -> DataFrame:
        """D3 on C11: lines of orders that are not ``MIXED`` have their order's only store already."""
        fixed = reconcile.fix_store_to_min(self.finalised_mixed(), self.keeper("fix_store_to_min"))
        return self.settled_lines().select(*reconcile.FACT_COLS).unionByName(fixed)

    def dates_fixed(self) -> DataFrame:
        """D6 on F8 after D3: lines of orders that are not ``MIXED`` have their order's only date already."""
        lines = self._before_date_fix()
        mixed = lines.where(reconcile.MIXED).select(*reconcile.FACT_COLS)
        return (lines.where(~F.col(reconcile.MIXED)).select(*reconcile.FACT_COLS)
                .unionByName(quality.fix_date_to_latest(mixed, self.keeper("fix_date_to_latest"))))

    def fact_with_payments(self) -> DataFrame:
        """F8 plus each order's payment summary (``marts.SUMMARY_COLS``), appended in C6's or C12's
        per-order join, and each line's bill date before D6; the payment-weighted marts and the
        after-D3 checks read it without joins of their own. Only ``MIXED`` orders meet C12's repairs."""
        def build() -> DataFrame:
            settled, mixed = self._fact_parts()
            late = {} if self.options.refresh_store_attrs else reconcile.late_attributes(settled, self.lookups())
            fact = self._put_together(reconcile.without_attributes(settled, late), mixed)
            return reconcile.with_attributes(reconcile.by_month(fact), late)

        return self._stage("clean_fact", build, "order_id", self.FACT_OPTIONS, reconcile.BILL_MONTH, reconcile.FACT_CHECKS, packed=True)

    def _fact_parts(self) -> tuple[DataFrame, DataFrame]:
        """The fact's lines of orders that are not ``MIXED``, and the others."""
        keep = lambda name, df: self._stage(f"clean_fact.{name}", lambda: df, depends=self.FACT_OPTIONS, observe=reconcile.ORDER_CHECKS)
        summary = likely_with(self.payment_summary(), self.mixed_orders(), "order_id")
        mixed = reconcile.clean_fact(self.finalised_mixed(), summary, True, keep)
        settled = reconcile.clean_as_is(self.settled_lines(), marts.SUMMARY_COLS)
        return settled.withColumn(reconcile.MIXED, F.lit(False)), mixed.withColumn(reconcile.MIXED, F.lit(True))

    def _put_together(self, settled: DataFrame, mixed: DataFrame) -> DataFrame:
        fact = settled.unionByName(mixed)
        return reconcile.with_month(reconcile.refresh_store_attrs(fact, self.t.stores) if self.options.refresh_store_attrs else fact)

    def fact_rows(self) -> DataFrame:
        """The rows of :meth:`fact_with_payments`, neither laid out by month nor written: for a table of the caller's own."""
        return self._put_together(*self._fact_parts())

    #: The options that the fact depends on.
    FACT_OPTIONS = ("clean_categories", "refresh_store_attrs")

    def seen_while_writing(self) -> dict[str, int]:
        """The counts that the writes of the per-order table and of the fact have gathered (ORDER_CHECKS, FACT_CHECKS)."""
        self.fact_with_payments()
        names = [self._named(n, self.FACT_OPTIONS) for n in (f"clean_fact.{reconcile.ORDER_REPAIRS}", "clean_fact")]
        return {k: v for n in names for k, v in self.store.seen(n).items()}

    def fact_by_month(self) -> DataFrame:
        """F8 and its partition column ``reconcile.BILL_MONTH``: reports of a period read only its months."""
        return self.fact_with_payments().select(*reconcile.FACT_COLS, reconcile.BILL_MONTH)

    def clean_fact(self) -> DataFrame:
        """F8, the 19 columns (the summary columns are pruned at the parquet scan)."""
        return self.fact_with_payments().select(*reconcile.FACT_COLS)

    def rfm_base(self) -> DataFrame:
        """Recency, frequency and monetary value per customer (A18 reads it four times)."""
        return self._stage("rfm_base", lambda: segments.rfm_base(self.clean_fact()), depends=("clean_categories", "refresh_store_attrs"))

    # -- P8 ----------------------------------------------------------------------------------
    def products_na_fixed(self) -> DataFrame:
        return quality.fix_na_category(self.t.products)

    def products_clean(self) -> DataFrame:
        return quality.fix_missing_attributes(self.products_na_fixed())

    def _products(self) -> DataFrame:
        return self.products_clean() if self.options.clean_categories else self.t.products

    # -- marts -------------------------------------------------------------------------------
    def _mart(self, name: str, build) -> DataFrame:
        return self._stage(name, build, depends=("clean_categories", "refresh_store_attrs", "approx"))

    def customer_360(self) -> DataFrame:
        return self._mart("customer_360", lambda: marts.customer_360(
            self.t.customers, self.fact_with_payments(), None, approx=self.options.approx))

    def customer_360_dedup(self) -> DataFrame:
        return self._mart("customer_360_dedup", lambda: marts.customer_360(
            self.t.customers, self.fact_with_payments(), None, dedupe_payments=True, approx=self.options.approx))

    def orders_360(self) -> DataFrame:
        return self._mart("orders_360", lambda: marts.orders_360(
            self.fact_with_payments(), None, approx=self.options.approx))

    def orders_360_dedup(self) -> DataFrame:
        return self._mart("orders_360_dedup", lambda: marts.orders_360(
            self.fact_with_payments(), None, dedupe_payments=True, approx=self.options.approx))

    def store_360(self) -> DataFrame:
        return self._mart("store_360", lambda: marts.store_360(
            self.clean_fact(), self.t.stores, approx=self.options.approx))


_PIPELINES: dict[tuple[str, str, str], CleaningBatch] = {}
_LOCK = threading.Lock()


def batch_for(spark: SparkSession, sf_dir: str) -> CleaningBatch:
    """The memoised cleaning batch over the fixture tables derived from ``sf_dir``."""
    folder = sf_dir.rstrip("/")
    files = [f"{folder}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    key = (spark.sparkContext.applicationId, folder, files_fingerprint(spark, files))
    with _LOCK:
        p = _PIPELINES.get(key)
        if p is None:
            p = CleaningBatch(spark, lambda stage: fixture_tables(spark, sf_dir, stage), key="fixture:" + folder, inputs=key[2])
            _PIPELINES[key] = p
        return p
