"""The clean fact kept up to date by increments (C9's INSERT, D3's and D6's UPDATE, C12) instead of rebuilds.

Every step from C1 to C12 works order by order: totals, matching, reconciliation, the multi-store
rows, the set difference and both repairs of an order depend on its own lines, payments and reviews
and on the dimension rows they name. So after new rows arrive only the *touched* orders can change:
those of the new lines, payments and reviews, and those with lines of a new customer, product or
store. An increment

1. appends the new rows to the source tables (new files only),
2. runs the cleaning batch over all rows of the touched orders,
3. finds the fact's files that hold touched orders (one column is read), and writes these files'
   other rows and the touched orders' new rows as new files,
4. commits both by one manifest (:mod:`tillroll.sources.versions`).

Files without touched orders are listed again as they are. The fact is clustered by bill month
(``reconcile.BILL_MONTH``): an order has one bill date after D6, so a day's new orders land in files of
their own, next to the old ones. An increment is applied once: its name is in the manifest.

A hot order is one touched order like others. Only lists of files reach the driver.
"""

from __future__ import annotations

import os
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import reconcile
from tillroll.operators.perkey import members
from tillroll.plans.batch import CleaningBatch, Options, side_by_side
from tillroll.sources.stage import scratch_path, scratch_scope, write_stage
from tillroll.sources.tables import RetailTables
from tillroll.sources.versions import Manifest, Versions

FACT = "fact"
#: Source tables with an order's own rows, and the dimensions: key in the dimension, column of the lines.
PER_ORDER = ("orders", "payments", "reviews")
DIMENSIONS = {"customers": ("custid", "customer_id"), "products": ("product_id", "product_id"), "stores": ("storeid", "delivered_storeid")}


class IncrementalFact:
    """F8 in versions under ``root``, with the source rows it was made of."""

    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):
        self.spark, self.options = spark, options
        self.versions = Versions(spark, root)

    def fact(self, version: int | None = None) -> DataFrame:
        """The 19 columns of F8."""
        return self.fact_by_month(version).select(*reconcile.FACT_COLS)

    def fact_by_month(self, version: int | None = None) -> DataFrame:
        """F8 with the payment summary and the partition column ``BILL_MONTH``."""
        return self.versions.read(FACT, self.versions.manifest(version))

    def apply(self, name: str, new: RetailTables) -> int:
        """Merge the new rows; returns the version that has them. An increment already applied is left alone."""
        old = self.versions.manifest()
        if name in old.applied:
            return old.version
        now = Manifest(old.version + 1, [*old.applied, name], dict(old.files), dict(old.schemas))
        tables = new.as_dict()
        fresh = dict(zip(tables, side_by_side(self.spark, *[partial(self.versions.write, table, df, now.version) for table, df in tables.items()])))
        for table, df in tables.items():
            now.schemas.setdefault(table, df.schema.jsonValue())
            now.files[table] = [*old.files.get(table, []), *fresh[table]]
        added = {t: self.versions.read(t, now, f) for t, f in fresh.items()}
        every = {t: self.versions.read(t, now) for t in added}
        with scratch_scope(self.spark):
            keep = lambda name, df: write_stage(df, scratch_path(self.spark, f"increment-{name}"))
            if any(old.files.get(t) for t in tables):
                touched = keep("touched", self._touched(added, every))
                own = dict(zip(PER_ORDER, side_by_side(self.spark, *[partial(keep, t, members(every[t], touched, "order_id")) for t in PER_ORDER])))
            else:  # every order is new
                touched, own = None, {t: every[t].where(F.col("order_id").isNotNull()) for t in PER_ORDER}
            batch = CleaningBatch(self.spark, RetailTables(**own, **{t: every[t] for t in DIMENSIONS}), f"increment:{os.urandom(6).hex()}", options=self.options)
            try:
                rows = batch.fact_rows()
                now.schemas.setdefault(FACT, rows.schema.jsonValue())
                now.files[FACT] = self._merged(rows, touched, old, now)
            finally:
                batch.store.drop()
            self.versions.commit(now)
        return now.version

    def _touched(self, added: dict[str, DataFrame], every: dict[str, DataFrame]) -> DataFrame:
        """order_id of every order that the new rows can change."""
        found = [added[t].select("order_id") for t in PER_ORDER]
        for table, (key, column) in DIMENSIONS.items():
            keys = added[table].select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
            if keys.head(1):
                keys = write_stage(keys, scratch_path(self.spark, f"new-{table}"))
                found.append(every["orders"].join(keys, column, "left_semi").select("order_id"))
        return reduce(DataFrame.unionByName, found).where(F.col("order_id").isNotNull()).distinct()

    def _merged(self, rows: DataFrame, touched: DataFrame | None, old: Manifest, now: Manifest) -> list[str]:
        """The files of the fact after ``rows`` have replaced all rows of ``touched`` orders."""
        files, hit = old.files.get(FACT, []), set()
        if files:
            at = self.versions.read(FACT, old).select("order_id", F.col("_metadata.file_path").alias("_file"))
            held = members(at, touched, "order_id").select("_file").distinct().collect()  # names of files
            hit = {self.versions.relative(FACT, r._file) for r in held}
        if hit:
            kept = members(self.versions.read(FACT, old, sorted(hit)), touched, "order_id", has=False)
            rows = rows.unionByName(kept)
        made = self.versions.write(FACT, reconcile.by_month(rows), now.version, reconcile.BILL_MONTH, "order_id")
        return [*(f for f in files if f not in hit), *made]
