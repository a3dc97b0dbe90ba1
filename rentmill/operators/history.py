"""Price history that grows with what is observed: a log that is only added to, and each key's last price.

An append compares the new observations with each other and with the last price of their keys, which is read from the
parts that they touch; the log isn't read. An observation that arrives late, after one of its key that was seen later,
changes what its successor compares with: the key's history is then taken from the log, put in order with what is new,
and added again as a whole, and the key's ``base``, the version from which its rows count, moves on. The log, the parts
and their bases are one version, committed by one manifest (see ``table``)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import KEY
from .table import Manifest, PartedTable, stage

OBSERVED = "platform string, external_id string, seen_at timestamp, price_cad decimal(10,2)"
LOGGED = f"{OBSERVED}, previous decimal(10,2), drop decimal(11,2), version int"
LAST = "platform string, external_id string, last struct<seen_at timestamp, price_cad decimal(10,2)>, base int"
COLUMNS = ("platform", "external_id", "seen_at", "price_cad")


def compared(rows: DataFrame, before: Column) -> DataFrame:
    """``rows`` of whole keys in order, each with the price ``previous`` to it (the first: ``before``) and its ``drop``."""
    w = W.partitionBy(*KEY).orderBy("seen_at", "price_cad")
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("previous", F.when(first, before).otherwise(F.lag("price_cad").over(w)))
    return rows.withColumn("drop", F.when(F.col("price_cad") < F.col("previous"), F.col("previous") - F.col("price_cad")))


class PriceHistory(PartedTable):
    """The history in the folder ``root``. Its parts hold each key's ``last`` observation and ``base``."""

    def append(self, observations: DataFrame) -> int | None:
        """Add ``observations`` (key, seen_at, price_cad); those without a price don't count. The new version."""
        spark, last = self.spark, self.newest()
        parts = last.parts if last else self.new_parts
        rows = observations.where("price_cad IS NOT NULL").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in OBSERVED.split(", ")))
        staged = stage(rows, parts)
        if not staged.parts:
            return self.version()
        version, touched = last.version + 1 if last else 0, sorted(staged.parts)
        known = [str(p) for p in touched if last and str(p) in last.folders]
        state = self._rows(last, known) if last else spark.createDataFrame([], LAST)
        seen = F.struct("seen_at", "price_cad")
        new = staged.rows.groupBy(*KEY).agg(F.min(seen).alias("first"), F.max(seen).alias("newest"))
        keys = new.join(state, list(KEY), "full_outer").withColumn("late", F.coalesce(F.col("first") < F.col("last"), F.lit(False)))

        rebased = F.when(F.col("late"), version).otherwise(F.coalesce("base", F.lit(0))).alias("base")
        folders, schema = self._write(keys.select(*KEY, F.greatest("last", "newest").alias("last"), rebased), parts, touched)
        after = self._rows(Manifest(version, parts, schema, folders), folders)
        late = after.where(F.col("base") == version).select(*KEY) if last else None
        some_late = last is not None and bool(late.limit(1).count())

        of_state = state.select(*KEY, F.col("last.price_cad").alias("_before"))
        punctual = staged.rows.join(of_state, list(KEY), "left")
        if some_late:
            punctual = punctual.join(late, list(KEY), "left_anti")
        added = compared(punctual, F.col("_before")).drop("_before")
        if some_late:
            whole = self._log(last, state).join(late, list(KEY), "left_semi").select(*COLUMNS)
            whole = whole.unionByName(staged.rows.join(late, list(KEY), "left_semi"))
            added = added.unionByName(compared(whole, F.lit(None).cast("decimal(10,2)")))
        folder = f"data/{uuid.uuid4().hex}"
        added.withColumn("version", F.lit(version)).write.parquet(f"{self.root}/{folder}")
        log = [*(last.log if last else []), folder]
        everywhere = (last.folders if last else {}) | folders
        self._commit(Manifest(version, parts, schema, everywhere, {}, log, some_late or bool(last and last.rebased)))
        return version

    def history(self) -> DataFrame:
        """All observations: key, seen_at, price_cad, previous, drop."""
        last = self.newest()
        if last is None:
            return self.spark.createDataFrame([], LOGGED).drop("version")
        return self._log(last, self._rows(last, None)).drop("version")

    def _log(self, m: Manifest, state: DataFrame) -> DataFrame:
        """The rows of the log that count, of the keys in ``state``."""
        rows = self.spark.read.schema(LOGGED).parquet(*(f"{self.root}/{f}" for f in m.log))
        if not m.rebased:
            return rows
        return rows.join(state.select(*KEY, "base"), list(KEY)).where("version >= base").drop("base")
