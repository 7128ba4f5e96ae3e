"""Tables that queries share: built once for the files that they are made of, read by every query after that."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.versions import derived

#: Changes when what the builders below write changes: tables of an older kind are built again.
KIND = "1"


def stored(spark: SparkSession, sf: str, name: str, tables: Sequence[str], make: Callable[[], DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """``make()`` as it was last written for the tables' files; sorted within files by ``order``, so that a filter on it skips row groups."""

    def write(path: str, others: dict) -> None:
        rows = make()
        if order:
            rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        rows.write.parquet(path)

    found = derived(spark, name, [f"{sf}/{t}.parquet" for t in tables], write, KIND)
    return spark.read.parquet(found["path"])
