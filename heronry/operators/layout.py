"""Tables laid out for the scans and joins that come again: folders by a column, buckets by a key.

A scan of some scopes reads their folders; a join on the folder's column prunes them by what the other side holds
once its filter has run; and two tables with the same buckets are joined where they lie, without an exchange."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame

from heronry.session import new_folder, removed


class Layout(NamedTuple):
    """rows: the table as it lies in its folder of the shared folder."""

    rows: DataFrame
    name: str
    path: str

    def dropped(self) -> None:
        """Takes the table off, its files too."""
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(spark, self.path)


def laid_out(rows: DataFrame, key: str, partitions: tuple[str, ...] = (), buckets: int = 8) -> Layout:
    """rows in folders by `partitions` (few values each), and in `buckets` by the hash of key, sorted by it. Tables that are to
    be joined on their keys take the same number of buckets: one for each task that a join shall have. A bucket of a
    folder is one file, as rows are dealt by bucket before they are written."""
    spark, name = rows.sparkSession, f"laid_out_{uuid.uuid4().hex}"
    path = new_folder(spark, name)
    dealt = rows.repartition(buckets, key)
    writer = dealt.write.option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)
    return Layout(spark.table(name), name, path)
