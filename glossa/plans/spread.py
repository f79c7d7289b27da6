"""Even distribution of rows before work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a table that is read in fewer pieces than there are cores.

    Few or badly split files would leave most of the cluster idle during
    scoring or parsing. Tables with enough pieces, such as any large one, pass
    through without a shuffle. Meant for a plain file scan, whose number of
    pieces is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
