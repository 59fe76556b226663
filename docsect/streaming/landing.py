"""A landing folder as a stream: each micro-batch of new files is merged into a repository's index.

An addition of ours; the tools themselves are batch.  Files go through the rules that a batch index has: names, folders
and suffixes that are refused are passed over, and a file with secrets keeps its name and gets no sections.

Every row has a version.  Each file's state is the version last taken: of several in a batch the highest counts, and one that is not
above the last is late and refused, a deletion like any other.  Rows without a version count as older than all, and take turns by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsect.functions import safety as S
from docsect.operators.prepare import prepare
from docsect.operators.sections import parse_stored
from docsect.plans.store import IndexStore

LANDED = "file string, content string, deleted boolean, version long"
UNNUMBERED = -1


def latest(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row of a file's highest version, if that is above the last one's."""
    last, best = (state.get[0] if state.exists else None), None
    for pdf in rows:
        for content, deleted, version in zip(pdf["content"], pdf["deleted"], pdf["version"]):
            row = (UNNUMBERED if pd.isna(version) else int(version), bool(deleted) if deleted is not None else False, content or "")
            best = row if best is None or row > best else best
    if best and (last is None or best[0] > last or best[0] == last == UNNUMBERED):
        state.update((best[0],))
        yield pd.DataFrame([(key[0], None if best[1] else best[2], best[1], best[0])], columns=["file", "content", "deleted", "version"])


def follow(spark: SparkSession, folder: str, store: IndexStore, repo: str, checkpoint: str, parse=parse_stored):
    """Starts a query over Parquet files of LANDED in folder; ends when what is there has been read."""
    name = F.col("file")
    rows = spark.readStream.schema(LANDED).parquet(folder).filter(S.suffix_ok(name) & S.folder_ok(name) & ~S.sensitive_name(name))
    taken = rows.groupBy("file").applyInPandasWithState(latest, LANDED, "version long", "append", GroupStateTimeout.NoTimeout)

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            live = prepare(batch.filter(~F.col("deleted")).select(F.lit(repo).alias("repo"), "file", F.encode("content", "UTF-8").alias("content")))
            if store.meta(repo):
                store.apply(repo, live, batch.select(F.lit(repo).alias("repo"), "file", F.when(F.col("deleted"), "deleted").otherwise("changed").alias("change")), parse)
            else:
                store.save(repo, live, parse)
        finally:
            batch.unpersist()

    return taken.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
