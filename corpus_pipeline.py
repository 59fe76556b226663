"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

Null, empty and too short texts go in the first stage, whose base rule asks for ten words; those that later lose all their
words go there.  Very long texts are rows like others.  Repeated rows are near duplicates, of which one stays; ties go to the smaller doc_id,
then to the text; a null doc_id counts as the last.  Extra columns are passed on, whatever they are called, up to the packing, which has its own.
An empty table has no rows at any stage.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsect.llm.common import Scratch
from docsect.llm.minhash import keep_first
from docsect.llm.packing import pack
from docsect.llm.pii import sanitise
from docsect.llm.quality import keep_good
from docsect.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, taken out of their texts."""
    return sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    return pack(docs)


#: By table and stage: what the results of a stage still read, a list for each call, and the calls of its successor so far.
_left: dict[tuple[str, str], list[list[Scratch]]] = {}
_followed: dict[tuple[str, str], int] = {}
_lock = threading.Lock()


def _taken(sf_dir: str, before: str | None) -> list[Scratch]:
    """What may go now that before's successor begins: nothing while there are more results than successors, as one may be unread."""
    key = (sf_dir, before)
    with _lock:
        if before is None or key not in _left:
            return []
        _followed[key] = _followed.get(key, 0) + 1
        if _followed[key] < len(_left[key]):
            return []
        _followed.pop(key)
        return [x for each in _left.pop(key) for x in each]


def _stage(name: str, before: str | None, f: Callable[..., DataFrame]) -> tuple[str, Callable[..., DataFrame]]:
    """The stage, which first deletes what its predecessor has left: its docs are that one's result, written and read again."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for x in _taken(sf_dir, before):
            x.clear()
        with Scratch.collected() as mine:
            out = f(spark, docs, sf_dir)
        with _lock:
            _left.setdefault((sf_dir, name), []).append(mine)
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return name, run


STAGES = [
    _stage("quality rules", None, quality_rules),
    _stage("MinHash near-dedup", "quality rules", near_dedup),
    _stage("substring dedup", "MinHash near-dedup", substring_dedup),
    _stage("PII", "substring dedup", personal_data),
    _stage("best-fit packing", "PII", best_fit_packing),
]

#: SQL cannot express learned rules, min-hashes or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
