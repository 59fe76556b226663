"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditionals.

The statistics of every whole text are native column expressions.  Learning is sequential covering on the labelled
rows: a rule is a conjunction of thresholds grown by information gain on two thirds of them, pruned on the rest, and
kept if it is precise enough there; rows it covers then leave the race.  Every step is one DataFrame aggregation that
returns the class counts by feature and threshold (at most features x BINS x 2 rows), so all labelled rows take part
however many there are.  Only DataFrame functions are used.

Null text has no words and fails the base rule.  Labels may be missing, null or repeated; without both classes there
are no rules and the base rule decides alone.  Extra columns and clashing names pass through keep_good() untouched.
Very long texts are counted whole; repeated rows get the same verdict; an empty table has no rows.  Repeated windows are
told by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import Scratch, with_clear_names

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
BINS = 24
MAX_RULES, MAX_TERMS = 8, 3
MIN_PRECISION, MIN_COVER = 0.9, 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share")


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with its statistics, and the name each one has there; the names clash with none of docs."""
    tag = uuid.uuid4().hex[:8]
    name = {k: f"_{k}_{tag}" for k in ("words", "lines", "grams", "sorted", "dups", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "upper", "marks", "distinct", *FEATURES)}
    col = {k: F.col(v) for k, v in name.items()}
    whole = F.coalesce(F.col(text), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    out = docs.withColumns({
        name["words"]: F.filter(F.split(whole, BREAKS), lambda w: w != ""),
        name["lines"]: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        name["n_symbols"]: (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        name["upper"]: (F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))).cast("long"),
        name["marks"]: (F.length(whole) - F.length(F.translate(whole, "!?", ""))).cast("long"),
    })
    out = out.withColumns({
        name["n_words"]: size(col["words"]),
        name["word_chars"]: F.length(F.array_join(col["words"], "")).cast("long"),
        name["distinct"]: size(F.array_distinct(col["words"])),
        name["n_lines"]: size(col["lines"]),
        name["n_dup_lines"]: size(col["lines"]) - size(F.array_distinct(col["lines"])),
        name["grams"]: F.when(F.size(col["words"]) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(col["words"]) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(col["words"], i, WINDOW)))),
    })
    repeated = F.size(F.array_distinct(col["grams"])) < F.size(col["grams"])
    out = out.withColumn(name["sorted"], F.when(repeated, F.array_sort(F.transform(col["grams"], lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    rest = F.size(col["sorted"]) - 1
    equal = F.zip_with(F.slice(col["sorted"], F.lit(1), rest), F.slice(col["sorted"], F.lit(2), rest), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    out = out.withColumn(name["dups"], F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))))
    more = F.size(col["dups"]) - 1
    steps = F.zip_with(F.slice(col["dups"], F.lit(1), more), F.slice(col["dups"], F.lit(2), more), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    out = out.withColumn(name["n_repeat_words"], F.coalesce(F.aggregate(steps, F.lit(WINDOW), lambda x, y: x + y), F.lit(0)).cast("long"))
    share = lambda a, b: F.when(col[b] > 0, col[a] / col[b]).otherwise(0.0)
    out = out.withColumns({
        name["mean_word"]: share("word_chars", "n_words"),
        name["symbol_share"]: share("n_symbols", "word_chars"),
        name["dup_line_share"]: share("n_dup_lines", "n_lines"),
        name["repeat_share"]: share("n_repeat_words", "n_words"),
        name["upper_share"]: share("upper", "word_chars"),
        name["mark_share"]: share("marks", "n_words"),
        name["distinct_share"]: share("distinct", "n_words"),
    })
    return out.drop(*[name[k] for k in ("words", "lines", "grams", "sorted", "dups", "upper", "marks", "distinct", "n_lines")]), name


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


class DecisionList:
    """Ordered rules; a rule is a list of (feature, "<=" or ">", threshold), and a document that meets one is rejected."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def verdict(self, column) -> Column:
        """True for documents to keep.  column: gives a feature's column."""
        out = F
        for rule in self.rules:
            out = out.when(reduce(lambda a, b: a & b, [column(f) <= t if op == "<=" else column(f) > t for f, op, t in rule]), False)
        return F.lit(True) if out is F else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{f} {op} {t:.6g}" for f, op, t in rule) for rule in self.rules) or "no rules"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, scratch: Scratch) -> DecisionList:
    """labelled: the features, `bad` boolean and `part` int (0: for pruning)."""
    cuts: dict[str, list[float]] = {}
    asked = [F.percentile_approx(F.when(F.col("bad") == bad, F.col(f)), [i / BINS for i in range(BINS)] + [0.99, 1.0], 2000).alias(f"{f}_{bad}") for f in FEATURES for bad in (True, False)]
    found = labelled.agg(*asked).first()
    for f in FEATURES:
        sides = [found[f"{f}_{bad}"] for bad in (True, False)]
        if None in sides:
            return DecisionList([])
        cuts[f] = sorted({float(x) for x in [*sides[0], *sides[1]]})
    below = lambda f: F.size(F.filter(F.array(*[F.lit(x) for x in cuts[f]]), lambda t: t < F.col(f)))
    bins = {f: below(f) for f in FEATURES}
    table = scratch.save(labelled.select("bad", "part", *[bins[f].cast("int").alias(f) for f in FEATURES]), "bins")
    meets = lambda rule: reduce(lambda a, b: a & b, [F.col(f) <= i if op == "<=" else F.col(f) > i for f, op, i in rule], F.lit(True))
    rules: list[list[tuple[str, str, int]]] = []
    while len(rules) < MAX_RULES:
        left = table.filter(reduce(lambda a, b: a & b, [~meets(r) for r in rules], F.lit(True)))
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MAX_TERMS:
            long = left.filter((F.col("part") != 0) & meets(rule)).select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])).alias("x"))
            counts: dict = {}
            for r in long.groupBy("x.f", "x.bin", "bad").count().collect():  # features x BINS x 2 rows at most
                counts.setdefault(r["f"], {}).setdefault(r["bin"], [0, 0])[0 if r["bad"] else 1] = r["count"]
            if not counts:
                break
            p0, n0 = (sum(x[i] for x in next(iter(counts.values())).values()) for i in (0, 1))
            best = (0.0, None)
            if p0 and n0:
                for f in FEATURES:
                    p = n = 0
                    for i in range(len(cuts[f])):
                        p, n = (a + b for a, b in zip((p, n), counts[f].get(i, [0, 0])))
                        best = max(best, (_gain(p, n, p0, n0), (f, "<=", i)), (_gain(p0 - p, n0 - n, p0, n0), (f, ">", i)), key=lambda x: x[0])
            if best[1] is None or best[0] < 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        stages = [rule[: i + 1] for i in range(len(rule))]
        told = left.filter("part = 0").agg(*[F.count(F.when(meets(s) & (F.col("bad") == bad), 1)).alias(f"c{i}_{int(bad)}") for i, s in enumerate(stages) for bad in (True, False)]).first()
        worth = [(told[f"c{i}_1"], told[f"c{i}_0"]) for i in range(len(stages))]
        i = max(range(len(stages)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(sum(worth[i]), 1), worth[i][0]))
        p, n = worth[i]
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(stages[i])
    # a value is in bin i if i cuts are below it, so bin <= i means value <= cuts[i]
    return DecisionList([[(f, op, cuts[f][i]) for f, op, i in rule] for rule in rules])


def learn_from(table: DataFrame, labels: DataFrame, scratch: Scratch) -> DecisionList:
    """The list learned from labels (doc_id, quality).  table: doc_id, n_repeat_words and the features, saved."""
    known = labels.select("doc_id", "quality").filter("quality is not null")
    rows = table.join(known, "doc_id").filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    labelled = rows.select(*FEATURES, (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("part"))
    return learn(scratch.save(labelled, "labelled"), scratch)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rule nor the learned list rejects, with the columns they came with.

    Texts and statistics are saved together: a filter on the statistics would else be pushed below them and
    compute each one as often as a rule names it.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted, name = with_statistics(docs)
    table = scratch.save(counted, "statistics")
    found = learn_from(table.select("doc_id", *[F.col(name[k]).alias(k) for k in ("n_repeat_words", *FEATURES)]), labels, scratch)
    good = ~base_failed(F.col(name["n_words"]), F.col(name["n_repeat_words"])) & found.verdict(lambda f: F.col(name[f]))
    return table.filter(good).select(*docs.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scratch = Scratch(spark, "quality")
    counted, name = with_statistics(with_clear_names(docs, "doc_id", "text"))
    table = scratch.save(counted.select("doc_id", *[F.col(name[k]).alias(k) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES)]), "statistics")
    found = learn_from(table, labels, scratch)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & found.verdict(F.col)).alias("kept"))
