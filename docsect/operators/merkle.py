"""What changed inside files: hash trees over their sections.

A section's tree is the hash of its own text and of the trees of the sections under it, so that equal trees mean equal
texts all the way down; a file's root is that of all its sections.  Files with equal roots are not looked into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.operators.sections import scan


def trees(sections: DataFrame) -> DataFrame:
    """repo, file, seq, id, hash, tree and root of sections (repo, file, seq, id, depth, hash); one pass over a file, from its end.

    The state has, for each depth, the hash of the trees that still wait for a section above them.
    """
    files = sections.groupBy("repo", "file").agg(F.sort_array(F.collect_list(F.struct("seq", "id", F.col("depth").cast("int").alias("depth"), "hash"))).alias("rows"))
    files = files.withColumn("back", F.reverse("rows"))
    empty = F.array_repeat(F.lit(""), F.array_max(F.col("rows.depth")) + 1)
    tree = lambda s, x: F.sha2(F.concat_ws(",", x["hash"], F.slice(s, x["depth"] + 2, F.size(s))), 256)
    step = lambda s, x: F.transform(s, lambda v, k: F.when(k < x["depth"], v).when(k == x["depth"], F.sha2(F.concat_ws(",", tree(s, x), v), 256)).otherwise(""))
    out = files.withColumn("trees", F.reverse(scan(F.col("back"), empty, "string", step, tree)))
    own = F.transform("rows", lambda x: F.concat_ws(":", x["depth"].cast("string"), x["id"], x["hash"]))
    out = out.withColumn("root", F.sha2(F.array_join(own, ","), 256))
    rows = out.select("repo", "file", "root", F.explode(F.arrays_zip("rows", "trees")).alias("x"))
    return rows.select("repo", "file", "x.rows.seq", "x.rows.id", "x.rows.hash", F.col("x.trees").alias("tree"), "root")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, file, id, nth, change): sections that were added, changed or deleted.  nth tells sections of one id in a file apart.

    A section under which alone something changed is as it was.
    """
    a, b = trees(old), trees(new)
    roots = [x.select("repo", "file", F.col("root").alias(n)).distinct() for x, n in ((a, "_old"), (b, "_new"))]
    differ = roots[0].join(roots[1], ["repo", "file"], "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("repo", "file")
    nth = F.row_number().over(Window.partitionBy("repo", "file", "id").orderBy("seq"))
    a, b = (x.join(differ, ["repo", "file"], "left_semi").withColumn("nth", nth).select("repo", "file", "id", "nth", F.col("tree").alias(f"_tree{k}"), F.col("hash").alias(f"_hash{k}")) for k, x in enumerate((a, b)))
    both = a.join(b, ["repo", "file", "id", "nth"], "full").filter(~F.col("_tree0").eqNullSafe(F.col("_tree1")))
    change = F.when(F.col("_hash0").isNull(), "added").when(F.col("_hash1").isNull(), "deleted").when(F.col("_hash0") != F.col("_hash1"), "changed")
    return both.select("repo", "file", "id", F.col("nth").cast("long").alias("nth"), change.alias("change")).filter("change is not null")
