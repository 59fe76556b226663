"""Raw files as an index takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.functions import safety as S
from docsect.functions import text as X
from docsect.operators import sections as P


def prepare(raw: DataFrame) -> DataFrame:
    """Clean files (repo, file, content, hash); those with secrets keep their row and lose their content.

    raw: repo, file, content (bytes) and maybe blob, a hash that the source has already.
    """
    blob = F.col("blob") if "blob" in raw.columns else F.lit(None).cast("string")
    read = raw.select("repo", "file", X.read_text(F.col("content")).alias("content"), F.coalesce(F.when(blob != "", blob), X.file_hash(F.col("content"))).alias("hash"))
    return P.stored_text(read.withColumn("content", F.when(F.size(S.secrets(F.col("content"))) == 0, F.col("content"))))
