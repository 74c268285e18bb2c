"""Bounded samples of labelled rows: labels are counted and thinned first, so that only the rows taken meet their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> list[tuple[str, int]]:
    """(text, label) of at most about `bound` rows of each label, chosen by a hash of doc_id.

    labels holds doc_id and the label, already restricted to what may be learned from. The sample of labels has a proven
    bound and is broadcast; documents are scanned once and not shuffled. Null labels, ids and texts are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    shares = {r[0]: min(1.0, bound / r[1]) for r in known.groupBy("y").count().collect()}
    if not shares:
        return []
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("y")]
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(taken), "doc_id").select("text", "y")
    return sorted((r[0], r[1]) for r in rows.collect())


def unlabelled(documents: DataFrame, bound: int) -> list[str]:
    """Texts of at most about `bound` documents, chosen by a hash of text: exact copies count once."""
    n = documents.where("text is not null").count()
    share = int(min(1.0, bound / max(1, n)) * (1 << 30))
    return sorted({r[0] for r in documents.where("text is not null").where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < share).select("text").collect()})
