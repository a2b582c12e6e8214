"""Relations between chunks: proofs, examples and scored likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 1


def proofs(chunks: DataFrame) -> DataFrame:
    """Both directions between theorems or definitions and proofs whose first pages are at most one apart.

    Pages are joined as they are: each proof is offered to its own page and both neighbours.
    """
    stated = chunks.filter(F.col("chunk_type").isin("theorem", "definition")).select("document_id", F.col("chunk_id").alias("src"), "page_number")
    offered = chunks.filter(F.col("chunk_type") == "proof").select("document_id", F.col("chunk_id").alias("dst"), F.explode(F.sequence(F.col("page_number") - PAGES, F.col("page_number") + PAGES)).alias("page_number"))
    there = stated.join(offered, ["document_id", "page_number"]).select("document_id", "src", "dst", F.lit("proof").alias("kind"))
    return there.unionByName(there.select("document_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()


def examples(chunks: DataFrame) -> DataFrame:
    """From theorems or definitions to examples of the document with a concept in common."""
    each = chunks.select("document_id", "chunk_id", "chunk_type", F.explode("concepts").alias("concept"))
    stated = each.filter(F.col("chunk_type").isin("theorem", "definition")).select("document_id", "concept", F.col("chunk_id").alias("src"))
    shown = each.filter(F.col("chunk_type") == "example").select("document_id", "concept", F.col("chunk_id").alias("dst"))
    return stated.join(shown, ["document_id", "concept"]).select("document_id", "src", "dst", F.lit("example").alias("kind")).distinct()


def related(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Ordered pairs of a document's chunks with their relatedness, from ``threshold`` up, at most 1.

    0.3 for one domain, 0.2 for each common concept, 0.2 for pages at most two apart, 0.15 for each common section.
    The threshold must exceed 0.3, so that related chunks are near or share a concept or section: these are the
    joins that find them.
    """
    if threshold <= 0.3:
        raise ValueError("one domain alone would relate all pairs of a document")
    own = chunks.select("document_id", F.col("chunk_id").alias("src"), F.col("page_number").alias("p"), F.col("domain").alias("d"), F.col("concepts").alias("c"), F.col("section_hierarchy").alias("s"))
    other = chunks.select("document_id", F.col("chunk_id").alias("dst"), F.col("page_number").alias("q"), F.col("domain").alias("e"), F.col("concepts").alias("f"), F.col("section_hierarchy").alias("t"))
    near = own.join(other.withColumn("p", F.explode(F.sequence(F.col("q") - 2, F.col("q") + 2))), ["document_id", "p"]).select("document_id", "src", "dst")
    pairs = near
    for a, b in (("c", "f"), ("s", "t")):
        left, right = own.select("document_id", "src", F.explode(a).alias("x")), other.select("document_id", "dst", F.explode(b).alias("x"))
        pairs = pairs.unionByName(left.join(right, ["document_id", "x"]).select("document_id", "src", "dst"))
    pairs = pairs.filter("src <> dst").distinct().join(own, ["document_id", "src"]).join(other, ["document_id", "dst"])
    common = lambda a, b: F.size(F.array_intersect(a, b))
    score = (
        F.when(F.col("d") == F.col("e"), 0.3).otherwise(0.0)
        + 0.2 * common("c", "f")
        + F.when(F.abs(F.col("p") - F.col("q")) <= 2, 0.2).otherwise(0.0)
        + 0.15 * common("s", "t")
    )
    scored = pairs.select("document_id", "src", "dst", F.round(score, 6).alias("score")).filter(F.col("score") >= threshold)
    return scored.withColumn("score", F.least("score", F.lit(1.0)))


def overlaps(boxes: DataFrame, key: str, group: str, cell: float = 200.0) -> DataFrame:
    """Pairs of a group's boxes that touch or overlap, with their share of the union.

    Boxes are joined by the cells of a grid that they reach into, so that distant ones never meet.
    """
    reach = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    cells = boxes.withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1")))
    left = cells.select(group, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in (key, "x0", "y0", "x1", "y1")])
    right = cells.select(group, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in (key, "x0", "y0", "x1", "y1")])
    pairs = left.join(right, [group, "cx", "cy"]).filter(F.col(f"a_{key}") < F.col(f"b_{key}")).drop("cx", "cy").distinct()
    touch = (F.col("a_x1") >= F.col("b_x0")) & (F.col("b_x1") >= F.col("a_x0")) & (F.col("a_y1") >= F.col("b_y0")) & (F.col("b_y1") >= F.col("a_y0"))
    side = lambda d: F.greatest(F.least(f"a_{d}1", f"b_{d}1") - F.greatest(f"a_{d}0", f"b_{d}0"), F.lit(0.0))
    both = side("x") * side("y")
    area = lambda b: (F.col(f"{b}_x1") - F.col(f"{b}_x0")) * (F.col(f"{b}_y1") - F.col(f"{b}_y0"))
    union = area("a") + area("b") - both
    iou = F.when(union > 0, both / union).otherwise(0.0)
    return pairs.filter(touch).select(group, F.col(f"a_{key}").alias("left_id"), F.col(f"b_{key}").alias("right_id"), F.round(iou, 6).alias("iou"))
