"""Merkle manifest of a dataset: a tree of digests for each source, and a tree over their roots.

Trees are built level by level with sibling-shift self-joins: a node's siblings have computed indices (its own with
the last bit flipped in binary trees, else the other slots of its run), so that one equi-join for each offset brings
their digests; rows in slot zero then have their whole run and emit the parent. Joins are on tree and index, which no
two nodes share, so a source with most of the rows is spread like any other.

A proof is the digests beside a leaf's way to the root. Ways are handed down from the roots: a node's is its own
siblings and then its parent's way, so each level is one more equi-join of tree and parent index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.shared import crc_part, hint, written

#: Nodes that become one parent.
FANOUT = 3
#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_ROW_BITS = 33  # of monotonically_increasing_id, for the row within its partition


def _field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value: no two lists of values read alike."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parent_digest(left: Column, digest: Column, right: Column) -> Column:
    """The digest, as hex text, of a run: the digests left of a node, its own and those right of it."""
    return F.sha2(F.concat(_hex(left), digest, _hex(right)), 256)


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``i``, the place of each row within its ``tree`` by ``order`` (nulls first), and ``m``, its tree's rows.

    Rows are dealt to ordered ranges and sorted there; each range's rows of a tree are counted, and prefix sums of
    these counts (one row a range and tree) give the places. Rows equal in all of ``order`` follow each other anyhow,
    and are dealt to several ranges where there are many.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)] + [F.col("_arrival")]
    dealt = rows.withColumn("_arrival", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    placed = dealt.sortWithinPartitions(*keys).drop("_arrival").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_range", F.shiftright("_at", _ROW_BITS)), "ordered")
    spans = placed.groupBy(tree, "_range").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(tree)  # as many rows as ranges, at most
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "m": F.sum("_n").over(whole)}).drop("_n")
    found = placed.join(hint(written(spans, "spans")), [tree, "_range"])
    return found.withColumn("i", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_from", "_before", "_range")


def _sibling(offset: int, fanout: int) -> Column:
    """The index of the sibling that stands ``offset`` slots further, around the run."""
    i = F.col("i")
    if fanout == 2:
        return i.bitwiseXOR(F.lit(1).cast("long"))
    return i - i % fanout + (i % fanout + offset) % fanout


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds ``left`` and ``right``, the digests of the siblings before and behind each node of ``tree, i, digest``."""
    found, none = nodes, F.lit(b"")
    for d in range(1, fanout):
        other = nodes.select("tree", F.col("i").alias(f"_i{d}"), F.col("digest").alias(f"_d{d}"))
        found = found.withColumn(f"_i{d}", _sibling(d, fanout)).join(other, ["tree", f"_i{d}"], "left")
    slot = F.col("i") % fanout
    behind = F.concat(*[F.when(slot + d < fanout, F.coalesce(f"_d{d}", none)).otherwise(none) for d in range(1, fanout)])
    before = F.concat(*[F.when(slot + d >= fanout, F.coalesce(f"_d{d}", none)).otherwise(none) for d in range(1, fanout)])
    return found.select(*nodes.columns, before.alias("left"), behind.alias("right"))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees over ``leaves`` (``tree, i, m, digest``), and the root of each tree.

    A level holds the nodes, with their siblings, of the trees that still have several; each is written once, and the
    first keeps the further columns of ``leaves``. Roots are ``tree, level, digest``: a lone leaf is its tree's root, at level 0.
    """
    most = leaves.agg(F.max("m").alias("m")).first()["m"] or 0
    levels: list[DataFrame] = []
    roots = [leaves.filter("m = 1").select("tree", F.lit(0).alias("level"), "digest")]
    nodes = leaves
    while most > 1:
        level = written(with_siblings(nodes.filter("m > 1"), fanout), f"level-{len(levels)}")
        levels.append(level)
        first = level.filter(F.col("i") % fanout == 0)
        made = F.unhex(parent_digest(F.col("left"), _hex(F.col("digest")), F.col("right")))
        nodes = first.select("tree", F.expr(f"i div {fanout}").alias("i"), F.expr(f"(m + {fanout - 1}) div {fanout}").alias("m"), made.alias("digest"))
        roots.append(nodes.filter("m = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        most = -(-most // fanout)
    return levels, written(reduce(DataFrame.unionByName, roots), "roots")


def ways(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with the ``way`` of each to the root of its tree and beyond, and what else is handed down.

    ``ends`` has for the root of each tree its ``level`` and what is handed down from it: ``way`` and further columns.
    """
    carried = [c for c in ends.columns if c not in ("tree", "level")]

    def ended(level: int) -> DataFrame:
        return ends.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("i"), *carried)

    own = F.array(F.struct("left", "right"))
    way = [F.concat(own, "_way").alias("way") if c == "way" else F.col(c) for c in carried]
    above = ended(len(levels))
    for at in range(len(levels) - 1, -1, -1):
        named = above.withColumnsRenamed({"i": "_up", "way": "_way"})
        nodes = levels[at].withColumn("_up", F.expr(f"i div {fanout}")).join(named, ["tree", "_up"])
        if at:
            above = nodes.select("tree", "i", *way).unionByName(ended(at))
        else:
            above = nodes.select(*leaves.columns, *way)
    alone = leaves.join(ended(0).drop("i"), "tree").select(*leaves.columns, *carried)
    return above.unionByName(alone) if levels else alone


def folded(digest: Column, way: Column) -> Column:
    """The root that a digest (hex text) gives together with the digests beside its way."""
    return F.aggregate(way, digest, lambda held, step: parent_digest(step["left"], held, step["right"]))


def proof(way: Column) -> Column:
    """A proof's digests, level by level and left to right, as hex text."""
    return F.array_join(F.transform(way, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), "")


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """Each document's leaf, subroot, root, the way between them and whether it verifies; one row for each row.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Of each source (null is one) the leaves, by
    ascending doc_id, are a tree; its root is the subroot, and subroots by source (null first, then by bytes) are a
    tree as well. ``checked`` is the digest that is verified: where ``tampered`` holds, that of the row with the text
    ``altered``. ``way`` has the siblings (raw digests, ``left`` and ``right``) on each level.

    Null values are told from empty ones; a null id comes first in its source; rows with one id follow each other by
    leaf, and repeated rows have leaves of their own. Texts are read whole, once. Further columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    values = [F.col(c) for c in COLUMNS]
    other = leaf_digest([*values[:-1], altered]) if altered is not None else leaf_digest(values)
    checked = F.when(tampered, other) if tampered is not None else F.lit(None).cast("binary")
    # the key of a tree: empty for a null source, so that it is first, else the source behind a letter
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest(values).alias("digest"), checked.alias("checked")), "leaves")
    leaves = written(positions(rows, "tree", ["doc_id", "digest"]), "leaves-placed")
    levels, subroots = grow(leaves, fanout)

    # the trees' roots are the leaves of one more tree
    tops = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "digest"), "tree", ["of"])
    tops = written(tops.withColumnRenamed("level", "of_level"), "subroots")
    upper, root = grow(tops, fanout)
    ends = root.select("tree", "level", F.array().cast("array<struct<left: binary, right: binary>>").alias("way"), F.col("digest").alias("root"))
    handed = ways(tops, upper, ends, fanout).select(F.col("of").alias("tree"), F.col("of_level").alias("level"), "way", F.col("digest").alias("subroot"), "root")
    found = ways(leaves, levels, written(handed, "ends"), fanout)
    digest = _hex(F.coalesce("checked", "digest"))
    found = found.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), digest.alias("checked"), "way")
    found = found.withColumn("folded_root", folded(F.col("checked"), F.col("way")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest, with each proof's digest, where every second document (by its id) has lost its line ends."""
    lost = crc_part(parts=2) == 0
    found = manifest(docs, tampered=lost, altered=F.translate("text", "\n", ""))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("way")), 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(v) for v in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"


#: The bit-serial crc32 of a decimal number: a byte is added, then eight times the last bit decides.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
    lambda c: [coalesce(ascii(c), -1)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def _sql_up(name: str, leaves: str) -> str:
    return f"""{name} AS (
    SELECT 0 AS level, tree, i, m, digest FROM {leaves}
    UNION ALL
    SELECT level + 1, tree, i // 3, (any_value(m) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
    FROM {name} WHERE m > 1 GROUP BY level, tree, i // 3
)"""


def _sql_beside(name: str, up: str) -> str:
    return f"""{name} AS (
    SELECT a.level, a.tree, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM {up} a JOIN {up} b ON a.level = b.level AND a.tree = b.tree AND a.i // 3 = b.i // 3 WHERE a.m > 1
    GROUP BY a.level, a.tree, a.i
)"""


ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m
    FROM (SELECT doc_id, coalesce('s' || source, '') AS tree, {_sql_leaf("text")} AS digest,
                 CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS checked
          FROM documents)
), {_sql_up("up", "leaves")},
subroots AS (
    SELECT tree AS of, digest, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM up WHERE m = 1
), {_sql_up("top", "subroots")}, {_sql_beside("beside", "up")}, {_sql_beside("above", "top")},
numbered AS (SELECT l.*, s.i AS place, s.digest AS subroot, row_number() OVER () AS id FROM leaves l JOIN subroots s ON l.tree = s.of),
ways AS (
    SELECT n.id, b.level, b.l, b.r FROM numbered n JOIN beside b ON n.tree = b.tree AND b.i = n.i // power(3, b.level)::BIGINT
    UNION ALL
    SELECT n.id, 1000 + a.level, a.l, a.r FROM numbered n JOIN above a ON a.i = n.place // power(3, a.level)::BIGINT
), steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM ways),
fold AS (
    SELECT id, 0 AS step, checked AS digest FROM numbered
    UNION ALL
    SELECT f.id, f.step + 1, sha256(s.l || f.digest || s.r) FROM fold f JOIN steps s ON f.id = s.id AND s.step = f.step + 1
), last AS (SELECT id, max_by(digest, step) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY id)
SELECT doc_id, n.digest AS leaf, subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM numbered n JOIN last USING (id) LEFT JOIN proofs USING (id) CROSS JOIN (SELECT digest FROM top WHERE m = 1) t
"""
