"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph (line) is cut into pieces of up to four words, the leaves; it has the digest of its leaves' digests, a
section (between blank lines) that of its paragraphs', the root that of the sections'. A fingerprint is the root and
a short form of every leaf: equal fingerprints mean equal texts, and the leaves tell how much two texts have in
common, in texts of a single line, too. Where two trees differ, the differing branches lead to the edited paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import with_next

#: Up to four words, ending early at the end of a sentence; all pieces together are the paragraph.
PIECE = r"[ \t\r]*(?:[^ \t\r]*[^ \t\r.!?][ \t\r]+){0,3}[^ \t\r]+[ \t\r]*|[ \t\r]+"
#: Hexadecimal digits of a root and of a leaf in a fingerprint.
ROOT, LEAF = 64, 8


def tree(text: Column) -> Column:
    """The digests of a text's leaves, for each section and paragraph."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def sections(tree: Column) -> Column:
    """The digests of a tree's paragraphs, for each section."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ""), 256)))


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections(tree), lambda s: F.sha2(F.array_join(s, ""), 256)), ""), 256)


def leaves(tree: Column) -> Column:
    """The leaves as they stand in a fingerprint, in order of the text."""
    return F.transform(F.flatten(F.flatten(tree)), lambda x: F.substring(x, 1, LEAF))


def packed(tree: Column, leaves: Column) -> Column:
    """A fingerprint: the root, a colon and all leaves."""
    return F.concat(root(tree), F.lit(":"), F.array_join(leaves, ""))


def leaves_of(fingerprint: Column) -> Column:
    """The leaves of a fingerprint."""
    return F.regexp_extract_all(F.substring(fingerprint, F.lit(ROOT + 2), F.length(fingerprint)), F.lit(f".{{{LEAF}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The share of the distinct leaves of two fingerprints that both have, 0 to 1; fingerprints without any are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both.cast("double") / every)


def differing_branches(a: Column, b: Column) -> Column:
    """Where two trees of ``sections`` differ: structs of section and paragraph, counted from 0.

    Sections with equal digests are not descended into; a branch that only one side has differs.
    """
    empty = F.lit(None)
    paired = F.arrays_zip(a.alias("a"), b.alias("b"))
    numbered = F.transform(paired, lambda s, i: F.struct(i.alias("section"), s["a"].alias("a"), s["b"].alias("b")))
    changed = F.filter(numbered, lambda s: ~s["a"].eqNullSafe(s["b"]))

    def paragraphs(s: Column) -> Column:
        lines = F.arrays_zip(F.coalesce(s["a"], F.array().cast("array<string>")).alias("a"), F.coalesce(s["b"], F.array().cast("array<string>")).alias("b"))
        at = F.transform(lines, lambda p, i: F.when(~p["a"].eqNullSafe(p["b"]), F.struct(s["section"].alias("section"), i.alias("paragraph"))).otherwise(empty))
        return F.filter(at, lambda x: x.isNotNull())

    return F.flatten(F.transform(changed, paragraphs))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how like they are, one row for each row.

    Null texts are empty. Rows follow one another by ascending id (null ids first, rows with one id by a hash of
    their text); the first follows the last, so a single row follows itself. Empty texts have the fingerprint of
    one empty paragraph without leaves. Texts of any length are fingerprinted whole: a fingerprint grows with its
    text. An empty table gives an empty result; further columns are ignored.
    """
    parts = parts or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # only texts are shuffled: cutting the following text again costs less than moving its leaves
    paired = with_next(texts, "doc_id", ["text"], parts)
    paired = paired.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    paired = paired.withColumns({"tree": tree(F.col("text")), "edited_tree": tree(F.col("edited")), "next_tree": tree(F.col("next_text"))})
    paired = paired.withColumns({"leaves": leaves(F.col("tree")), "edited_leaves": leaves(F.col("edited_tree")), "next_leaves": leaves(F.col("next_tree"))})
    return paired.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("tree"), F.col("leaves")).alias("fingerprint"),
        packed(F.col("edited_tree"), F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def _sql_tree(text: str) -> str:
    pattern = PIECE.replace("'", "''")
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{pattern}'), lambda x: sha256(x))))"


def _sql_leaves(tree: str) -> str:
    return f"list_transform(flatten(flatten({tree})), lambda x: x[1:{LEAF}])"


def _sql_packed(tree: str, leaves: str) -> str:
    return f"sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), '')) || ':' || array_to_string({leaves}, '')"


def _sql_like(a: str, b: str) -> str:
    every = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {every} = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / {every} END"


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
followed AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM texts),
changed AS (SELECT doc_id, text, following, substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) AS edited FROM followed),
trees AS (SELECT *, {_sql_tree("text")} AS t, {_sql_tree("edited")} AS e, {_sql_tree("following")} AS f FROM changed),
cut AS (SELECT *, {_sql_leaves("t")} AS tl, {_sql_leaves("e")} AS el, {_sql_leaves("f")} AS fl FROM trees)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sql_packed("t", "tl")} AS fingerprint,
       {_sql_packed("e", "el")} AS edited_fingerprint, {_sql_like("tl", "el")} AS near_edited, {_sql_like("tl", "fl")} AS near_next
FROM cut
"""
