"""Exact deduplication, fill-in-the-middle and the dataset manifest against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docweft.llm import exact_dedup, fill_in_middle, manifest

ODD = [
    (1, "a b", "x"), (2, "ab", "x"), (3, " \t\r\n\x0b\x0c", "x"), (4, None, "x"), (5, "", None), (6, "ab ", "y"), (7, "a  b", "y"), (7, "a  b", "y"),
    (None, "a   b", "z"), (None, None, None), (8, "é\U0001f600x" * 40_000, "z"), (9, " é\U0001f600x" * 40_000, "z"), (10, "<P> in it", "x"), (11, "<<S", "x"),
]


def _docs(spark, rows, clash=True):
    docs = spark.createDataFrame([(i, t, s, "en", None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")
    return docs.withColumns({c: F.lit("other") for c in ("digest", "normal", "_metadata", "n", "run", "tree", "i", "m", "left", "way", "file", "_at")}) if clash else docs


def _generated(seed, rows):
    rng = random.Random(seed)
    alphabet = ["a", "Zb", " ", "\n", ".", "é", "\U0001f600", "<", "P", ">", "9"]
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["x", "y", None, "ü", "xx"])) for i in rng.sample(range(-50, 10_000), rows)]


# exact deduplication


def _equal_texts(rows):
    """For each row its text without blanks, how many have it, and the id and length of the row that stays."""
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {key: (len(x), min(x)[3]) for key, x in groups.items()}


def _check_decisions(found, rows):
    groups = _equal_texts(rows)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(found) == len(rows)
    assert sorted((r.doc_id or 0, r.text_sha256) for r in found) == sorted((i or 0, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()) for i, t, _ in rows)
    for r in found:
        assert (r.group_size, r.keep_id) == by_digest[r.text_sha256]
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted(by_digest)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_duplicates_of_odd_rows(spark):
    _check_decisions(exact_dedup.exact_duplicates(_docs(spark, ODD)).collect(), ODD)
    assert exact_dedup.exact_duplicates(_docs(spark, ODD).limit(0)).count() == 0


def test_exact_duplicates_with_a_hot_text_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OFTEN", 50)
    rows = _generated(1, 300) + [(20_000 + i, "the same" + " " * (i % 7), "x") for i in range(400)]
    _docs(spark, rows, clash=False).repartition(7).write.parquet(f"{tmp_path}/docs")
    _check_decisions(exact_dedup.exact_duplicates(spark.read.parquet(f"{tmp_path}/docs")).collect(), rows)


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark):
    rows = _generated(2, 120) + ODD
    short = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    found = exact_dedup.deduplicate(_docs(spark, rows), digest=short).collect()
    groups = _equal_texts(rows)
    assert sorted((r.group_size, r.keep_id or 0) for r in found if r.kept) == sorted((n, i or 0) for n, i in groups.values())
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(groups)


@pytest.mark.parametrize("bits", [2, 64])
def test_a_store_compares_later_documents_with_earlier_ones(spark, tmp_path, bits):
    digest = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, bits))
    first, later = ODD + _generated(3, 60), [(30_000, "  a b", "x"), (30_001, "new", "x"), (-7, "ab", "x")] + _generated(4, 60)
    folder = f"file://{tmp_path}/store"
    exact_dedup.deduplicate(_docs(spark, first), folder, digest)
    found = exact_dedup.deduplicate(_docs(spark, later), folder, digest).collect()
    groups = _equal_texts(first + later)
    assert len(found) == len(first) + len(later)
    assert sorted((r.group_size, r.keep_id or 0) for r in found if r.kept) == sorted((n, i or 0) for n, i in groups.values())
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in held  # the session's own setting is as it was


# fill-in-the-middle


def _transformed(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_is_as_by_brute_force_and_goes_back(spark):
    rows = _generated(5, 300) + ODD
    wanted = sorted(((i or 0, *_transformed(i, t), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=repr)
    found = fill_in_middle.transform(_docs(spark, rows)).collect()
    assert sorted(((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored_sha256) for r in found), key=repr) == wanted
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    texts = {(i or 0, len(t or ""), (t or "")[:50]): (t or "").encode() for i, t, _ in rows}
    for r in found:  # descriptors lie in the two buffers and name every byte of the text once
        own = sorted((p.start, p.length) for p in r.pieces if p.buffer == fill_in_middle.TEXT and p.length)
        ends = [0, *(a + n for a, n in own)]
        assert [a for a, _ in own] == ends[:-1]
        assert ends[-1] in {len(t) for k, t in texts.items() if k[0] == (r.doc_id or 0)}
    assert fill_in_middle.transform(_docs(spark, rows).limit(0)).count() == 0
    thin = fill_in_middle.transform(_docs(spark, rows), outputs=False)
    assert "output" not in thin.columns and sorted(r.output_sha256 for r in thin.collect()) == sorted(r.output_sha256 for r in found)


def test_units_are_found_block_by_block(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BLOCK", 7)
    text = "ab é.c\n\U0001f600ddd  e" * 5
    import numpy as np

    starts = fill_in_middle.unit_starts(np.frombuffer(text.encode(), np.uint8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert [fill_in_middle.place(starts, k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


# manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(i, t, s):
    values = (i, s, "en", None if t is None else len(t), t)
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][a : a + fanout]) for a in range(0, len(levels[-1]), fanout)])
    return levels


def _siblings(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        a = at - at % fanout
        out.append((level[a:at], level[at + 1 : a + fanout]))
        at //= fanout
    return out


def _manifest(rows, fanout):
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((i is not None, i or 0), _leaf(i, t, s), i, t) for i, t, x in rows if x == s) for s in sources}
    built = {s: _levels([x[1] for x in tree], fanout) for s, tree in trees.items()}
    top = _levels([built[s][-1][0] for s in sources], fanout)
    out = []
    for place, s in enumerate(sources):
        for at, (_, leaf, i, t) in enumerate(trees[s]):
            steps = _siblings(built[s], at, fanout) + _siblings(top, place, fanout)
            lost = zlib.crc32(("" if i is None else str(i)).encode()) % 2 == 0 and t is not None
            folded = None
            held = leaf
            if lost:
                cut = t.replace("\n", "")
                held = _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", len(t), cut)))
            for left, right in steps:
                held = _h(*left, held, *right)
            folded = held
            out.append((i or 0, leaf, built[s][-1][0], top[-1][0], _h(*(x for l, r in steps for x in (*l, *r))), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("rows", [ODD + _generated(6, 130), [(1, "one\n", "x")], [(i, "a\nb", None) for i in range(9)], [(i, "t\n", f"s{i % 11}") for i in range(23)]])
def test_manifest_is_as_by_brute_force(spark, rows):
    found = [(r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.verified(_docs(spark, rows)).collect()]
    assert sorted(found) == sorted(_manifest(rows, 3))


def test_binary_manifest_verifies_and_tells_changed_rows(spark):
    rows = _generated(7, 50)
    good = manifest.manifest(_docs(spark, rows), fanout=2).collect()
    assert {r.root for r in good} == {_manifest(rows, 2)[0][3]} and all(r.verified for r in good)
    bad = manifest.manifest(_docs(spark, rows), fanout=2, tampered=F.col("doc_id") % 3 == 0, altered=F.concat("text", F.lit("!"))).collect()
    assert {r.doc_id for r in bad if not r.verified} == {i for i, _, _ in rows if i % 3 == 0}
    assert manifest.verified(_docs(spark, rows).limit(0)).count() == 0
