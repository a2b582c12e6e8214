"""Near-duplicates and benchmark decontamination against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pytest

from docweft.llm import decontamination as dc
from docweft.llm import near_duplicates as nd
from docweft.llm.words import word_hashes


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, source, rate):
    out = []
    for w in source.split():
        r = rng.random()
        out += [f"e{rng.randrange(9999)}"] if r < rate / 2 else [] if r < 0.75 * rate else [w, f"i{rng.randrange(9999)}"] if r < rate else [w]
    return " ".join(out)


def jaccard(a, b):
    x, y = (re.findall(r"\w+", t.lower()) for t in (a, b))
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (x, y))
    return len(x & y) / len(x | y)


def similarity(a, b):
    """1 - word edits / longer text, by the plain recurrence, one row at a time."""
    x, y = (np.array(re.findall(r"\w+", (t or "").lower()), object) for t in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return 1 - row[-1] / max(len(x), len(y))


def brute_links(texts, like, low):
    return {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if like(texts[a], texts[b]) >= low}


def brute_classes(texts, links):
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return {i: find(i) for i in texts}


def found_classes(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in nd.classes(docs).collect()}


def test_classes_match_brute_force(spark):
    rng = random.Random(11)
    texts, n = {}, 0
    for _ in range(25):
        base = text(rng, rng.randint(40, 200))
        for rate in (0, 0, 0.03, 0.08, 0.5):
            texts[n] = edited(rng, base, rate) if rate else base
            n += 1
    passage = text(rng, 80)
    for _ in range(20):
        texts[n] = f"{text(rng, 60)} {passage} {text(rng, 60)}"
        n += 1
    rows = [(i, t, "c") for i, t in texts.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert got == brute_classes(texts, brute_links(texts, similarity, nd.SIMILARITY))
    assert {got[i] for i in range(125, 145)} == set(range(125, 145))


def test_recall_at_and_around_the_threshold(spark):
    rng = random.Random(21)
    texts, shares = {}, {0.19: 0.9, 0.15: 0.95, 0.1: 0.99}
    for share in shares:
        for i in range(150):
            base = text(rng, rng.randint(60, 250)).split()
            other = base[:]
            for place in rng.sample(range(len(base)), int(share * len(base))):
                other[place] = f"new{i}x{place}"
            n = len(texts)
            texts[n], texts[n + 1] = " ".join(base), " ".join(other)
    got = found_classes(spark, texts)
    for k, least in enumerate(shares.values()):
        assert np.mean([got[2 * i + 1] == 2 * i for i in range(150 * k, 150 * k + 150)]) >= least
    assert all(got[n] == n for n in texts if n % 2 == 0)


def test_near_pairs_behind_a_crowd(spark):
    rng = random.Random(12)
    texts, last = {}, []
    for family in range(3):
        template = text(rng, 200).split()
        # a crowd of 40 that share two thirds of their words and are unlike; in it two pairs that differ in a few words more
        for n in range(40):
            words = template[:]
            for block in rng.sample(range(0, 200, 10), 7):
                words[block : block + 10] = text(rng, 10, 10**6).split()
            texts[len(texts)] = " ".join(words)
            if n in (20, 39):
                for place in rng.sample(range(200), 6):
                    words[place] = f"own{family}x{n}x{place}"
                last.append(len(texts))
                texts[len(texts)] = " ".join(words)
    got = found_classes(spark, texts)
    assert got == brute_classes(texts, brute_links(texts, similarity, nd.SIMILARITY))
    assert all(got[i] == i - 1 for i in last)


@pytest.mark.parametrize("shared", [60, 100])
def test_recall_behind_boilerplate(spark, shared):
    """Pairs at the threshold among texts that all share a passage, all edits outside of it, against brute force."""
    rng = random.Random(31)
    passage, texts = text(rng, shared), {}
    for _ in range(150):
        base = text(rng, 200 - shared, 10**6).split()
        other = base[:]
        for place in rng.sample(range(len(base)), 38):
            other[place] = f"new{place}x{len(texts)}"
        cut = rng.randint(0, len(base))
        for words in (base, other):
            texts[len(texts)] = " ".join([*words[:cut], passage, *words[cut:]])
    want = brute_classes({i: t for i, t in texts.items() if i < 20}, brute_links({i: t for i, t in texts.items() if i < 20}, similarity, nd.SIMILARITY))
    assert all(want[i] == i - i % 2 for i in want)
    got = found_classes(spark, texts)
    assert all(got[n] == n for n in texts if n % 2 == 0)
    assert np.mean([got[n] == n - 1 for n in texts if n % 2]) >= 0.9


def test_crowded_keys_lose_no_pair(spark):
    """Among texts that all share a passage: pairs whose other words have no 5-gram in common, up to the threshold."""
    rng = random.Random(34)
    passage, texts = text(rng, 100), {}
    for n in range(40):
        base = text(rng, 100, 10**6).split()
        # every run of five words has an edit, those that go into the passage as well
        other = [f"new{n}x{place}" if place % 5 == (4 if place < 50 else 0) or n % 2 and place % 5 == 2 else w for place, w in enumerate(base)]
        for words in (base, other):
            texts[len(texts)] = " ".join([*words[:50], passage, *words[50:]])
    got = found_classes(spark, texts)
    assert got == brute_classes(texts, brute_links(texts, similarity, nd.SIMILARITY))
    assert all(got[n] == n - n % 2 for n in texts)


def test_pairs_of_crowded_texts_against_brute_force(spark):
    """Texts of few words and one large class: every pair of different classes that is alike is a candidate."""
    rng = random.Random(35)
    hashes = lambda t: np.array([int(w[1:]) for w in t.split()], np.uint64)
    bases = [text(rng, size, vocabulary) for size, vocabulary in ((3, 4), (9, 5), (30, 8), (60, 300)) for _ in range(4)]
    texts = [base for base in bases for _ in range(12)]
    for n, source in enumerate(texts):
        words = source.split()
        for place in sorted(rng.sample(range(len(words)), rng.randint(0, len(words) // 4)), reverse=True):
            words[place : place + 1] = rng.choice([[], [f"w{rng.randrange(9)}"], [words[place], "w1"]])
        texts[n] = " ".join(words)
    texts += [" ".join([*bases[-1].split()[:-1], f"w{1000 + i}"]) for i in range(60)]
    label = [i if i < 192 else 500 for i in range(len(texts))]
    rows = [(i, label[i], hashes(t).tobytes()) for i, t in enumerate(texts)]
    met = nd._crowded_pairs(spark.createDataFrame(rows, "node long, label long, words binary"))
    found = {tuple(sorted(r)) for r in met.collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if label[i] != label[j] and nd.alike([hashes(texts[i])], [hashes(texts[j])])[0]}
    assert len(want) > 100 and want <= found
    assert all(label[i] != label[j] for i, j in found)


def joined_rows(spark, run):
    """The most rows that a join made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, most = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}, 0
    run()
    each = lambda found: (found.apply(i) for i in range(found.size()))
    for execution in [e.executionId() for e in each(store.executionsList()) if e.executionId() not in before]:
        values = store.executionMetrics(execution)
        for node in (n for n in each(store.planGraph(execution).allNodes()) if "Join" in n.name()):
            for metric in (m for m in each(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("large", [False, True])
def test_crowded_texts_meet_in_few_rows(spark, large):
    """Words that many texts have, at places or in sizes where too few others can follow; classes that share many words."""
    rng = random.Random(36)
    texts, label = [], []
    for n in range(240):
        size = 100 if large else rng.randint(80, 100)
        # of one large class with ten words each in common with 40 other texts; or of few common words, the rest frequent
        first = range(12) if large else [10_000 + 100 * n + i for i in range(12)] + [100 + i for i in rng.sample(range(60), 8)]
        texts.append(np.array([*first, *range(1_000, 1_000 + size - len(first))], np.uint64))
        if large:
            texts[-1][rng.sample(range(12, 100), 15)] = [10_000 + 100 * n + i for i in range(15)]
        label.append(0 if large and n < 200 else n)
    rows = [(i, label[i], t.tobytes()) for i, t in enumerate(texts)]
    found = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = joined_rows(spark, lambda: found.extend(nd._crowded_pairs(spark.createDataFrame(rows, "node long, label long, words binary")).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    pairs = {tuple(sorted(r)) for r in found}
    apart = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if label[i] != label[j]]
    assert {p for p in apart if nd.alike([texts[p[0]]], [texts[p[1]]])[0]} <= pairs
    assert most <= (len(apart) * 1.05 if large else len(apart) / 2), (most, len(apart))


@pytest.mark.parametrize("words", [1 << 20, 1_000])
def test_large_classes_meet_by_blocks(spark, monkeypatch, words):
    """One class of near copies and texts of their own classes just inside and outside of the threshold, against brute force."""
    monkeypatch.setattr(nd, "BLOCK_WORDS", words)
    rng = random.Random(37)
    template, texts = np.arange(1_000, 1_120, dtype=np.uint64), []
    for n in range(140):
        texts.append(template.copy())
        for place in rng.sample(range(120), 10 if n < 100 else rng.randint(12, 22)):
            texts[-1][place] = 10_000 + (200 * n + place if n < 100 else rng.randrange(60))
    label = [0 if n < 100 else n for n in range(140)]
    members = spark.createDataFrame([(7, n, 140, 120) for n in range(140)], "key long, node long, n long, n_words long")
    labels = spark.createDataFrame(list(enumerate(label)), "node long, label long")
    sequences = spark.createDataFrame([(n, t.tobytes()) for n, t in enumerate(texts)], "node long, words binary")
    pairs, linked = nd._open_pairs(members, labels, sequences)
    listed, blocks = [(r["a"], r["b"]) for r in pairs.collect()], [(r["a"], r["b"]) for r in linked.collect()]
    # the large class is not paired text by text: one link a text and block is enough
    assert blocks and len(blocks) < 40 * 20 and not any(min(p) < 100 <= max(p) for p in listed)
    found = [p for p in listed if nd.alike([texts[p[0]]], [texts[p[1]]])[0]] + blocks
    assert all(nd.alike([texts[a]], [texts[b]])[0] for a, b in found)
    brute = [p for p in itertools.combinations(range(140), 2) if label[p[0]] != label[p[1]] and nd.alike([texts[p[0]]], [texts[p[1]]])[0]]
    classes = lambda pairs: {(r["node"], r["label"]) for r in nd.components(spark.createDataFrame([(label[a], label[b]) for a, b in pairs], "a long, b long")).collect()}
    assert brute and classes(found) == classes(brute)


def test_broadcast_tables_are_given_back(spark, monkeypatch):
    """Bitmaps and counters that were sent to tasks leave the driver when the tables made with them are written."""
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(send(value)) or sent[-1])
    passage = " ".join(f"p{i}" for i in range(60))
    found_classes(spark, {n: f"{passage} own{n} text{n}" + " of its own" * n for n in range(30)})
    assert len(sent) >= 3 and not any(os.path.exists(x._path) for x in sent)


def test_long_texts_of_few_words(spark):
    rng = random.Random(32)
    texts = {}
    for size, vocabulary in ((5_000, 2), (6_000, 60), (9_000, 300), (50_000, 1_000)):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
        other, unlike = base[:], base[:]
        for words, share in ((other, 0.02), (unlike, 0.6)):
            for place in rng.sample(range(size), int(share * size)):
                words[place] = f"w{rng.randrange(vocabulary)}"
        for words in (base, other, unlike):
            texts[len(texts)] = " ".join(words)
    got = found_classes(spark, texts)
    assert all(got[i + 1] == i == got[i] for i in range(0, 12, 3))
    assert all(got[i + 2] == i + 2 for i in range(3, 12, 3))  # of two words, the third is like the first by chance


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "one text of six words here", "mongo-1", "d", "f"), (1, "one text of six words here", "mongo-1", "d", "f"), (2, "another text", "mongo-2", "e", "g")], "doc_id long, text string, _id string, _digest string, _FOUND string")
    assert sorted(tuple(r) for r in nd.deduplicated(docs).select("_id", "_digest", "_FOUND").collect()) == [("mongo-1", "d", "f"), ("mongo-2", "e", "g")]


def test_edits_by_diagonals_against_plain_edit_distance():
    rng = random.Random(33)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 80))] for _ in range(2))
        most = rng.randint(0, 90)
        assert nd.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(round((1 - similarity(" ".join(map(str, a)), " ".join(map(str, b)))) * max(len(a), len(b))) if a and b else max(len(a), len(b)), most + 1)


def test_common_shingles_are_never_missed(spark):
    """Pairs with 80 % of their word 5-grams in common, from 9 words up, exactly at the threshold too."""
    rng = random.Random(14)
    texts = {}
    for length in [*range(8, 16), 40, 90]:
        for _ in range(40):
            base = text(rng, length, 10**6).split()
            for words in (base, rng.choice([base[:-1], base[1:], base[:-2], [*base, "more"], ["changed", *base[1:]]])):
                texts[len(texts)] = " ".join(words)
    got = found_classes(spark, texts)
    near = brute_links(texts, jaccard, 0.8)
    assert len([1 for a, b in near if jaccard(texts[a], texts[b]) == 0.8]) > 20
    assert all(got[a] == got[b] for a, b in near)
    like = brute_links(texts, similarity, nd.SIMILARITY)
    assert all(got[b] == b or (got[b], b) in like for b in texts)


def test_a_large_skewed_class_and_a_long_chain(spark):
    rng = random.Random(5)
    base, texts = text(rng, 120).split(), {}
    for i in range(1500):
        words = base[:]
        for place in rng.sample(range(120), 6):
            words[place] = f"n{i}x{place}"
        texts[i] = " ".join(words)
    words = text(rng, 200).split()
    for i in range(120):
        words = words[:]
        words[(i * 17) % 190 : (i * 17) % 190 + 10] = text(rng, 10, 10**6).split()
        texts[2000 + i] = " ".join(words)
    got = found_classes(spark, texts)
    assert {got[i] for i in range(1500)} == {0} and {got[2000 + i] for i in range(120)} == {2000}


def test_rows_not_ids_are_compared(spark):
    rng = random.Random(4)
    words = text(rng, 400).split()
    chain = []
    for i in range(8):
        words = words[:]
        words[i * 40 : i * 40 + 20] = text(rng, 20).split()
        chain.append(" ".join(words))
    other = text(rng, 50)
    rows = [(100 + i, t, i) for i, t in enumerate(chain)]
    rows += [(1, "", 1), (2, None, 2), (3, "...", 3), (4, "two words", 4), (5, "Two words", 5), (6, "two words more", 6), (None, chain[0], 7), (7, "same row", 8), (7, "same row", 8)]
    rows += [(8, other, 9), (8, text(rng, 60), 10), (None, "no id here", 11), (None, "no id here", 12), (None, other, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = nd.classes(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[i].class_id for i in range(100, 108)} == {100} and [i for i in range(100, 108) if by[i].kept] == [100]
    assert by[1].class_id == by[2].class_id == 1 and by[4].class_id == by[5].class_id == 4 and by[6].class_id == 6
    assert [r.kept for r in got if r.doc_id == 8] == [True, True] and by[7].kept
    assert sorted((str(r.class_id), r.kept) for r in got if r.doc_id is None) == [("100", False), ("8", False), ("None", True), ("None", True)]
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.node for r in kept.collect() if r.node not in (11, 12)) == [0, 1, 3, 4, 6, 8, 9, 10] and kept.filter("node IN (11, 12)").count() == 1
    assert nd.classes(docs.limit(0)).count() == 0 and nd.deduplicated(docs.limit(0)).count() == 0


def test_edits_against_plain_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 40))]
        b = a[:]
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(b) or 1)
            b[p : p + rng.randint(0, 1)] = [rng.randint(0, 99)] * rng.randint(0, 1)
        x, y = (np.array(v, np.uint64) for v in (a, b))
        want = round((1 - similarity(" ".join(map(str, a)), " ".join(map(str, b)))) * max(len(a), len(b)))
        assert nd.least_edits([x], [y], 45)[0] == want
        assert not b or nd.alike([x], [y])[0] == (want <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_long_texts_are_aligned_piece_by_piece():
    rng = random.Random(2)
    base = [rng.randrange(1 << 40) for _ in range(60_000)]
    like, unlike = base[:], base[:]
    for place in rng.sample(range(60_000), 9_000):
        like[place] = rng.randrange(1 << 40)
    del like[20_000:22_000]
    for place in rng.sample(range(60_000), 14_000):
        unlike[place] = rng.randrange(1 << 40)
    moved = base[30_000:] + base[:30_000]
    a, *others = (np.array(v, np.uint64) for v in (base, like, unlike, moved))
    assert nd.alike([a] * 3, others).tolist() == [True, False, False]


def test_order_counts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    other = words[:]
    rng.shuffle(other)
    a, b = word_hashes(" ".join(words)), word_hashes(" ".join(other))
    assert nd.alike([a], [a]).tolist() == [True] and nd.alike([a], [b]).tolist() == [False]
    twice = word_hashes(" ".join(words[100:] + words[:100]))
    assert not nd.alike([a], [twice])[0]


def test_leaks_are_found_with_substitutions(spark):
    rng = random.Random(9)
    items = {i: text(rng, rng.randint(15, 60)) for i in range(30)}
    rows, planted = [], set()
    for i in range(200):
        body = text(rng, rng.randint(30, 200)).split()
        if i % 2:
            item = rng.randrange(30)
            passage = items[item].split()
            for _ in range(len(passage) // 12):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = passage
            planted.add((i, item))
        rows.append((i, " ".join(body), "x"))
    rows += [(900, None, ""), (901, "", ""), (None, items[3], ""), (902, text(rng, 5000) + ". " + items[7].upper() + "! " + text(rng, 5000), "")]
    planted |= {(None, 3), (902, 7)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "one two"), (None, "null named item with some more words")], "item_id long, text string")
    for block in (dc.BLOCK_WORDS, 100):
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, block_words=block).collect()}
        assert got == planted
    kept = {r.doc_id for r in dc.clean(docs, bench).collect()}
    assert kept == {i for i, _, _ in rows} - {d for d, _ in planted}
    shared = spark.createDataFrame([(1, items[0]), (1, "another text with this id"), (None, items[1]), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in dc.clean(shared, bench).collect()) == ["None", "another text with this id"]
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0


def brute_leaks(text, item):
    """Whether some alignment without gaps has a passage long enough with enough equal words (short items: as a whole)."""
    a, b = (re.findall(r"\w+", x.lower()) for x in (text, item))
    if len(b) < dc.LEAST_ITEM:
        return False
    for shift in range(-len(b), len(a) + 1):
        equal = [a[i + shift] == w if 0 <= i + shift < len(a) else None for i, w in enumerate(b)]
        if len(b) < dc.MIN_WORDS:
            if None not in equal and sum(equal) >= dc.MIN_SHARE * len(b) - 1e-9:
                return True
            continue
        for i in range(len(b)):
            for j in range(i + dc.MIN_WORDS, len(b) + 1):
                part = equal[i:j]
                if part[0] and part[-1] and None not in part and sum(part) >= dc.MIN_SHARE * (j - i) - 1e-9:
                    return True
    return False


def test_leaks_match_brute_force(spark):
    rng = random.Random(31)
    items = {i: text(rng, n, 300) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 25, 40] * 2)}
    items[99] = "same same same same same same same same same same same same same same"
    rows = [(0, "same " * 300), (1, None), (2, ""), (3, items[18])]
    for i in range(10, 190):
        item = rng.choice(list(items))
        passage = items[item].split()
        cut = rng.randrange(max(1, len(passage) - 13))
        passage = passage[cut : cut + rng.randint(13, 40)] if len(passage) > 20 else passage
        for place in rng.sample(range(len(passage)), min(len(passage), int(rng.choice([0.1, 0.2, 0.25]) * len(passage)))):
            passage[place] = "changed"
        rows.append((i, f"{text(rng, rng.randint(0, 30), 300)} {' '.join(passage)} {text(rng, rng.randint(0, 30), 300)}"))
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect())
    want = sorted((i, k) for i, t in rows for k, x in items.items() if t and brute_leaks(t, x))
    assert got == want and len(want) > 120
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})


def test_masks_hit_every_passage_with_a_fifth_replaced():
    for mask in dc.MASKS[:1]:
        places = dc._offsets(mask)
        for n in range(13, 20):
            begins = np.arange(n - places[-1])[:, None] + places
            for replaced in itertools.combinations(range(1, n - 1), n // 5):
                assert not np.isin(begins, replaced).any(axis=1).all()
    for n in range(dc.LEAST_ITEM, 13):
        for replaced in itertools.combinations(range(n), n // 5):
            assert any(all(m[i] == "0" for i in replaced) for m in dc.item_masks(n, n // 5))


def test_best_passage_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 25))])
        _, length, n = dc.best_passage(equal, 0.8)
        want = 0
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8:
                    want = max(want, b - a)
        assert length <= want and (not length or n / length >= 0.8)
        assert length >= want - 1 or not want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    base = [text(rng, 60) + " the and of" for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s", 1), (101, edited(rng, base[1], 0.001), "en", "s", 1), (102, "12345", None, "s", 5), (103, None, None, None, None)]
    leak = text(rng, 40)
    rows += [(104, text(rng, 30) + " " + leak, "en", "s", 1)] + [(200 + i, f"{text(rng, 40)} blarg snorf grunk", "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == set(range(40))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and corpus_pipeline.ORACLE_SQL is None
