"""Near-duplicates by Order MinHash and banded alignment.

For each of several hash functions a text keeps its two smallest occurrence-labelled word 5-grams and the order in
which it has them; that ordered pair is a key. Unlike plain MinHash keys these agree only where the order agrees
too. Two texts are near-duplicates if a banded alignment of their words needs edits for at most a fifth of the
longer one (edit similarity 0.8 or more).

Exact copies are one text throughout, named by a digest, so a group of them costs one. Candidates are all pairs of
texts that share a key. Texts meet the heads (least members) of their keys first, which makes most copies one class; only
pairs whose classes still differ are compared after that. Of a key that few texts have these are compared pair by pair; among
the texts of crowded keys an exact join on their rarest words finds all that can be alike; where it finds two larger
classes, blocks of their texts are compared until a link is found. No number of partners is fixed anywhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import BROADCAST_ROWS, bounded_batches, counted_join, discard, free_names, hint, written
from docweft.llm.words import mix, sliced, words

#: Words in a k-mer, and the share of the longer text's words that an alignment must leave unedited.
K = 5
SIMILARITY = 0.8
#: Hash functions, and k-mers that each retains. Texts with a share J of common k-mers agree in a key about as often as
#: J squared: with one word in ten changed J is 0.42 and they share 11 of 64 keys, with one in twenty 25.
KEYS = 64
KEEP = 2
#: Of a key that at most ``FEW`` texts have, all pairs are compared; those of the other keys are found by their rarest words.
FEW = 16
#: Rare words that two texts of crowded keys have in common at least. A larger number reads more words and compares fewer pairs.
RARE = 4
#: Ranges of sizes from a text's own to the longest that it may be alike with: more of them make more keys and fewer pairs.
RANGES = 12
#: Counters of the table that orders words by how many texts have them.
COUNTERS = 1 << 22
#: Longer texts are aligned piece by piece between words that both have once; pieces without such words that have over
#: four times as many words are aligned diagonal by diagonal.
PIECE = 1_000
#: Words compared at once along a diagonal.
STRIDE = 32
#: Texts or pairs read at once.
PAIRS = 512
#: Bits of the bitmap that tells which texts have to be compared.
MARKS = 1 << 26
#: Pairs of one head that a part gets, about.
DEALT = 64
#: Pairs of classes with more pairs of texts than this are compared by blocks, of at most about so many texts and words.
WHOLE = 4
BLOCK = 64
BLOCK_WORDS = 1 << 20

_SEEDS = mix(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def kmers(hashes: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``k`` words within a text, and where each text's runs begin; a shorter text is one run."""
    sizes = np.diff(bounds)
    count = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    begins = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(begins[-1]) - begins[owner] + bounds[owner]
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = at + i < bounds[owner + 1] if len(at) else np.zeros(0, bool)
        total = np.where(inside, total * _TIMES + hashes[np.minimum(at + i, max(len(hashes) - 1, 0))], total)
    return mix(total), begins


def occurrences(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each value, how often its text had it before."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])) if len(v) else np.zeros(0, np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values))))
    return out


def labelled_kmers(hashes: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k-mer and of how often it stood before (no two of a text are equal), and where each text's begin."""
    grams, begins = kmers(hashes, bounds, k)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return mix(grams + occurrences(grams, owner).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begins


def order_min_hash(hashes: np.ndarray, bounds: np.ndarray, keys: int = KEYS, keep: int = KEEP, k: int = K) -> list[np.ndarray]:
    """The keys of each text: for each hash function its ``keep`` smallest labelled k-mers, in text order, as one hash.

    ``hashes`` are the words of several texts, ``bounds`` where each text begins. A text without words has no key.
    """
    labelled, begins = labelled_kmers(hashes, bounds, k)
    sizes = np.diff(begins)
    texts = np.flatnonzero(sizes)
    starts, sizes = begins[:-1][texts], sizes[texts]
    out = np.empty((len(texts), keys), np.uint64)
    for j in range(keys if len(texts) else 0):
        value = mix(labelled ^ _SEEDS[j])
        places = []
        for _ in range(keep):
            at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), sizes))
            if len(at) != len(texts):  # one of two equal hashes, or of a text that has no more k-mers
                at = at[np.unique(np.searchsorted(starts, at, side="right"), return_index=True)[1]]
            places.append(at)
            value[at] = np.iinfo(np.uint64).max
        total = np.full(len(texts), j, np.uint64)
        for at in np.sort(np.stack(places), axis=0):
            total = total * _TIMES + labelled[at]
        out[:, j] = mix(total)
    none = np.zeros(0, np.uint64)
    found = [none] * (len(begins) - 1)
    for i, text in enumerate(texts.tolist()):
        found[text] = out[i]
    return found


def least_edits(a: list[np.ndarray], b: list[np.ndarray], most: int | list[int]) -> list[int]:
    """For each pair of sequences, the fewest words to insert, delete or replace, or ``most`` + 1 if they are more."""
    bounds = [most] * len(a) if isinstance(most, int) else most
    return [_edits(x, y, n) for x, y, n in zip(a, b, bounds, strict=True)]


def _edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """``least_edits`` of one pair, by columns of the table of edits as integers: a bit tells for each word of ``a`` whether the number rises or falls there."""
    n, full = len(a), (1 << len(a)) - 1
    if not n or abs(n - len(b)) > most:
        return min(max(n, len(b)), most + 1)
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    up, down, edits, left = full, 0, n, len(b)
    for word in b.tolist():
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        edits += (rises >> (n - 1) & 1) - (falls >> (n - 1) & 1)
        left -= 1
        if edits - left > most:  # each word to come takes back one at most
            return most + 1
        rises, falls = rises << 1 | 1, falls << 1
        same |= down
        up, down = full & (falls | ~(same | rises)), full & rises & same
    return edits


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The fewest words to insert, delete or replace between two sequences, or ``most`` + 1 if they are more.

    For each number of edits the furthest place on each diagonal is kept, so memory grows with ``most`` and work with
    the edits that are needed; diagonals from which ``most`` edits do not lead to the end are left out.
    """
    la, lb = len(a), len(b)
    end = lb - la
    if abs(end) > most:
        return most + 1
    _, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.concatenate([numbers[:la], np.full(STRIDE + 1, -1)])
    right = np.concatenate([numbers[la:], np.full(STRIDE + 1, -2)])
    steps = np.arange(STRIDE)

    def along(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How far each place can go on its diagonal over equal words."""
        going = np.flatnonzero(left[x] == right[x + k])
        while len(going):
            at = x[going, None] + steps
            same = left[np.minimum(at, la)] == right[np.minimum(at + k[going, None], lb)]
            run = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
            x[going] += run
            going = going[run == STRIDE]
        return x

    reach = np.full(2 * most + 5, -2, np.int64)  # of diagonal k at k + most + 2
    for e in range(most + 1):
        k = np.arange(max(-e, end - (most - e), -la), min(e, end + (most - e), lb) + 1)
        at = k + most + 2
        x = np.maximum(np.maximum(reach[at] + 1, reach[at - 1]), reach[at + 1] + 1) if e else np.zeros(1, np.int64)
        x = np.minimum(np.minimum(x, la), lb - k)
        inside = (x >= 0) & (x + k >= 0)
        x[inside] = along(x[inside], k[inside])
        reach[at] = np.where(inside, x, -2)
        if reach[end + most + 2] >= la:
            return e
    return most + 1


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two multisets share: no alignment can match more."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _pieces(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Two long sequences cut at the longest chain of words that both have once: pieces, and those that stay very long.

    Alignments of the pieces make one of the whole, so their edits together are never fewer than the best whole one's.
    """
    once = [np.unique(x, return_index=True, return_counts=True) for x in (a, b)]
    (x, i), (y, j) = ((v[n == 1], at[n == 1]) for v, at, n in once)
    _, s, t = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(i[s])
    at_a, at_b = i[s][order].tolist(), j[t][order].tolist()
    ends: list[int] = []
    chain: list[int] = []
    before = [-1] * len(at_b)
    for n, place in enumerate(at_b):  # the longest increasing subsequence
        k = bisect_left(ends, place)
        before[n] = chain[k - 1] if k else -1
        ends[k : k + 1] = [place]
        chain[k : k + 1] = [n]
    path, n = [], chain[-1] if chain else -1
    while n >= 0:
        path.append(n)
        n = before[n]
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    large: list[tuple[np.ndarray, np.ndarray]] = []
    p, q, last = 0, 0, (0, 0)
    for u, v in [*((at_a[n], at_b[n]) for n in reversed(path)), (len(a), len(b))]:
        # before a long way without a cut, the last one possible; else where the piece is long enough
        far = max(u - last[0], v - last[1]) > PIECE
        for x, y in [last, (u, v)] if far else [(u, v)]:
            size = max(x - p, y - q)
            if size and (size >= PIECE or far or u == len(a)):
                (large if size > 4 * PIECE else pieces).append((a[p:x], b[q:y]))
                p, q = x, y
        last = (u, v)
    return pieces, large


def _edits_allowed(sizes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """How many edits two texts may need, the longer of which has so many words."""
    return ((1 - similarity) * sizes + 1e-9).astype(np.int64)


def alike(a: list[np.ndarray], b: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each pair of word sequences, whether an alignment edits at most 1 - ``similarity`` of the longer one.

    Sequences over ``PIECE`` words are aligned piece by piece, so the work grows with their length; pieces are cut at
    words that both have once, in the same order. Where there are none, the work grows with the length times the edits.
    """
    most = _edits_allowed(np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64), similarity)
    found = np.zeros(len(a), bool)
    spent = np.zeros(len(a), np.int64)
    tasks: list[tuple[int, np.ndarray, np.ndarray]] = []
    larger: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        longer = max(len(x), len(y))
        if longer - min(len(x), len(y)) > most[i] or longer - common_words(x, y) > most[i]:
            continue
        found[i] = True
        if longer <= PIECE:
            tasks.append((i, x, y))
        else:
            pieces, large = _pieces(x, y)
            tasks += [(i, p, q) for p, q in pieces]
            larger += [(i, p, q) for p, q in large]
    of = [i for i, _, _ in tasks]
    np.add.at(spent, np.array(of, np.int64), least_edits([x for _, x, _ in tasks], [y for _, _, y in tasks], most[of].tolist()))
    for i, x, y in larger:  # what the short pieces left of the edits is what these may take
        if spent[i] <= most[i]:
            spent[i] += edits_within(x, y, int(most[i] - spent[i]))
    return found & (spent <= most)


def _digest(text: Column) -> Column:
    """What names a text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch):
            held = words(part.column("text"))
            keys = [x.view(np.int64) for x in order_min_hash(held.hashes(), held.bounds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest").cast(pa.binary()), pa.array(np.diff(held.bounds).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_words", "keys"],
            )


def _place(digest: Column, doc_id: Column) -> Column:
    """Where a text's first row stands in the bitmap of wanted ones."""
    return F.pmod(F.xxhash64(digest, doc_id), F.lit(MARKS))


def _bitmap(rows: DataFrame, number: Column) -> np.ndarray:
    """The bitmap of the places (from 1 on) of some rows, at most ``MARKS`` bits in all."""
    bits = rows.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    marks = np.zeros((MARKS // 32768, 4096), np.uint8)
    for row in bits.toLocalIterator():
        marks[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return marks.reshape(-1)


def _shared_keys(unique: DataFrame, groups: DataFrame) -> DataFrame:
    """The keys of each text that are among ``groups``, written; a bitmap keeps most others out of the shuffle."""
    sent = unique.sparkSession.sparkContext.broadcast(_bitmap(groups, F.pmod("key", F.lit(MARKS)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("keys").offsets.to_numpy())
            keys = batch.column("keys").flatten().to_numpy()
            place = keys & (MARKS - 1)
            kept = np.flatnonzero(sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[kept])), pa.array(keys[kept])], names=["node", "key"])

    keys = unique.select("node", F.array_distinct("keys").alias("keys")).mapInArrow(run, "node long, key long")
    found = written(counted_join(keys, groups, "key"), "members")
    sent.destroy()  # the driver holds it, too
    return found


def _word_lists(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The word hashes of the wanted texts (``node``, and ``digest`` and ``doc_id`` of their first rows), written.

    A bitmap of fixed size tells every task which rows may be wanted, so that only their words, and no texts or
    further copies, go on to the join that decides.
    """
    place = _place(F.col("digest"), F.col("doc_id"))
    number = place + 1  # the bitmap functions count from 1
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(wanted, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array(sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1))
            for part in sliced(batch):
                held = words(part.column("text"))
                hashes = held.hashes()
                lists = [hashes[a:b].tobytes() for a, b in zip(held.bounds[:-1], held.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("digest").cast(pa.binary()), pa.array(lists, pa.binary())], names=["digest", "words"])

    found = texts.select("digest", "text", place.alias("place")).mapInArrow(run, "digest binary, words binary")
    found = written(found.dropDuplicates(["digest"]).join(wanted.select("digest", "node"), "digest").select("node", "words"), "words")
    sent.destroy()
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each head's words and then those of the texts that meet it; ``a`` is null in the rows of heads."""
    head, other = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            part = batch.slice(at, PAIRS)
            a, b, left, right = [], [], [], []
            for x, y, held in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("words"), strict=True):
                if x is None:
                    head, other = y, np.frombuffer(held.as_py(), np.uint64)
                elif y == head:
                    a.append(x)
                    b.append(y)
                    left.append(np.frombuffer(held.as_py(), np.uint64))
                    right.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike(left, right))], names=["a", "b", "alike"])


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``a``, ``b`` and whether they are alike, for distinct pairs of texts.

    The pairs of one ``b`` are dealt among as many parts as they need, each of which gets its words once and before the
    others: a text that a large class meets is neither one task nor copied into every pair.
    """
    counted = counted_join(pairs, pairs.groupBy("b").agg(F.count("*").alias("n")), "b")
    salted = counted.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / DEALT)).cast("int").alias("salt"))
    heads = salted.select("b", "salt").distinct().select("b", "salt", F.lit(None).cast("long").alias("a"))
    # one join brings the words of both sides
    asked = salted.select("b", "salt", "a").unionByName(heads).withColumn("node", F.coalesce("a", "b"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = asked.join(sequences.join(hint(needed), "node", "left_semi"), "node").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return written(rows.select("a", "b", "words").mapInArrow(_compare, "a long, b long, alike boolean"), "compared")


def _size_range(sizes: np.ndarray) -> np.ndarray:
    """The number of the range that a text's size is in: ``RANGES`` of them make up the sizes that it may be alike with."""
    return np.floor(np.log(np.maximum(sizes, 1)) * (RANGES / np.log(1 / SIMILARITY)) + 1e-9).astype(np.int64)


def _counter(labelled: np.ndarray) -> np.ndarray:
    return (labelled % np.uint64(COUNTERS)).astype(np.int64)


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts given as word hashes, labelled by occurrence, and where each text's begin."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("words")]
    return labelled_kmers(np.concatenate([np.zeros(0, np.uint64), *lists]), np.cumsum([0, *map(len, lists)]), 1)


def _range_bit(ranges: np.ndarray) -> np.ndarray:
    return np.int32(1) << (ranges % 31).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each counter is met by the words of a partition, and the ranges of sizes of their texts as bits."""
    counts, ranges = np.zeros(COUNTERS, np.int32), np.zeros(COUNTERS, np.int32)
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            labelled, begins = _words_of(batch.slice(at, PAIRS))
            sizes = np.diff(begins)
            met = _counter(labelled)
            np.bitwise_or.at(ranges, met, np.repeat(_range_bit(_size_range(sizes)), sizes))
            counter, n = np.unique(met, return_counts=True)
            counts[counter] += n.astype(np.int32)
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met].astype(np.int64)), pa.array(ranges[met])], names=["counter", "n", "ranges"])


def _longest(common: np.ndarray) -> np.ndarray:
    """The most words that a text may have of which another one, alike, has so many in common."""
    size = common + common // 4 + 2
    for _ in range(4):
        size -= size - _edits_allowed(size) > common
    return size


def _rare_words(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What two texts that are alike have in common, written: a ``key``, and ``RARE`` of their rarest words (or all that they need).

    A text of ``size`` words and a shorter one (or of equal size) that is alike have at least ``need`` in common: an edit
    changes one word. Words stand in an order that is the same for all texts: by a table of fixed size that counts words,
    then by hash; those of one text only are left out. After the first common word ``need`` - 1 others must follow in
    either text, so it stands among the first of the longer one, and its place in the shorter one bounds how long the other
    may be. A key is a word and a narrow range of sizes: each text has it under its ``own`` size, and under those of longer
    texts that it may meet by that word. The second table has each text's ``rarest`` words and their ``places``.
    """
    met = texts.select("words").mapInArrow(_counted, "counter int, n long, ranges int").groupBy("counter")
    met = met.agg(F.least(F.sum("n"), F.lit(np.iinfo(np.int32).max)).cast("int").alias("n"), F.bit_or("ranges").alias("ranges"))
    found = met.filter("n > 1").toArrow()  # at most COUNTERS rows in all
    table = np.ones((2, COUNTERS), np.int32)
    for held, name in zip(table, ("n", "ranges"), strict=True):
        held[found.column("counter").to_numpy()] = found.column(name).to_numpy()
    del found
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                labelled, begins = _words_of(part)
                sizes = np.diff(begins)
                need = sizes - _edits_allowed(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                often = sent.value[0][_counter(labelled)]
                order = np.lexsort((labelled, often, owner))
                place = np.arange(len(order)) - begins[owner]
                first = np.flatnonzero((place < (sizes - need + RARE)[owner]) & (often[order] > 1))
                of = owner[first]
                ends = np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32)
                rarest, places = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (labelled[order[first]].view(np.int64), place[first].astype(np.int32)))
                key = place[first] <= (sizes - need)[of]
                first, of = first[key], of[key]
                low, high = _size_range(sizes)[of], _size_range(_longest(sizes[of] - place[first]))
                times = high - low
                # a row under its own size, and then one for each range of longer texts
                again = np.repeat(np.arange(len(of)), times)
                sized = low[again] + 1 + np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                word = labelled[order[first]]
                there = np.flatnonzero(sent.value[1][_counter(word)][again] & _range_bit(sized))  # in which the word is met
                again, sized = again[there], sized[there]
                keys = mix(np.concatenate([word, word[again]]) ^ mix(np.concatenate([low, sized]).astype(np.uint64) + np.uint64(1)))
                ends = np.concatenate([of, of[again]])
                turn = np.argsort(ends, kind="stable")
                begins = np.searchsorted(ends[turn], np.arange(len(sizes) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begins), pa.array(x)) for x in (keys[turn].view(np.int64), turn < len(of))]
                columns = [part.column("node"), part.column("label"), pa.array(sizes.astype(np.int32)), rarest, places, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "size", "rarest", "places", "keys", "owns"])

    found = written(texts.mapInArrow(run, "node long, label long, size int, rarest array<long>, places array<int>, keys array<long>, owns array<boolean>"), "rare")
    sent.destroy()
    met = F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("owns").alias("own"))).alias("met")
    keyed = written(found.select("node", "label", met).select("node", "label", "met.key", "met.own"), "keyed")
    return keyed, found.select("node", "label", "size", "rarest", "places")


def _classes_met(crowd: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keys, rarest words, the keys by which classes meet, and the pairs of classes that do, with the numbers of their texts."""
    keyed, texts = _rare_words(crowd)
    counted = keyed.groupBy("key", "label", "own").agg(F.count("*").alias("n"))
    # texts of one range meet once, others from the shorter one's side
    a, b = counted.toDF("key", "label_a", "own_a", "n_a"), counted.filter("own").select("key", F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    meeting = written(a.join(b, "key").filter("label_a < label_b OR NOT own_a AND label_a > label_b"), "keys-met")
    sized = texts.groupBy("label").agg(F.count("*").alias("members"))
    # a pair of classes may meet either way round
    ways = meeting.groupBy(F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("rows"))
    ways = ways.join(sized.toDF("low", "n_low"), "low").join(sized.toDF("high", "n_high"), "high")
    ways = written(ways.select("low", "high", "n_low", "n_high", F.expr("n_low * n_high <= rows").alias("whole")), "classes-met")
    return keyed, texts, meeting, ways


def _crowded_pairs(crowd: DataFrame, most: int | None = None, met: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All pairs of texts of different classes that may be alike: none is left out that has the edit similarity.

    Classes meet by the keys of their texts before texts do. Of two that meet, all texts are paired, or those with equal
    keys where that gives fewer rows: a class whose texts share many words with another's is not paired once a word.
    With ``most``, pairs of classes that would be paired as a whole in more rows are left to ``_block_links``.
    """
    keyed, texts, meeting, ways = met or _classes_met(crowd)
    if most is not None:
        ways = ways.filter(~F.col("whole") | (F.col("n_low") * F.col("n_high") <= most))
    members = texts.select("node", "label", "size")
    a, b = (members.toDF(f"node_{x}", y, f"size_{x}") for x, y in (("a", "low"), ("b", "high")))
    pairs = ways.filter("whole").join(a, "low").join(b, "high")
    pairs = pairs.filter(F.expr("least(size_a, size_b)") + 1e-9 >= SIMILARITY * F.expr("greatest(size_a, size_b)")).select("node_a", "node_b")
    some = ways.filter("NOT whole")
    some = some.select(F.col("low").alias("label_a"), F.col("high").alias("label_b")).union(some.select("high", "low"))
    some = meeting.join(some, ["label_a", "label_b"]).select("key", "label_a", "own_a", "label_b")
    a, b = keyed.select("key", F.col("label").alias("label_a"), F.col("own").alias("own_a"), F.col("node").alias("node_a")), keyed.filter("own")
    some = some.join(a, ["key", "label_a", "own_a"]).join(b.select("key", F.col("label").alias("label_b"), F.col("node").alias("node_b")), ["key", "label_b"])
    pairs = pairs.union(some.select(F.least("node_a", "node_b"), F.greatest("node_a", "node_b"))).distinct()
    a, b = (texts.select(F.col("node").alias(f"node_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "rarest", "places")]) for x in "ab")
    need = F.ceil(SIMILARITY * F.expr("greatest(size_a, size_b)") - 1e-9)
    common = pairs.join(a, "node_a").join(b, "node_b").withColumn("common", F.array_intersect("rarest_a", "rarest_b")).withColumn("need", need)
    common = common.filter(F.size("common") >= F.least(F.lit(RARE), "need"))
    # of a pair's common words, the rarest decides whether enough others can follow
    follow = [F.expr(f"size_{x} - try_element_at(places_{x}, cast(array_position(rarest_{x}, common[0]) as int)) >= need") for x in "ab"]
    return common.filter(follow[0] & follow[1]).select("node_a", "node_b")


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the words of each block and then those of the texts that meet it, and gives each text's first link with the block."""
    at, nodes, lists, index = None, [], [], None
    for batch in batches:
        a, b = [], []
        for *key, inside, node, held in zip(*(batch.column(c).to_pylist() for c in ("big", "block", "salt", "inside", "node", "words")), strict=True):
            if key != at:
                at, nodes, lists, index = key, [], [], None
            words_of = np.frombuffer(held, np.uint64)
            if inside:
                nodes.append(node)
                lists.append(words_of)
                continue
            if index is None:
                sizes = np.array([len(x) for x in lists], np.int64)
                labelled, begins = labelled_kmers(np.concatenate(lists), np.cumsum([0, *sizes]), 1)
                order = np.argsort(labelled)
                index = labelled[order], np.repeat(np.arange(len(sizes)), np.diff(begins))[order]
            own = labelled_kmers(words_of, np.array([0, len(words_of)]), 1)[0]
            low, high = (np.searchsorted(index[0], own, side=x) for x in ("left", "right"))
            met = high - low
            place = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
            common = np.bincount(index[1][place], minlength=len(sizes))
            longer = np.maximum(sizes, len(own))
            # no alignment can match more than the common words; the likeliest text first, and one link makes one class
            for i in np.argsort(-common, kind="stable"):
                if common[i] >= longer[i] - _edits_allowed(longer[i]) and alike([words_of], [lists[i]])[0]:
                    a.append(node)
                    b.append(nodes[i])
                    break
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([True] * len(a))], names=["a", "b", "alike"])


def _block_links(crowd: DataFrame, ways: DataFrame) -> DataFrame:
    """For pairs of classes all of whose texts may be alike: a link ``a``, ``b`` for every text and block that have one, written.

    The larger class is dealt into blocks; each text of the other is sent to a block once, not once for every text in it, and
    compared there with all of them until one is alike, which makes both classes one.
    """
    swap = F.col("n_low") > F.col("n_high")
    met = ways.select(F.when(swap, F.col("low")).otherwise(F.col("high")).alias("big"), F.when(swap, F.col("high")).otherwise(F.col("low")).alias("small"), F.least("n_low", "n_high").alias("n"))
    asks = met.groupBy("big").agg(F.sum("n").alias("asks"))
    members = crowd.select("node", "label", (F.length("words") / 8).alias("size"))
    dealt = members.groupBy(F.col("label").alias("big")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    dealt = dealt.join(asks, "big").withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_WORDS)).cast("int"))
    dealt = written(dealt.select("big", "n", "blocks", F.ceil(F.col("asks") / (DEALT * 4)).cast("int").alias("salts")), "blocks")
    inside = counted_join(members.select(F.col("label").alias("big"), "node"), dealt, "big")
    inside = inside.select("big", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("inside"))
    asked = met.select("big", "small").join(members.select(F.col("label").alias("small"), "node"), "small").join(dealt.drop("n"), "big")
    asked = asked.select("big", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(False).alias("inside"))
    rows = inside.unionByName(asked).join(crowd.select("node", "words"), "node")
    rows = rows.repartition("big", "block", "salt").sortWithinPartitions("big", "block", "salt", F.desc("inside"))
    found = written(rows.select("big", "block", "salt", "inside", "node", "words").mapInArrow(_compare_blocks, "a long, b long, alike boolean"), "linked")
    discard(dealt)
    return found


def _sides(rows: DataFrame, *shared: str) -> list[DataFrame]:
    """The rows as either side of pairs: all columns but the shared ones are named for their side."""
    return [rows.select(*[F.col(c).alias(c if c in shared else f"{c}_{x}") for c in rows.columns]) for x in "ab"]


def _open_pairs(members: DataFrame, labels: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a key, whose classes differ and that may be alike; and links found between blocks of larger classes.

    Of a key that few texts have, all pairs whose lengths allow it; of the other keys, all pairs whose words allow it.
    """
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "node", "n", "n_words", "label")
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    left = written(named.join(apart, "key", "left_semi"), "open-keys")
    a, b = _sides(left.filter(F.col("n") <= FEW).select("key", "node", "label", "n_words"), "key")
    fits = F.least("n_words_a", "n_words_b") + 1e-9 >= SIMILARITY * F.greatest("n_words_a", "n_words_b")
    few = a.join(b, "key").filter(F.expr("node_a > node_b AND label_a <> label_b") & fits).select("node_a", "node_b")
    crowd = left.filter(F.col("n") > FEW).select("node", "label").distinct()
    crowd = written(sequences.join(hint(crowd), "node"), "crowd")
    met = _classes_met(crowd)
    many = _crowded_pairs(crowd, WHOLE, met).select(F.greatest("node_a", "node_b").alias("node_a"), F.least("node_a", "node_b").alias("node_b"))
    linked = _block_links(crowd, met[-1].filter(F.col("whole") & (F.col("n_low") * F.col("n_high") > WHOLE)))
    return few.union(many).distinct().toDF("a", "b"), linked


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes differ."""
    named = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    named = named.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    return named.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def links(unique: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs ``a``, ``b`` of texts (nodes) that are near-duplicates, enough to connect all classes."""
    keyed = unique.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    groups = written(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1"), "groups")
    members = _shared_keys(unique, groups)
    discard(groups)
    sequences = _word_lists(texts, unique.select("node", "digest", "doc_id").join(members.select("node").distinct(), "node"))

    met = members.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    # the least head of a text first: a class of copies mostly has it in common, and is one class after that
    first = written(met.groupBy("a").agg(F.min("b").alias("b")), "pairs")
    results = _verified(first, sequences)
    discard(first)
    sized = members.join(unique.select("node", "n_words"), "node")
    for rest in (lambda labels: (_apart(met.distinct(), labels), None), lambda labels: _open_pairs(sized, labels, sequences)):
        labels = components(results.filter("alike"))
        pairs, linked = rest(labels)
        pairs = written(pairs.join(results.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        discard(labels)
        results = results.unionByName(_verified(pairs, sequences))
        if linked is not None:
            results = results.unionByName(linked)
        discard(pairs)
    for table in (members, sequences):
        discard(table)
    return results.filter("alike").select("a", "b")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """``node`` and the least node that it is connected with, for all nodes with an edge, written each round.

    Each round hands every node the least label among its neighbours and then that label's own label, so labels
    travel ever longer ways; it ends when no label changes, and raises if that takes more than ``most`` rounds.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        joined = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        roots = joined.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = written(joined.join(roots, "label").select("node", F.least("label", "root").alias("label"), "was"), "labels")
        discard(labels)
        labels = moved.select("node", "label")
        if moved.filter("label <> was").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as ``doc_id`` and ``digest`` of the text, and for each digest its class and number of rows.

    Of the second table: ``class_id`` is the least id of the class, ``first`` whether the digest is the one that
    stays (it has that id; of several the least digest), ``n`` how many rows have the digest.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = written(texts.mapInArrow(_sketches, "doc_id long, digest binary, n_words long, keys array<long>"), "sketches")
    unique = sketches.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    # numbers are given once, where the table is written, and read from there ever after
    unique = written(unique.withColumn("node", F.monotonically_increasing_id()), "texts")
    labels = components(links(unique, texts))
    nodes = unique.select("node", "digest", "doc_id", "n").join(labels, "node", "left")
    nodes = written(nodes.withColumn("label", F.coalesce("label", "node")), "nodes")
    # texts with an id come before texts without, then the least id, then the least digest
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("best")
    chosen = counted_join(nodes, nodes.groupBy("label").agg(best, F.count("*").alias("members")), "label", "members")
    chosen = chosen.select("digest", "n", F.col("best.doc_id").alias("class_id"), (F.col("best.digest") == F.col("digest")).alias("first"))
    chosen = written(chosen, "classes")
    for table in (nodes, unique):
        discard(table)
    return sketches.select("doc_id", "digest"), chosen


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` and ``kept`` for every row: near-duplicates, also through others, share a class.

    The class is named by its least ``doc_id``; the row that has it is kept. What counts is the text of a row, not
    its id: rows of one id with different texts are in the classes of their texts, and if several of them are in
    one class under that id, the one with the least digest is kept. Rows without an id belong to the class of their
    text like any other; they are kept only in a class without ids, whose ``class_id`` is null. Repeated rows are
    kept all or not at all.

    Null texts count as empty; texts without a word are alike only if they are equal, and so are texts without a
    run of five words in common. Texts of any length are compared whole, long ones piece by piece. An empty table
    gives an empty result; further columns are ignored.
    """
    rows, digests = grouped(docs)
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return counted_join(rows, digests, "digest", "n").select("doc_id", "class_id", kept.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of ``classes``, with all its columns; of rows with equal ids and texts one, whichever Spark meets first."""
    rows, digests = grouped(docs)
    named = lambda doc_id: F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
    digest, number, count = free_names(docs, "digest", "id", "n")
    key = [digest, number]
    chosen = digests.filter("first").select(F.col("digest").alias(digest), named(F.col("class_id")).alias(number))
    repeated = rows.groupBy(F.col("digest").alias(digest), named(F.col("doc_id")).alias(number)).agg(F.count("*").alias(count)).filter(F.col(count) > 1)
    repeated = written(repeated.join(chosen, key, "left_semi").select(*key), "repeated")
    found = docs.withColumns({digest: _digest(F.col("text")), number: named(F.col("doc_id"))})
    if repeated.isEmpty():
        return found.join(chosen, key, "left_semi").select(docs.columns)
    # repeated rows are made one where they are, before any of them is shuffled
    several = hint(repeated)
    once = found.join(several, key, "left_anti").join(chosen, key, "left_semi").select(docs.columns)
    return once.unionByName(found.join(several, key, "left_semi").dropDuplicates(key).select(docs.columns))
