"""Toxicity: a logistic classifier with counterfactual regularisation.

Identity terms in the labelled texts are swapped, for another term of their group and for a neutral one, and the
fit penalises what these swaps change in the score. A term that only happens to stand in toxic texts then gains
little weight, so neutral mentions of a group score like the same text about anyone else.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches, crc_part, written
from docweft.llm.words import Words, mix, sliced, words

#: Labelled rows fitted at most, as many of each label as there are up to half of it; chosen by a hash of the id.
MAX_ROWS = 16_000
#: Size of the hashed feature space, and so of the model at most.
FEATURES = 1 << 20
#: Words count whole and by their first bytes, which related word forms share.
PREFIXES = (None, 4, 6)
#: A feature is used if its difference between the labels is so many standard errors, in at least so many texts.
MIN_Z = 4.5
MIN_TEXTS = 5
THRESHOLD = 0.3
#: Weight of the mean squared change of the score (before the logistic function) under swaps.
PENALTY = 10.0

#: Identity terms that may stand for each other in a sentence, by language: groups, and persons of either sex. Pronouns count,
#: as they say who a sentence is about. Callers may give groups of their own.
IDENTITY_GROUPS = {
    "en": (
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"),
        ("he", "she"),
        ("himself", "herself"),
        ("woman", "man", "girl", "boy"),
        ("women", "men", "girls", "boys"),
        ("female", "male", "transgender", "nonbinary"),
        ("immigrant", "native", "refugee", "foreigner"),
        ("immigrants", "natives", "refugees", "foreigners"),
        ("blind", "deaf", "disabled", "autistic"),
        ("young", "old", "elderly", "teenage"),
    ),
    "de": (
        ("er", "sie"),
        ("mann", "frau", "junge", "mädchen"),
        ("männer", "frauen", "jungen"),
        ("christ", "jude", "moslem", "hindu"),
        ("christen", "juden", "moslems", "muslime"),
        ("ausländer", "einheimische", "flüchtlinge", "einwanderer"),
    ),
    "fr": (
        ("il", "elle"),
        ("ils", "elles"),
        ("homme", "femme", "garçon", "fille"),
        ("hommes", "femmes", "garçons", "filles"),
        ("chrétien", "juif", "musulman", "bouddhiste"),
        ("chrétiens", "juifs", "musulmans", "bouddhistes"),
        ("étrangers", "immigrés", "réfugiés"),
    ),
    "es": (
        ("él", "ella"),
        ("ellos", "ellas"),
        ("hombre", "mujer", "niño", "niña"),
        ("hombres", "mujeres", "niños", "niñas"),
        ("cristiano", "judío", "musulmán", "budista"),
        ("cristianos", "judíos", "musulmanes", "budistas"),
        ("extranjeros", "inmigrantes", "refugiados"),
    ),
}
NEUTRAL = "person"


@dataclass
class Terms:
    """Identity terms and what stands for each of them: the next of its group; a term of several groups is in the first."""

    following: dict[str, str]

    @staticmethod
    def of(groups: dict[str, tuple[tuple[str, ...], ...]]) -> Terms:
        following: dict[str, str] = {}
        for group in itertools.chain.from_iterable(groups.values()):
            for i, term in enumerate(group):
                following.setdefault(term, group[(i + 1) % len(group)])
        return Terms(following)

    def swapped(self, text: str) -> list[str]:
        """The text with every term swapped for the next of its group, and for a neutral word; none without terms."""
        pattern = _pattern(tuple(self.following))
        if not self.following or not pattern.search(text):
            return []
        return [pattern.sub(lambda m: self.following[m[0].lower()], text), pattern.sub(NEUTRAL, text)]

    def features(self) -> np.ndarray:
        """The features of all terms, swapped ones and the neutral word."""
        known = sorted({*self.following, *self.following.values(), NEUTRAL})
        return np.unique(_distinct(words(pa.array(known, pa.string())))[1])


@functools.cache
def _pattern(terms: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)


@dataclass
class Model:
    """Weights of the features that are used, and the score without any."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(FEATURES, np.float64)
        table[self.ids] = self.weights
        return table


def feature_ids(held: Words) -> list[np.ndarray]:
    """The hashed features of each word, an array for each kind."""
    out = []
    for kind, most in enumerate(PREFIXES):
        out.append((mix(held.hashes(most) + np.uint64(kind)) >> np.uint64(44)).astype(np.int64))
    return out


def _distinct(held: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), sorted."""
    owner = held.owner()
    both = np.unique(np.concatenate([owner * FEATURES + ids for ids in feature_ids(held)])) if len(owner) else np.zeros(0, np.int64)
    return both // FEATURES, both % FEATURES


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled texts outside the held-out part, and how many rows there are of each label.

    Of several labels for one document the toxic one counts.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_part() != 2))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for label in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most max_rows short rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    # of several texts with one id one, so that rows are bounded, too; mostly there are none such
    several = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(chosen, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = F.broadcast(written(several, "repeated-ids"))  # at most max_rows ids
    if several.isEmpty():
        return texts, totals
    one = texts.join(several, "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.join(several, "doc_id", "left_anti").unionByName(one), totals


def _featurise(terms: Terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct features of each text (kind 0), and what its swapped forms change (kinds 1, 2): added ones as they are,
    removed ones as -1 - feature. The label is in the last bit of ``form``, the kind above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                forms, kinds, source = [], [], []
                for text in part.column("text").to_pylist():
                    source += [len(forms)] * (1 + len(changed := terms.swapped(text or "")))
                    kinds += range(1 + len(changed))
                    forms += [text or "", *changed]
                row, ids = _distinct(words(pa.array(forms, pa.string())))
                bounds = np.searchsorted(row, np.arange(len(forms) + 1))
                own = lambda i: ids[bounds[i] : bounds[i + 1]]
                lists = []
                for i, (kind, of) in enumerate(zip(kinds, source, strict=True)):
                    lists.append(np.concatenate([np.setdiff1d(own(i), own(of)), -1 - np.setdiff1d(own(of), own(i))]) if kind else own(i))
                kinds = np.array(kinds, np.int32)
                labels = part.column("label").to_numpy()[np.cumsum(kinds == 0) - 1]
                yield pa.RecordBatch.from_arrays([pa.array((2 * kinds + labels).astype(np.int32)), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["form", "ids"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY, groups: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY_GROUPS) -> Model:
    """The classifier, from labelled rows outside the held-out part; ``penalty`` weighs the counterfactual term.

    The features of the identity terms are used whatever their strength, so that the penalty can settle them.
    """
    bounded_batches(docs.sparkSession)
    terms = Terms.of(groups)
    texts, totals = training_rows(docs, labels, max_rows)
    total = sum(totals.values())
    prior = totals.get(1, 0) / total if total else 0.0
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), base)
    if not 0 < prior < 1:
        return nothing
    table = texts.select("text", "label").mapInArrow(_featurise(terms), "form int, ids array<int>").toArrow()
    if not table.num_rows:
        return nothing
    held = [_entries(batch) for batch in table.to_batches() if batch.num_rows]
    # one pass over the entries counts them, another keeps those of the features that are used
    seen, count = [np.zeros(FEATURES, np.int64) for _ in (0, 1)], np.zeros(2, np.int64)
    for kind, label, sizes, ids in held:
        of = np.repeat(np.where(kind == 0, label, 2).astype(np.int8), sizes)
        for c in (0, 1):
            seen[c] += np.bincount(ids[of == c], minlength=FEATURES)
            count[c] += int(((kind == 0) & (label == c)).sum())
    if not count.all():
        return nothing
    strong = _strength(seen, count) >= MIN_Z
    if not strong.any():
        return nothing
    named = terms.features()
    strong[named[seen[0][named] + seen[1][named] >= MIN_TEXTS]] = True
    used = np.flatnonzero(strong)
    number = np.full(FEATURES, -1, np.int32)
    number[used] = np.arange(len(used))
    labels_of, rows, columns, forms, changed, signs, n_texts, n_forms = [], [], [], [], [], [], 0, 0
    for kind, label, sizes, ids in held:
        column = number[np.where(ids < 0, -1 - ids, ids)]
        kept = np.flatnonzero(column >= 0)
        entry = np.repeat(np.arange(len(kind)), sizes)[kept]
        real = kind[entry] == 0
        text, form = np.cumsum(kind == 0) - 1 + n_texts, np.cumsum(kind > 0) - 1 + n_forms
        labels_of.append(label[kind == 0])
        rows.append(text[entry[real]])
        columns.append(column[kept[real]])
        forms.append(form[entry[~real]])
        changed.append(column[kept[~real]])
        signs.append(np.where(ids[kept[~real]] < 0, -1.0, 1.0))
        n_texts, n_forms = n_texts + int((kind == 0).sum()), n_forms + int((kind > 0).sum())
    # the driver holds the entries of the used features once, and none of the others, while it fits
    del table, held, kind, sizes, ids, column, kept, entry, real, text, form, seen
    pa.default_memory_pool().release_unused()
    label = _joined(labels_of)
    swaps = Swaps(_joined(forms), _joined(changed), _joined(signs), n_forms)
    weight = np.where(label == 1, totals[1] / count[1], totals[0] / count[0]) / total
    bias, weights = _descend(_joined(rows), _joined(columns), len(used), label, weight, swaps, base, penalty)
    return Model(used, weights, bias)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied, as both need not be held."""
    found = np.concatenate(parts)
    parts.clear()
    return found


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of ``_featurise``: each form's kind, label and number of features, and all features."""
    form, lists = batch.column("form").to_numpy(), batch.column("ids")
    return form // 2, form % 2, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


@dataclass
class Swaps:
    """What swapped forms change: entries of form, feature and sign; ``total`` counts all forms, those that change nothing, too."""

    row: np.ndarray
    column: np.ndarray
    sign: np.ndarray
    total: int


def _strength(seen: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    """The difference of each feature's share between the labels, in standard errors."""
    both = seen[0] + seen[1]
    share = (both + 1) / (count.sum() + 2)
    error = np.sqrt(share * (1 - share) * (1 / count[0] + 1 / count[1]))
    return np.where(both >= MIN_TEXTS, np.abs(seen[1] / count[1] - seen[0] / count[0]) / error, 0)


def _descend(row: np.ndarray, column: np.ndarray, size: int, label: np.ndarray, weight: np.ndarray, swaps: Swaps, base: float, penalty: float) -> tuple[float, np.ndarray]:
    """Minimises weighted log loss + a ridge + the mean squared change of the score under swaps, by Adam."""
    w = np.zeros(size + 1)
    w[-1] = base
    first, second = np.zeros_like(w), np.zeros_like(w)
    ridge = np.append(np.full(size, 1e-5), 0)
    forms = swaps.total
    for step in range(1, 401):
        z = np.bincount(row, weights=w[column], minlength=len(label)) + w[-1]
        pull = weight * (1 / (1 + np.exp(-z)) - label)
        gradient = np.append(np.bincount(column, weights=pull[row], minlength=size), pull.sum()) + ridge * w
        if forms:
            change = np.bincount(swaps.row, weights=swaps.sign * w[swaps.column], minlength=forms)
            gradient[:-1] += np.bincount(swaps.column, weights=2 * penalty / swaps.total * swaps.sign * change[swaps.row], minlength=size)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        rate = 0.1 * (1 - step / 420)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(w[-1]), w[:-1]


def toxicity_score(text: Column, model: Model) -> Column:
    """The probability that a text is toxic; null counts as the empty text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.table()
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(_score(p.column("text"), table, model.bias) for p in sliced(pa.RecordBatch.from_arrays([batch], names=["text"])))]))

    return score(text)


def _score(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    held = words(texts)
    owner, found = held.owner(), []
    for ids in feature_ids(held):
        at = np.flatnonzero(table[ids])
        found.append(owner[at] * FEATURES + ids[at])
    both = np.unique(np.concatenate(found))
    z = np.bincount(both // FEATURES, weights=table[both % FEATURES], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def swap_changes(docs: DataFrame, model: Model, groups: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY_GROUPS) -> DataFrame:
    """``doc_id`` and the largest change of the score when identity terms are swapped, for texts that have any."""
    terms = Terms.of(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in sliced(batch):
                ids, change = [], []
                for doc_id, text in zip(part.column("doc_id"), part.column("text").to_pylist(), strict=True):
                    if forms := terms.swapped(text or ""):
                        score = _score(pa.array([text, *forms], pa.string()), table, model.bias)
                        ids.append(doc_id.as_py())
                        change.append(float(np.abs(score[1:] - score[0]).max()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(change, pa.float64())], names=["doc_id", "change"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, change double")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> DataFrame:
    """``doc_id``, whether it is held out, its score and the decision, for every row and the whole of its text.

    Null and empty texts get the score of a text without any known feature; long texts are scored whole. Null ids are held out if their
    checksum says so; repeated rows score alike; without labels of both kinds every score is the share of toxic
    labels (0 without labels); an empty table gives an empty result; further columns are ignored.
    """
    model = fit(docs, labels, max_rows, penalty)
    scored = docs.select("doc_id", (crc_part() == 2).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
