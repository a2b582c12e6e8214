"""Language identification by hierarchical discrimination.

A linear classifier over letter sequences first picks the language family; within it, one-versus-one linear
support vector machines separate the closely related languages, each pair by its own machine. How usual a text's
letter sequences are in the language picked tells texts of no learned language, which the machines cannot.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches, crc_part, hint, written
from docweft.llm.words import lowered, mix, sliced, word_mask

#: Labelled texts fitted at most, the same number of each language, chosen by a hash of id and text.
MAX_ROWS = 3000
FEATURES = 1 << 13
#: Lengths, in bytes, of the letter sequences.
GRAMS = (2, 3, 4)
UNDETERMINED = "und"
#: Deviations that a text may have at least; more where one in twenty labelled texts has over a quarter of them.
LEAST_CUT = -8.0
#: The spread of a language's texts is taken as so much at least, as some have an odd passage in ordinary prose.
LEAST_SPREAD = 0.1

#: Families of language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].split("_")[0].lower(), code)


@dataclass
class Profile:
    """How usual letter sequences are in each language: logarithms, and their level and spread in its texts."""

    languages: list[str]
    logs: np.ndarray
    level: np.ndarray
    spread: np.ndarray
    within: np.ndarray
    #: Texts at this deviation from the level count half.
    cut: np.ndarray

    def likeness(self, code: np.ndarray, owner: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How well each text fits the language picked for it (0 to 1): near 1 for its like, near 0 for the unlike."""
        of = np.searchsorted(np.array(self.languages, object), language)
        count = np.maximum(np.bincount(owner, minlength=len(language)), 1)
        usual = np.bincount(owner, weights=self.logs[of[owner], code], minlength=len(language)) / count
        deviation = _deviation(usual, count, self.level[of], self.spread[of], self.within[of])
        return 1 / (1 + np.exp(np.clip(self.cut[of] - deviation, -50, 50)))


def _deviation(usual: np.ndarray, count: np.ndarray, level: np.ndarray, spread: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The distance from the level in units of what texts of this length spread; about eight sequences overlap."""
    return (usual - level) / np.sqrt(spread**2 + 8 * within / count + 1e-6)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log(0.9 * x.mean(axis=0) + 0.1 / FEATURES)


def _profile(x: np.ndarray, total: np.ndarray, language: np.ndarray) -> Profile:
    """The profile from rows of frequencies; each half of a language's rows is measured with the logarithms of the other."""
    known = sorted(set(language))
    logs, numbers = np.zeros((len(known), FEATURES), np.float32), np.zeros((4, len(known)))
    for i, code in enumerate(known):
        rows = np.flatnonzero(language == code)
        logs[i] = _logs(x[rows])
        halves = (rows[::2], rows[1::2]) if len(rows) > 1 else (rows, rows)
        usual, square = np.zeros(len(language)), np.zeros(len(language))
        for a, b in (halves, halves[::-1]):
            other = _logs(x[b])
            usual[a], square[a] = x[a] @ other, x[a] @ other**2
        usual, within = usual[rows], float(np.median(square[rows] - usual[rows] ** 2))
        level = float(np.median(usual))
        spread = max(LEAST_SPREAD, 1.4826 * float(np.median(np.abs(usual - level))))
        deviation = _deviation(usual, total[rows], level, spread, within)
        numbers[:, i] = level, spread, within, min(LEAST_CUT, 4 * float(np.quantile(deviation, 0.05)))
    return Profile(known, logs, *numbers)


@dataclass
class Model:
    """One column of weights for each machine: families one against the rest, then pairs of languages within each."""

    weights: np.ndarray
    bias: np.ndarray
    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]
    profile: Profile

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and confidences from the margins of all machines."""
        n = len(margins)
        picked, sure = _best(margins[:, : len(self.families)] if len(self.families) > 1 else np.zeros((n, 1)))
        language, score = np.empty(n, object), np.empty(n)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(picked == f)
            votes = np.zeros((len(rows), len(members)))
            for column, (g, a, b) in enumerate(self.pairs, len(self.families) if len(self.families) > 1 else 0):
                if g == f:
                    won = np.tanh(margins[rows, column])
                    votes[:, a] += won
                    votes[:, b] -= won
            inner, inner_sure = _best(votes)
            language[rows] = np.array(members, object)[inner]
            score[rows] = sure[rows] * inner_sure
        return language, score


def _best(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first largest of each row, and how clearly it leads (1/2 to 1)."""
    picked = votes.argmax(axis=1)
    if votes.shape[1] == 1:
        return picked, np.ones(len(votes))
    ordered = np.sort(votes, axis=1)
    return picked, 1 / (1 + np.exp(-2 * (ordered[:, -1] - ordered[:, -2])))


def gram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed letter sequences of all texts and the text of each; words end in one space, digits are spaces."""
    data, offsets = lowered(texts)
    letter = word_mask(data) & ~((data >= 48) & (data <= 57))
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    kept = letter | (after & ~first)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[kept]
    code = np.where(letter, data, 32)[kept].astype(np.uint64)
    codes, owners = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        value = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(257) + code[i : len(code) - n + 1 + i]
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        codes.append((mix(value) >> np.uint64(51)).astype(np.int64)[inside])
        owners.append(owner[: len(owner) - n + 1][inside])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch):
            code, owner = gram_codes(part.column("text"))
            both, count = np.unique(owner * FEATURES + code, return_counts=True)
            bounds = pa.array(np.searchsorted(both // FEATURES, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.ListArray.from_arrays(bounds, pa.array((both % FEATURES).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.float32)))],
                names=["lang", "ids", "counts"],
            )


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` different texts with a language, outside the held-out part, as many of each language.

    They are those with the least hashes of id and text, so rows are what is limited, not ids. A bound on the hash,
    from each language's number of rows, leaves few more than are wanted before they are ranked.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_part() != 2))
    usable = usable.select(F.col("lang"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    totals = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max_rows // max(1, totals.count())
    # four times as many as wanted, and never under a thousand, so that enough are left for certain
    share = F.pmod("key", F.lit(1 << 30)) < F.lit(float(1 << 30)) * max(4 * each, 1000) / F.col("n")
    near = usable.select("lang", "key").join(hint(totals), "lang").filter(share).select("lang", "key").distinct()
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "key"))).filter(F.col("_n") <= each)
    chosen = F.broadcast(ranked.select("lang", "key"))  # at most max_rows short rows
    return usable.join(chosen, ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "text")


def _machine(x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, both sides weighted alike, by Adam."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sign = sign.astype(np.float32)
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    for step in range(1, 121):
        margin = sign * (x @ w[:-1] + w[-1])
        pull = -2 * weight * sign * np.maximum(0, 1 - margin)
        gradient = np.append(pull @ x, pull.sum()) + np.float32(1e-4) * np.append(w[:-1], np.float32(0))
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """The two levels of machines; None where no text has a language."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, max_rows).mapInArrow(_frequencies, "lang string, ids array<int>, counts array<float>").toArrow()
    if not rows.num_rows:
        return None
    language = np.array(rows.column("lang").to_pylist(), object)
    ids, counts = (rows.column(c).combine_chunks() for c in ("ids", "counts"))
    sizes = np.diff(ids.offsets.to_numpy())
    row = np.repeat(np.arange(len(language)), sizes)
    counts = counts.flatten().to_numpy()
    total = np.bincount(row, weights=counts, minlength=len(language)).astype(np.float32)
    x = np.zeros((len(language), FEATURES), np.float32)
    x[row, ids.flatten().to_numpy()] = counts / total[row]
    del rows, ids, counts, row
    pa.default_memory_pool().release_unused()
    profile = _profile(x, total, language)
    mean = x.mean(axis=0)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean * mean, 0))
    scale = (1 / (spread + 1e-4) / np.sqrt(FEATURES)).astype(np.float32)
    x *= scale
    known = sorted(set(language))
    families = sorted({family(c) for c in known})
    members = [[c for c in known if family(c) == f] for f in families]
    of = np.array([families.index(family(c)) for c in language])
    machines = [_machine(x, np.where(of == f, 1, -1)) for f in range(len(families))] if len(families) > 1 else []
    pairs = []
    for f, codes in enumerate(members):
        for a, b in itertools.combinations(range(len(codes)), 2):
            chosen = (language == codes[a]) | (language == codes[b])
            machines.append(_machine(x[chosen], np.where(language[chosen] == codes[a], 1, -1)))
            pairs.append((f, a, b))
    weights = np.stack([w for w, _ in machines], axis=1) * scale[:, None] if machines else np.zeros((FEATURES, 0))
    return Model(weights.astype(np.float32), np.array([b for _, b in machines]), families, members, pairs, profile)


def language_of(text: Column, model: Model | None) -> Column:
    """A struct of the predicted language and its confidence, low for texts unlike it; ``und`` for texts without a letter."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            languages, scores = [np.zeros(0, object)], [np.zeros(0)]
            for part in sliced(pa.RecordBatch.from_arrays([batch], names=["text"])):
                code, owner = gram_codes(part.column("text"))
                count = np.maximum(np.bincount(owner, minlength=part.num_rows), 1)
                margins = np.stack([np.bincount(owner, weights=model.weights[code, k], minlength=part.num_rows) / count + b for k, b in enumerate(model.bias)], axis=1) if len(model.bias) else np.zeros((part.num_rows, 0))
                language, score = model.decide(margins)
                languages.append(language)
                scores.append(score * model.profile.likeness(code, owner, language))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(languages), pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(nothing)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, whether it is held out, the predicted language and its confidence, for every row's whole text.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if none has a language to
    learn from. Long texts count whole. Null ids are held out if their checksum says so; repeated rows are predicted alike; ties go to the
    language first in order of code; an empty table gives an empty result; further columns are ignored.
    """
    found = language_of(F.col("text"), fit(docs, max_rows))
    scored = docs.select("doc_id", (crc_part() == 2).alias("held_out"), found.alias("_found"))
    return scored.select("doc_id", "held_out", F.col("_found.lang_pred"), F.col("_found.score"))
