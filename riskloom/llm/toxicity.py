"""Toxicity: a sparse linear classifier whose scores do not move when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from riskloom.llm.bounded import hash_sample
from riskloom.session import stage

#: Terms that name groups of people, by kind; a term is swapped with the others of its kind.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer"),
    "faith": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "turkish", "indian", "chinese", "immigrant"),
    "colour": ("black", "white", "brown", "latino"),
    "ability": ("disabled", "deaf", "blind", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
    "gender, de": ("frauen", "männer", "mädchen", "jungen", "nichtbinäre"),
    "orientation, de": ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    "faith, de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    "origin, de": ("afrikaner", "asiaten", "europäer", "amerikaner", "mexikaner", "araber", "türken", "inder", "chinesen", "einwanderer"),
    "colour, de": ("schwarze", "weiße", "braune"),
    "ability, de": ("behinderte", "gehörlose", "blinde", "autisten"),
    "age, de": ("alte", "junge", "senioren", "jugendliche"),
    "gender, fr": ("femmes", "hommes", "filles", "garçons"),
    "orientation, fr": ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    "faith, fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    "origin, fr": ("africains", "asiatiques", "européens", "américains", "mexicains", "arabes", "turcs", "indiens", "chinois", "immigrés"),
    "colour, fr": ("noirs", "blancs", "bruns"),
    "ability, fr": ("handicapés", "sourds", "aveugles", "autistes"),
    "age, fr": ("vieux", "jeunes", "âgés", "adolescents"),
    "gender, es": ("mujeres", "hombres", "niñas", "niños"),
    "orientation, es": ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    "faith, es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    "origin, es": ("africanos", "asiáticos", "europeos", "americanos", "mexicanos", "árabes", "turcos", "indios", "chinos", "inmigrantes"),
    "colour, es": ("negros", "blancos", "morenos"),
    "ability, es": ("discapacitados", "sordos", "ciegos", "autistas"),
    "age, es": ("viejos", "jóvenes", "ancianos", "adolescentes"),
}

_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6)
#: Words a worker remembers; the memory is emptied when it is full, which changes no score.
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class ToxicityConfig:
    #: Bound on the labelled rows that are fitted, taken in the order of a hash of doc_id.
    max_fit_rows: int = 8192
    #: Bound on the features that enter the fit: those most strongly tied to the label, seen in ``min_rows`` rows or more.
    max_features: int = 8192
    min_rows: int = 3
    swap_penalty: float = 1.0
    #: Least likelihood ratio of feature and label, in nats.
    min_strength: float = 6.0
    lasso: float = 5e-5
    ridge: float = 1e-5
    rounds: int = 500
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    bias: float

    def logit(self, features: set[int]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features)


# --- features ------------------------------------------------------------------------------------------


def word_features(token: str) -> list[int]:
    """Features of a raw token: each run of letters as a word, and its first letters."""
    out = []
    for word in _LETTERS.findall(token.lower()):
        out.append(xxhash.xxh64_intdigest("w:" + word) >> 1)
        out += [xxhash.xxh64_intdigest(f"{n}:{word[:n]}") >> 1 for n in PREFIXES if len(word) >= n]
    return out


def text_features(text: str | None) -> set[int]:
    return {f for token in set((text or "").lower().split()) for f in word_features(token)}


def swaps(text: str | None) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with the same sentence naming the next group of its kind."""
    for sentence in _SENTENCE.split((text or "").lower()):
        words = _LETTERS.findall(sentence)
        for term in dict.fromkeys(w for w in words if w in _NEXT):
            yield " ".join(words), " ".join(_NEXT[term] if w == term else w for w in words)


_NEXT = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS.values() for i, term in enumerate(terms)}


# --- fit -----------------------------------------------------------------------------------------------


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            seen[label.as_py()].update(text_features(text.as_py()))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from _counts(seen)
                seen = (Counter(), Counter())
    yield from _counts(seen)


def _counts(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    keys = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(keys), 100_000):
        part = keys[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array([c[k] for k in part], pa.int64()) for c in seen)], ["f", "clean", "toxic"])


def _chosen(kept: frozenset[int]):
    """Rows of (label, chosen features), and of (-1, what a swap adds, what it takes away)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, plus, minus = [], [], []
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py()
                label.append(y.as_py())
                plus.append(sorted(text_features(words) & kept))
                minus.append([])
                for before, after in swaps(words):
                    a, b = text_features(before) & kept, text_features(after) & kept
                    if a != b:
                        label.append(-1)
                        plus.append(sorted(b - a))
                        minus.append(sorted(a - b))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(plus, kind), pa.array(minus, kind)], ["label", "plus", "minus"])

    return run


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", id_: str = "doc_id", config: ToxicityConfig | None = None) -> ToxicityModel:
    """Fit on ``labelled(<id>, <text>, <label> 0/1)``; rows with another label or a null id are left out.

    Features are counted on the executors and only the chosen ones of at most ``max_fit_rows`` rows come to the driver.
    Without usable rows the model has no weights and scores 0 everywhere; with one class only, it scores the smoothed share of that class.
    """
    config = config or ToxicityConfig()
    usable = labelled.where(F.col(label).isin(0, 1) & F.col(id_).isNotNull())
    some = hash_sample(usable.select(F.col(id_).alias("id"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")), config.max_fit_rows, "id", "label", "text")
    rows = stage(some.select("text", "label").repartition(8), "toxicity-fit")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 + n1:
        return ToxicityModel({}, -np.inf)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not n0 or not n1:
        return ToxicityModel({}, bias)
    counts = rows.mapInArrow(_associations, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= config.min_rows)
    # Likelihood ratio of the 2 x 2 table of feature and label.
    seen = F.col("clean") + F.col("toxic")

    def part(observed: Column, share: float) -> Column:
        return F.when(observed > 0, observed * F.log(observed / (seen * share))).otherwise(0.0)

    strength = part(F.col("clean"), n0 / (n0 + n1)) + part(F.col("toxic"), n1 / (n0 + n1))
    kept = [r["f"] for r in counts.where(strength >= config.min_strength).orderBy(strength.desc(), "f").limit(config.max_features).collect()]
    # Features that occur in identity terms may enter too, so that their weights can be held equal.
    chosen = stage(rows.mapInArrow(_chosen(frozenset(kept)), "label int, plus array<long>, minus array<long>"), "toxicity-chosen")
    place = {f: i for i, f in enumerate(kept)}
    texts = chosen.where("label >= 0").collect()
    # Equal swaps are one with a count, so their number is that of the terms and of the few features each may share with its sentence.
    pairs = chosen.where("label < 0").groupBy("plus", "minus").agg(F.count("*").alias("n")).collect()
    pairs.sort(key=lambda r: (r["plus"], r["minus"]))
    often = np.array([r["n"] for r in pairs], float)
    often *= 2 * config.swap_penalty / max(often.sum(), 1.0)
    y = np.array([r["label"] for r in texts], float)
    row, col = _cells([r["plus"] for r in texts], place)
    prow, pcol = _cells([r["plus"] for r in pairs], place)
    mrow, mcol = _cells([r["minus"] for r in pairs], place)
    w, b = np.zeros(len(kept)), bias
    n = len(y)
    # The largest eigenvalue of the curvature gives the step.
    direction = np.ones(len(kept) + 1)
    top = 1.0
    for _ in range(30):
        direction /= max(np.linalg.norm(direction), 1e-12)
        z = direction[-1] + np.bincount(row, direction[col], n)
        curved = np.append(np.bincount(col, z[row], len(kept)), z.sum()) * 0.25 / n
        if pairs:
            moved = (np.bincount(prow, direction[pcol], len(pairs)) - np.bincount(mrow, direction[mcol], len(pairs))) * often
            curved[:-1] += np.bincount(pcol, moved[prow], len(kept)) - np.bincount(mcol, moved[mrow], len(kept))
        top = max(float(direction @ curved), 1e-6)
        direction = curved
    step = 0.9 / (top * 1.1 + config.ridge)
    look, look_b, t = w.copy(), b, 1.0
    for _ in range(config.rounds):
        z = look_b + np.bincount(row, look[col], n)
        error = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, error[row], len(w)) + config.ridge * look
        if pairs:
            moved = np.bincount(prow, look[pcol], len(pairs)) - np.bincount(mrow, look[mcol], len(pairs))
            moved *= often
            grad += np.bincount(pcol, moved[prow], len(w)) - np.bincount(mcol, moved[mrow], len(w))
        new = look - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * config.lasso, 0)
        new_b = look_b - step * error.sum()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, look_b = new + (old - 1) / t * (new - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new, new_b
    return ToxicityModel({f: float(x) for f, x in zip(kept, w, strict=True) if x}, float(b))


def _cells(rows: Sequence[Sequence[int]], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at.astype(np.int64), np.array([place[f] for r in rows for f in r], np.int64)


# --- scores --------------------------------------------------------------------------------------------


def score(model: ToxicityModel, text: Column) -> Column:
    """Probability of the toxic label for each whole text. A null text counts as an empty one."""
    weights, bias = model.weights, model.bias
    neutral: set[str] = set()

    @arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        out = np.empty(len(batch))
        for i, x in enumerate(batch):
            # Tokens that carry no weight are remembered, so a text costs little more than its split.
            rest = set((x.as_py() or "").lower().split()) - neutral
            hit: set[int] = set()
            for token in rest:
                found = [f for f in word_features(token) if f in weights]
                if found:
                    hit.update(found)
                else:
                    neutral.add(token)
            if len(neutral) > CACHE_WORDS:
                neutral.clear()
            out[i] = bias + sum(weights[f] for f in sorted(hit))
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-out)))

    return run(text)


def held_out(id_: Column) -> Column:
    """Rows that are never fitted; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", config: ToxicityConfig | None = None) -> DataFrame:
    """``(doc_id, text, toxic)`` of the documents with a label that may be learnt from. A repeated label is used once.

    The labels are cut to ``max_fit_rows`` before the join, so what is broadcast has that bound and no text is shuffled.
    """
    id__ = F.col("doc_id")
    marks = labels.select("doc_id", "toxic").where(id__.isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id__)).distinct()
    some = hash_sample(marks, (config or ToxicityConfig()).max_fit_rows, "doc_id", "toxic")
    return docs.select(F.col(id_).alias("doc_id"), "text").join(F.broadcast(some), "doc_id")


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row, repeated rows included; null and empty texts score as no words."""
    return docs.select(F.col(id_).alias("doc_id"), held_out(F.col(id_)).alias("held_out"), score(model, F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows that the classifier does not reject, with the columns they have.

    Null and empty texts are scored as no words; repeated rows all stay or all go; an empty table stays empty.
    """
    return docs.where(score(model, F.col(text)) < threshold)
