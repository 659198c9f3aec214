"""Language identification by nearest centroid.

A text is lower-cased and its character n-grams of one to three letters are counted in a fixed number of hashed
places; counts become TF-IDF vectors of length one. Each language has several centroids, found by spherical k-means over
labelled rows, and a text gets the language of the centroid with the largest cosine. A text is marked as rejected if its best
cosine lies far under those of the language's training rows of like length: short texts lie farther from any centroid than
long ones, and no single row sets a bound.

Training rows are drawn by language, so that every labelled language is learned however rare it is. Null texts and texts
without a letter are "und" with score 0 and rejected; very long texts are counted whole, in parts. Equal cosines go to the language
that comes first. Rows are independent: repeated rows repeat, null ids pass through, an empty table gives an empty result;
without a labelled row, all is "und". Labels are used in training alone. Carried columns come back as they are, but for those
named like a column that is made, which are left out; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices

#: Hashed places of the n-grams.
PLACES = 1 << 12
CENTROIDS = 3
#: Labelled rows that a model is fitted on, at most about, over all languages; documented bound on the driver's work.
TRAIN_ROWS = 3000
#: Characters that n-grams are counted in at a time; a text's parts overlap, so that nothing is lost.
PART = 1 << 20
#: Lengths, in counted n-grams, that part texts into classes with rejection bounds of their own; each class is so many times longer than the one before.
CLASS_STEP, CLASSES = 4, 8
#: A text is rejected if its cosine is under this share of the quantile of its language's training rows of its class.
REJECT_QUANTILE, REJECT_SHARE = 0.02, 0.55
#: Rows that a quantile needs; a class with fewer takes the bound of the next shorter class that has them, or else LOOSE_SHARE of the language's lowest cosine.
QUANTILE_ROWS, LOOSE_SHARE = 20, 0.5
UNKNOWN = "und"
MADE = ("lang_pred", "score", "rejected")


def count_grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if there is no letter. Marks, digits and spaces count as word ends."""
    letters = np.zeros(PLACES, np.float32)
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return None
    kinds = _letter_table()
    is_letter = kinds[np.minimum(codes, len(kinds) - 1)]
    far = codes >= len(kinds) - 1
    if far.any():
        is_letter = is_letter.copy()
        is_letter[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    for k in range(0, len(codes), PART):
        one = np.concatenate([codes[k - 2 : k] if k else [32], codes[k : k + PART], [32] if k + PART >= len(codes) else []]).astype(np.uint32)
        new = 1 if k == 0 else 2
        a, b, c = one[:-2], one[1:-1], one[2:]
        mix = lambda h: ((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        three = mix(a * np.uint32(961) + b * np.uint32(31) + c + np.uint32(7))
        keep = (b != 32) | ((a != 32) & (c != 32))
        letters += np.bincount(three[keep], minlength=PLACES).astype(np.float32)
        a, b = one[new - 1 : -1], one[new:]
        two = mix(a * np.uint32(53) + b + np.uint32(101))
        letters += np.bincount(two[(a != 32) | (b != 32)], minlength=PLACES).astype(np.float32)
        single = one[new:]
        letters += np.bincount(mix(single[single != 32] + np.uint32(999)), minlength=PLACES).astype(np.float32)
    return letters


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x3000)] + [False]))
    return _TABLE[0]


def length_class(sizes: np.ndarray) -> np.ndarray:
    """The class of texts with so many n-grams."""
    return np.clip((np.log(np.maximum(sizes, 1)) / np.log(CLASS_STEP)).astype(np.int64), 0, CLASSES - 1)


@dataclass
class Model:
    """idf by place; centroids as rows, with their language; rejection bounds by centroid and length class."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    bounds: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) by text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        for k in range(0, len(texts), 256):
            counted = [(i, c) for i, t in enumerate(texts[k : k + 256], k) if t and (c := count_grams(t)) is not None]
            if not counted or not self.languages:
                continue
            counts = np.stack([c for _, c in counted])
            classes = length_class(counts.sum(1))
            cosine = self.weigh(counts) @ self.centroids.T
            best = cosine.argmax(1)
            for (i, _), row, at, length in zip(counted, cosine, best, classes, strict=True):
                score = float(min(1.0, max(0.0, row[at])))
                out[i] = (self.languages[at], score, score < self.bounds[at, length])
        return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the means of k equal parts along the direction in which the rows differ most: no outlier has a part of its own. As many centroids as there are rows at most."""
    k = min(k, len(x))
    off = x - x.mean(0)
    direction = off[int(np.einsum("ij,ij->i", off, off).argmax())]
    for _ in range(20):
        direction = off.T @ (off @ direction)
        size = np.linalg.norm(direction)
        if size < 1e-9:
            break
        direction = direction / size
    parts = np.array_split(np.argsort(off @ direction, kind="stable"), k)
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    centroids = unit(np.stack([x[p].sum(0) for p in parts]))
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(1)
        centroids = unit(np.stack([x[of == j].sum(0) if (of == j).any() else centroids[j] for j in range(k)]))
    return centroids


def rejection_bounds(cosines: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A bound for each length class from a language's rows: their best cosines and classes. No class is stricter than all rows together would be."""
    share = lambda own: REJECT_SHARE * float(np.quantile(own, REJECT_QUANTILE))
    out, bound = np.zeros(CLASSES), LOOSE_SHARE * float(cosines.min())
    for c in range(CLASSES):
        own = cosines[classes == c]
        if len(own) >= QUANTILE_ROWS:
            bound = min(share(own), share(cosines))
        out[c] = bound
    return out


def fit(languages: list[str], x: np.ndarray, centroids: int = CENTROIDS) -> Model:
    """languages and counts by row; the counts are weighed in place."""
    if not languages:
        return Model(np.ones(PLACES, np.float32), np.zeros((0, PLACES), np.float32), [], np.zeros((0, CLASSES)))
    classes = length_class(x.sum(1))
    idf = (np.log((1 + len(languages)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    parts, names, bounds = [], [], []
    labels = np.array(languages)
    for language in sorted(set(languages)):
        rows = labels == language
        own = x[rows]
        found = cluster(own, centroids)
        parts.append(found)
        names += [str(language)] * len(found)
        bounds += [rejection_bounds((own @ found.T).max(1), classes[rows])] * len(found)
    return Model(idf, np.concatenate(parts).astype(np.float32), names, np.stack(bounds))


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language, about as many of each as the bound allows: all of small ones, and one at least."""
    out, left = {}, most
    for k, (language, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[language] = max(1, min(n, left // (len(sizes) - k)))
        left = max(0, left - out[language])
    return out


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows, or on about that many of them, chosen by language and by a hash of the id. Counts of the languages and these rows are all that the driver holds."""
    rows = df.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(sizes.values()) > most:
        wanted = quotas(sizes, most)
        shares = F.create_map(*[F.lit(v) for lang in wanted for v in (lang, 1 << 30 if wanted[lang] == sizes[lang] else max(1, int((1 << 30) * wanted[lang] / sizes[lang])))])
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < shares[F.col("lang")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, places, values = [], [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (counts := count_grams(text)) is not None:
                    at = np.flatnonzero(counts)
                    langs.append(lang)
                    places.append(at.astype("<u2").tobytes())
                    values.append(counts[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "places", "counts"])

    found = list(rows.select("text", "lang").mapInArrow(grams, "lang string, places binary, counts binary").toLocalIterator())
    x = np.zeros((len(found), PLACES), np.float32)
    for own, row in zip(x, found, strict=True):
        own[np.frombuffer(row.places, "<u2")] = np.frombuffer(row.counts, "<f4")
    return fit([row.lang for row in found], x)


def identify(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and lang_pred, score, rejected."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in MADE]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))
    schema = "".join(f"c_{k} {rows.schema[f'c_{k}'].dataType.simpleString()}, " for k in range(len(carry)))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: places by languages and centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(run, f"{schema}lang_pred string, score double, rejected boolean")
    return found.select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)], "lang_pred", "score", "rejected")


def held_out(id_col: str) -> Column:
    """Rows that models never learn from; a null id is in no fold and isn't learned from either."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id")), "doc_id", "text", "lang")
    found = identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
