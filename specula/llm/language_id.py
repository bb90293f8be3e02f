"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family, one against the rest, picks the family; inside it
one-versus-one machines, one for each pair of its languages, vote. A family of more than ``CLOSE`` languages is cut
into sub-families first, in halves along the direction in which its languages' means differ most, with a machine for
each cut, until ``CLOSE`` or fewer are left to vote; so machines grow with languages, not with their square. Features
are letter 1- to 3-grams of words with their edges, hashed to 4,096 places and counted over the whole text by array
operations in slices of ``SLICE`` characters, as shares of the total.

Machines are fitted on the driver from a bounded sample of labelled rows, about ``per_language`` for each language or,
where languages are many, an equal share of ``in_all`` (the documented bound), one at least; chosen by a hash of doc_id
and text, equal ones once. Scoring is a map without a shuffle. Texts of any length count in full in both. Every
language of a labelled row with a text is learned.

Defined results: a null text or one without a letter gives ``und`` and score 0; without labelled rows every text
gives ``und``; one learned language is given to every text with a letter; equal texts give equal results;
repeated rows stay; other columns pass through, those named lang_pred or score are replaced.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specula.llm.bpe_codec import blocks, schema_with, with_columns
from specula.llm.common import table

PLACES = 4096
CLOSE = 8
SLICE = 1 << 18
#: Families of languages by ISO 639-1 code. A language not listed is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ur ne",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str) -> np.ndarray:
    """Counts of the places of all 1- to 3-grams of a text's words, edges of words included.

    Long texts are counted in slices, each with the character before it and the one behind it.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    return sum(_counts(points[k : k + SLICE + 2], k > 0) for k in range(0, max(1, len(points) - 2), SLICE))


def _counts(points: np.ndarray, goes_on: bool) -> np.ndarray:
    """Grams of all but the first and last of ``points``; pairs with the first one only where no slice before had them."""
    letter = _letters()[points]
    letter[[0, -1]] &= points[[0, -1]] > 0
    c = np.where(letter, points, 32).astype(np.uint32)
    x, y, z = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
    pairs = (x[:-1] + y[1:])[int(goes_on) :][(letter[:-1] | letter[1:])[int(goes_on) :]]
    grams = (x[1:-1][letter[1:-1]], pairs + np.uint32(7), (x[:-2] + y[1:-1] + z[2:])[letter[1:-1]] + np.uint32(13))
    return sum(np.bincount((g ^ (g >> np.uint32(15))) % np.uint32(PLACES), minlength=PLACES) for g in grams)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 200.0, rounds: int = 150) -> np.ndarray:
    """Weights and a bias of a linear machine with squared hinge loss, by accelerated gradient steps; classes weigh alike."""
    x = np.hstack([x, np.full((len(x), 1), 0.05, x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    step = 1 / (1 + 2 * weight.max() * np.linalg.norm(x, 2) ** 2)
    w = z = np.zeros(x.shape[1])
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * (weight * short * y) @ x)
        w, z = new, new + k / (k + 3) * (new - w)
    return np.append(w[:-1], w[-1] * 0.05)


def halves(codes: list[str], mean: dict[str, np.ndarray]) -> tuple[list[str], list[str]]:
    """Languages in two halves along the direction in which their means differ most."""
    m = np.array([mean[c] for c in codes])
    along = (m - m.mean(0)) @ np.linalg.svd(m - m.mean(0), full_matrices=False)[2][0]
    order = [c for _, c in sorted(zip(along.tolist(), codes, strict=True))]
    return sorted(order[: len(order) // 2]), sorted(order[len(order) // 2 :])


class Model:
    """``weights``: PLACES rows, a column for each machine; ``bias``; families and their languages, and how these are cut."""

    def __init__(self, languages: list[str], x: np.ndarray, labels: list[str]):
        self.languages = languages
        self.families: dict[str, list[str]] = {}
        for code in languages:
            self.families.setdefault(FAMILY_OF.get(code.lower()[:2], code), []).append(code)
        labels_ = np.array(labels)
        share = (x / np.maximum(1, x.sum(1, keepdims=True))).astype(np.float64) * 30
        self.machines: list[tuple] = []
        columns = []
        tasks = [(("family", f), codes, [c for c in languages if c not in codes]) for f, codes in self.families.items()] if len(self.families) > 1 else []
        self.cuts: dict[tuple, tuple[tuple, tuple]] = {}  # languages of a family or sub-family: those of its halves
        todo = [tuple(codes) for codes in self.families.values()]
        mean = {c: share[labels_ == c].mean(0) for codes in todo if len(codes) > CLOSE for c in codes}
        for codes in todo:
            if len(codes) > CLOSE:
                self.cuts[codes] = left, right = tuple(map(tuple, halves(list(codes), mean)))
                tasks.append((("cut", codes), left, right))
                todo += [left, right]
            else:
                tasks += [(("pair", a, b), [a], [b]) for a, b in combinations(codes, 2)]
        for key, these, those in tasks:
            use = np.isin(labels_, [*these, *those])
            w = fit_svm(share[use], np.where(np.isin(labels_[use], these), 1.0, -1.0))
            steep = 3 / max(1e-9, np.median(np.abs(share[use] @ w[:-1] + w[-1])))
            columns.append(np.append(w[:-1] * 30, w[-1]))
            self.machines.append((*key, steep))
        self.weights = np.array([c[:-1] for c in columns]).T.reshape(PLACES, len(columns)) if columns else np.zeros((PLACES, 0))
        self.bias = np.array([c[-1] for c in columns])

    def decide(self, sums: np.ndarray, totals: np.ndarray) -> tuple[list[str], list[float]]:
        """Languages and scores of texts with these sums of weights and counts of grams."""
        margins = sums / np.maximum(1, totals)[:, None] + self.bias
        sure = {m[:-1]: 1 / (1 + np.exp(-np.clip(m[-1] * margins[:, k], -50, 50))) for k, m in enumerate(self.machines)}
        out, scores = [], []
        for row, total in enumerate(totals):
            if not total or not self.languages:
                out.append("und")
                scores.append(0.0)
                continue
            family = max(self.families, key=lambda f: (sure[("family", f)][row] if len(self.families) > 1 else 1.0, f))
            score = float(sure[("family", family)][row]) if len(self.families) > 1 else 1.0
            codes = tuple(self.families[family])
            while codes in self.cuts:
                p = float(sure[("cut", codes)][row])
                codes, score = self.cuts[codes][p <= 0.5], score * max(p, 1 - p)
            votes = {c: [0, 0.0] for c in codes}
            for a, b in combinations(codes, 2):
                p = float(sure[("pair", a, b)][row])
                for c, q in ((a, p), (b, 1 - p)):
                    votes[c][0] += q > 0.5
                    votes[c][1] += q
            best = max(codes, key=lambda c: (*votes[c], c))
            out.append(best)
            scores.append(score * (votes[best][1] / (len(codes) - 1) if len(codes) > 1 else 1.0))
        return out, scores


def fit(labelled: DataFrame, per_language: int = 400, in_all: int = 12_800) -> Model:
    """A model of every language of rows (doc_id, text, lang) from a bounded sample of them."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("lot"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("lot").alias("n"), F.min("lot").alias("least")).collect()  # a row a language
    if not found:
        return Model([], np.zeros((0, PLACES)), [])
    each = max(1, min(per_language, in_all // len(found)))
    edges = [(r["lang"], r["least"], min(1.0, each / r["n"])) for r in found]
    drawn = labelled.sparkSession.createDataFrame(edges, "lang string, least bigint, rate double")
    lot = F.pmod(F.xxhash64("lot"), F.lit(1 << 40)) / float(1 << 40)

    def run(batches):
        for batch in blocks(batches, 100):
            x = [features(t).astype("<u4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], names=["lang", "x"])

    if len(edges) <= 10_000:
        drawn = F.broadcast(drawn)  # a row a language
    some = rows.join(drawn, "lang").where((lot < F.col("rate")) | (F.col("lot") == F.col("least"))).select("lang", "text").distinct()
    got = sorted(some.mapInArrow(run, "lang string, x binary").collect(), key=lambda r: (r["lang"], r["x"]))
    labels = [r["lang"] for r in got]
    return Model(sorted(set(labels)), np.array([np.frombuffer(r["x"], "<f4") for r in got]).reshape(-1, PLACES), labels)


def predict(docs: DataFrame, model: Model, text: str = "text", letters: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, and if asked for in column ``letters`` whether the text has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES x machines numbers, whatever the data's size

    def run(batches):
        m = shared.value
        for batch in blocks(batches, 200):
            counts = np.array([features(t or "") for t in batch.column(batch.schema.names.index(text)).to_pylist()])
            langs, scores = m.decide(counts @ m.weights, counts.sum(1))
            more = {letters: pa.array(counts.sum(1) > 0, pa.bool_())} if letters else {}
            yield with_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())} | more)

    added = {"lang_pred": T.StringType(), "score": T.DoubleType()} | ({letters: T.BooleanType()} if letters else {})
    return docs.mapInArrow(run, schema_with(docs, added))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    kept = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return predict(kept, model).select("doc_id", "held_out", "lang_pred", "score")
