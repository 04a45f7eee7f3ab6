"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside the family.

Features are relative frequencies of hashed character 1- to 3-grams of the whole lower-cased text, non-letters as
blanks. The models are trained here, on at most ``per_language`` labelled rows a language (a documented bound;
the rows with the least hash of their id, so any order of the input gives the same models). Prediction is one pass
over all rows: a count of features and a product with a handful of weight vectors.

Cases: a null, empty or letterless text gets language and family ``und`` with margins 0; rows with a null label are
predicted but not learned from; with a single known language everything with letters is that language; ties of votes
go to the larger sum of margins, then to the first name; repeated rows are predicted alike; an empty table gives an
empty result, a table without any labels makes every row ``und``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

FAMILIES: dict[str, tuple[str, ...]] = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk"),
}
DIM = 2048
PER_LANGUAGE = 400
#: Feature vectors are dense, so this many rows at a time bound their memory (6 MB), however short the texts.
SLICE_ROWS = 256
_KEYS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UND = "und"


def frequencies(cp: np.ndarray, off: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 3 * dim) relative frequencies, and the number of letters of each text."""
    n = len(off) - 1
    letter = (cp >= 128) | ((cp >= 97) & (cp <= 122))
    c = np.where(letter, cp, 32).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, 3 * dim), np.float32)
    h = np.zeros(len(c), np.uint32)
    for k in range(3):
        if len(c) <= k:
            break
        h = h[: len(c) - k] * np.uint32(_KEYS[2]) + c[k:] * np.uint32(_KEYS[0]) + np.uint32(k)
        same = doc[: len(c) - k] == doc[k:]
        b = (((h ^ (h >> np.uint32(15))) * np.uint32(_KEYS[1])) >> np.uint32(16)) % np.uint32(dim)
        cell = doc[: len(c) - k] * dim + b
        count = np.bincount(cell[same], minlength=n * dim).reshape(n, dim)
        out[:, k * dim : (k + 1) * dim] = count / np.maximum(1, count.sum(axis=1, keepdims=True))
    return out, np.bincount(doc[letter], minlength=n)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, reg: float = 1e-3) -> np.ndarray:
    """Weights (last: bias) of a linear SVM by subgradient descent on the mean hinge loss, averaged; y is +-1."""
    # classes weigh alike whatever their sizes
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w = np.zeros(x.shape[1])
    mean = np.zeros_like(w)
    for t in range(1, rounds + 1):
        short = (x @ w) * y < 1
        grad = reg * w - x[short].T @ (weight[short] * y[short])
        w = w - grad / (reg * (t + 20))
        mean += (w - mean) * (2 / (t + 1))
    return mean


def train(
    docs: DataFrame,
    families: Mapping[str, Sequence[str]] = FAMILIES,
    per_language: int = PER_LANGUAGE,
    dim: int = DIM,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
) -> dict:
    """The models, from a bounded sample of labelled rows; features are counted on the executors."""
    of = {lang: fam for fam, langs in families.items() for lang in langs}
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1))
    counts = {
        r["lang"]: r["n"]
        for r in docs.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    rows: list[tuple[str, bytes]] = []
    if counts:
        pairs = [
            v for lang, n in counts.items() for v in (F.lit(lang), F.lit(int(min(1.0, 1.5 * per_language / n + 50 / n) * (1 << 30))))
        ]
        some = docs.select(
            F.col(label_col).alias("lang"), key.alias("key"), F.lower(F.col(text_col)).alias("text")
        ).filter(F.col("lang").isNotNull() & (F.col("key") <= F.element_at(F.create_map(*pairs), F.col("lang"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in C.slices(whole, 2, rows=SLICE_ROWS):
                    x, letters = frequencies(*C.codes(b.column(2)), dim)
                    vec = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], names=["lang", "key", "x"]).filter(
                        pa.array(letters > 0)
                    )

        got = some.mapInArrow(run, "lang string, key long, x binary").orderBy("key", "lang", "x").limit(
            2 * per_language * len(counts)
        )
        seen: dict[str, int] = {}
        for r in got.collect():  # at most 2 * per_language rows a language
            if seen.setdefault(r["lang"], 0) < per_language:
                seen[r["lang"]] += 1
                rows.append((r["lang"], r["x"]))
    names = np.array([r[0] for r in rows], object)
    x = np.array([np.frombuffer(r[1], np.float16) for r in rows], np.float64).reshape(len(rows), 3 * dim)
    # frequencies are small and uneven: each feature is scaled by its spread, folded into the weights afterwards
    scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(3 * dim) if len(rows) else np.ones(3 * dim)
    fam = np.array([of.get(v, v) for v in names], object)

    def duels(kinds: np.ndarray, rows: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
        out = []
        for a, b in combinations(sorted(set(kinds[rows])), 2):
            on = rows & ((kinds == a) | (kinds == b))
            w = svm(x[on] * scale, np.where(kinds[on] == a, 1.0, -1.0))
            out.append((a, b, np.concatenate([w[:-1] * scale, w[-1:]])))
        return out

    every = np.ones(len(rows), bool)
    return {
        "dim": dim,
        "families": {f: sorted(set(names[fam == f])) for f in sorted(set(fam))},
        "top": duels(fam, every),
        "inner": {f: duels(names, fam == f) for f in sorted(set(fam))},
    }


def _vote(x: np.ndarray, kinds: Sequence[str], duels) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row by votes, then margins; and the winner's mean margin."""
    place = {k: i for i, k in enumerate(kinds)}
    votes, sums = np.zeros((len(x), len(kinds))), np.zeros((len(x), len(kinds)))
    for a, b, w in duels:
        m = x @ w[:-1] + w[-1]
        for k, s in ((a, m), (b, -m)):
            votes[:, place[k]] += s > 0
            sums[:, place[k]] += s
    won = np.argmax(votes + 0.4999 * np.tanh(sums), axis=1)
    return won, sums[np.arange(len(x)), won] / max(1, len(kinds) - 1)


def classify(cp: np.ndarray, off: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    x, letters = frequencies(cp, off, model["dim"])
    n = len(off) - 1
    lang, fam = np.full(n, UND, object), np.full(n, UND, object)
    top_margin, inner_margin = np.zeros(n), np.zeros(n)
    fams = list(model["families"])
    ok = letters > 0
    if fams and ok.any():
        won, margin = _vote(x, fams, model["top"])
        for i, f in enumerate(fams):
            rows = ok & (won == i)
            if rows.any():
                kinds = model["families"][f]
                k, inner = _vote(x[rows], kinds, model["inner"][f])
                fam[rows], lang[rows] = f, np.array(kinds, object)[k]
                top_margin[rows], inner_margin[rows] = margin[rows], inner
    return {"family": fam, "language": lang, "family_margin": top_margin, "language_margin": inner_margin}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, language, family_margin, language_margin) of every row."""
    read = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    names = ["id", "family", "language", "family_margin", "language_margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, 1, rows=SLICE_ROWS):
                got = classify(*C.codes(b.column(1)), model)
                cols = [pa.array(got[c], pa.string() if i < 2 else pa.float64()) for i, c in enumerate(names[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return read.mapInArrow(
        run, f"id {kind}, family string, language string, family_margin double, language_margin double"
    ).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **how) -> DataFrame:
    """Train on the labelled rows and predict all."""
    return predict(docs, train(docs, id_col=id_col, text_col=text_col, label_col=label_col, **how), id_col, text_col)
