"""Language identification by nearest centroid.

A text is the vector of its character 1-, 2- and 3-grams (case-folded, digits and punctuation
taken as spaces), hashed into ``DIMENSIONS`` features, weighted by sublinear TF times IDF and
normalised. Each language has several centroids, found by spherical k-means; a text takes the
language of the centroid of greatest cosine. It is rejected when that cosine is below the floor of
that language and the text's length: ``FLOOR_SHARE`` of a low quantile of the cosines among
training texts of the language that are about as long, so no single odd text sets it. Short texts
score lower; under the lengths that training texts have, the floor falls with the root of the length.

Document frequencies are taken over all training texts. The centroids are fitted on a bounded,
documented sample: for each language the ``per_language`` texts of least id hash.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; ties
go to the language that sorts first; texts with a null language are scored but not learned from;
without any training text everything is ``und``; a null ``doc_id`` is scored and not learned from;
repeated rows are each scored; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.hashing import mix
from sparquill.llm.memory import releasing

DIMENSIONS = 4096
PER_LANGUAGE = 400
CLUSTERS = 4
FLOOR_SHARE, FLOOR_QUANTILE = 0.5, 0.05
FLOOR_TEXTS = 20  # texts that a floor is taken from, where the language has as many
LENGTHS = 32  # floors a language, one for each factor of two in length
MAX_LANGUAGES = 1000
MERGERS = 8
ROWS = 256
UNDETERMINED = "und"

_BREAK = {c: " " for c in range(0x80) if not chr(c).isalpha()}


def codes(text: str) -> np.ndarray:
    """Code points of the case-folded text; runs of other ASCII characters than letters are one space."""
    plain = " " + " ".join(text.translate(_BREAK).lower().split()) + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Feature counts, one row a text."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        c = codes(text).astype(np.uint64)
        if len(c) < 3:
            continue
        two = c[:-1] << np.uint64(21) | c[1:]
        grams = np.concatenate((c, two, (two[:-1] << np.uint64(21)) ^ c[2:] ^ np.uint64(1 << 63)))
        row += np.bincount((mix(grams) >> np.uint64(20)).astype(np.int64) % dimensions, minlength=dimensions)
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, started from texts far from each other; fewer if there are fewer texts."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack((centres, x[np.argmin((x @ centres.T).max(axis=1))][None]))
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def length_class(tf: np.ndarray) -> np.ndarray:
    """Logarithm of the length of texts, from their feature counts: a text of n code points has 3n - 3 features."""
    return np.log2(np.maximum(tf.sum(axis=1, dtype=np.float64) / 3, 1)).astype(np.int64)


def length_floors(cosine: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Least cosine for each length class, from training texts at most one class away."""
    near = [cosine[np.abs(length - k) <= 1] for k in range(LENGTHS)]
    enough = min(FLOOR_TEXTS, max(map(len, near)))
    usable = np.array([k for k in range(LENGTHS) if len(near[k]) >= enough])
    out = np.zeros(LENGTHS)
    for k in range(LENGTHS):
        source = usable[np.abs(usable - k).argmin()]
        out[k] = FLOOR_SHARE * np.quantile(near[source], FLOOR_QUANTILE) * 2.0 ** (min(k - source, 0) / 2)
    return out


def fit(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS) -> dict:
    """Centroids, their languages and floors, and IDF, from the rows of ``docs(doc_id, text, lang)`` where ``training`` holds."""
    usable = docs.filter(training & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the column is no language label")
    # An id hash below this share of its range is a candidate: about twice the bound for each language, and no sort of all rows.
    share = {k: min(1.0, (2 * per_language + 50) / n) for k, n in sizes.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, df, chosen = 0, np.zeros(dimensions, np.int64), {}
        for batch in batches:
            ids, langs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            order = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.int64)
            for at in range(0, len(ids), ROWS):
                tf = counts(batch.column(2)[at : at + ROWS].to_pylist(), dimensions)
                df += (tf > 0).sum(axis=0)
                seen += len(tf)
                for i, row in enumerate(tf, at):
                    if order[i] < share[langs[i]] * 2**53 and row.any():
                        chosen.setdefault(langs[i], []).append((int(order[i]), row))
                for lang, some in chosen.items():
                    chosen[lang] = sorted(some, key=lambda p: p[0])[:per_language]
        rows = [(None, -1, df.astype(np.float64), seen)] if seen else []
        rows += [(lang, key, row.astype(np.float64), 1) for lang, some in chosen.items() for key, row in some]
        for lang, key, row, n in rows:
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([key], pa.int64()), pa.array([used.astype(np.int32).tobytes()]), pa.array([row[used].tobytes()]), pa.array([n], pa.int64())], names=["lang", "key", "at", "n", "seen"])

    schema = "lang string, key long, at binary, n binary, seen long"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(dimensions), 0
        for batch in batches:
            is_count = np.array([x is None for x in batch.column(0).to_pylist()], bool)
            for r in batch.filter(pa.array(is_count)).to_pylist():
                df[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.float64)
                seen += r["seen"]
            yield batch.filter(pa.array(~is_count))
        if seen:
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_pylist([{"lang": None, "key": -1, "at": used.astype(np.int32).tobytes(), "n": df[used].tobytes(), "seen": seen}], pa.schema([("lang", pa.string()), ("key", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("seen", pa.int64())]))

    df, seen, sample = np.zeros(dimensions), 0, {}
    # The driver gets MERGERS rows of counts, and of each language about twice the bound of samples.
    for r in usable.mapInArrow(scan, schema).repartition(MERGERS).mapInArrow(merged, schema).collect():
        at, values = np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float64)
        if r.lang is None:
            df[at] += values
            seen += r.seen
        else:
            sample.setdefault(r.lang, []).append((r.key, at, values.astype(np.float32)))
    idf = np.log((1 + seen) / (1 + df)).astype(np.float32) + np.float32(1)
    names, centres, floors = [], [], []
    for lang in sorted(sample):
        some = sorted(sample[lang], key=lambda p: (p[0], len(p[1])))[:per_language]
        tf = np.zeros((len(some), dimensions), np.float32)
        for row, (_, at, values) in zip(tf, some, strict=True):
            row[at] = values
        x = weighted(tf, idf)
        own = clustered(x, clusters)
        names += [lang] * len(own)
        centres.append(own)
        floors += [length_floors((x @ own.T).max(axis=1), length_class(tf))] * len(own)
    return {"langs": names, "centres": np.vstack(centres).astype(np.float32) if centres else np.zeros((0, dimensions), np.float32), "floors": np.array(floors).reshape(-1, LENGTHS), "idf": idf}


def identify(docs: DataFrame, model: dict, *carried: str) -> DataFrame:
    """``doc_id`` and the ``carried`` columns with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``, for ``docs(doc_id, text, ...)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is a parameter: centroids times dimensions
    schema = docs.select("doc_id", *carried).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dimensions = len(m["idf"])
        centres, floors, langs = m["centres"].T, m["floors"], np.array(m["langs"], object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(0).to_pylist()]
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                if len(langs):
                    tf = counts(texts, dimensions)
                    cosine = weighted(tf, m["idf"]) @ centres
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
                    known, far = langs[best], score < floors[best, length_class(tf)]
                else:
                    known, score, far = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
                known, score, far = np.where(lettered, known, UNDETERMINED), np.where(lettered, score, 0.0), far | ~lettered
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(known, pa.string()), pa.array(score), pa.array(far)], names=schema.names)

    return docs.select(F.col("text").alias("__text"), "doc_id", *carried).mapInArrow(releasing(run), schema)

