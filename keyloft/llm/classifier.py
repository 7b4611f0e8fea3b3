"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of a text become about thirty numbers. Random Fourier features of the standardized numbers approximate a
Gaussian kernel, so ridge regression on them is a linear problem: every task sums the normal equations of its labelled
rows by fold, a few tasks add those sums up, and the driver solves one small system per fold. Scores of rows outside the fold they were
fitted on, counted per bin of the score, are the ground of a monotone calibration.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, map_arrow, maybe_among, table

#: Random features; width of the Gaussian kernel in standard deviations of a statistic; ridge; folds; tasks that add up the sums of all others.
FEATURES, WIDTH, RIDGE, FOLDS, SUM_TASKS = 192, 6.0, 1e-3, 4, 8
#: Bins of raw scores over [-0.5, 1.5] for calibration.
BINS = 512

_KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>=~^_@", "bar": b"|/\\", "loud": b"!?", "stop": b".", "comma": b",;:", "quote": b"'\"()[]{}-", "space": b" \t", "line": b"\r\n"}
N_STATISTICS = len(_KINDS) + 13


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics of each UTF-8 text; zeros for an empty one."""
    out = np.zeros((len(texts), N_STATISTICS), dtype=np.float32)
    kinds = np.full(256, len(_KINDS), dtype=np.uint8)
    for k, chars in enumerate(_KINDS.values()):
        kinds[list(chars)] = k
    for row, text in zip(out, texts):
        if not text:
            continue
        counts = np.bincount(kinds[np.frombuffer(text, np.uint8)], minlength=len(_KINDS) + 1)
        words = text.split()
        n = max(1, len(words))
        seen = Counter(words)
        pairs = len(set(zip(words, words[1:])))
        lines = [x for x in text.split(b"\n") if x.strip()]
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        at = len(_KINDS) + 1
        row[:at] = np.sqrt(counts / len(text))
        row[at:] = (
            np.log1p(len(text)) / 4,
            np.log1p(len(words)) / 4,
            lengths.mean() / 8 if len(words) else 0,
            lengths.std() / 8 if len(words) else 0,
            len(seen) / n,
            max(seen.values(), default=0) / n,
            pairs / max(1, len(words) - 1),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))) / 4,
            float((lengths <= 3).sum()) / n,
            float((lengths > 20).sum()) / n,
            sum(1 for w in words if w[:1].isupper()) / n,
        )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (array of float) of every row of docs."""

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = statistics([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATISTICS, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], schema=kinds)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, x array<float>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS).astype(np.float64)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int) -> np.ndarray:
    """Random Fourier features of standardized statistics, and a constant."""
    rng = np.random.RandomState(seed)
    w = rng.standard_normal((x.shape[1], features)) / width
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ w + rng.uniform(0, 2 * np.pi, features)) * np.sqrt(2 / features)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of least weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, y: the mean label of each document that may be learned from; null ids and null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    known = known.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.avg("quality").alias("y"))


class QualityModel:
    """Fitted on statistics (document_statistics) and labels (doc_id, quality); scores statistics."""

    def __init__(self, x: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS, seed: int = 11):
        """Learns from all labelled rows that are not held out; several labels of a doc_id are averaged, null ones ignored.

        Without a label every score is 0.5.
        """
        self.features, self.width, self.seed = features, width, seed
        scratch = Scratch(x.sparkSession, "quality")
        rows = x.join(learnable(labels), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int"))
        rows = scratch.save(rows, "labelled")
        stats = rows.agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(N_STATISTICS)]).alias("mean"), F.array(*[F.stddev_pop(F.get("x", F.lit(i))) for i in range(N_STATISTICS)]).alias("std")).first()
        self.weights = None
        if not stats.n:
            return
        self.mean, std = np.array(stats["mean"]), np.array(stats["std"])
        self.scale = np.where(std > 1e-6, std, 1.0)
        grams = self._normal_equations(rows, folds)
        total = sum(grams.values())
        solve = lambda g: np.linalg.solve(g[:-1, :-1] + ridge * max(1.0, g[-2, -2]) * np.eye(features + 1) / features, g[:-1, -1])
        by_fold = {f: solve(total - g) if len(grams) > 1 else solve(g) for f, g in grams.items()}
        self.weights = solve(total)
        self._calibrate(rows, by_fold)
        scratch.drop(rows)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.features, self.width, self.seed)

    def _normal_equations(self, rows: DataFrame, folds: int) -> dict[int, np.ndarray]:
        """Sums of [z y]' [z y] by fold: of each task, then of SUM_TASKS tasks that add those, then on the driver."""
        size, z_of = self.features + 2, self._z
        kinds = pa.schema([("fold", pa.int32()), ("sums", pa.binary())])

        def table_of(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"fold": list(sums), "sums": [s.tobytes() for s in sums.values()]}, schema=kinds)

        def sum_rows(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    z = np.hstack([z_of(_matrix(part.column("x"))), part.column("y").to_numpy()[:, None]])
                    fold = part.column("fold").to_numpy()
                    for f in np.unique(fold).tolist():
                        own = z[fold == f]
                        sums[f] = sums.get(f, 0) + own.T @ own
            yield table_of(sums)

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, own in zip(batch.column("fold").to_pylist(), batch.column("sums")):
                    sums[f] = sums.get(f, 0) + np.frombuffer(own.as_buffer()).reshape(size, size)
            yield table_of(sums)

        by_task = map_arrow(rows.select("x", "y", "fold"), sum_rows, "fold int, sums binary")
        out: dict[int, np.ndarray] = {}
        for r in map_arrow(by_task.repartition(SUM_TASKS), add, "fold int, sums binary").collect():  # SUM_TASKS * folds rows at most
            out[r.fold] = out.get(r.fold, 0) + np.frombuffer(r.sums).reshape(size, size)
        return out

    def _calibrate(self, rows: DataFrame, by_fold: dict[int, np.ndarray]) -> None:
        z_of = self._z

        def run(batches):
            for batch in batches:
                z, fold = z_of(_matrix(batch.column("x"))), batch.column("fold").to_numpy()
                raw = np.zeros(len(z))
                for f, w in by_fold.items():
                    raw[fold == f] = z[fold == f] @ w
                bins = np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "y": batch.column("y"), "raw": pa.array(raw)})

        found = map_arrow(rows.select("x", "y", "fold"), run, "bin int, y double, raw double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).sort("bin").collect()  # BINS rows at most
        self.knots = np.maximum.accumulate(np.array([r.raw for r in found]))
        self.levels = isotonic(np.array([r.y for r in found]), np.array([float(r.n) for r in found]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of each is the raw score, so that equal levels keep their order."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self._z(x) @ self.weights
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)

    def score(self, x: DataFrame) -> DataFrame:
        """doc_id, score of each row of statistics."""
        model = self

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.probabilities(_matrix(batch.column("x"))))})

        return map_arrow(x.select("doc_id", "x"), run, "doc_id long, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; learned from their own labelled part.

    Statistics for learning are taken of rows that may be labelled alone; all rows are scored as they pass.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = QualityModel(document_statistics(maybe_among(keyed, learnable(labels), "doc_id")[0]), labels)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = statistics([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]).astype(np.float64)
                yield part.filter(pa.array(model.probabilities(x) >= threshold))

    return map_arrow(docs, run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    The whole text decides alone; a null text scores like an empty one. Rows of null or repeated doc_ids are scored like
    others; other columns are ignored; without labels every score is 0.5; an empty table gives an empty result. Texts of any
    length are read whole, one cell at a time.
    """
    x = Scratch(docs.sparkSession, "statistics").save(document_statistics(docs), "statistics")
    rows = QualityModel(x, labels).score(x)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
