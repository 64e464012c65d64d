"""Quality classifier by compression.

Zstandard dictionaries are built from pieces of good and of bad labelled
texts.  A text is compressed piece by piece with each of them; what the good
dictionary saves against the bad one, a byte of text, is the feature, and a
logistic curve fitted on other labelled texts turns it into a score.

The fit uses a bounded sample (``SAMPLE_PIECES`` pieces of ``SAMPLE_DOCS`` rows
a class for the dictionaries, ``SAMPLE_ROWS`` rows for the curve), chosen by
hash, so neither what is sent to the executors nor what comes to the driver
grows with the data.  Scoring reads whole texts, a
piece at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.shared import materialize, pick, ship_code

SAMPLE_PIECES = 6000
SAMPLE_PIECE_CHARS = 1024
SAMPLE_ROWS = 8000
SAMPLE_DOCS = 3000
DICTIONARY_BYTES = 500_000
LEVEL = 3
#: Bytes that are compressed together: short, so that a repeated phrase can't hide in its own history.
PIECE_BYTES = 128
#: A text gets so many bytes of an average good one, so that a few words of evidence don't reject it.
PRIOR_BYTES = 64
THRESHOLD = 0.7
FOLDS, HELD_OUT, CURVE_FOLD = 4, 2, 3


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the curve; without both classes only ``constant``."""

    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    constant: float | None = None


def _dictionary(pieces: list[bytes], size: int):
    import zstandard

    if sum(map(len, pieces)) > 4 * size:
        try:
            return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too few or too uniform pieces to train on
    return b"".join(pieces)[-size:]


class _Sizes:
    """Compressed sizes of texts by the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.by = []
        for raw in (good, bad):
            trained = raw[:4] == b"\x37\xa4\x30\xec"  # the magic number of trained dictionaries
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def saved(self, text: bytes) -> int:
        """Bytes that the good dictionary saves against the bad one."""
        good, bad = self.by
        total = 0
        for i in range(0, len(text), PIECE_BYTES):
            piece = text[i : i + PIECE_BYTES]
            total += len(bad(piece)) - len(good(piece))
        return total


_made: dict[tuple[int, int], _Sizes] = {}


def _sizes(good: bytes, bad: bytes) -> _Sizes:
    key = hash(good), hash(bad)
    if key not in _made:
        _made.clear()
        _made[key] = _Sizes(good, bad)
    return _made[key]


def saved_bytes(text: Column, good: bytes, bad: bytes) -> Column:
    """Bytes that the good dictionary saves against the bad one; 0 for null and empty texts."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = _sizes(good, bad)
        for column in batches:
            body, off = flat.flat(column)
            raw = memoryview(body)
            yield pa.array([tool.saved(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.int64())

    return run(text)


def _rate(saved: Column, text: Column, prior: float) -> Column:
    return (saved + F.lit(prior * PRIOR_BYTES)) / (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(PRIOR_BYTES))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on labelled rows outside the held-out fold.

    Of rows that repeat an id in ``labels`` the largest label counts; null ids
    and labels are left out.  Without both labels the model is a constant: the
    share of label 1, or 1.0 without any label.
    """
    ship_code(docs.sparkSession)
    known = pick(labels, id=id_col, label=label_col).dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("curve", fold(F.col("id")) == CURVE_FOLD).filter(fold(F.col("id")) != HELD_OUT)

    def some(condition, most: int) -> DataFrame:
        return known.filter(condition).orderBy(F.xxhash64("id"), "id").limit(most)

    # a bounded list of ids, so the texts stay where they are
    chosen = some("NOT curve AND label = 1", SAMPLE_DOCS).union(some("NOT curve AND label = 0", SAMPLE_DOCS)).union(some("curve", SAMPLE_ROWS))
    chosen = materialize(chosen, "quality-sample")
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "label", "curve")
    n_pieces = F.ceil(F.length("text") / F.lit(SAMPLE_PIECE_CHARS)).cast("int")
    pieces = (
        rows.filter("NOT curve")
        .withColumn("k", F.explode(F.when(n_pieces > 0, F.sequence(F.lit(0), n_pieces - 1))))
        .select("label", "doc_id", "k", F.col("text").substr(F.col("k") * SAMPLE_PIECE_CHARS + 1, F.lit(SAMPLE_PIECE_CHARS)).alias("piece"))
    )

    def sample(label: int) -> list[bytes]:
        most = pieces.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", "k"), "piece").limit(SAMPLE_PIECES)
        return [r[0].encode() for r in most.select("piece").collect()]

    good, bad = sample(1), sample(0)
    if not good or not bad:
        n, ones = rows.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("double"))).first()
        return QualityModel(constant=float(ones) / n if n else 1.0)
    good, bad = _dictionary(good, DICTIONARY_BYTES), _dictionary(bad, DICTIONARY_BYTES)
    curve = rows.filter("curve").select("label", "text").limit(SAMPLE_ROWS)
    got = curve.select("label", saved_bytes(F.col("text"), good, bad).alias("saved"), F.octet_length("text").alias("size")).collect()
    y = np.array([r["label"] for r in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return QualityModel(constant=float(y.mean()) if len(y) else 1.0)
    saved, size = (np.array([r[c] for r in got], dtype=float) for c in ("saved", "size"))
    prior = float(saved[y == 1].sum() / max(size[y == 1].sum(), 1.0))
    slope, shift = _logistic((saved + prior * PRIOR_BYTES) / (size + PRIOR_BYTES), y)
    return QualityModel(good, bad, prior, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with a weak pull to 0."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1 of a text; a null text counts as empty, and an empty one has an average good text's score."""
    if model.constant is not None:
        return F.lit(float(model.constant))
    z = F.lit(model.slope) * _rate(saved_bytes(text, model.good, model.bad), text, model.prior) + F.lit(model.shift)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null id is in no fold (held_out false).  Repeated rows get equal scores;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    scored = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), quality_score(F.col("text").cast("string"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
