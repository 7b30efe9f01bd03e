"""Language identification with hyperdimensional profiles (operator 6).

Every letter has a random vector of +1 and -1. A letter at place ``p`` of an n-gram is its vector
rotated ``p`` times; the n-gram is the product of its rotated letters (binding), and a text is the
sum of its n-grams (bundling). A language's prototype is the bundle of all its training texts. A
text gets the language whose prototype has the largest cosine with it; the cosine is the score.

Letters are lower-cased, everything else is one space between words. Letters outside a-z share a
fixed number of vectors by code point, so the n-gram space is bounded. Bundling is a sum, so a task
counts n-grams first and binds each once.

Cases: a text that is null or without a letter is ``und`` with score 0; so is every text when there
is nothing to learn from; texts of one letter are padded with spaces; of equal cosines the
alphabetically first language wins; rows may repeat; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import free_name, read_table, slices

UNKNOWN = "und"
DIMENSIONS = 512
ORDER = 3
SEED = 5
# Vectors in use: the space, a to z, and the slots that other letters share.
SYMBOLS = 64
HELD_OUT = 2
# Languages that a task counts at a time, and rows that go back at a time.
LANGS_COUNTED = 64
OUTPUT_ROWS = 1_000

_PLANE = 0x10000


def _symbol_table() -> np.ndarray:
    """Symbol of every code point of the first plane; 0 is the space."""
    table = np.zeros(_PLANE, np.uint8)
    for code in range(_PLANE):
        if 0xD800 <= code < 0xE000:
            continue
        lower = chr(code).lower()
        if lower[0].isalpha():
            point = ord(lower[0])
            table[code] = point - 96 if 97 <= point <= 122 else 27 + point % (SYMBOLS - 27)
    return table


class Profiles:
    """Letter vectors and the n-grams of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        signs = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
        self.dimensions = dimensions
        self._places = [np.roll(signs, place, axis=1) for place in range(ORDER)]
        # The first two letters bound, one row per pair of symbols.
        first, second = self._places[0], self._places[1]
        self._pairs = (first[:, None, :] * second[None, :, :]).reshape(SYMBOLS**2, dimensions)
        self._symbols = _symbol_table()

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the text's n-grams; none if it has no letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self._symbols[np.minimum(codes, _PLANE - 1)]
        beyond = np.flatnonzero(codes >= _PLANE)
        for at in beyond:
            point = int(codes[at])
            symbols[at] = 27 + point % (SYMBOLS - 27) if chr(point).isalpha() else 0
        letters = symbols > 0
        if not letters.any():
            return np.zeros(0, np.int64)
        # A space on both sides; of white space in a row the first is kept.
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        line = np.zeros(int(keep.sum()) + 2, np.int64)
        line[1:-1] = symbols[keep]
        return (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the bound vectors of n-grams, each ``counts`` times."""
        total = np.zeros(self.dimensions, np.float64)
        for start in range(0, grams.size, 4096):
            part = grams[start : start + 4096]
            bound = self._pairs[part // SYMBOLS] * self._places[2][part % SYMBOLS]
            total += counts[start : start + 4096].astype(np.float32) @ bound.astype(np.float32)
        return total


_profiles: dict[tuple[int, int], Profiles] = {}


def _shared(dimensions: int, seed: int) -> Profiles:
    if (dimensions, seed) not in _profiles:
        _profiles[dimensions, seed] = Profiles(dimensions, seed)
    return _profiles[dimensions, seed]


def learn(
    labelled: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> dict[str, np.ndarray]:
    """Prototype of each language, from all rows with a text and a language.

    A task sends one vector per language it has seen; the driver gets one vector of ``dimensions``
    numbers per language.
    """
    rows = labelled.select(
        F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _shared(dimensions, seed)
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, cells in counts.items():
                grams = np.flatnonzero(cells)
                if grams.size:
                    total = np.rint(profiles.bundle(grams, cells[grams])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([total], pa.list_(pa.int64()))], ["lang", "part"]
                    )
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                if lang not in counts:
                    if len(counts) >= LANGS_COUNTED:
                        yield from flush()
                    counts[lang] = np.zeros(SYMBOLS**ORDER, np.int64)
                np.add.at(counts[lang], profiles.grams(text.as_py()), 1)
        yield from flush()

    parts = rows.mapInArrow(count, "lang string, part array<bigint>")
    sums = (
        parts.select("lang", F.posexplode("part").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("profile"))
    )
    return {
        row["lang"]: np.array([item["value"] for item in row["profile"]], np.float64)
        for row in sums.collect()
    }


def predict(
    df: DataFrame,
    prototypes: dict[str, np.ndarray],
    keep: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    rows = df.select(*keep, F.col(text_column).cast("string").alias(free_name(df, "text_")))
    names = list(keep)
    judge = _judge(prototypes, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, OUTPUT_ROWS):
            found, scores = judge(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in names)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def keep_known(
    df: DataFrame,
    prototypes: dict[str, np.ndarray],
    text_column: str = "text",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """Rows in which a language is found, with their own columns. Each text moves once each way."""
    place = df.columns.index(text_column)
    judge = _judge(prototypes, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, OUTPUT_ROWS):
            found, _ = judge(batch.column(place))
            yield batch.filter(pa.array([lang != UNKNOWN for lang in found]))

    return df.mapInArrow(run, df.schema)


def _judge(
    prototypes: dict[str, np.ndarray], dimensions: int, seed: int
) -> Callable[[pa.Array], tuple[list[str], list[float]]]:
    """Function from texts to their languages and scores."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[lang] for lang in langs]).reshape(len(langs), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1)

    def judge(texts: pa.Array) -> tuple[list[str], list[float]]:
        profiles = _shared(dimensions, seed)
        found, scores = [], []
        for value in texts:
            text = value.as_py()
            grams = profiles.grams(text) if text else np.zeros(0, np.int64)
            best, score = UNKNOWN, 0.0
            if grams.size and langs:
                bundle = profiles.bundle(*np.unique(grams, return_counts=True))
                length = np.linalg.norm(bundle)
                cosines = matrix @ bundle / (length if length > 0 else 1.0)
                at = int(np.argmax(cosines))
                best, score = langs[at], float(min(max(cosines[at], 0.0), 1.0))
            found.append(best)
            scores.append(score)
        return found, scores

    return judge


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out from learning; a null id is not."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == HELD_OUT


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = learn(documents.where(~held_out(F.col("doc_id"))))
    marked = documents.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(marked, prototypes, keep=("doc_id", "held_out"))
