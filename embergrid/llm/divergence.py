"""Source divergence audit (operator 12): how far the sources of a language stray in their terms.

1. Tasks find the terms of whole texts in the bytes of an Arrow column. Terms are bucketed by length.
   One of up to 16 bytes is packed into one or two uint64 words, whose order is the bytes' order;
   longer ones keep their bytes, in buckets of doubling width. Words are sorted by radix, 16 bits at
   a time, longer terms by their bytes, and runs give counts per term, group and document.
2. A task adds up its runs before it passes them on, so a term of most documents moves once or a few
   times per task and group. Spark adds up the tasks' rows and keeps terms of enough documents.
3. Kept terms come with their counts by source. A task scores them against all sources of their
   language in integers; for pairs it only adds what differs from "in neither source", which is known
   per pair, so a term costs its non-zero sources times all sources.

A document is a row; a group is a (language, source). Tables of a size are: groups with their totals,
which the driver and every task hold. They are the square root of the pair rows that are the result.

Cases: null text, language and source count as empty; groups without terms take part; a language
without kept terms has pairs of value 0 and no term rows; null, shared ids and repeated rows are
documents like others; texts and terms of any length are read whole; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, runs_inside, shuffle_partitions, staged, text_slices

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

# Bytes of text that are split at a time, and runs that a task adds up before it passes them on.
SLICE_BYTES = 4 << 20
HELD_RUNS = 1_000_000
# Cells (terms or non-zero counts times sources) that are scored at a time, and pair cells that a task
# holds.
SCORED_CELLS = 500_000
HELD_CELLS = 4_000_000

_WORD = 8
_PACKED = 2 * _WORD

_PARTIAL = "lang string, source string, term binary, n bigint, docs bigint"
_SCORES = "lang string, source string, part string, item binary, value bigint"

# A term's bytes: ASCII letters, lower-cased, and every byte of a character outside ASCII.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def term_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, and start, length and document of each term.

    Bytes that belong to no term are 0. ``offsets`` are the documents' ends as in Arrow; a term never
    goes over one.
    """
    low = _LOWER[data]
    return low, *runs_inside(low != 0, offsets)


def _bucket(lengths: np.ndarray) -> np.ndarray:
    """Bucket of each length, as its number of bytes: even up to 16, above that doubling."""
    width = lengths + (lengths & 1)
    long = lengths > _PACKED
    if long.any():
        width[long] = 1 << np.ceil(np.log2(lengths[long])).astype(np.int64)
        width[long] *= 1 + (width[long] < lengths[long])
    return width


def _packed(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Keys of a bucket: columns of uint64 words, or one column of byte strings for long terms."""
    size = width if width > _PACKED else -(-width // _WORD) * _WORD
    low = np.concatenate([low, np.zeros(size, np.uint8)])
    cells = np.lib.stride_tricks.sliding_window_view(low, size)[starts]
    cells[np.arange(size) >= lengths[:, None]] = 0
    if width > _PACKED:
        return cells.view(f"S{size}")
    return cells.view(">u8").astype(np.uint64)


def _unpacked(keys: np.ndarray) -> pa.Array:
    """Terms of packed keys, as bytes."""
    if keys.dtype == np.uint64:
        keys = keys.astype(">u8")
    cells = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1)
    used = cells != 0
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    data = pa.py_buffer(cells[used].tobytes())
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(keys), [None, pa.py_buffer(ends.astype(np.int64)), data]
    ).cast(pa.binary())


def _order(keys: np.ndarray, width: int, group: np.ndarray) -> np.ndarray:
    """Stable order by key, then group. Words are sorted by radix: numpy's stable sort of 16 bits."""
    order = np.arange(len(keys))

    def radix(column: np.ndarray, bits: int, start: int = 0) -> None:
        nonlocal order
        for shift in range(start, bits, 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)[order]
            order = order[np.argsort(digit, kind="stable")]

    radix(group.astype(np.uint64), max(1, int(group.max(initial=0)).bit_length()))
    if keys.dtype != np.uint64:
        return order[np.argsort(keys[order, 0], kind="stable")]
    for column in range(keys.shape[1] - 1, -1, -1):
        used = min(_WORD, width - column * _WORD)
        radix(keys[:, column], 64, 64 - 8 * used)
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if new.size:
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
    return new


@dataclass
class RunCounter:
    """Runs of a task: per bucket, keys with their group, occurrences and documents."""

    groups: dict[tuple[str, str], int] = field(default_factory=dict)
    runs: dict[int, list[tuple[np.ndarray, ...]]] = field(default_factory=dict)
    held: int = 0

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        """Counts the terms of documents."""
        ids = [self.groups.setdefault(pair, len(self.groups)) for pair in zip(langs, sources)]
        group_of = np.array(ids, np.int64)
        low, starts, lengths, documents = term_places(data, offsets)
        widths = _bucket(lengths)
        for width in np.unique(widths).tolist():
            chosen = widths == width
            keys = _packed(low, starts[chosen], lengths[chosen], width)
            doc = documents[chosen]
            group = group_of[doc]
            order = _order(keys, width, group)
            keys, group, doc = keys[order], group[order], doc[order]
            new = _changes(*keys.T, group)
            # Documents rise within a key and group, as the sort is stable.
            new_doc = new | _changes(doc)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(keys)))
            self._hold(width, keys[at], group[at], n, np.add.reduceat(new_doc.astype(np.int64), at))

    def _hold(self, width: int, *columns: np.ndarray) -> None:
        self.runs.setdefault(width, []).append(columns)
        self.held += len(columns[0])

    def combine(self) -> None:
        """Adds up equal runs."""
        for width, parts in self.runs.items():
            keys, group, n, docs = (np.concatenate(columns) for columns in zip(*parts))
            order = _order(keys, width, group)
            keys, group, n, docs = keys[order], group[order], n[order], docs[order]
            at = np.flatnonzero(_changes(*keys.T, group))
            self.held += at.size - len(keys)
            self.runs[width] = [(keys[at], group[at], np.add.reduceat(n, at), np.add.reduceat(docs, at))]

    def take(self) -> Iterator[pa.RecordBatch]:
        """All rows; nothing is held after that. A row without a term marks each group."""
        langs = pa.array([pair[0] for pair in self.groups], pa.string())
        sources = pa.array([pair[1] for pair in self.groups], pa.string())
        zeros = pa.array(np.zeros(len(langs), np.int64))
        marks = pa.array([b""] * len(langs), pa.binary())
        names = ["lang", "source", "term", "n", "docs"]
        yield pa.RecordBatch.from_arrays([langs, sources, marks, zeros, zeros], names)
        for parts in self.runs.values():
            for keys, group, n, docs in parts:
                # Pieces whose bytes fit an Arrow column, whatever the width.
                step = max(1, min(100_000, (64 << 20) // max(1, keys[:1].nbytes)))
                for start in range(0, len(keys), step):
                    piece = slice(start, start + step)
                    index = pa.array(group[piece])
                    columns = [langs.take(index), sources.take(index), _unpacked(keys[piece])]
                    columns += [pa.array(n[piece]), pa.array(docs[piece])]
                    yield pa.RecordBatch.from_arrays(columns, names)
        self.groups, self.runs, self.held = {}, {}, 0


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of every group and term, and of every group without a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, full = RunCounter(), HELD_RUNS
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                counter.add(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), data, offsets)
                if counter.held > full:
                    counter.combine()
                    # What stays may double before it is added up again; more is passed on.
                    full = 2 * counter.held
                    if counter.held > HELD_RUNS:
                        yield from counter.take()
                        full = HELD_RUNS
        counter.combine()
        yield from counter.take()

    partial = docs.mapInArrow(counted, _PARTIAL)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)``, exact: three decimal digits at a time."""
    rest, value = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1_000, total)
        value = value * 1_000 + digits
    return value + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) ** 2 / q)``; both are at most 1e9 + 1, so the square fits."""
    gap = p - q
    return gap * gap // q


@dataclass
class Language:
    """Sources of a language with their totals over kept terms, the number of terms as ``terms``."""

    sources: list[str]
    totals: np.ndarray
    terms: int

    def __post_init__(self) -> None:
        self.places = pa.array(self.sources, pa.string())
        # As a sum in whole numbers; the language's own total is the sources'.
        self.sizes = self.totals + self.terms
        self.size = int(self.totals.sum()) + self.terms
        if self.terms:
            self.absent = probability(np.zeros(len(self.sources), np.int64), self.sizes)

    def neither(self, source: int | np.ndarray) -> np.ndarray:
        """Value that a term in neither source adds, towards every source."""
        return divergence(np.asarray(self.absent[source])[..., None], self.absent)


class Scores:
    """Scores of a task for one language: pair corrections by source, and the best terms."""

    def __init__(self, language: Language, top: int) -> None:
        self.language, self.top = language, top
        self.pairs: dict[int, np.ndarray] = {}
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in language.sources]
        self.least = np.zeros(len(language.sources), np.int64)

    def add(self, terms: pa.Array, row: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Scores terms; ``row, source, n`` list their non-zero counts."""
        words = self.language
        counts = np.zeros((len(terms), len(words.sources)), np.int64)
        counts[row, source] = n
        p = np.broadcast_to(words.absent, counts.shape).copy()
        p[row, source] = probability(n, words.sizes[source])
        step = max(1, SCORED_CELLS // len(words.sources))
        for start in range(0, row.size, step):
            at, one = row[start : start + step], source[start : start + step]
            own = p[at, one]
            # From a source with the term to all others, and from sources without it to this one.
            self._pair(one, divergence(own[:, None], p[at]) - words.neither(one), False)
            without = divergence(words.absent[None, :], own[:, None])
            without -= divergence(words.absent[None, :], words.absent[one][:, None])
            without[counts[at] > 0] = 0
            self._pair(one, without, True)
        own = p[row, source]
        whole = probability(counts.sum(axis=1), np.int64(words.size))[row]
        value = divergence(own, whole)
        for at in np.flatnonzero((own > whole) & (value >= self.least[source])).tolist():
            best = self.best[source[at]]
            best.append((-int(value[at]), terms[int(row[at])].as_py()))
            if len(best) >= 10 * self.top:
                self._prune(int(source[at]))

    def _pair(self, source: np.ndarray, cells: np.ndarray, towards: bool) -> None:
        """Adds cells of each source: a row of values from it, or towards it."""
        order = np.argsort(source, kind="stable")
        at = np.flatnonzero(_changes(source[order]))
        sums = np.add.reduceat(cells[order], at, axis=0)
        for number, values in zip(source[order][at].tolist(), sums):
            key = ~number if towards else number
            if key in self.pairs:
                self.pairs[key] += values
            else:
                self.pairs[key] = values.copy()

    def _prune(self, source: int) -> None:
        best = heapq.nsmallest(self.top, self.best[source])
        self.best[source] = best
        if len(best) == self.top:
            self.least[source] = -best[-1][0]

    def cells(self) -> int:
        return len(self.pairs) * len(self.language.sources)

    def take_pairs(self, lang: str) -> Iterator[pa.RecordBatch]:
        names = self.language.places
        for key, values in self.pairs.items():
            number, towards = (~key, True) if key < 0 else (key, False)
            others = np.flatnonzero((values != 0) & (np.arange(len(values)) != number))
            one = pa.array([self.language.sources[number]] * others.size, pa.string())
            other = names.take(pa.array(others))
            source, item = (other, one) if towards else (one, other)
            yield _rows(lang, source, "pair", item.cast(pa.binary()), values[others])
        self.pairs = {}

    def take_terms(self, lang: str) -> Iterator[pa.RecordBatch]:
        for number, name in enumerate(self.language.sources):
            self._prune(number)
            best = self.best[number]
            source = pa.array([name] * len(best), pa.string())
            items = pa.array([term for _, term in best], pa.binary())
            yield _rows(lang, source, "term", items, np.array([-value for value, _ in best], np.int64))


def _rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    size = len(source)
    columns = [pa.array([lang] * size, pa.string()), source, pa.array([part] * size, pa.string()), item, pa.array(value)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _scored(languages: dict[str, Language], top: int):
    """Scores kept terms ``lang, term, cells(source, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: dict[str, Scores] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                score = scores.setdefault(lang, Scores(languages[lang], top))
                step = max(1, SCORED_CELLS // len(score.language.sources))
                for start in range(0, own.num_rows, step):
                    part = own.slice(start, step)
                    cells = part.column("cells")
                    flat = cells.flatten()
                    ends = np.diff(cells.offsets.to_numpy())
                    place = pc.index_in(flat.field("source"), value_set=score.language.places)
                    score.add(
                        part.column("term"),
                        np.repeat(np.arange(part.num_rows), ends),
                        place.to_numpy(zero_copy_only=False).astype(np.int64),
                        flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64),
                    )
                    if sum(one.cells() for one in scores.values()) > HELD_CELLS:
                        for name, one in scores.items():
                            yield from one.take_pairs(name)
        for name, score in scores.items():
            yield from score.take_pairs(name)
            yield from score.take_terms(name)

    return run


def _unseen(languages: dict[str, Language]):
    """Pair rows of each group as if every term were in neither source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, name in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                language = languages[lang]
                own = language.sources.index(name)
                value = np.zeros(len(language.sources), np.int64)
                if language.terms:
                    value = language.neither(own) * language.terms
                others = np.flatnonzero(np.arange(value.size) != own)
                source = pa.array([name] * others.size, pa.string())
                item = language.places.take(pa.array(others)).cast(pa.binary())
                yield _rows(lang, source, "pair", item, value[others])

    return run


def audit(
    df: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others and its language.

    ``pair`` rows rank all other sources of the language, ``term`` rows the ``top_terms`` terms that
    the source uses more than its language. Runs jobs for the totals before the result is asked for.
    """
    docs = df.select(
        *(
            F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)
            for name, alias in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))
        )
    )
    marks = F.length("term") == 0
    by_term = (
        term_counts(docs)
        .groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("docs").alias("docs"))
    )
    kept = staged(by_term.where(marks | (F.col("docs") >= min_docs)).drop("docs"), "audit-terms")
    cell = F.explode("cells").alias("cell")
    totals = (
        kept.select("lang", cell)
        .groupBy("lang", "cell.source")
        .agg(F.sum("cell.n").alias("n"))
        .join(kept.groupBy("lang").agg(F.count_if(~marks).alias("terms")), "lang")
        # One row per group.
        .collect()
    )
    by_lang: dict[str, list] = {}
    for row in totals:
        by_lang.setdefault(row["lang"], []).append(row)
    languages = {
        lang: Language(
            [row["source"] for row in rows], np.array([row["n"] for row in rows], np.int64), rows[0]["terms"]
        )
        for lang, rows in by_lang.items()
    }
    scored = staged(
        kept.where(~marks)
        .repartition(max(shuffle_partitions(df.sparkSession), 1), F.xxhash64("lang", "term"))
        .mapInArrow(_scored(languages, top_terms), _SCORES),
        "audit-scores",
    )
    groups = kept.where(marks).select("lang", cell).select("lang", "cell.source")
    unseen = groups.mapInArrow(_unseen(languages), _SCORES)
    pairs = (
        scored.where("part = 'pair'")
        .unionByName(unseen)
        .groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    terms = scored.where("part = 'term'").select("*", rank).where(F.col("rank") <= top_terms)
    return (
        pairs.select("*", rank)
        .unionByName(terms)
        .select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
terms AS (
  SELECT doc, lang, source,
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
),
kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}
),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL
),
sizes AS (
  SELECT g.lang, g.source, coalesce(n, 0) + coalesce(v, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c
      ON c.lang = g.lang AND c.source = g.source
    LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k ON k.lang = g.lang
),
grid AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // s.size::HUGEINT AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang
    LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
whole AS (
  SELECT lang, term, 1 + {SCALE}::HUGEINT * (sum(n) + 1)::HUGEINT //
    (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM counts GROUP BY lang, term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT g.lang, g.source, 'term', g.term, ((p - q) * (p - q) // q)::BIGINT
  FROM grid g JOIN whole w ON w.lang = g.lang AND w.term = g.term
  WHERE g.n > 0 AND p > q
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
    ORDER BY value DESC, item COLLATE "binary")::INTEGER AS rank
  FROM ranked
)
SELECT * FROM numbered WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
