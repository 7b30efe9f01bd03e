"""Exact Jaccard join of documents on word shingles (operator 2).

Documents are sets of five-word shingles under the Jaccard distance, a metric. Two link when their
distance is at most ``t`` (0.25). Documents without a common text are all equally far apart, so
regions cannot grow around arbitrary pivots; they grow around pivots near the data:

1. Equal sets are one class; everything below works on classes.
2. A class is placed in the spaces of its anchors: the first shingles of its set in one order for
   all, rare ones first. With ``n - ceil(0.75 n) + 1`` anchors of ``n`` shingles, two linked sets
   share one. The order comes from a table of counts of fixed size over all documents; it decides
   how many classes meet, not which links are found.
3. Each anchor's space gets a pivot, the class with the most common content, hence the most central.
   All others that set sizes and the anchor's place leave a chance get their exact distance to it.
   Those within ``t`` are its region: linked to the pivot, and so in one component, whatever their
   distances to one another.
4. A class outside the region can only link to members whose distance to the pivot differs by at
   most ``t`` (triangle inequality). The outsiders and the members in that window go on, and the
   step repeats with a pivot among the outsiders, or among the members of several regions when there
   are none, while many pairs are left.
5. The pairs left are those in no common region, inside each window, and within the limits that set
   sizes and the place of the anchor put on the overlap. They meet in an equi-join on the anchor,
   and their distances are computed.
6. Links to pivots and from pairs make the components, by minimum labels with pointer jumping.

No step lists the pairs of a group: regions cost one row per member, and pairs only arise between
classes that no region connects. Shingles and sets are compared by 64-bit hashes.

Cases: documents without words, null or empty, have no shingles and link with nothing; fewer than
five words are one shingle, the whole sequence; of rows repeated with one id each is a document, and
equal texts link them; a null id never is a component's id unless it holds no other; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, shuffle_partitions, staged

WORDS = 5
# Similarity of linked documents, in hundredths.
SIMILARITY = 75

# The table of counts has a fixed size: slices of cells, whatever the data. A task's counts stop here.
MOST_COUNTED = 255
CELL_BITS = 24
SLICES = 64
WEIGHT_STEPS = 4

# The membership filter for the sets that are fetched again, in bits. False hits cost work only.
FILTER_BITS = 1 << 23

# Another round of pivots is taken while more than this many pairs per row are left.
PAIRS_PER_ROW = 100
ROUNDS = 4
# Of so many anchors one is looked at to estimate the pairs that are left.
ESTIMATE_FROM = 16

# Classes that a task remembers to have listed.
CLASSES_KEPT = 400_000
# Bytes hashed at a time, and the length from which a word is hashed by itself.
SEGMENT = 1 << 18
LONG_WORD = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_SHORT = 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_WHITE_BYTES = re.compile(rb"[\x20\x09-\x0D]")


def _powers(base: int) -> np.ndarray:
    factors = np.full(SEGMENT + 1, np.uint64(base % (1 << 64)))
    factors[0] = 1
    return np.multiply.accumulate(factors)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most ``SEGMENT`` bytes.

    A word's hash is its polynomial, taken from running sums and moved to the origin.
    """
    codes = np.frombuffer(data, np.uint8)
    inside = ~_WHITE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if codes.size and inside[0]:
        edges = np.concatenate([[0], edges])
    if codes.size and inside[-1]:
        edges = np.concatenate([edges, [codes.size]])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(codes.size + 1, np.uint64)
    np.cumsum(codes * _UP[: codes.size], out=sums[1:])
    lengths = ends - starts
    hashes = _mixed((sums[ends] - sums[starts]) * _DOWN[starts] + lengths.astype(np.uint64))
    for at in np.flatnonzero(lengths >= LONG_WORD):
        hashes[at] = xxhash.xxh64_intdigest(data[starts[at] : ends[at]])
    return hashes, starts


def _long_text_hashes(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length, segment by segment, cut at white space."""
    parts, start = [], 0
    while start < len(data):
        stop = start + SEGMENT
        if stop < len(data):
            cut = max(data.rfind(bytes([white]), start, stop) for white in np.flatnonzero(_WHITE).tolist())
            if cut < 0:
                # One word fills the segment.
                end = _WHITE_BYTES.search(data, stop)
                stop = end.start() if end else len(data)
                parts.append(np.array([xxhash.xxh64_intdigest(data[start:stop])], np.uint64))
                start = stop
                continue
            stop = cut + 1
        parts.append(_word_hashes(data[start:stop])[0])
        start = stop
    return np.concatenate(parts)


def _sets_of_words(hashes: np.ndarray, counts: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sets of texts whose words stand one after the other in ``hashes``."""
    runs = np.zeros(max(hashes.size - words + 1, 0), np.uint64)
    for place in range(words):
        runs = _mixed(runs * np.uint64(_BASE) + hashes[place : place + runs.size])
    start = 0
    for count in counts.tolist():
        if count >= words:
            values = np.sort(runs[start : start + count - words + 1])
        elif count:
            values = np.array([_SHORT * count % (1 << 64)], np.uint64)
            for place in range(start, start + count):
                values = _mixed(values * np.uint64(_BASE) + hashes[place])
        else:
            values = np.zeros(0, np.uint64)
        start += count
        fresh = np.ones(values.size, bool)
        np.not_equal(values[1:], values[:-1], out=fresh[1:])
        yield values[fresh]


def shingle_sets(texts: Iterable[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles.

    ``bytes.lower`` knows A-Z only, as wanted. Short texts are hashed together.
    """
    held: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        if held:
            hashes, starts = _word_hashes(b"\n".join(held))
            ends = np.cumsum([len(text) + 1 for text in held])
            counts = np.diff(np.searchsorted(starts, ends), prepend=0)
            yield from _sets_of_words(hashes, counts, words)

    for text in texts:
        data = (text or b"").lower()
        if size + len(data) + 1 > SEGMENT:
            yield from together()
            held, size = [], 0
        if len(data) >= SEGMENT:
            hashes = _long_text_hashes(data)
            yield from _sets_of_words(hashes, np.array([hashes.size]), words)
        else:
            held.append(data)
            size += len(data) + 1
    yield from together()


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets([text], words))


def _batch_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    return shingle_sets((text.as_py() for text in column), words)


def _class_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64), pa.int64())


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


_SETS = "id bigint, mark binary, n bigint, c bigint, slice int, cells binary"


def set_facts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Set size and class of every row of ``docs(id, mark, text)``, and each task's counts by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counts in one byte each; what is as common as that is common enough.
        cells = np.zeros(1 << CELL_BITS, np.uint8)
        for batch in batches:
            sizes, classes = [], []
            for hashes in _batch_sets(batch.column("text"), words):
                sizes.append(hashes.size)
                classes.append(_class_id(hashes) if hashes.size else None)
                # Cells that two shingles of a text share count once.
                touched = _cells(hashes)
                cells[touched] = np.minimum(cells[touched], MOST_COUNTED - 1) + 1
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                ["id", "mark", "n", "c", "slice", "cells"],
            )
        packed = [zlib.compress(part.tobytes(), 1) for part in np.split(cells, SLICES)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(SLICES, pa.int64()),
                pa.nulls(SLICES, pa.binary()),
                pa.nulls(SLICES, pa.int64()),
                pa.nulls(SLICES, pa.int64()),
                pa.array(range(SLICES), pa.int32()),
                pa.array(packed, pa.binary()),
            ],
            ["id", "mark", "n", "c", "slice", "cells"],
        )

    return docs.mapInArrow(run, _SETS)


def cell_weights(facts: DataFrame) -> bytes:
    """Logarithmic count of each cell in one byte: the same number of bytes for any data."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << CELL_BITS) // SLICES, np.uint64)
        for packed in table.column("cells"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
        weights = np.minimum(np.rint(np.log2(np.maximum(total, 1)) * WEIGHT_STEPS), 255)
        return pa.table(
            {"slice": table.column("slice")[:1], "weights": pa.array([weights.astype(np.uint8).tobytes()])}
        )

    merged = (
        facts.where("slice IS NOT NULL")
        .select("slice", "cells")
        .groupBy("slice")
        .applyInArrow(merge, "slice int, weights binary")
    )
    parts = {row["slice"]: bytes(row["weights"]) for row in merged.collect()}
    empty = bytes((1 << CELL_BITS) // SLICES)
    return b"".join(parts.get(number, empty) for number in range(SLICES))


def anchor_rows(docs: DataFrame, weights: bytes, words: int = WORDS) -> DataFrame:
    """``a, c, meta``: the anchors of each class; ``meta`` packs set size, place and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int, np.ndarray]] = []
            for hashes in _batch_sets(batch.column("text"), words):
                if not hashes.size:
                    continue
                number = _class_id(hashes)
                if number in seen:
                    continue
                if len(seen) >= CLASSES_KEPT:
                    seen.clear()
                seen.add(number)
                weight = table[_cells(hashes)]
                size = hashes.size
                count = size - -(-SIMILARITY * size // 100) + 1
                order = np.argsort(weight, kind="stable")[:count]
                mean = int(weight.mean() * 2)
                meta = (size << 35 | mean) + (np.arange(count, dtype=np.int64) << 9)
                parts.append((hashes[order], number, meta))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate([part[0] for part in parts])),
                        pa.array(np.repeat([part[1] for part in parts], [part[0].size for part in parts]), pa.int64()),
                        pa.array(np.concatenate([part[2] for part in parts]), pa.int64()),
                    ],
                    ["a", "c", "meta"],
                )

    return docs.select("text").mapInArrow(run, "a bigint, c bigint, meta bigint")


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``a, c``, those whose anchor several classes have, once per class."""
    held = None
    open_anchor = False

    def rows(a: np.ndarray, c: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(meta)], ["a", "c", "meta"])

    for batch in batches:
        a, c, meta = (batch.column(name).to_numpy() for name in ("a", "c", "meta"))
        if held is not None:
            a, c, meta = (np.concatenate([[one], many]) for one, many in zip(held, (a, c, meta)))
        if not a.size:
            continue
        first = np.ones(a.size, bool)
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        # The row held from the last batch comes first and stays a first of its kind.
        a, c, meta = a[first], c[first], meta[first]
        same = a[1:] == a[:-1]
        keep = np.zeros(a.size, bool)
        keep[1:] = same
        keep[:-1] |= same
        keep[0] |= open_anchor
        # The last row may go on in the next batch.
        open_anchor = bool(keep[-1])
        held = (a[-1], c[-1], meta[-1])
        yield rows(a[:-1][keep[:-1]], c[:-1][keep[:-1]], meta[:-1][keep[:-1]])
    if held is not None and open_anchor:
        yield rows(*(np.array([value]) for value in held))


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """``a, c, n, i, w`` of the anchors with two classes or more."""
    partitions = max(shuffle_partitions(anchors.sparkSession), 1)
    shared = (
        anchors.repartition(partitions, "a")
        .sortWithinPartitions("a", "c")
        .mapInArrow(_shared_only, "a bigint, c bigint, meta bigint")
    )
    return shared.select(
        "a",
        "c",
        F.shiftright("meta", 35).cast("int").alias("n"),
        F.expr("cast(shiftright(meta, 9) & 67108863 AS INT)").alias("i"),
        F.expr("cast(meta & 511 AS INT)").alias("w"),
    )


def _filter_bit(row_id: Column) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(FILTER_BITS)).cast("int")


def fetch_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``c, hashes`` of the classes ``wanted(c)``, made from the texts again.

    A filter of fixed size over the ids of the classes' first documents keeps other texts out. A few
    others pass, and a class may come more than once.
    """
    ids = classes.join(wanted, "c", "left_semi").select(_filter_bit(F.col("first_id")).alias("bit"))
    words_of_bits = ids.groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")
    )
    filled = np.zeros(FILTER_BITS >> 6, np.int64)
    for row in words_of_bits.collect():
        filled[row["at"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(filled.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            bits = batch.column("bit").to_numpy().astype(np.int64)
            hit = (table[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
            few: list[np.ndarray] = []
            for hashes in _batch_sets(batch.column("text").filter(pa.array(hit.astype(bool))), words):
                if hashes.size:
                    few.append(hashes)
                if len(few) >= 256:
                    yield set_rows(few)
                    few = []
            if few:
                yield set_rows(few)

    def set_rows(few: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(hashes.size for hashes in few)])
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(few)))
        return pa.RecordBatch.from_arrays([pa.array(map(_class_id, few), pa.int64()), values], ["c", "hashes"])

    bits = docs.select(_filter_bit(F.col("id")).alias("bit"), "text")
    return bits.mapInArrow(run, "c bigint, hashes array<bigint>")


def similarities(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """``c, p, common, n, pn`` of class pairs ``(c, p)``."""
    wanted = pairs.select("c").union(pairs.select("p")).distinct()
    sets = staged(fetch_sets(docs, classes, wanted, words), "join-sets")
    # Both joins read one shuffle of the sets.
    one, two = sets.alias("one"), sets.alias("two")
    first = pairs.alias("pairs").join(one, F.col("pairs.c") == F.col("one.c"))
    first = first.select("pairs.c", "pairs.p", F.col("one.hashes").alias("own")).alias("first")
    both = first.join(two, F.col("first.p") == F.col("two.c")).select(
        "first.c",
        "first.p",
        F.size(F.array_intersect("first.own", "two.hashes")).alias("common"),
        F.size("first.own").alias("n"),
        F.size("two.hashes").alias("pn"),
    )
    return both.distinct()


def _linked() -> Column:
    return 100 * F.col("common") >= SIMILARITY * (F.col("n") + F.col("pn") - F.col("common"))


def _similarity(common: str) -> Column:
    return F.col(common) / (F.col("n") + F.col("pn") - F.col(common))


def _pivot_round(
    docs: DataFrame, classes: DataFrame, rows: DataFrame, number: int, words: int
) -> tuple[DataFrame, DataFrame]:
    """One pivot per anchor: its links, and the rows that may have others.

    ``rows`` has ``a, c, n, i, w, regions, near``: the regions a class is in as bits, and its
    similarities to the pivots so far, null where only a bound below a link is known.
    """
    rows = rows.withColumn("cap", _largest_partner())
    # Classes in no region first. Where each is in one, those of different regions may still link, so
    # any class that was no pivot yet can be the next; pivots themselves have left the rows.
    free = (F.col("regions") == 0).alias("free")
    central = F.max(F.struct(free, "w", F.bitwise_not("c").alias("other"), "c", "n", "i")).alias("pivot")
    # A region that holds all of an anchor's classes connects them all.
    shared = F.bit_and("regions").alias("shared")
    # At the first shared anchor of two linked sets, the smaller one's place leaves room for a
    # partner of its own size. Rows without that room need such a row of a size within their cap.
    smallest = F.min(F.when(F.col("cap") >= F.col("n"), F.col("n"))).alias("smallest")
    pivots = (
        rows.groupBy("a")
        .agg(central, smallest, shared)
        .where("shared = 0 AND smallest IS NOT NULL")
        .select(
            "a",
            "smallest",
            F.col("pivot.c").alias("p"),
            F.col("pivot.n").alias("pn"),
            F.col("pivot.i").alias("pi"),
        )
    )
    met = rows.join(pivots, "a").where("c <> p AND (cap >= n OR smallest <= cap)")
    met = staged(met.drop("cap", "smallest"), "join-met")
    # Of a pair's shared anchors the first leaves the most that can be common; not all can link.
    most = F.max(F.least(F.col("n") - F.col("i"), F.col("pn") - F.col("pi"))).alias("most")
    pairs = met.groupBy("c", "p", "n", "pn").agg(most)
    possible = (100 + SIMILARITY) * F.col("most") >= SIMILARITY * (F.col("n") + F.col("pn"))
    possible &= SIMILARITY * F.greatest("n", "pn") <= 100 * F.least("n", "pn")
    pairs = staged(pairs.withColumn("possible", possible), "join-pivots")
    open_pairs = pairs.where("possible").select("c", "p")
    known = staged(similarities(docs, classes, open_pairs, words), "join-distances")
    links = known.where(_linked()).select("c", "p")
    exact = known.select("c", "p", _similarity("common").alias("s"), _linked().alias("inside"))
    placed = pairs.join(exact, ["c", "p"], "left").select(
        "c",
        "p",
        "s",
        F.coalesce("inside", F.lit(False)).alias("inside"),
        F.coalesce("s", _similarity("most")).alias("at_most"),
    )
    met = met.join(placed, ["c", "p"]).select(
        "a",
        "c",
        "n",
        "i",
        "w",
        F.when(F.col("inside"), F.col("regions").bitwiseOR(F.lit(1 << number)))
        .otherwise(F.col("regions"))
        .alias("regions"),
        F.array_append("near", F.col("s")).alias("near"),
        "s",
        "inside",
        "at_most",
    )
    # Anchors whose classes are all in the region are done. Elsewhere members stay that lie within
    # the distance t of the shell where the nearest outsider is.
    outside = F.max(F.when(~F.col("inside"), F.col("at_most"))).alias("nearest")
    shells = met.groupBy("a").agg(outside).where("nearest IS NOT NULL")
    window = F.col("s") <= F.col("nearest") + (1 - SIMILARITY / 100) + 1e-9
    left = met.join(shells, "a").where(~F.col("inside") | window)
    return links, left.drop("s", "inside", "at_most", "nearest")


def _largest_partner() -> Column:
    """Largest size of a set that can link to this one if the anchor is their first shared one.

    With the anchor at place ``i``, at most ``n - i`` shingles are common, and a link needs
    ``SIMILARITY / (100 + SIMILARITY)`` of both sizes together.
    """
    room = (100 + SIMILARITY) * (F.col("n") - F.col("i").cast("bigint"))
    return F.floor(room / SIMILARITY) - F.col("n")


def _meeting_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside the first region, and all rows, with the sizes that their partners can have."""
    most = F.least(_largest_partner(), F.floor(F.col("n") * 100 / SIMILARITY))
    least = F.ceil(F.col("n") * SIMILARITY / 100)
    sized = rows.withColumns({"most": most, "least": least}).where("most >= least")
    return sized.where(F.col("regions").bitwiseAND(F.lit(1)) == 0), sized


def left_pairs(rows: DataFrame) -> DataFrame:
    """Distinct class pairs that no region connects and no bound rules out."""
    asking, present = _meeting_rows(rows)
    one = asking.select("a", *[F.col(name).alias(f"_{name}") for name in ("c", "n", "most", "least", "regions", "near")])
    t = 1 - SIMILARITY / 100 + 1e-9
    windows = F.forall(
        F.arrays_zip(F.col("_near").alias("x"), F.col("near").alias("y")),
        lambda pair: F.coalesce(F.abs(pair["x"] - pair["y"]) <= t, F.lit(True)),
    )
    pairs = one.join(present, "a").where(
        (F.col("c") != F.col("_c"))
        & F.col("n").between(F.col("_least"), F.col("_most"))
        & F.col("_n").between(F.col("least"), F.col("most"))
        & (F.col("regions").bitwiseAND(F.col("_regions")) == 0)
        & windows
    )
    return pairs.select(F.greatest("c", "_c").alias("c"), F.least("c", "_c").alias("p")).distinct()


def _pairs_to_meet(rows: DataFrame) -> int:
    """About how many pairs ``left_pairs`` looks at, from a part of the anchors."""
    asking, present = _meeting_rows(rows.where(F.pmod("a", F.lit(ESTIMATE_FROM)) == 0))
    asked = asking.groupBy("a").agg(F.count("*").alias("k"))
    there = present.groupBy("a").agg(F.count("*").alias("m"))
    met = asked.join(there, "a").agg(F.sum(F.col("k") * F.col("m"))).first()[0] or 0
    return met * ESTIMATE_FROM


def find_links(docs: DataFrame, facts: DataFrame, classes: DataFrame, words: int = WORDS) -> DataFrame:
    """``c, p``: links between classes that make the same components as all links."""
    spark = docs.sparkSession
    anchors = anchor_rows(docs, cell_weights(facts), words)
    rows = staged(shared_anchors(anchors), "join-anchors")
    rows = rows.withColumns({"regions": F.lit(0), "near": F.array().cast("array<double>")})
    links = spark.createDataFrame([], "c bigint, p bigint")
    for number in range(ROUNDS):
        found, left = _pivot_round(docs, classes, rows, number, words)
        links = links.unionByName(found)
        rows = staged(left, "join-left")
        if _pairs_to_meet(rows) <= PAIRS_PER_ROW * rows.count():
            break
    checked = similarities(docs, classes, staged(left_pairs(rows), "join-pairs"), words)
    return links.unionByName(checked.where(_linked()).select("c", "p"))


def components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``c, first``: the smallest ``(id, class)`` reachable, for classes with a link.

    Labels move to neighbours as minima, and then each label takes its own class's label, which
    doubles the reach. Hot classes only add rows to a minimum with partial sums.
    """
    edges = staged(
        links.unionByName(links.select(F.col("p").alias("c"), F.col("c").alias("p"))).distinct(), "join-edges"
    )
    own = F.struct(F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("id"), F.col("c").alias("at"))
    labels = staged(
        classes.join(edges.select("c").distinct(), "c", "left_semi").select("c", own.alias("first")), "join-labels"
    )
    while True:
        heard = (
            edges.join(labels.select(F.col("c").alias("p"), "first"), "p")
            .groupBy("c")
            .agg(F.min("first").alias("heard"))
        )
        nearer = labels.join(heard, "c").select("c", "first", F.least("first", "heard").alias("heard"))
        further = nearer.select(F.col("c").alias("at"), F.col("heard").alias("jump"))
        moved = staged(
            nearer.withColumn("at", F.col("heard.at"))
            .join(further, "at")
            .select("c", F.least("heard", "jump").alias("next"), (F.least("heard", "jump") != F.col("first")).alias("moved")),
            "join-labels",
        )
        labels = moved.select("c", F.col("next").alias("first"))
        if moved.where("moved").isEmpty():
            return labels


def labelled_rows(
    df: DataFrame, id_column: str, text_column: str, words: int, mark: Column | None = None
) -> DataFrame:
    """``id, mark, n, c, first_id, first`` of every row.

    ``first_id`` is the smallest id of the row's class, and ``first`` the smallest ``(id, class)``
    of its component, null if the class has no link.
    """
    docs = df.select(
        F.col(id_column).cast("bigint").alias("id"),
        (F.lit(None).cast("binary") if mark is None else mark).alias("mark"),
        F.col(text_column).cast("string").cast("binary").alias("text"),
    )
    facts = staged(set_facts(docs, words), "join-facts")
    rows = facts.where("slice IS NULL").select("id", "mark", "n", "c")
    classes = staged(
        rows.where("n > 0").groupBy("c").agg(F.min("id").alias("first_id")), "join-classes"
    )
    labels = components(find_links(docs, facts, classes, words), classes)
    return rows.join(classes.join(labels, "c", "left"), "c", "left")


def jaccard_components(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    label = F.nullif(F.col("first.id"), F.lit((1 << 63) - 1))
    return labelled_rows(df, id_column, text_column, words).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce(label, "first_id", "id").alias("component_id"),
    )


def component_heads(
    df: DataFrame, mark: Column, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS
) -> DataFrame:
    """``id, mark`` of one row of each component: the smallest id, null last, then the smallest mark.

    Rows are told apart by id and ``mark``, so ids may be null or shared. Rows without shingles are
    all listed.
    """
    rows = labelled_rows(df, id_column, text_column, words, mark)
    # The class whose smallest id is the component's; of its rows, those with that id.
    own = F.col("first").isNull() | (F.col("first.at") == F.col("c"))
    at_head = rows.where(F.col("c").isNotNull() & own & F.col("id").eqNullSafe(F.col("first_id")))
    heads = at_head.groupBy("c").agg(F.first("first_id").alias("id"), F.min("mark").alias("mark"))
    return heads.select("id", "mark").unionByName(rows.where("c IS NULL").select("id", "mark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT one, two FROM common
  JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two
  WHERE 100 * k >= {SIMILARITY} * (x.n + y.n - k)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.two FROM reach JOIN links ON links.one = reach.other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY ALL
"""
