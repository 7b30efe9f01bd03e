"""Mixing sources to target weights by hierarchical budgets (operator 10).

The tree has one level per column, by default domain, language, source. Every leaf has a supply:
its tokens times the epochs allowed. The budget goes down the tree: siblings share what their parent
gets by weight; a sibling that cannot use its share keeps its supply, and the rest goes to the other
siblings. Only what a whole subtree cannot use reaches the siblings of its parent, because a node
never gets more than its subtree holds.

Each leaf takes documents in a seeded order, new for each epoch, until the next one would pass the
leaf's budget. The order is a hash; running sums are taken within hash slices, as many as the leaf
needs, so a leaf with a third of all rows is no single task.

Cases: null column values form a leaf of their own, named by ``MISSING``; null and empty texts have
no tokens and ride along while their place in the order is before the cut; repeated rows count as
often as they occur, with ties by id; weights default to 1, and a weight of 0 takes nothing; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, staged

MISSING = "(none)"
SEED = 17
EPOCHS = 2
# Rows that one slice of a leaf's order should hold.
SLICE_ROWS = 1_000

LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 3, "fr": 3, "es": 2},
    "source": {"src0": 1, "src1": 3, "src2": 2},
}
# The budget as a part of all tokens, in hundredths.
BUDGET_PERCENT = 60


def n_words(text: Column) -> Column:
    """Words of a text: the token count that budgets are in."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """Domain of a source: four families by the checksum of its name."""
    return F.concat(F.lit("d"), F.crc32(source.cast("binary")) % 4)


def with_tree(df: DataFrame, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """``id, domain, lang, source, tokens`` of documents, and the columns ``keep`` by name."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(MISSING))
    return df.select(
        F.col("doc_id").alias("id"),
        domain_of(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)).alias("lang"),
        source.alias("source"),
        n_words(F.col("text")).alias("tokens"),
        *[column.alias(name) for name, column in (keep or {}).items()],
    )


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    column = F.lit(1)
    for value, weight in given.items():
        column = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(column)
    return column.cast("bigint")


def share_among_siblings(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``given`` to nodes with ``supply, weight`` and their parent's ``budget``.

    Siblings in order of supply per weight: the first ones that cannot use their share keep their
    supply, all later ones share the rest by weight, rounded down. Exact in decimals.
    """
    wide = "decimal(38,0)"
    by_need = (
        Window.partitionBy(*parent)
        .orderBy((F.col("supply") / F.col("weight")).asc(), F.col(name))
    )
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = (F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))).cast("decimal(19,0)")
    heavy = F.sum("weight").over(onward).cast("decimal(19,0)")
    ranked = nodes.where("weight > 0").withColumns({"rest": rest, "heavy": heavy})
    enough = (F.col("supply").cast("decimal(19,0)") * F.col("heavy")).cast(wide) > (
        F.col("rest") * F.col("weight").cast("decimal(19,0)")
    ).cast(wide)
    # The first sibling that can use its whole share sets the rate for itself and all later ones.
    ranked = ranked.withColumn("_at", F.row_number().over(by_need)).withColumn("_enough", enough)
    first = F.min(F.when(F.col("_enough"), F.struct("_at", "rest", "heavy"))).over(
        Window.partitionBy(*parent)
    )
    ranked = ranked.withColumn("_first", first)
    shared = F.expr(
        "cast(_first.rest * cast(weight as decimal(19,0)) as decimal(38,0)) div _first.heavy"
    )
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    return ranked.withColumn("given", F.when(capped, F.col("supply")).otherwise(shared)).drop(
        "rest", "heavy", "_at", "_enough", "_first"
    )


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget: Column,
    epochs: int,
) -> DataFrame:
    """Leaves with ``given``, their part of the budget in tokens.

    ``leaves`` has the level columns, ``tokens`` and ``n_docs``; ``budget`` is an expression over
    ``all_tokens``. Every step works on the tree's nodes, not on documents.
    """
    supply = leaves.withColumn("supply", F.col("tokens") * F.lit(epochs))
    nodes = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        here = (
            supply.groupBy(*path)
            .agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
            .withColumn("weight", _weight(level, weights))
        )
        if nodes is None:
            everything = Window.partitionBy()
            here = here.withColumn("all_tokens", F.sum("tokens").over(everything))
            here = here.withColumn("budget", budget.cast("bigint")).drop("all_tokens")
            parent: list[str] = []
        else:
            parent = path[:-1]
            here = here.join(nodes.select(*parent, F.col("given").alias("budget")), parent)
        nodes = share_among_siblings(here, parent, level)
    return nodes.select(*levels, "given").join(leaves, list(levels))


def select_mix(
    rows: DataFrame,
    levels: Sequence[str] = LEVELS,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    epochs: int = EPOCHS,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
    mark: str | None = None,
) -> DataFrame:
    """Chosen rows of ``rows(id, *levels, tokens)`` with ``epoch`` and ``tokens_before``.

    A binary column ``mark`` tells rows with one id apart: it orders them, places those with a null
    id, and is returned.
    """
    keys, marks = list(levels), [mark] if mark else []
    rows = staged(rows.select("id", *keys, "tokens", *marks), "mix-rows")
    leaves = rows.groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")
    )
    budget = F.floor(F.col("all_tokens") * budget_percent / 100)
    budgets = staged(leaf_budgets(leaves, levels, weights, budget, epochs), "mix-budgets")

    # One row per leaf and epoch in use; the last epoch is cut short.
    last = F.when(F.col("tokens") == 0, 0).otherwise(
        F.least(F.ceil(F.col("given") / F.col("tokens")) - 1, F.lit(epochs - 1))
    )
    plan = budgets.where("given > 0 OR tokens = 0").select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).alias("epoch"),
        F.col("given"),
        F.col("tokens").alias("leaf_tokens"),
        F.greatest(F.ceil(F.col("n_docs") / slice_rows), F.lit(1)).cast("bigint").alias("slices"),
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("id").cast("string"), *map(F.hex, marks), F.lit(""))))
    leading = F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint")
    drawn = (
        rows.join(plan, keys)
        .withColumn("order", order)
        # Slices are ranges of the hash, so slice order is row order.
        .withColumn("slice", F.floor(leading * F.col("slices") / F.lit(2**32)).cast("int"))
        .withColumn("room", F.col("given") - F.col("epoch") * F.col("leaf_tokens"))
    )
    drawn = staged(drawn, "mix-drawn")
    part = [*keys, "epoch", "slice"]
    sizes = drawn.groupBy(*part).agg(F.sum("tokens").alias("slice_tokens"))
    # At most one row per slice of a leaf.
    earlier = Window.partitionBy(*keys, "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*part, F.coalesce(F.sum("slice_tokens").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*part).orderBy("order", "id", "tokens", *marks)
    return (
        drawn.withColumn("upto", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, part)
        .withColumn("tokens_before", (F.col("start") + F.col("upto") - F.col("tokens")).cast("bigint"))
        .where(F.col("tokens_before") + F.col("tokens") <= F.col("room"))
        .select("id", *marks, *keys, "epoch", "tokens", "tokens_before")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select_mix(with_tree(read_table(spark, sf_dir, "documents")))
    return chosen.withColumnRenamed("id", "doc_id")


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN '{value}' THEN {weight}" for value, weight in WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END"


def oracle_sql(families: Mapping[str, str]) -> str:
    """Checking SQL: siblings joined with one another, the order without slices.

    ``families`` maps each source to its domain, since the SQL engine has no such checksum.
    """
    listed = ", ".join(f"('{source}', '{domain}')" for source, domain in families.items())
    levels = []
    for depth, level in enumerate(LEVELS):
        path = ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth])
        over = f"PARTITION BY {parent}" if parent else ""
        budget = (
            f"(SELECT sum(tokens) * {BUDGET_PERCENT} // 100 FROM docs)::HUGEINT"
            if not depth
            else "above.given"
        )
        source = f"here{depth}" + (f" JOIN level{depth - 1} above USING ({parent})" if depth else "")
        siblings = " AND ".join(f"a.{name} = b.{name}" for name in LEVELS[:depth]) or "true"
        levels.append(f"""
here{depth} AS (
  SELECT {path}, sum(tokens)::HUGEINT * {EPOCHS} AS supply, ({_sql_weight(level)})::HUGEINT AS weight
  FROM docs GROUP BY {path}
),
numbered{depth} AS (
  SELECT here{depth}.*, {budget} AS budget,
    row_number() OVER ({over} ORDER BY supply::DOUBLE / weight::DOUBLE, {level}) AS spot FROM {source}
),
rated{depth} AS (
  SELECT a.*, any_value(a.budget) - coalesce(sum(b.supply) FILTER (b.spot < a.spot), 0) AS rest,
    sum(b.weight) FILTER (b.spot >= a.spot) AS heavy
  FROM numbered{depth} a JOIN numbered{depth} b ON {siblings}
  GROUP BY ALL
),
firsts{depth} AS (
  SELECT {parent + ',' if parent else ''} min(spot) AS first_at, arg_min(rest, spot) AS first_rest,
    arg_min(heavy, spot) AS first_heavy
  FROM rated{depth} WHERE supply * heavy > rest * weight {'GROUP BY ' + parent if parent else ''}
),
level{depth} AS (
  SELECT {', '.join('r.' + name for name in LEVELS[: depth + 1])},
    CASE WHEN first_at IS NULL OR spot < first_at THEN supply
      ELSE (first_rest * weight) // first_heavy END AS given
  FROM rated{depth} r LEFT JOIN firsts{depth} f
    ON {' AND '.join(f'r.{name} = f.{name}' for name in LEVELS[:depth]) or 'true'}
)""")
    keys = ", ".join(LEVELS)
    return f"""
WITH families(source, domain) AS (VALUES {listed}),
docs AS (
  SELECT doc_id, domain, coalesce(lang, '{MISSING}') AS lang, d.source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM (SELECT doc_id, text, lang, coalesce(source, '{MISSING}') AS source FROM documents) d
  JOIN families USING (source)
),{','.join(levels)},
leaves AS (SELECT {keys}, sum(tokens)::HUGEINT AS leaf_tokens FROM docs GROUP BY {keys}),
drawn AS (
  SELECT docs.*, epoch, given - epoch * leaf_tokens AS room,
    sum(tokens) OVER (
      PARTITION BY {keys}, epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id, tokens
      ROWS UNBOUNDED PRECEDING
    ) AS upto
  FROM docs JOIN level{len(LEVELS) - 1} USING ({keys}) JOIN leaves USING ({keys})
  CROSS JOIN range({EPOCHS}) t(epoch)
)
SELECT doc_id, {keys}, epoch::INTEGER AS epoch, tokens::BIGINT AS tokens,
  (upto - tokens)::BIGINT AS tokens_before
FROM drawn WHERE upto <= room AND room > 0
"""


SOURCES = (*(f"src{number}" for number in range(40)), MISSING)
ORACLE_SQL = oracle_sql({name: f"d{zlib.crc32(name.encode()) % 4}" for name in SOURCES})
