"""URL filters: rules first, else two character models (operator 5, DataFrame functions only).

URLs that a rule decides train two models, one of accepted and one of rejected URLs. A model gives
the chance of the next character after up to three others: counts of the longest context mixed with
the chance from the next shorter one, by the number of different characters seen there
(Witten-Bell), down to an even chance. A URL's score is the mean log ratio of the two chances per
character, so long URLs do not count more. The cut is the one that best separates accepted from
rejected training URLs by the mean of both rates, half-way between the URLs on its two sides.

Characters are those of host and path, with what lies outside the alphabet as one symbol, so there
are at most ``len(ALPHABET) ** 4`` character runs, whatever the data. Log ratios are kept as whole
millionths, so sums do not depend on their order.

Cases: a null url or one without ``://`` has empty host and path and is judged as the empty string;
without training URLs every score is 0 and the verdict is allow; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, staged

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# What the models tell apart; any other character is OTHER. START pads, END closes a URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./_-*$"
START, END, OTHER = "^", "$", "*"
CONTEXT = 3
MILLION = 1_000_000
# Bins per nat in which the cut is looked for, and their largest number from zero.
BINS, MOST_BINS = 200, 2000
# Character runs up to here are broadcast: some 40 MB.
BROADCAST_RUNS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_length() -> list[tuple[str, str, str]]:
    return sorted(RULES, key=lambda rule: -len(rule[0] + rule[1]))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in reversed(_by_length()):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column) -> Column:
    """Characters of a URL for the models."""
    lower = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.concat(F.regexp_replace(lower, "[^a-z0-9./_-]", OTHER), F.lit(END))


def character_runs(urls: DataFrame) -> DataFrame:
    """One row per character of ``symbols``, as ``run``: its context and itself."""
    padded = F.concat(F.lit(START * CONTEXT), F.col("symbols"))
    places = F.sequence(F.lit(1), F.length("symbols"))
    runs = F.transform(places, lambda place: F.substring(padded, place, F.lit(CONTEXT + 1)))
    return urls.withColumn("run", F.explode(runs))


def log_ratios(training: DataFrame, runs: DataFrame) -> DataFrame:
    """``run, ratio``: millionths of the log ratio for each of ``runs(run)``.

    ``training`` has ``run, allow, block``: how often each run is in accepted and rejected URLs.
    """
    scored = runs.select("run", F.lit(1 / len(ALPHABET)).alias("p_allow"), F.lit(1 / len(ALPHABET)).alias("p_block"))
    for size in range(CONTEXT + 1):
        tail = F.substring("run", CONTEXT + 1 - size, size + 1)
        counts = training.groupBy(tail.alias("tail")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"))
        context = F.substring("tail", 1, size)
        totals = counts.groupBy(context.alias("context")).agg(
            *[F.sum(f"n_{side}").alias(f"all_{side}") for side in ("allow", "block")],
            *[F.sum((F.col(f"n_{side}") > 0).cast("bigint")).alias(f"kinds_{side}") for side in ("allow", "block")],
        )
        scored = (
            scored.withColumn("tail", tail)
            .withColumn("context", context)
            .join(counts, "tail", "left")
            .join(totals, "context", "left")
        )
        chances = {}
        for side in ("allow", "block"):
            seen, every, kinds = (F.coalesce(f"{name}_{side}", F.lit(0)) for name in ("n", "all", "kinds"))
            mixed = (seen + kinds * F.col(f"p_{side}")) / (every + kinds)
            chances[f"p_{side}"] = F.when(every > 0, mixed).otherwise(F.col(f"p_{side}"))
        scored = scored.withColumns(chances).select("run", "p_allow", "p_block")
    ratio = F.round((F.log("p_allow") - F.log("p_block")) * MILLION).cast("bigint")
    return scored.select("run", ratio.alias("ratio"))


def best_cut(labelled: DataFrame) -> int:
    """Bin from which on URLs are accepted; ``labelled`` has ``bin, allow, block`` counts.

    The bins are few whatever the data; the driver gets one number.
    """
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bins = labelled.groupBy("bin").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    all_allow, all_block = F.sum("allow").over(every), F.sum("block").over(every)
    wrong = F.coalesce(F.sum("allow").over(below), F.lit(0))
    right = F.coalesce(F.sum("block").over(below), F.lit(0))
    # Sum of both rates times both totals, in whole numbers.
    gain = (all_allow - wrong) * F.greatest(all_block, F.lit(1)) + right * F.greatest(all_allow, F.lit(1))
    # Half-way to the bin below that holds training URLs.
    lower = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin"))
    cut = F.floor((lower + F.col("bin") + 1) / 2)
    row = bins.select(cut.alias("cut"), gain.alias("gain")).orderBy(F.desc("gain"), F.abs("cut"), "cut").first()
    return 0 if row is None else row["cut"]


def filter_urls(df: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; scores are millionths."""
    url = F.col(url_column).cast("string")
    rows = df.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), decided.alias("decided"), symbols(F.col("host"), F.col("path")).alias("symbols"))
    # A URL that many pages share is scored once; all its rows have one verdict by rule.
    urls = staged(
        rows.groupBy("symbols").agg(
            F.count_if(F.col("decided") == "allow").alias("allow"),
            F.count_if(F.col("decided") == "block").alias("block"),
        ),
        "url-symbols",
    )
    runs = staged(
        character_runs(urls).groupBy("run").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")),
        "url-runs",
    )
    ratios = staged(log_ratios(runs.where("allow > 0 OR block > 0"), runs), "url-ratios")
    if ratios.count() <= BROADCAST_RUNS:
        ratios = F.broadcast(ratios)
    scores = (
        character_runs(urls)
        .join(ratios, "run")
        .groupBy("symbols", "allow", "block")
        .agg(F.sum("ratio").alias("total"), F.count("*").alias("length"))
    )
    scores = staged(scores.withColumn("score", F.floor(F.col("total") / F.col("length")).cast("bigint")), "url-scores")
    width = MILLION // BINS
    place = F.greatest(F.least(F.floor(F.col("score") / width), F.lit(MOST_BINS)), F.lit(-MOST_BINS))
    labelled = scores.where("allow > 0 OR block > 0").select(place.alias("bin"), "allow", "block")
    cut = best_cut(labelled) * width
    judged = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return rows.join(scores.select("symbols", "score"), "symbols").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score"
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def _oracle_sql() -> str:
    fits = {
        host + path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        for host, path, _ in RULES
    }
    rule = " ".join(f"WHEN {fits[h + p]} THEN '{h + p}'" for h, p, _ in _by_length())
    decided = " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in RULES)
    orders = []
    for size in range(CONTEXT + 1):
        before = f"scored{size - 1}" if size else "uniform"
        orders.append(f"""
counts{size} AS (
  SELECT run[{CONTEXT + 1 - size}:] AS tail, sum(allow) AS n_allow, sum(block) AS n_block
  FROM trained GROUP BY ALL
),
totals{size} AS (
  SELECT tail[1:{size}] AS context, sum(n_allow) AS all_allow, sum(n_block) AS all_block,
    count(*) FILTER (n_allow > 0) AS kinds_allow, count(*) FILTER (n_block > 0) AS kinds_block
  FROM counts{size} GROUP BY ALL
),
scored{size} AS (
  SELECT run,
    CASE WHEN coalesce(all_allow, 0) > 0
      THEN (coalesce(n_allow, 0)::DOUBLE + kinds_allow::DOUBLE * p_allow) / (all_allow + kinds_allow)::DOUBLE
      ELSE p_allow END AS p_allow,
    CASE WHEN coalesce(all_block, 0) > 0
      THEN (coalesce(n_block, 0)::DOUBLE + kinds_block::DOUBLE * p_block) / (all_block + kinds_block)::DOUBLE
      ELSE p_block END AS p_block
  FROM {before}
  LEFT JOIN counts{size} ON counts{size}.tail = run[{CONTEXT + 1 - size}:]
  LEFT JOIN totals{size} ON totals{size}.context = run[{CONTEXT + 1 - size}:{CONTEXT}]
)""")
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parts),
urls AS (
  SELECT *, CASE rule {decided} END AS decided,
    regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[^a-z0-9./_-]', '{OTHER}', 'g') || '{END}' AS symbols
  FROM ruled
),
texts AS (
  SELECT symbols, count(*) FILTER (decided = 'allow') AS allow, count(*) FILTER (decided = 'block') AS block
  FROM urls GROUP BY symbols
),
exploded AS (
  SELECT symbols, allow, block, ('{START * CONTEXT}' || symbols)[i:i + {CONTEXT}] AS run
  FROM (SELECT *, unnest(range(1, length(symbols) + 1)) AS i FROM texts)
),
runs AS (SELECT run, sum(allow) AS allow, sum(block) AS block FROM exploded GROUP BY run),
trained AS (SELECT * FROM runs WHERE allow > 0 OR block > 0),
uniform AS (
  SELECT run, 1.0::DOUBLE / {len(ALPHABET)} AS p_allow, 1.0::DOUBLE / {len(ALPHABET)} AS p_block FROM runs
),{','.join(orders)},
scores AS (
  SELECT symbols, allow, block, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM exploded JOIN (
    SELECT run, round((ln(p_allow) - ln(p_block)) * {MILLION})::BIGINT AS ratio FROM scored{CONTEXT}
  ) USING (run) GROUP BY ALL
),
bins AS (
  SELECT greatest(least(floor(score::DOUBLE / {MILLION // BINS}), {MOST_BINS}), -{MOST_BINS})::BIGINT AS bin,
    sum(allow) AS allow, sum(block) AS block
  FROM scores WHERE allow > 0 OR block > 0 GROUP BY ALL
),
gains AS (
  SELECT floor((coalesce(lag(bin) OVER (ORDER BY bin), bin) + bin + 1)::DOUBLE / 2)::BIGINT AS cut,
    ((SELECT sum(allow) FROM bins) - coalesce(sum(allow) OVER below, 0))
      * greatest((SELECT sum(block) FROM bins), 1)
    + coalesce(sum(block) OVER below, 0) * greatest((SELECT sum(allow) FROM bins), 1) AS gain
  FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cut AS (SELECT coalesce((SELECT cut FROM gains ORDER BY gain DESC, abs(cut), cut LIMIT 1), 0) * {MILLION // BINS} AS cut)
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM urls JOIN scores USING (symbols)
"""


ORACLE_SQL = _oracle_sql()
