"""Mixing sources to target weights by Poisson replication (operator 7).

Each source gets the repetition rate that makes its expected share of characters the target.
Each document draws a Poisson count with that mean by inverting the distribution at a uniform
number hashed from its id and a seed, appears that often, and all copies are ordered by another
hash: the same seed gives the same corpus on any cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import without


@dataclass(frozen=True)
class Mix:
    """Shares of named sources and of all others together (in proportion to their sizes), and the
    expected characters of the result as a multiple of those given."""

    targets: dict[str, float] = field(default_factory=lambda: {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1})
    rest: float = 0.5
    budget: float = 1.0
    seed: int = 17


def uniform(seed: str, *parts: Column) -> Column:
    """A number from 0 to below 1, of 52 bits, hashed from the seed and the parts (null: an empty word)."""
    named = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") / 2.0**52


def poisson_steps(mean: float) -> list[float]:
    """The distribution function at 0, 1, ...: a uniform number's count is how many steps it reaches."""
    out, total, k = [], 0.0, 0
    while mean > 0 and (k <= mean or total < 1 - 2.0**-53) and (not out or k <= mean + 60 + 20 * math.sqrt(mean)):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


#: The largest mean that is inverted at once: a step table of at most about a hundred numbers.
LARGEST = 16.0


def parts_of(mean: float) -> int:
    """A count of a larger mean is the sum of this many independent counts of a smaller one."""
    return max(1, math.ceil(mean / LARGEST))


def rates(df: DataFrame, mix: Mix, source: str = "source", text: str = "text") -> dict[str | None, float]:
    """The mean repetitions of each named source, and of the rest under None.

    As many rows reach the driver as sources are named. A source without characters gets 0, and
    so do all its documents.
    """
    named = F.when(F.col(source).isin(list(mix.targets)), F.col(source))
    sums = df.groupBy(named.alias("s")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("n"))
    sizes = {r.s: r.n or 0 for r in sums.collect()}
    total = sum(sizes.values())
    goals = {**mix.targets, None: mix.rest}
    scale = mix.budget / (sum(goals.values()) or 1)
    return {s: scale * goal * total / sizes[s] if sizes.get(s) else 0.0 for s, goal in goals.items()}


def mixed(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df's rows as often as drawn, with `copy` (int, from 0) and `shuffle_key` (double), in its order.

    Partitions are ranges of shuffle_key, each sorted, so files written from it hold one global
    shuffle; rows that agree in key and copy, as those of a null or repeated key, are dealt on by a
    hash of their text and their number, so that they share out over partitions. Rows of equal key draw alike; null and unnamed sources are the rest; null texts and
    empty ones count no characters but are drawn like others of their source. Columns named like
    the new ones are replaced.
    """
    df = without(df, ["copy", "shuffle_key"])
    found = rates(df, mix, source, text)

    def count(mean: float) -> Column:
        parts = parts_of(mean)
        steps = F.array(*[F.lit(s) for s in poisson_steps(mean / parts)])
        one = lambda u: F.size(F.filter(steps, lambda s: s <= u))
        if parts == 1:
            return one(uniform(f"{mix.seed}/draw", F.col(key)))
        more = lambda total, k: total + one(uniform(f"{mix.seed}/draw", F.col(key), k))
        return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), more)

    times = count(found[None])
    for name, mean in found.items():
        times = times if name is None else F.when(F.col(source) == name, count(mean)).otherwise(times)
    rows = df.withColumn("__times", times).filter("__times > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__times")
    rows = rows.withColumn("shuffle_key", uniform(f"{mix.seed}/order", F.col(key), F.col("copy")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"__text": F.xxhash64(text), "__row": F.monotonically_increasing_id()})
    order = ["shuffle_key", "__text", "__row"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__text", "__row")


def oracle_sql(mix: Mix = Mix()) -> str:
    """DuckDB SQL for the key, source, copy, shuffle_key and a digest of the text of mixed() over documents."""
    goals = {**mix.targets, None: mix.rest}
    scale = mix.budget / (sum(goals.values()) or 1)
    rows = ", ".join(f"({'NULL' if s is None else chr(39) + s + chr(39)}, {scale * g!r}::DOUBLE)" for s, g in goals.items())
    names = ", ".join(f"'{s}'" for s in mix.targets)
    number = lambda prefix, what: f"('0x' || substr(md5('{mix.seed}/{prefix}|' || {what}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text, CASE WHEN source IN ({names}) THEN source END AS s FROM documents),
sizes AS (SELECT s, sum(coalesce(length(text), 0))::DOUBLE AS n FROM docs GROUP BY s),
goals(s, goal) AS (VALUES {rows}),
rates AS (SELECT g.s, goal * (SELECT sum(n) FROM sizes) / z.n AS mean FROM goals g JOIN sizes z ON g.s IS NOT DISTINCT FROM z.s WHERE z.n > 0),
parts AS (SELECT s, mean / greatest(1, ceil(mean / {LARGEST})) AS mean, greatest(1, ceil(mean / {LARGEST}))::BIGINT AS parts FROM rates WHERE mean > 0),
steps AS (SELECT s, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS upto
          FROM parts, (SELECT unnest(range(0, 200))::DOUBLE AS k) WHERE k <= mean + 60 + 20 * sqrt(mean)),
drawn AS (SELECT r, doc_id, source, text, s, {number('draw', "coalesce(doc_id::VARCHAR, '') || CASE WHEN parts > 1 THEN '|' || part ELSE '' END")} AS u
          FROM (SELECT docs.*, parts, unnest(range(0, parts)) AS part FROM docs JOIN parts ON docs.s IS NOT DISTINCT FROM parts.s)),
counted AS (SELECT d.r, d.doc_id, d.source, d.text, count(*) FILTER (WHERE upto <= u) AS times
            FROM drawn d JOIN steps t ON d.s IS NOT DISTINCT FROM t.s GROUP BY d.r, d.doc_id, d.source, d.text)
SELECT doc_id, source, copy::INTEGER AS copy, {number('order', "coalesce(doc_id::VARCHAR, '') || '|' || copy")} AS shuffle_key, sha256(encode(coalesce(text, ''))) AS text_sha256
FROM (SELECT doc_id, source, text, unnest(range(0, times)) AS copy FROM counted)
"""
