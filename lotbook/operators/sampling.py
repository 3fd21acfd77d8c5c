"""Order, samples and splits that repeat exactly on any layout."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lotbook.functions.hashing import DIGITS, digest, share_limit
from lotbook.operators.rows import with_row_id
from lotbook.session import staged

# How many standard deviations a bound on digests is set off from where it is expected; the chance that it
# does not hold is below 1e-14 (Chernoff), and then it is set off further.
MARGIN = 8

# Keys that are looked at to tell about where a cut-off key lies.
SAMPLE_ROWS = 200_000


def sort_by_weight(df: DataFrame, weight: str = "weight", name: str = "feature") -> DataFrame:
    return df.orderBy(F.desc(weight), name)


def shuffle_rows(df: DataFrame, key: str, seed: int = 10) -> DataFrame:
    """All rows in an order that has nothing to do with their content (a distributed sort by digest)."""
    return df.withColumn("shuffle_key", digest(key, seed)).orderBy("shuffle_key")


def _margin(n: int, times: int) -> int:
    return math.ceil(times * MARGIN * math.sqrt(n) + (times * MARGIN) ** 2)


def _limit(rows: int, total: int) -> str:
    """The digest below which so many of all rows are expected."""
    return share_limit(min(Fraction(rows, total), Fraction(1))) if total else "g"


def digest_cutoff(df: DataFrame, n: int, key: str, seed: int) -> str:
    """The digest of the n-th row in digest order ('g', above all digests, if there are fewer rows).

    Two scans at any size: one counts the rows (on parquet, from the footers), one reads the keys. Digests are uniform, so
    the n-th lies within some root(n) places of where it is expected; only the digests in that bracket, a share of
    the rows that shrinks as they grow, are written down and ordered. The counts decide, so the result is exact.
    """
    return _digest_at(df.select(digest(key, seed).alias("h")), n, df.count())


def _digest_at(digests: DataFrame, n: int, total: int) -> str:
    """The n-th of ``total`` digests, the column ``h`` of uniform digests."""
    if n > total:
        return "g"
    times = 1
    while True:
        lo, hi = _limit(max(n - _margin(n, times), 0), total), _limit(n + _margin(n, times), total)
        marked = digests.where(F.col("h") < hi).select(F.when(F.col("h") >= lo, F.col("h")).alias("h"))
        # equal digests (repeated keys) and those below the bracket become counts before anything moves
        counted = staged(marked.groupBy("h").agg(F.count("*").alias("n")), "bracket")
        totals = counted.agg(F.sum(F.when(F.col("h").isNull(), F.col("n"))).alias("below"), F.sum("n").alias("all")).first()
        below, rows = totals["below"] or 0, totals["all"] or 0
        if below < n <= rows:
            break
        times *= 4
    place = n - below
    inside = counted.where("h is not null")
    if rows - below > inside.count():  # a repeated key
        return _at_weight(with_row_id(inside, "h", "_place"), place)
    # as many rows as the bracket has, some root(n), in one task
    return inside.orderBy("h").limit(place).agg(F.max("h")).first()[0]


def _at_weight(numbered: DataFrame, place: int) -> str:
    """The first digest up to which there are ``place`` rows: halves the numbered digests (h, n, _place) until one is left."""
    lo, hi = 0, numbered.agg(F.max("_place")).first()[0]
    while lo < hi:
        middle = (lo + hi) // 2
        if numbered.where(F.col("_place") <= middle).agg(F.sum("n")).first()[0] >= place:
            hi = middle
        else:
            lo = middle + 1
    return numbered.where(F.col("_place") == lo).first()["h"]


def sample_n(df: DataFrame, n: int, key: str, seed: int = 10) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), each set equally likely; ``key`` must be unique.

    The rows are read twice, whatever their number: one scan counts them, one keeps those below a digest that a few more than
    ``n`` rows are expected to have. These are written down, and the result is a filter on them: no sort and no limit that would
    funnel the sample through one task.
    """
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if n >= total:
        return df
    hashed = df.withColumn("_digest", digest(key, seed))
    times = 1
    while True:
        kept = staged(hashed.where(F.col("_digest") < _limit(n + _margin(n, times), total)), "sample")
        found, last = kept.agg(F.count("*"), F.max("_digest")).first()
        if found >= n:
            break
        times *= 4
    return kept.where(F.col("_digest") <= F.lit(_digest_at_end(kept, n, found, last))).drop("_digest")


def _digest_at_end(kept: DataFrame, n: int, found: int, last: str) -> str:
    """The n-th digest among rows of which at most a few more than n are there: only the last ones are ordered."""
    share = Fraction(int(last, 16) + 1, 16**DIGITS) * Fraction(max(n - _margin(n, 1), 0), found)
    tail = kept.where(F.col("_digest") >= share_limit(share)).select(F.col("_digest").alias("h"))
    ends = kept.select(F.col("_digest").alias("h"))
    # one more than have to go: some root(n) rows, in one task; behind this bound unless chance has it otherwise
    last_ones = ends.where(F.col("h") >= share_limit(share)).orderBy(F.desc("h")).limit(found - n + 1)
    cut, rows = last_ones.agg(F.min("h"), F.count("*")).first()
    if rows <= found - n:
        cut = ends.orderBy(F.desc("h")).limit(found - n + 1).agg(F.min("h")).first()[0]
    return cut


def split(df: DataFrame, test_size: float, key: str, seed: int = 10, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. By default each row decides by its digest alone, so the test share is
    ``test_size`` up to chance; ``exact`` gives ceil(n * test_size) test rows, after two scans (rows, then keys)."""
    own = digest(key, seed)
    if not exact:
        is_test = own < F.lit(share_limit(test_size))
    else:
        total = df.count()
        wanted = math.ceil(total * test_size)
        cutoff = _digest_at(df.select(own.alias("h")), wanted, total) if wanted else None
        is_test = F.lit(False) if cutoff is None else own <= F.lit(cutoff)
    return df.where(~is_test), df.where(is_test)


def with_fold(df: DataFrame, k: int, key: str, seed: int = 10, name: str = "fold") -> DataFrame:
    """A fold number 0..k-1 per row, from the digest of its key."""
    return df.withColumn(
        name, F.pmod(F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")
    )


def first_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the order of a unique key.

    A plain top-n sends n rows of every partition to one task. Here the n-th key is found and the result is a filter.
    A random sample says up to which key rows can matter (checked by a count); a distributed sort numbers these keys.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if n < 1:
        return df.where(F.lit(False))
    wanted = df.select(*keys)
    bound = _key_bound(wanted, n, keys)
    near = wanted if bound is None else wanted.where(F.struct(*keys) <= bound)
    last = with_row_id(near, keys, "_place_of_key").where(F.col("_place_of_key") == n - 1).first()
    return df if last is None else df.where(F.struct(*keys) <= _key(df, last, keys))


def _key_bound(df: DataFrame, n: int, keys: list[str]):
    total = df.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    place = math.ceil(share * n * 1.2 + 100)
    if place >= share * total:
        return None
    sample = df.sample(share, seed=1).orderBy(*keys).limit(place)
    row = sample.orderBy(*[F.desc(k) for k in keys]).first()
    if row is None:
        return None
    bound = _key(df, row, keys)
    return bound if df.where(F.struct(*keys) <= bound).count() >= n else None


def _key(df: DataFrame, row: Row, keys: Sequence[str]) -> Column:
    """A key found on the driver, to compare rows with."""
    types = dict(df.dtypes)
    return F.struct(*[F.lit(row[k]).cast(types[k]).alias(k) for k in keys])
