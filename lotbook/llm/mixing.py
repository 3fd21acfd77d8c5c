"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Each source gets a target number of words: a share of ``SHARE`` times all words by its weight, at most
``MOST`` times what it has, the excess shared out again by weight. All documents of a source have the same
expected copies, target / size of the source, a whole part and a fraction. Fractions are rounded in pairs:
words move between two documents, up on one side and down on the other, at odds that keep both expectations,
until one of them is taken or left for good; the other goes on with what remains. So a source misses its
target by the last document at most. The pairs meet in a reduction tree: blocks of about ``BLOCK`` documents
are folded side by side and leave one document each, and these are folded again. Documents of similar
size are neighbours in a block.

All draws follow from hashes of the document and a seed, so reruns agree.

Nulls and odd input: a null text has size 0; sources sort by code point, null last, and null is a source of its
own. Rows equal in id, source and text are one unit of their joint size, taken or left together. A document
without words is taken as often as its expectation rounds to. An empty table gives no rows. All input columns
ride along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.rows import WORD, carried, row_key
from lotbook.operators.rows import with_row_id
from lotbook.session import staged

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 128


def sized(docs: DataFrame) -> DataFrame:
    """row, _source, _key, size"""
    return docs.select(
        carried(docs), F.col("source").alias("_source"), row_key("doc_id", "source", "text").alias("_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0)).alias("size"),
    )


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_source, source_size, units, target: one row a source."""
    per_source = units.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    ordered = per_source.select("*", F.col("_source").isNull().alias("_last"))
    ranked = with_row_id(ordered, ["_last", "_source"], "_rank").drop("_last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = staged(ranked.withColumn("_weight", F.element_at(cycle, F.pmod("_rank", F.lit(len(weights))).cast("int") + 1)), "sources")
    ceiling = most * F.col("source_size")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:  # each pass stops at least one more source, and what stopped stays stopped: the level only rises
        stopped = F.col("_weight") * level > ceiling if held >= 0 else F.lit(False)
        row = weighted.agg(
            F.sum(stopped.cast("int")).alias("n"), F.sum(F.when(stopped, ceiling)).alias("given"),
            F.sum(F.when(~stopped, F.col("_weight"))).alias("weight"),
        ).first()
        if not row["weight"] or row["n"] == held:
            break
        held, level = row["n"], (share * total - (row["given"] or 0.0)) / row["weight"]
    target = F.least(ceiling, F.col("_weight") * level)
    return weighted.select("_source", "source_size", "units", target.alias("target"))


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _fold(items: Column, seed: int) -> Column:
    """Fold documents (size, key, p) into struct(left, done): one document that is open, all others decided."""
    kind = "array<struct<key: bigint, up: int>>"

    def pair(state: Column, item: Column) -> Column:
        a, b = state["left"], item
        up_a, down_a = (1.0 - a["p"]) * a["size"], a["p"] * a["size"]
        up_b, down_b = (1.0 - b["p"]) * b["size"], b["p"] * b["size"]
        to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
        chosen = _draw(a["key"], b["key"], F.lit(seed)) * (to_a + to_b) < to_b
        # words move to a: either a is full, or b is empty; and the other way round
        a_done = F.when(chosen, up_a <= down_b).otherwise(down_a <= up_b)
        moved = F.when(chosen, to_a).otherwise(-to_b)
        rest_a, rest_b = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        bounded = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        left = F.when(a_done, F.struct(b["size"].alias("size"), b["key"].alias("key"), bounded(rest_b).alias("p")))
        left = left.otherwise(F.struct(a["size"].alias("size"), a["key"].alias("key"), bounded(rest_a).alias("p")))
        up = F.when(a_done, chosen).otherwise(~chosen).cast("int")
        done = F.struct(F.when(a_done, a["key"]).otherwise(b["key"]).alias("key"), up.alias("up"))
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(done)).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("left"), F.array().cast(kind).alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, pair)


def rounded(units: DataFrame, most_units: int, seed: int, block: int = BLOCK) -> DataFrame:
    """_key, up: whether the fraction ``p`` of each unit (_source, units, size > 0, _key, p) becomes one copy."""
    level, found, count = 0, [], F.col("units")
    while True:
        blocks = F.greatest(F.ceil(count / F.lit(block)), F.lit(1))
        place = F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(level)), blocks)
        items = F.sort_array(F.collect_list(F.struct("size", F.col("_key").alias("key"), "p")))
        folded = (
            units.groupBy("_source", "units", place.alias("_block")).agg(items.alias("items"))
            .select("_source", "units", _fold(F.col("items"), seed + level).alias("fold")).select("_source", "units", "fold.*")
        )
        folded = staged(folded, "folded")
        found.append(folded.select(F.explode("done").alias("d")).select(F.col("d.key").alias("_key"), F.col("d.up").alias("up")))
        units = folded.select("_source", "units", "left.size", F.col("left.key").alias("_key"), "left.p")
        most_units, level = -(-most_units // block), level + 1
        count = F.ceil(count / F.lit(block))
        if most_units <= 1:
            break
    found.append(units.select("_key", (_draw(F.col("_key"), F.lit(seed - 1)) < F.col("p")).cast("int").alias("up")))
    decided = found[0]
    for part in found[1:]:
        decided = decided.unionAll(part)
    return decided


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """row, size, source_size, target, copies: how often each document is taken."""
    rows = sized(docs)
    units = staged(rows.groupBy("_source", "_key").agg(F.sum("size").alias("size")), "units")
    sources = staged(targets(units, weights, share, most), "targets")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = sources.select(F.col("_source").alias("_s"), "units", expected.alias("_e"))
    wide = units.join(per_source, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor("_e").cast("int")
    openly = (F.col("size") > 0) & (F.col("_e") > whole)
    fractions = wide.where(openly).select(
        "_source", "units", F.col("size").cast("double").alias("size"), "_key", (F.col("_e") - whole).alias("p"))
    most_units = sources.agg(F.max("units")).first()[0] or 0
    ups = rounded(fractions, most_units, seed)
    plain = F.when(F.col("size") > 0, whole).otherwise(F.round("_e").cast("int"))
    copies = (
        wide.where(~openly).select("_key", plain.alias("copies"))
        .unionAll(wide.where(openly).select("_key", whole.alias("copies")).join(ups, "_key").select("_key", (F.col("copies") + F.col("up")).alias("copies")))
    )
    known = sources.select(F.col("_source").alias("_s"), "source_size", "target")
    out = rows.join(staged(copies, "copies"), "_key").join(known, F.col("_source").eqNullSafe(F.col("_s")))
    return out.select("row", "size", "source_size", "target", "copies")
