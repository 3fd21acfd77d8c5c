"""Near-duplicate documents by an inverted join on the coordinates of their signatures.

A document's set is its distinct shingles of five words (fewer words: the whole sequence). Its signature is
``COORDS`` minima of the hashed set. Documents with one and the same set form a class at once. Every class is
posted under its (coordinate, value) pairs. Two classes with ``MATCHES`` equal coordinates must share one of the
``COORDS - MATCHES + 1`` rarest pairs of either, so only this prefix is posted for the search, and classes
that share too few pairs with anyone are skipped; a passage that very many documents hold makes frequent pairs, which
no prefix of a different document reaches. Collisions are counted on the whole signatures, and pairs above the
threshold are confirmed on the full sets, as text.

Components need no list of all pairs. A round takes one class of each posting list as its head, compares the others
with it, and merges what is linked; lists within one component are finished. The first head is the class whose pairs are the
most frequent, the text that copies are likely to come from; later ones are the most frequent outside the largest
component of the list. After ``ROUNDS`` rounds, or one that links next to nothing, the classes outside it (stragglers) must still be compared with all others,
so that no link is lost. Where they are at most ``FEW`` this is done at once, a fixed number of pairs for each entry of the list.
In other lists all are measured against one frequent text p: two sets a, b that share nothing outside p share at most
min(|a & p|, |b & p|) shingles, so only those pairs are compared whose sizes allow a link under this bound, and those
that share a shingle outside p, found by a join on these shingles.

At 64 coordinates and 32 matches a pair at exactly 0.75 is missed with a chance of about 3 in a million.

Nulls and odd input: a null or empty text has an empty set and is linked with nothing. Repeated rows are linked
like any copies. A row whose doc_id is null is compared, but never names a component; without any other name the
component is null. ``kept`` compares null-safe. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.components import components
from lotbook.llm.rows import carried, row_key, text_column
from lotbook.session import staged

SIZE = 5
LIMIT = (75, 100)  # intersection * 100 >= union * 75
COORDS, MATCHES = 64, 32
#: Of different components, and of sizes that allow a link.
OTHER = f"root <> root_a and {LIMIT[1]} * least(n, n_a) >= {LIMIT[0]} * greatest(n, n_a)"
ONCE = "not straggler or class_a < class"  # two stragglers meet from either side
ROUNDS = 3
WORTH = 0.01  # share of its pairs that a round must link for another one to follow
FEW = 8
WORDS_KEPT = 50_000  # hashed words that a task remembers before it starts anew
CHUNK = 4096  # shingles hashed at a time


def shingles(text: str) -> set[bytes]:
    """The set of a text: joined lower-case words; no word holds a space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    if len(words) < SIZE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(SIZE)))))


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a) and LIMIT[1] * both >= LIMIT[0] * (len(a) + len(b) - both)


class WordHash(dict):
    def __init__(self) -> None:
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = self.digest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits; one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    draw = np.random.default_rng(20240229)
    flips = draw.integers(0, 2**63, COORDS, dtype=np.uint64)[:, None]
    odds = (draw.integers(0, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    cache = WordHash()
    for batch in batches:
        counts, low, high, signatures = [], [], [], []
        for text in text_column(batch, "text"):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            n = len(words)
            if not n:
                counts.append(0), low.append(None), high.append(None), signatures.append(None)
                continue
            one = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
            width = min(n, SIZE)
            grams = np.full(n - width + 1, width, dtype=np.uint64)
            for i in range(width):
                grams = _mixed(grams * np.uint64(0xA0761D6478BD642F) + one[i : n - width + 1 + i])
            grams = np.unique(grams)
            best = None
            for at in range(0, len(grams), CHUNK):
                least = ((grams[at : at + CHUNK] ^ flips) * odds).min(axis=1)
                best = least if best is None else np.minimum(best, least)
            digest = xxhash.xxh3_128_intdigest(grams.tobytes())
            counts.append(len(grams))
            low.append((digest & (2**64 - 1)) - 2**63)
            high.append((digest >> 64) - 2**63)
            signatures.append((best >> np.uint64(33)).astype("<i4").tobytes())
        columns = [batch.column("node"), batch.column("doc_id"), pa.array(counts, type=pa.int64()),
                   pa.array(low, type=pa.int64()), pa.array(high, type=pa.int64()), pa.array(signatures, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "n_shingles", "low", "high", "signature"])
    cache.clear()
    pa.default_memory_pool().release_unused()  # a worker is used again, also for other stages


def sketch(docs: DataFrame) -> DataFrame:
    """node, doc_id, n_shingles, low, high (digest of the set), signature"""
    wanted = docs.select(row_key("doc_id", "text").alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return wanted.mapInArrow(
        _sketch, "node bigint, doc_id bigint, n_shingles bigint, low bigint, high bigint, signature binary")


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair (coordinate, value), both in one number."""
    base = np.arange(COORDS, dtype=np.int64) << 32
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<i4").reshape(-1, COORDS)
        classes = np.repeat(batch.column("class").to_numpy(zero_copy_only=False), COORDS)
        pairs = (values.astype(np.int64) + base).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(pairs)], names=["class", "pair"])


def postings(classes: DataFrame) -> DataFrame:
    """class, pair, weight, n: the prefix of each class that shares enough pairs with others.

    The weight is how often its pairs occur: large for a text that many others are copies of.
    """
    every = classes.select("class", "signature").mapInArrow(_coordinates, "class bigint, pair bigint")
    shared = every.groupBy("pair").agg(F.count("*").alias("times")).where("times > 1")
    common = every.join(shared, "pair").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("times", "pair"))).alias("pairs"))
    common = common.where(F.size("pairs") >= MATCHES)
    # pairs of their own come first in the order and are in the prefix, although nobody shares them
    prefix = F.slice("pairs", F.lit(1), F.size("pairs") - F.lit(MATCHES - 1))
    weight = F.aggregate("pairs", F.lit(0).cast("bigint"), lambda a, p: a + p["times"])
    common = common.join(classes.select("class", "n"), "class")
    return common.select("class", weight.alias("weight"), "n", F.explode(prefix).alias("p")).select("class", "p.pair", "weight", "n")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar; rows of one head follow each other, so its set is made once."""
    head, known = None, set()
    for batch in batches:
        keep = []
        for i, (a, text_a, text_b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"))):
            if a != head:
                head, known = a, shingles(text_a.as_py())
            if similar(known, shingles(text_b.as_py())):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, type=pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs that share enough coordinates and then enough of their full sets."""
    side = lambda c: texts.select(F.col("class").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("text").alias(f"text_{c}"))
    # four bytes a coordinate
    equal = F.expr(f"size(filter(sequence(0, {COORDS - 1}), i -> substr(sig_a, 4 * i + 1, 4) = substr(sig_b, 4 * i + 1, 4)))")
    slim = texts.select("class", "signature")
    counted = (
        pairs.join(slim.select(F.col("class").alias("a"), F.col("signature").alias("sig_a")), "a")
        .join(slim.select(F.col("class").alias("b"), F.col("signature").alias("sig_b")), "b")
        .where(equal >= MATCHES).select("a", "b")
    )
    wide = counted.join(side("b").drop("sig_b"), "b").join(side("a").drop("sig_a"), "a").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(_confirmed, "a bigint, b bigint")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, class, both (shingles shared with the head), rest: hashes of the others, need: how many of them a link takes at least.

    A linked set shares at least 3/4 of n shingles with this one, so ``need`` of them or more outside the head.
    """
    import xxhash

    head, known = None, set()
    for batch in batches:
        both, rest, needs = [], [], []
        for p, text_p, text in zip(batch.column("head").to_pylist(), batch.column("text_head"), batch.column("text")):
            if p != head:
                head, known = p, shingles(text_p.as_py())
            mine = shingles(text.as_py())
            other = mine - known
            both.append(len(mine) - len(other))
            needs.append(max(1, -(-LIMIT[0] * len(mine) // LIMIT[1]) - both[-1]))
            rest.append([xxhash.xxh3_64_intdigest(s) - 2**63 for s in other] if len(other) >= needs[-1] else [])
        columns = [batch.column("head"), batch.column("class"), pa.array(both, type=pa.int64()), pa.array(needs, type=pa.int64()),
                   pa.array(rest, type=pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["head", "class", "both", "need", "rest"])


def _prefixes(measured: DataFrame) -> DataFrame:
    """head, class, at, s: the rarest len - need + 1 shingles outside the head of each class, rarest first.

    In one order of all shingles, two linked sets share one of these. Where a passage is common among the classes of a head, its
    shingles come last, so that it brings together few of them.
    """
    every = measured.select("head", "class", F.explode("rest").alias("s"))
    times = every.groupBy("head", "s").agg(F.count("*").alias("times"))
    order = F.sort_array(F.collect_list(F.struct("times", "s")))
    ordered = every.join(times, ["head", "s"]).groupBy("head", "class").agg(order.alias("order"))
    needed = ordered.join(measured.select("head", "class", "need"), ["head", "class"])
    first = F.slice("order", F.lit(1), F.greatest(F.size("order") - F.col("need").cast("int") + 1, F.lit(0)))
    return needed.select("head", "class", F.posexplode(first).alias("at", "o")).select("head", "class", "at", "o.s")


def _remaining(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs of different components that may be linked, for the lists that heads did not finish."""
    entry = ["pair", "class", "root", "n"]
    sizes = marked.groupBy("pair", "root").agg(F.count("*").alias("c"))
    lists = sizes.groupBy("pair").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"))
    lists = lists.select("pair", F.col("m.root").alias("most"), (F.col("all") - F.col("m.c")).alias("left"))
    rows = staged(marked.join(lists, "pair"), "stragglers")
    few, many = rows.where(F.col("left") <= FEW), rows.where(F.col("left") > FEW)
    side = few.where("root <> most").select("pair", F.col("class").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"))
    pairs = few.select(*entry).join(side, "pair").where(OTHER).select("a", F.col("class").alias("b"))

    # any set will do to measure against: the most frequent within two steps, so that a group has one for all its lists
    ranked = F.struct((-F.col("weight")).alias("w"), F.col("class").alias("a"))
    firsts = many.groupBy("pair").agg(F.min(ranked).alias("first"))
    hubs = many.join(firsts, "pair").groupBy("class").agg(F.min("first").alias("hub"))
    heads = many.join(hubs, "class").groupBy("pair").agg(F.min("hub").alias("m")).select("pair", F.col("m.a").alias("head"))
    spokes = many.join(heads, "pair").groupBy("head", "class", "root", "n").agg(F.max(F.expr("root <> most")).alias("straggler"))
    spokes = staged(spokes, "spokes")
    words = texts.select("class", "text")
    wide = spokes.select("head", "class").join(words, "class").join(words.select(F.col("class").alias("head"), F.col("text").alias("text_head")), "head")
    found = wide.mapInArrow(_measured, "head bigint, class bigint, both bigint, need bigint, rest array<bigint>")
    found = staged(found.join(spokes, ["head", "class"]), "measured")
    mine = [F.col(c).alias(f"{c}_a") for c in ("class", "root", "n", "both")]
    asked = found.where("straggler")
    firsts = found.select("head", "class", "root", "n", "both", "straggler").join(_prefixes(found), ["head", "class"])
    firsts = staged(firsts, "prefixes")
    left = firsts.where("straggler").select("head", *mine, F.col("at").alias("at_a"), "s")
    shared = left.join(firsts, ["head", "s"])
    # the overlap is at most the smaller one within the head and, where this is the first shingle that both have, the smaller
    # number of those outside from here on; what is no first one may go, as the first one stays
    shared = shared.where((F.least("both", "both_a") + F.least(F.expr("n - both - at"), F.expr("n_a - both_a - at_a"))) * sum(LIMIT)
                          >= (F.col("n") + F.col("n_a")) * LIMIT[0])
    # 100 * both >= 75 * (n_a + n_b - both), for the largest overlap that is possible within the head
    most = (F.col("both") * sum(LIMIT) / LIMIT[0] - F.col("n"))
    lengths = F.sequence(F.floor(F.col("n") * LIMIT[0] / LIMIT[1]), F.floor(most).cast("bigint"))
    sized = asked.where(F.floor(most) >= F.floor(F.col("n") * LIMIT[0] / LIMIT[1])).select("head", *mine, F.explode(lengths).alias("n"))
    within = F.least("both", "both_a") * sum(LIMIT) >= (F.col("n") + F.col("n_a")) * LIMIT[0]
    sized = sized.join(found.select("head", "class", "root", "n", "both", "straggler"), ["head", "n"]).where(within)
    more = [p.where(OTHER).where(ONCE).select(F.col("class_a").alias("a"), F.col("class").alias("b")) for p in (shared, sized)]
    return pairs.unionAll(more[0]).unionAll(more[1]).distinct()


def _rank() -> Column:
    """Order of the heads of a list."""
    return F.struct((-F.col("weight")).alias("w"), F.col("class").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"))


def linked_classes(posts: DataFrame, texts: DataFrame) -> DataFrame | None:
    """class, root: classes that have links, with the name of their component; None without any list."""
    roots = edges = tested = None
    last = False
    for turn in range(ROUNDS + 1):
        marked = posts.withColumn("root", F.col("class")) if roots is None else (
            posts.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
        mixed = marked.groupBy("pair").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("pair")
        marked = staged(marked.join(mixed, "pair").select("pair", "class", "root", "weight", "n"), "marked")
        if marked.isEmpty():
            break
        last = last or turn == ROUNDS
        if last:
            pairs = _remaining(marked, texts)
        else:
            free = marked
            if turn:
                sizes = marked.groupBy("pair", "root").agg(F.count("*").alias("c"))
                largest = sizes.groupBy("pair").agg(F.max(F.struct("c", "root")).alias("m")).select("pair", F.col("m.root").alias("most"))
                free = marked.join(largest, "pair").where("root <> most")
            heads = free.groupBy("pair").agg(F.min(_rank()).alias("m")).select("pair", "m.a", "m.root_a", "m.n_a")
            pairs = marked.join(heads, "pair").where(OTHER).select("a", F.col("class").alias("b")).distinct()
        pairs = pairs.select("a", "b", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).dropDuplicates(["low", "high"])
        pairs = staged(pairs if tested is None else pairs.join(tested, ["low", "high"], "left_anti"), "pairs")
        compared = pairs.count()
        if compared:
            tested = pairs.select("low", "high") if tested is None else tested.unionAll(pairs.select("low", "high"))
            found = staged(_links(pairs.select("a", "b"), texts), "links")
            linked = found.count()
            if linked:
                edges = found if edges is None else edges.unionAll(found)
                roots = components(edges).select(F.col("node").alias("class"), "root")
        if last:
            break
        # once heads are linked with next to nothing, more of them would only be compared in vain
        last = not compared or linked < WORTH * compared
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """node, doc_id, n_shingles, component_id, kept: one row a document; node is its row key."""
    sketches = staged(sketch(docs), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("low", "high").agg(
        F.min(F.struct("node", "signature")).alias("m"), F.min("doc_id").alias("least"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = staged(classes.select("n", "low", "high", F.col("m.node").alias("class"), F.col("m.signature").alias("signature"), "least", "copies"), "classes")
    posts = staged(postings(classes), "postings")
    wanted = posts.select("class").distinct()
    texts = docs.select(row_key("doc_id", "text").alias("class"), "text").join(wanted, "class")
    texts = texts.groupBy("class").agg(F.first("text").alias("text"))  # equal rows share a key
    texts = staged(texts.join(classes.select("class", "signature"), "class"), "texts")
    roots = linked_classes(posts, texts)
    named = classes
    if roots is not None:
        named = classes.join(roots, "class", "left")
        root = F.coalesce("root", "class")
    else:
        root = F.col("class")
    named = staged(named.select("low", "high", "least", "copies", root.alias("root")), "roots")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"), F.sum("copies").alias("rows"))
    groups = groups.where("rows > 1")
    known = named.join(groups, "root").select("low", "high", "component_id")
    joined = sketches.join(known.withColumn("_known", F.lit(True)), ["low", "high"], "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("node", "doc_id", "n_shingles", component.alias("component_id"),
                         component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``: one document of each component stays, the one with the smallest doc_id. Of equal rows one
    stays too, but rows without words, which are linked with nothing, all do."""
    kept = near_duplicates(docs).where("kept").select("node", (F.col("n_shingles") == 0).alias("_blank")).distinct()
    rows = docs.select(row_key("doc_id", "text").alias("node"), carried(docs)).join(kept, "node")
    own = F.when(F.col("_blank"), F.monotonically_increasing_id())  # told apart, whatever the numbers are
    return rows.withColumn("_own", own).dropDuplicates(["node", "_own"]).select("row.*")
