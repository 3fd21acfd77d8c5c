"""Line dedup across documents by a deletion-neighbourhood join, in SQL functions only.

A line is dropped if an earlier one (order of doc_id, then place) has the same words, or, for lines of at least
``NEAR_WORDS`` words, words within an edit distance of one: a word replaced, added or taken out. The earliest of such
lines stays. Lines of fewer than ``MIN_WORDS`` words are left alone.

Each line has n deletion variants, one for each word left out, and two lines lie within the bound if

- they have n words each and share the variant without word i (a replaced word), or
- one is itself a variant of the other (an added word).

Lines that share a key of the first kind are within the bound of each other, all of them, so it is enough to
know the earliest; for the second kind, the earliest of either role. So no pairs within a group are ever made: keys are
aggregated to their earliest line and joined back. The earliest found is then compared word by word.

Variants are hashed in one pass over the words: words are hashed with their place, and with the place before it for
what follows a deletion; running exclusive-ors give all n variants. Before that, lines that cannot have a partner are set
aside: of q words in front, q behind and the rest (q is at most a third of the words) one edit touches one part only, so only
lines that share the other two parts with another line take part.

Nulls and odd input: a null text stays null and has no lines. Null doc_ids count as the last. Equal rows are one
document: none loses lines to the other. A document whose lines are all dropped has an empty text. Lines are cut at
line feeds only; blank and short lines stay. An empty table gives no rows. All input columns ride along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotbook.llm.rows import SPACE, carried, row_key
from lotbook.operators.rows import with_row_id
from lotbook.session import staged

MIN_WORDS, NEAR_WORDS = 5, 11


def plain(line: str) -> Column:
    """The words of a line with one space between them. Most lines have that form, which is cheap to see."""
    odd = F.startswith(F.col(line), F.lit(" ")) | F.endswith(F.col(line), F.lit(" "))
    for sign in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(F.col(line), F.lit(sign))
    words = F.filter(F.split(F.col(line), SPACE), lambda w: w != "")
    return F.when(odd, F.array_join(words, " ")).otherwise(F.col(line))


def _count(text: str, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(sign), F.lit("")))


def _q(n: Column) -> Column:
    """Words in a part that is compared: a multiple of three, at most a third of n - 1, so that two parts leave one word."""
    return (F.floor((n - 1) / 9) * 3).cast("int")


def _xor(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """ord (place in the order of lines), line (its words), n: lines of at least MIN_WORDS words"""
    # what is said beside an explode is worked out for each line, so the key comes first
    keyed = docs.where("text is not null").select("doc_id", row_key("doc_id", "text").alias("_key"), F.split("text", "\n", -1).alias("_lines"))
    lines = keyed.select("doc_id", "_key", F.posexplode("_lines").alias("_place", "_line"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("_key").alias("key"), F.col("_place").alias("place"))
    # conditions stay behind a generator, so a line is looked at once
    lines = lines.select(order.alias("ord"), F.explode(F.array(plain("_line"))).alias("line"))
    lines = lines.where("line <> ''").select("ord", "line", F.explode(F.array(_count("line", " ") + 1)).alias("n"))
    return lines.where(F.col("n") >= MIN_WORDS)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """ord, n, h (hash of the words), parts (keys of two parts of three, none for short lines)"""
    n = F.col("n")
    pairs = F.array_distinct(F.array(_q(n), _q(n - 1)))
    first = lambda q: F.call_function("substring_index", F.col("line"), F.lit(" "), q)
    keys = lambda q: F.array(F.xxhash64(F.lit(0), q, first(q), first(-q)), F.xxhash64(F.lit(1), q, first(2 * q)), F.xxhash64(F.lit(2), q, first(-2 * q)))
    parts = F.flatten(F.transform(pairs, keys))
    return numbered_lines(docs).select("ord", "n", F.xxhash64("line").alias("h"), F.when(n >= NEAR_WORDS, parts).alias("parts"))


def _variants(lines: DataFrame) -> DataFrame:
    """rank, n, i, vh: the hash of the words of a line without word i; i = 0 is the whole line."""
    marked = lines.select(
        "rank", "n",
        F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("at"),
        F.transform("words", lambda w, i: F.xxhash64(w, i - 1)).alias("before"),
    ).select("rank", "n", _xor(F.col("at")).alias("whole"), _xor(F.col("before")).alias("shifted"), F.arrays_zip("at", "before").alias("both"))
    marked = marked.select("rank", "n", "whole", "shifted", F.posexplode("both").alias("place", "w"))
    so_far = Window.partitionBy("rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    head = F.bit_xor("w.at").over(so_far).bitwiseXOR(F.col("w.at"))
    tail = F.col("shifted").bitwiseXOR(F.bit_xor("w.before").over(so_far))
    found = marked.select("rank", "n", "whole", "place", head.bitwiseXOR(tail).alias("vh"))
    # the first word stands for the whole line as well
    one = F.struct((F.col("place") + 1).alias("i"), F.col("vh").alias("vh"))
    whole = F.struct(F.lit(0).alias("i"), F.col("whole").alias("vh"))
    return found.select("rank", "n", F.explode(F.when(F.col("place") == 0, F.array(whole, one)).otherwise(F.array(one))).alias("v")).select("rank", "n", "v.*")


def within_one(a: str, b: str) -> Column:
    """Edit distance of two word lists at most one: what they share in front and behind leaves one word at most."""
    n_a, n_b = F.size(a), F.size(b)

    def shared(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(differs == 0, F.least(n_a, n_b).cast("bigint")).otherwise(differs - 1)

    both = shared(F.col(a), F.col(b)) + shared(F.reverse(a), F.reverse(b))
    return (F.abs(n_a - n_b) <= 1) & (both >= F.greatest(n_a, n_b) - 1)


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h: lines for which an earlier, different one lies within the bound. ``firsts``: h, n, ord, parts."""
    keys = firsts.where("parts is not null").select("h", F.explode("parts").alias("part"))
    shared = keys.groupBy("part").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("part")
    wanted = keys.join(shared, "part").select("h").distinct()
    wanted = firsts.where("parts is not null").join(wanted, "h").select("h", "n", "ord")
    # texts are looked up by document, and only the lines that are wanted are taken from them
    places = wanted.groupBy(F.col("ord.key").alias("_key")).agg(F.collect_list(F.struct("h", "n", "ord")).alias("of"))
    texts = docs.select(row_key("doc_id", "text").alias("_key"), "text").join(places, "_key").dropDuplicates(["_key"])
    cut = texts.select("of", F.split("text", "\n", -1).alias("cut"))
    lines = cut.select(F.explode(F.transform("of", lambda o: F.struct(o["h"].alias("h"), o["n"].alias("n"), o["ord"].alias("ord"), F.get("cut", o["ord"]["place"]).alias("line")))).alias("o")).select("o.*")
    lines = lines.select("h", "n", "ord", F.split(plain("line"), " ").alias("words"))
    lines = with_row_id(lines, ["ord", "h"], "rank")
    variants = staged(_variants(lines), "variants")

    replaced = variants.where("i > 0")
    cliques = replaced.groupBy("n", "i", "vh").agg(F.min("rank").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = replaced.join(cliques, ["n", "i", "vh"]).where("least < rank").select("rank", F.col("least").alias("earlier"))

    roles = variants.select("rank", F.when(F.col("i") > 0, F.col("n") - 1).otherwise(F.col("n")).alias("n"), "vh", (F.col("i") == 0).alias("whole"))
    ends = roles.groupBy("n", "vh").agg(
        F.min(F.when(F.col("whole"), F.col("rank"))).alias("least_whole"), F.min(F.when(~F.col("whole"), F.col("rank"))).alias("least_cut"))
    ends = ends.where("least_whole is not null and least_cut is not null")
    other = F.when(F.col("whole"), F.col("least_cut")).otherwise(F.col("least_whole"))
    added = roles.join(ends, ["n", "vh"]).select("rank", other.alias("earlier")).where("earlier < rank")

    first = found.unionAll(added).groupBy("rank").agg(F.min("earlier").alias("earlier"))
    mine = lines.select("rank", "h", F.col("words").alias("words_a"))
    theirs = lines.select(F.col("rank").alias("earlier"), F.col("words").alias("words_b"))
    return first.join(mine, "rank").join(theirs, "earlier").where(within_one("words_a", "words_b")).select("h")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row, text, n_lines, dropped: the text that is left, and the places of the dropped lines, from 0."""
    lines = staged(hashed_lines(docs), "lines")
    firsts = lines.groupBy("h", "n").agg(F.min("ord").alias("ord"), F.count("*").alias("times"), F.min("parts").alias("parts"))
    firsts = staged(firsts, "firsts")
    near = staged(near_lines(docs, firsts).withColumn("near", F.lit(True)), "near")
    known = firsts.join(near, "h", "left").where("times > 1 or near").select(
        "h", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h", "ord").join(known, "h").where("near or ord > first")
    gone = gone.select(F.col("ord.key").alias("_key"), F.col("ord.place").alias("place")).distinct()
    per_doc = gone.groupBy("_key").agg(F.sort_array(F.collect_list("place")).alias("_gone"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(_count("text", "\n") + 1)
    rows = docs.select(carried(docs), F.col("text").alias("_text"), row_key("doc_id", "text").alias("_key"), n_lines.alias("n_lines"))
    joined = rows.join(per_doc, "_key", "left").withColumn("_cut", F.split("_text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), "_gone")
    left = F.array_join(F.transform(places, lambda p: F.get("_cut", p)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left)
    return joined.select("row", text.alias("text"), "n_lines", F.coalesce("_gone", F.array().cast("array<int>")).alias("dropped"))
