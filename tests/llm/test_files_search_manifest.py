"""Token files, ranked search and the manifest against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import differences, oracle_connection
from lotbook.llm import lexical, merkle, token_ids, wavelet
from lotbook.llm.queries import ORACLES, QUERIES, word_bpe_path
from lotbook.session import scratch_path


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_merkle_manifest"])
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), oracle_connection(sf_dir), ORACLES[name]) is None


# --- token ids ----------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("remembered, stretch, longest", [(800_000, 8 << 20, 12), (40, 60, 200)])
def test_texts_are_cut_as_the_tokenizer_cuts_them(monkeypatch, remembered, stretch, longest):
    """Also with a memory that is full all the time, and in short stretches."""
    monkeypatch.setattr(token_ids, "REMEMBERED", remembered)
    monkeypatch.setattr(token_ids, "STRETCH", stretch)
    rng, tok = random.Random(5), tokenizer()
    pool = [*map(chr, range(0x260)), *"'''''sstremvelld  <||>0123 İΣσςабв中文😀̀̈​ 　ﬁ﷐½²", "<|endoftext|>", "'re", "don't"]
    ids = token_ids.TokenIds(word_bpe_path())
    for turn in range(400):
        letters = pool if turn % 2 else list("abcdeXY'.,12 \n(")
        texts = ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(10)] + [None]
        got = list(ids.of_all(pa.array(texts)))
        assert [g for g in got] == [ids_of(tok, t).tobytes() for t in texts]
        assert len(ids.known) <= remembered


# --- wavelet matrices ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n, kinds", [(0, 5), (1, 5), (9, 2), (5_000, 3), (140_000, 49_408), (70_000, 100_000)])
def test_shard_against_the_list_of_ids(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1).astype(np.uint32)
    shard = wavelet.Shard(wavelet.to_file(ids, [7] if n else [], [n] if n else [], part=3, start=11) + b"\n")
    assert (shard.tokens() == ids).all() and (shard.n, shard.part, shard.start) == (n, 3, 11)
    for place in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
        assert shard.token(place) == ids[place]
    for token in {0, 1, kinds - 1, kinds, 1 << 20, *ids[:3].tolist()}:
        places = np.flatnonzero(ids == token).tolist()
        assert shard.count(token) == len(places)
        assert shard.find(token, 1, 7) == places[1:8]
        assert shard.count(token, n // 3, n // 2) == sum(n // 3 <= p < n // 2 for p in places)
    with pytest.raises(IndexError):
        shard.token(n)


def test_no_token_file():
    with pytest.raises(ValueError):
        wavelet.Shard(bytes(wavelet.struct.calcsize(wavelet.HEADER)))


def test_files_give_back_all_documents(spark, sf_dir):
    """Many small files: ids, starts, counts and places are those of the texts."""
    tok, docs = tokenizer(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "files")
    wavelet.write(docs, folder, word_bpe_path(), shard=20_000)
    assert wavelet.files(spark, folder).count() > 8
    wanted, start, counts, places = [], 0, Counter(), []
    for row in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.append(ids_of(tok, row["text"]), np.uint32(1)).astype("<u4")
        wanted.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        counts.update(ids.tolist())
        places += [(row["doc_id"], int(p)) for p in np.flatnonzero(ids == 267)]
    got = wavelet.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == wanted
    found = {r["token"]: r["n"] for r in wavelet.count_tokens(spark, folder, [0, 1, 267, 99_999]).collect()}
    assert found == {t: counts[t] for t in (0, 1, 267, 99_999)}
    assert sorted(map(tuple, wavelet.find_token(spark, folder, 267).collect())) == places


def test_files_of_odd_input(spark, odd, empty):
    folder = scratch_path(spark, "odd")
    wavelet.write(odd, folder, word_bpe_path(), shard=10_000)
    tok = tokenizer()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"] or "")))
    got = wavelet.read_documents(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]  # the null number first
    sums = [zlib.crc32(np.append(ids_of(tok, r["text"]), np.uint32(1)).astype("<u4").tobytes()) for r in rows]
    assert sorted(r["ids_crc32"] for r in got) == sorted(sums)
    nothing = scratch_path(spark, "nothing")
    wavelet.write(empty, nothing, word_bpe_path())
    assert wavelet.read_documents(spark, nothing).collect() == []
    assert wavelet.count_tokens(spark, nothing, [1]).collect() == []


# --- ranked search -------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(docs, items, best):
    counted = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in items:
        rows = []
        for doc_id, c, n in counted:
            m = 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall((text or "").translate(SMALL))) if c[t]
            )
            if score > 0:
                rows.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        found += [(item, place, doc_id, -score) for place, (score, _, doc_id) in enumerate(sorted(rows, key=lambda r: r[:2])[:best], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("chunk, cells, part_bytes", [(4096, 4_000_000, 1 << 20), (3, 30, 60)])
def test_search_against_brute_force(spark, documents, monkeypatch, chunk, cells, part_bytes):
    """Also in tries of three documents, few items at a time, and items in several parts; with ties and copies."""
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "ITEM_BYTES", part_bytes)
    rng = random.Random(2)
    words = ["a", "bb", "Ünï", "c3", "D", "ee", "ff", "gg", "hh", "ii", "中文", "jj"]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 25))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[3]) for i in range(9)] + [(None, texts[3]), (500, None), (501, "?!.")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((1, 2, 3, 5, 8, 12))] + [(9, None), (10, "..."), (11, "zz")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical.search(documents([(i, t, "s") for i, t in docs]).repartition(3), frame, best=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 7)


def test_search_of_odd_input(spark, documents, odd, empty):
    items = spark.createDataFrame([(1, "same WORDS"), (1, "same WORDS"), (None, "word"), (3, None)], "item_id bigint, text string")
    rows = lexical.search(odd, items).collect()
    assert Counter(r["item_id"] for r in rows) == {1: 2 * 4, None: 1}  # repeated rows, and repeated items, take places each
    assert [r["doc_id"] for r in rows if r["item_id"] is None] == [7]
    assert lexical.search(empty, items).collect() == [] == lexical.search(odd, items.where("item_id > 7")).collect()


def test_bounds_hold_and_cut_off():
    """No document below a node scores more than its bound, and a walk leaves documents unscored."""
    rng = np.random.default_rng(1)
    leaves = []
    for i in range(300):
        terms = np.flatnonzero(rng.random(40) < np.linspace(0.9, 0.05, 40))
        if len(terms):
            leaves.append(lexical.Node(terms, rng.integers(1, 5, len(terms)), int(rng.integers(50, 200)), 1, i))
    weights = np.zeros((40, 6))
    for item in range(6):
        weights[rng.choice(40, 5, replace=False), item] = rng.integers(1, 9000, 5)
    found, every = lexical.Search(weights, 3), np.arange(6)

    def below(node):
        return [node] if not node.children else [leaf for c in node.children for leaf in below(c)]

    def check(node):
        bound = found._scores(node, every)
        assert len(below(node)) == node.size
        for leaf in below(node):
            assert (found._scores(leaf, every) <= bound).all()
        for child in node.children:
            check(child)

    root = lexical.tree(leaves)
    check(root)
    seen = []
    plain = found._scores
    found._scores = lambda node, items: seen.append(0 if node.children else len(items)) or plain(node, items)
    found.walk(root, list(range(300)))
    assert 18 <= sum(seen) < 0.8 * 6 * len(leaves)  # documents that are scored for an item


# --- the manifest --------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, place, found, fanout):
    """Siblings from the leaf up, and the root with ``found`` in place of the leaf."""
    siblings = []
    for level in levels[:-1]:
        first = place // fanout * fanout
        run = level[first : first + fanout]
        siblings += [x for j, x in enumerate(run) if first + j != place]
        run[place - first] = found
        place, found = place // fanout, h(*run)
    return siblings, found


def brute_manifest(rows, fanout):
    groups = {}
    for r in rows:
        told = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        changed = list(told)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            changed[3] += 1
        groups.setdefault(r["lang"], []).append((r["doc_id"], h(*map(field, told)), h(*map(field, changed))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([leaf for _, leaf, _ in groups[g]], fanout)
    top = brute_tree([trees[g][-1][0] for g in order], fanout)
    found = []
    for place, g in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(groups[g]):
            below, subroot = climb(trees[g], i, changed, fanout)
            above, root = climb(top, place, subroot, fanout)
            found.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*below, *above), root, root == top[-1][0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("fanout, block", [(2, 4096), (2, 4), (3, 9), (5, 5), (7, 100)])
def test_manifest_against_brute_force(spark, documents, monkeypatch, fanout, block):
    """Blocks of a few leaves make several rounds; groups of 1 to 40 rows, and many of them."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, f"text {i}" * rng.randint(0, 3), rng.choice(["s", None])) for i in range(90)] + [(5, "twice", "s")] * 3
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") < 40, "en").when(F.col("doc_id") < 55, None)
                                      .when(F.col("doc_id") < 60, "é").otherwise(F.concat(F.lit("l"), "doc_id")))
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars"))).repartition(3)
    got = merkle.verify_documents(docs, fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(docs.collect(), fanout)


def test_manifest_of_odd_input(odd, empty):
    assert sorted(map(tuple, merkle.verify_documents(odd).collect()), key=repr) == brute_manifest(odd.collect(), 2)
    assert merkle.verify_documents(empty).collect() == []
    one = odd.where("doc_id = 2")
    assert sorted(map(tuple, merkle.verify_documents(one).collect()), key=repr) == brute_manifest(one.collect(), 2)


def test_states_and_constants():
    assert [hex(x) for x in merkle.START[:2]] == ["0x6a09e667", "0xbb67ae85"] and hex(merkle.ROUNDS[63]) == "0xc67178f2"
    nodes = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(11)), np.uint8).reshape(-1, 32)
    grown, states = merkle._grow(nodes, 2, 4)
    assert [x.tobytes().hex() for x in grown[1]] == [h(*[n.tobytes().hex() for n in nodes[i : i + 4]]) for i in (0, 4, 8)]
    # the state before slot 2 is that behind the first two children
    behind = merkle._start(1)
    for i in (4, 5):
        behind = merkle.compress(behind, merkle._as_block(nodes[i : i + 1]))
    assert (states[0][1, 1] == behind[:, 0]).all()
