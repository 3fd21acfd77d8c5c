"""Operators on documents against brute force, and on odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotbook.llm import brown, linedup, mixing, neardup, packing, pii, quality, token_ids
from lotbook.llm.queries import QUERIES, word_bpe_path


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_class_model_scores(spark, sf_dir, real):
    words = {i: (r["text"] or "").encode().lower().split() + [None] for i, r in real.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    tokens, types = sum(counts.values()), len(counts)
    gain = 0.0
    for row in QUERIES["op1_brown_scores"](spark, sf_dir).collect():
        mine = words[row["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (tokens + types + 1)) for w in mine)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert (row["n_tokens"], row["n_known"]) == (len(mine), sum(counts[w] > 0 for w in mine))
        assert (row["train_tokens"], row["held_out"]) == (tokens, held[row["doc_id"]])
        if row["held_out"]:
            gain += row["score"] - row["base_score"]
    assert gain > 0


def test_class_model_is_a_distribution(documents):
    """Over all next words, the unknown ones of each surface class included, the probabilities add up to one."""
    rng = random.Random(3)
    docs = documents([(i, " ".join(rng.choices(["aa", "bb", "cc.", "dd", "rare%d" % i], k=30)), "s") for i in range(40)])
    model = brown.train(docs, F.lit(False))
    edge = brown.CLASSES + brown.SURFACE
    for before in (edge, int(model.classes[0])):
        total = 10 ** model.transition[before, edge]
        for word, n in model.known.items():
            unit = model.units.get(word)
            c = int(model.classes[unit]) if unit is not None else edge - 1 - brown.surface(word)
            total += 10 ** (model.transition[before, c] + model.emission[c]) * (n if unit is not None else n - brown.DISCOUNT)
        assert total <= 1 + 1e-9


@pytest.mark.parametrize("spread", [1, 2])
def test_probabilities_add_up_to_one(documents, spread):
    """Over the end, all learnt words and the estimated unseen ones; no unseen word gets more than one seen once."""
    rng = random.Random(spread)
    words = ["aa", "bb", "cc.", "dd", *[f"r{'x' * (i % 14)}{i}{'.!a5'[i % 4]}" for i in range(60)]]
    docs = documents([(i, " ".join(rng.choices(words, weights=[40] * 4 + [spread] * 60, k=30)), "s") for i in range(40)])
    model = brown.train(docs, F.lit(False))
    edge = brown.CLASSES + brown.SURFACE
    surfaces = [edge - 1 - s for s in range(brown.SURFACE)]
    once = {s: model.emission[c] + math.log10(1 - brown.DISCOUNT) for s, c in enumerate(surfaces)}
    types = Counter(brown.surface(w) for w in model.known if w not in model.units)
    assert model.units and types and all(model.unknown[s] <= once[s] + 1e-12 for s in types)
    for before in range(edge + 1):
        total = 10 ** model.transition[before, edge]
        for word, n in model.known.items():
            unit = model.units.get(word)
            c = int(model.classes[unit]) if unit is not None else edge - 1 - brown.surface(word)
            total += 10 ** (model.transition[before, c] + model.emission[c]) * (n if unit is not None else n - brown.DISCOUNT)
        total += sum(10 ** (model.transition[before, c] + model.unknown[s]) * model.unseen[s] for s, c in enumerate(surfaces))
        assert total == pytest.approx(1, abs=1e-9)


def test_exchange_against_a_walk_over_words():
    """The class that a word moves to is the one that raises the likelihood of the class bigrams most, word by word."""
    rng = np.random.default_rng(7)
    words, count = 12, 5  # three classes that words move between, one fixed unit, the edge
    classes = np.concatenate([rng.integers(0, 3, words), [3, 4]])
    table = rng.integers(0, 9, (words + 2, words + 2)) * (rng.random((words + 2, words + 2)) < 0.6)
    pairs = np.zeros((count, count))
    np.add.at(pairs, (classes[:, None], classes[None, :]), table)
    first, second = np.nonzero(table)
    batch = pa.RecordBatch.from_pydict({"first": first, "second": second, "n": table[first, second]})
    moving = np.arange(words + 2) < words
    (contexts,) = brown._contexts(iter([batch]), classes, moving, count)
    found = brown._gains(contexts.to_pandas(), classes, pairs, 3).set_index("word")["best"]
    log = lambda x: math.log(max(x, 0) + 0.5)
    for w in found.index:
        gains = []
        for c in range(3):
            gain = 0.0
            out = pairs.sum(1) - (table[w].sum() if c == classes[w] else 0) * (np.arange(count) == c)
            into = pairs.sum(0) - (table[:, w].sum() if c == classes[w] else 0) * (np.arange(count) == c)
            for k in range(count):
                right, left = table[w][classes == k].sum(), table[:, w][classes == k].sum()
                gain += right * (log(pairs[c, k] - (right if c == classes[w] else 0)) - log(out[c]))
                gain += left * (log(pairs[k, c] - (left if c == classes[w] else 0)) - log(into[c]))
            gains.append(gain)
        assert gains[found[w]] == pytest.approx(max(gains))


def test_junk_scores_below_text(spark, sf_dir):
    """Random letters and shuffled words score below the real texts that were held out; known words alone beat the base."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = brown.train(docs, brown.held_out())
    real = [(r["doc_id"], r["text"]) for r in docs.where(brown.held_out()).collect() if r["text"]]
    junk = [(10**6 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(100))) for i in range(20)]
    mixed = [(2 * 10**6 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in real]
    learnt = set(map(bytes, model.known))
    known = [(3 * 10**6 + i, " ".join(w for w in t.split() if model.known.get(w.encode().lower()))) for i, t in real]
    assert learnt
    rows = spark.createDataFrame(real + junk + mixed + known, "doc_id bigint, text string")
    sums = {}
    for r in brown.score(rows, model, F.lit(False)).select("row.doc_id", "n_tokens", "base_score", "score").collect():
        n, base, score = sums.get(r["doc_id"] // 10**6, (0, 0, 0))
        sums[r["doc_id"] // 10**6] = (n + r["n_tokens"], base + r["base_score"], score + r["score"])
    per_token = [sums[k][2] / sums[k][0] for k in range(4)]
    assert per_token[1] < per_token[2] < per_token[0] < per_token[3]
    assert per_token[3] - sums[3][1] / sums[3][0] > 0.1


def brute_repeats(words):
    spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(hit)


def test_quality_counts(spark, sf_dir, real):
    for row in QUERIES["op2_quality_rules"](spark, sf_dir).collect():
        text = real[row["doc_id"]]["text"] or ""
        raw = text.encode().split()
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert row["n_words"] == len(raw)
        assert row["word_chars"] == sum(len(w.decode()) for w in raw)
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == brute_repeats(raw)
        failed = len(raw) < 10 or 100 * row["n_repeat_words"] > 20 * len(raw)
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_quality_accuracy_and_monotony(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect() if r["doc_id"] in labels]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] and not r["base_failed"]]
    assert sum(good) / len(good) > 0.95
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.FEATURES)))
    at = quality.FEATURES.index("symbols")
    model = quality.fit_trees(x, (x[:, at] + rng.normal(0, 0.2, 400) < 0.5).astype(int), np.arange(400) % 5 == 4)
    steps = np.repeat(x[:1], 50, axis=0)
    steps[:, at] = np.linspace(0, 1, 50)
    assert (np.diff(model.margin(steps)) <= 1e-12).all()


def test_lines_within_one_word(documents):
    rng = random.Random(1)
    base = [" ".join(rng.choices("abcdefghij", k=rng.randint(4, 16))) for _ in range(60)]
    lines = []
    for _ in range(500):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 2)] = [rng.choice("abcdefghijxyz")] if kind else []
        lines.append((" " if rng.random() < 0.1 else "") + "  ".join(words) if rng.random() < 0.1 else " ".join(words))
    docs = [(i, "\n".join(lines[10 * i : 10 * i + 10]), "s") for i in range(50)]

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < linedup.NEAR_WORDS:
            return a == b
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    seen, want = [], {}
    for i, text, _ in docs:
        for place, line in enumerate(text.split("\n")):
            words = line.split()
            if len(words) >= linedup.MIN_WORDS:
                if any(near(words, other) for other in seen):
                    want.setdefault(i, []).append(place)
                seen.append(words)
    got = {r["row"]["doc_id"]: r for r in linedup.dedup_lines(documents(docs)).collect()}
    for i, text, _ in docs:
        assert got[i]["dropped"] == want.get(i, [])
        assert got[i]["text"] == "\n".join(line for p, line in enumerate(text.split("\n")) if p not in want.get(i, []))


def brute_components(texts):
    sets = {i: neardup.shingles(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if neardup.similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("few", [neardup.FEW, 0])
def test_near_duplicates(documents, monkeypatch, few):
    """Copies, near copies around the threshold and a passage that all share; with no list counted as short, too."""
    monkeypatch.setattr(neardup, "FEW", few)
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(5_000)
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(60)] + passage for _ in range(4)]
    texts = {}
    for i in range(140):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = word()
        texts[i] = " ".join(words) if i % 20 else ["", None, "one", "one"][i // 20 % 4]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents([(i, t, "s") for i, t in texts.items()])).collect()}
    for i, (n, root) in brute_components(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, root == i)


def test_mix_reaches_targets(documents):
    rng = random.Random(2)
    docs = [(i, "w " * min(int(rng.lognormvariate(3, 1)), 300), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3_000)]
    rows = [r.asDict() for r in mixing.mix(documents(docs)).collect()]
    again = {r["row"]["doc_id"]: r["copies"] for r in mixing.mix(documents(docs).repartition(7)).collect()}
    assert {r["row"]["doc_id"]: r["copies"] for r in rows} == again
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, goal = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    free, left = set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            goal[s] = 2 * sizes[s] if over else level * weight[s]
            left -= goal[s] if over else 0
        free -= over or free
    taken, most = Counter(), max(r["size"] for r in rows)
    for r in rows:
        assert r["copies"] in (0, 1, 2)
        assert r["target"] == pytest.approx(goal[r["row"]["source"]])
        taken[r["row"]["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - goal[s]) <= most for s in order)


def test_pieces_and_packing(spark, sf_dir, real):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe_path())
    ids = {i: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for i, r in real.items()}
    rows = QUERIES["op9_best_fit_packing"](spark, sf_dir).collect()
    pieces, sequences = Counter(), {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        pieces[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {i: len(v) for i, v in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * sum(pieces.values()) / 2048 + 1


def test_sweeps_are_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(30):
        capacity = rng.choice([10, 50, 200])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 300))), reverse=True)
        runs = packing.sweeps(Counter(lengths), capacity)
        room, starts = {}, [r[0] for r in runs] + [len(lengths)]
        for (first, sequence, offset), end in zip(runs, starts[1:]):
            for k in range(first, end):
                free = room.setdefault(sequence + k - first, capacity)
                assert capacity - free == offset and free >= lengths[k]
                room[sequence + k - first] = free - lengths[k]
        bins = []
        for n in lengths:
            fits = [b for b in bins if b >= n]
            if fits:
                bins.remove(min(fits))
            bins.append((min(fits) if fits else capacity) - n)
        assert len(room) == len(bins)


def test_words_have_the_ids_of_texts():
    ids = token_ids.TokenIds(word_bpe_path())
    for text in ("<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's dogs'. l'eau I'LL 'S x's.", "ΌΣΟΣ. İst naïve É. e\u0301 Å", "12,300.50 x1. a1b ... %%%the###"):
        assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_surrogates(documents):
    texts = ["Mail bob.smith@mail7.example.com or BOB.SMITH@MAIL7.EXAMPLE.COM now.", "Call +1 (212) 555-1234 or +1 212-555-1234; ip 10.0.0.1.",
             "Card 4111 1111 1111 1111 and 4111111111111111.", "Herr Karl Möller met Frau Anna Möller; господин Иван Петров.",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00 ssn 123-45-6789', "clean 2019-2020, 3.14, 12:30, 100,000"]
    got = [r["text"] for r in pii.replace_entities(documents([(i, t, "s") for i, t in enumerate(texts)]), "key").orderBy("row.doc_id").collect()]
    import re

    mail = re.findall(r"\S+@\S+", got[0])
    assert mail[0].upper() == mail[1] and "bob" not in got[0].lower()
    phones = re.findall(r"\+1 \(?\d{3}\)?[ -]\d{3}-\d{4}", got[1])
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "2125551234" not in re.sub(r"\D", "", got[1])
    cards = re.findall(r"\d[\d ]{14,18}\d", got[2])
    assert len({c.replace(" ", "") for c in cards}) == 1 and cards[0] != "4111 1111 1111 1111"
    digits = [int(c) for c in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    names = re.findall(r"(?:Herr|Frau) (\w+) (\w+)", got[3])
    assert names[0][1] == names[1][1] != "Möller" and re.search(r"господин [А-Яа-я]+ [А-Яа-я]+\.", got[3])
    iban = re.search(r"DE[\d ]+\d", got[4]).group(0).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[5] == texts[5]


def test_surrogates_stay_distinct(documents):
    """All 1,000 last three digits of a format with few values are drawn: collisions are drawn again."""
    rows = [(i, f"call (12) 345-{i:04d}", "s") for i in range(600)]
    got = [r["text"] for r in pii.replace_entities(documents(rows), "key").collect()]
    assert len(set(got)) == 600 and not set(got) & {t for _, t, _ in rows}


def test_surrogates_of_full_formats(documents):
    """All values of two formats, and mails without a letter or digit before the last label."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = [f"{a}{b}@two.com" for a in letters for b in letters] + [f"{a}@one.com" for a in letters] + ["-@-.com", "--@-.com"]
    rows = pii.replace_entities(documents([(i, f"to {t} now", "s") for i, t in enumerate(found)]), "key").orderBy("row.doc_id").collect()
    got = [r["text"][3:-4] for r in rows]
    assert len(set(got)) == len(found) and not set(got) & set(found)
    assert all(re.fullmatch(r"[a-z]{2}@[a-z]{3}\.com", g) for g in got[:676])
    assert all(re.fullmatch(r"[a-z]@[a-z]{3}\.com", g) for g in got[676:702])
    assert re.fullmatch(r"-[a-z]@-\.com", got[702]) and re.fullmatch(r"--[a-z]@-\.com", got[703])


def test_values_of_a_format_are_counted_once(spark):
    canons = [("mail", "a-1@x.com"), ("card", "4111111111111111"), ("card", "4111111111111112"), ("phone", "12125551234"), ("ssn", "123456789"),
              ("ip", "1.2.3.4"), ("secret", "0" * 32), ("iban", "DE89370400440532013000"), ("name.female", "anna"), ("name.surname", "петров")]
    rows = spark.createDataFrame(canons, "kind string, canon string")
    kind, canon = F.col("kind"), F.col("canon")
    for wider in (0, 2):
        template, frame = pii._format(kind, canon, "key", wider)
        shaped = rows.select("kind", "canon", template.alias("template"), frame.alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(699))).alias("i"))
        made = shaped.select("kind", "canon", pii._value(kind, F.col("template"), F.col("frame"), "key", F.col("i")).alias("v")).where("v.rest = 0")
        counts = {(r["kind"], r["canon"]): (r["n"], r["d"]) for r in made.groupBy("kind", "canon").agg(
            F.count("*").alias("n"), F.countDistinct("v.value").alias("d")).collect()}
        few = 260 if wider == 0 else 700  # a letter and a digit
        assert counts == {c: (few if c[0] == "mail" else 700,) * 2 for c in canons}


def test_names_without_a_title_and_in_other_scripts(documents):
    texts = ["Anna came. Mrs Anna Schmidt's house; Schmidt, ANNA and Anna Schmidt's. Annabel and Mr X. stay.", "Anna Schmidt without a title stays.",
             "Mr Γιώργος Παπάς and Παπάς.", "Mr Արամ, Dr გიორგი; Mrs שרה אמרה שרה; Mr علي قال; Ms सीता"]
    rows = pii.replace_entities(documents([(i, t, "s") for i, t in enumerate(texts)]), "key").orderBy("row.doc_id").collect()
    got = [r["text"] for r in rows]
    given, surname = re.search(r"Mrs (\w+) (\w+)'s", got[0]).groups()
    assert got[0] == f"{given} came. Mrs {given} {surname}'s house; {surname}, {given.upper()} and {given} {surname}'s. Annabel and Mr X. stay."
    assert not {given, surname} & {"Anna", "Schmidt"} and got[1] == texts[1]
    assert (rows[0]["n_replaced"], rows[0]["kinds"]) == (6, "name=6")
    assert re.fullmatch(r"Mr [Α-ω]+ ([Α-ω]+) and \1\.", got[2])
    assert re.fullmatch(r"Mr [Ա-և]+, Dr [ა-ჿ]+; Mrs ([א-ת]+) אמרה \1; Mr [ء-ي]+ قال; Ms [ऀ-ॿ]+", got[3])
    assert not any(n in got[2] + got[3] for n in ("Παπάς", "Արամ", "გიორგი", "שרה", "علي", "सीता"))


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_input(spark, request, name):
    docs = request.getfixturevalue(name)
    n = docs.count()
    assert quality.judge(docs, quality.ACCEPT_ALL).count() == n
    lines = linedup.dedup_lines(docs).collect()
    assert len(lines) == n and all(r["text"] is None for r in lines if r["row"]["doc_id"] == 1)
    near = neardup.near_duplicates(docs).collect()
    assert len(near) == n
    assert {r["component_id"] for r in near if r["doc_id"] in (5, 6)} <= {5}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == n and all(r["copies"] * r["size"] <= 2 * r["size"] for r in mixed)
    assert packing.pack(packing.pieces(docs, word_bpe_path())).count() >= n
    assert pii.replace_entities(docs, "key").count() == n
    scored = brown.score(docs, brown.train(docs, brown.held_out()), brown.held_out()).collect()
    assert len(scored) == n and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in scored)


def test_stages_keep_the_columns(spark, sf_dir, documents):
    docs = documents([(i, f"Some words of document {i} that are, all in all, not so many. " + "And a few more of them here. " * 2, "s") for i in range(40)] )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes, name


def test_pipeline(spark, sf_dir, real):
    rows = QUERIES["pipeline"](spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(real)
    assert all(r["offset"] + r["length"] <= 2048 for r in rows)


def _keyed(rows):
    return sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in rows), key=repr)


def test_stages_on_odd_input(spark, sf_dir, odd, empty):
    """Nulls, blanks, ties, repeated rows, a long text, clashing columns: what each stage makes of them."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, empty, sf_dir).count() == 0, name
    columns = odd.columns
    rows = {name: stages[name](spark, odd, sf_dir) for name in ("quality_rules", "line_dedup", "near_dedup", "mix_sources")}
    for name, df in rows.items():
        assert df.columns == columns, name
    # fewer than ten words, or one word over and over: only the row without a number can pass the base rules
    assert {r["doc_id"] for r in rows["quality_rules"].collect()} <= {None}
    # the line of 5 comes first, so 6 has none left and goes; equal rows are both first; documents that never had words stay
    assert _keyed(rows["line_dedup"].collect()) == _keyed(r for r in odd.collect() if r["doc_id"] != 6)
    # one row of 5, 5, 6; blank rows are linked with nothing
    near = [(1, ""), (2, ""), (3, " \n\t "), (None, "no nu"), (5, "same "), (7, "word "), (8, "x"), (8, "y")]
    assert _keyed(rows["near_dedup"].collect()) == sorted(near, key=repr)
    # blank rows count nothing in a mix, so they may stay; no row is taken more than twice
    before, taken = (Counter(_keyed(r)) for r in (odd.collect(), rows["mix_sources"].collect()))
    assert taken and all(n <= 2 * before[k] for k, n in taken.items())
    packed = stages["best_fit_packing"](spark, odd, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert {r["length"] for r in packed if r["doc_id"] in (1, 2, 3)} == {1}


def test_blank_rows_all_stay(documents):
    rows = [(5, "", "s"), (5, "", "s"), (6, None, "s"), (6, None, "s"), (7, "a b c", "s"), (7, "a b c", "s")]
    left = neardup.drop_near_duplicates(documents(rows)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in left) == [5, 5, 6, 6, 7]


def test_frequent_words_come_as_text_from_one_part_at_least():
    """A word with its share of all tokens is named in some part, rare ones in none; the counts are whole."""
    import pyarrow as pa

    from lotbook.llm import brown

    rare = [f"r{i}" for i in range(200_000)]
    texts = ["the " * 3 + " ".join(rare[i : i + 1000]) for i in range(0, len(rare), 1000)] + ["the cat"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([False] * len(texts))], names=["_text", "held_out"])
    parts = [r for part in brown._counted(iter([batch])) for r in part.to_pylist()]
    total = sum(r["total"] for r in parts)
    assert total == sum(len(t.split()) for t in texts)
    named = {r["word"] for r in parts if r["word"]}
    assert b"the" in named and not any(w.startswith(b"r") for w in named)


def test_conditions_on_lines_do_not_repeat_their_making(spark):
    """The words of a line are made and counted once, however many conditions read them."""
    docs = spark.createDataFrame([(1, "a b c  d e f\n\n a b\tc d e f\na b")], "doc_id bigint, text string")
    lines = linedup.numbered_lines(docs)
    assert [(r["line"], r["n"]) for r in lines.collect()] == [("a b c d e f", 6)] * 2
    assert lines._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 5


def test_sketch_remembers_a_fixed_number_of_words(monkeypatch):
    """Signatures do not depend on how many hashed words a task remembers."""
    import pyarrow as pa

    texts = [" ".join(f"w{i * j % 97}" for j in range(60)) for i in range(1, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(29)), pa.array(range(29)), pa.array(texts)], names=["node", "doc_id", "text"])
    (whole,) = neardup._sketch(iter([batch]))
    monkeypatch.setattr(neardup, "WORDS_KEPT", 7)
    (small,) = neardup._sketch(iter([batch]))
    assert whole.equals(small)


def test_every_word_seen_often_enough_has_a_learnt_class(documents, monkeypatch):
    """Also words that are no heads; the score is that of the path through all classes, and the probabilities add up to one."""
    monkeypatch.setattr(brown, "BROADCAST", 2.0**-5)
    rng = random.Random(5)
    kinds = [["der", "die", "das"], [f"noun{'x' * (i % 5)}{i}" for i in range(30)], [f"verb{i}." for i in range(20)]]
    texts = [" ".join(rng.choice(kinds[j % 3]) for j in range(30)) + (" odd%d" % i if i % 3 else "") for i in range(60)]
    docs = documents([(i, t, "s") for i, t in enumerate([*texts, "", "noun1 odd1 never seen der"])])
    held = F.col("doc_id") >= 60
    model = brown.train(docs, held)
    counts = Counter(w.encode() for t in texts for w in t.split())
    (keys,) = [dict(zip(counts, brown._key(list(counts)).tolist()))]
    tail = {r["key"]: r for r in model.counts.collect()}
    edge = brown.CLASSES + brown.SURFACE
    assert set(model.units) and len(model.units) < 10 and set(tail) == {keys[w] for w in counts if w not in model.known}
    often = [w for w, n in counts.items() if n >= brown.LEAST and w not in model.known]
    assert len(often) > 30
    classes, logs = {None: edge}, {}
    for w, n in counts.items():
        if w in model.units:
            c = int(model.classes[model.units[w]])
        else:
            c = tail[keys[w]]["cls"] if keys[w] in tail else edge - 1 - brown.surface(w)
        assert (c < brown.CLASSES) == (n >= brown.LEAST)
        classes[w], logs[w] = c, math.log10(n - (0 if c < brown.CLASSES else brown.DISCOUNT)) + model.emission[c]
    for before in range(edge + 1):
        total = 10 ** model.transition[before, edge] + sum(10 ** (model.transition[before, classes[w]] + logs[w]) for w in counts)
        total += sum(10 ** (model.transition[before, edge - 1 - s] + model.unknown[s]) * model.unseen[s] for s in range(brown.SURFACE))
        assert total == pytest.approx(1, abs=1e-9)
    monkeypatch.setattr(brown, "TOKENS", 50)
    rows = {r["doc_id"]: r for r in brown.score(docs, model, held).select("row.doc_id", "n_tokens", "n_known", "score").collect()}
    for r in docs.collect():
        words = [w.encode().lower() for w in r["text"].split()]
        path = [edge, *[classes.get(w, edge - 1 - brown.surface(w)) for w in words], edge]
        score = sum(model.transition[a, b] for a, b in zip(path, path[1:])) + sum(logs.get(w, model.unknown[brown.surface(w)]) for w in words)
        assert rows[r["doc_id"]]["score"] == pytest.approx(score)
        assert rows[r["doc_id"]]["n_known"] == sum(w in counts for w in words) + 1
