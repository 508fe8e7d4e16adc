"""The operators over documents: brute force, planted cases, and hostile inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from leafmill.llm import decontaminate, lang_id, license_scan, lm, near_dup, packing, quality
from leafmill.llm.queries import vocabulary
from leafmill.llm.textkernels import shingle_sets, word_hashes
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty, blank, short, repeated, odd white space and characters, and one very long text.
HOSTILE = [None, "", " \n\t ", "a", "one two three four", "One TWO three four", "É é\x1cx\x85y  z", "a b c d e f g h", "a b c d e f g h", "!!! ???", "w" * 40000, "word " * 30000]


def docs(spark, texts, **more):
    rows = [(i, t, *(c[i] for c in more.values())) for i, t in enumerate(texts)]
    kinds = {"lang": "string", "train": "boolean"}
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} {kinds[k]}" for k in more))


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [prose(rng, rng.randint(30, 120), words) for _ in range(25)]
    texts = list(HOSTILE)
    for b in base:
        texts.append(b)
        for _ in range(rng.randint(0, 6)):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    hub = prose(rng, 80, words).split()
    for _ in range(300):  # one large group around one text
        w = list(hub)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts


def test_near_duplicates_match_brute_force(spark, copies):
    got = near_dup.near_duplicates(docs(spark, copies).withColumn("digest", F.lit("clash"))).orderBy("doc_id").collect()
    sets = [shingles(t) for t in copies]
    want = near_dup.exact_links(sets)
    assert [r.component_id for r in got] == want.tolist()
    assert [r.n_shingles for r in got] == [len(s) for s in sets]
    assert [r.kept for r in got] == [i == c for i, c in enumerate(want)]
    assert all(got[i].component_id == i for i in (0, 1, 2))


def test_near_duplicates_repeated_rows_and_empty(spark):
    twice = docs(spark, ["a b c d e f", "x"]).union(docs(spark, ["a b c d e f", "x"]))
    assert sorted(map(tuple, near_dup.near_duplicates(twice).collect())) == [(0, 2, 0, True)] * 2 + [(1, 1, 1, True)] * 2
    assert near_dup.near_duplicates(twice.limit(0)).count() == 0


def test_register_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:1600]), np.sort(pool[400:2000])
    regs = near_dup.registers(np.concatenate([a, b]), np.array([1600, 1600]), 400)
    less, more = [np.array([x]) for x in ((regs[0] < regs[1]).sum(), (regs[0] > regs[1]).sum())]
    estimate = near_dup.likely_similarity(less, more, 400, np.array([1600.0]), np.array([1600.0]))[0]
    assert abs(estimate - 1200 / 2000) < 0.1
    # Sketches merge by maximum.
    both = near_dup.registers(np.sort(pool[:2000]), np.array([2000]), 400)[0]
    assert (np.maximum(regs[0], regs[1]) == both).all()


def test_long_texts_hash_alike():
    text = b"Alpha beta GAMMA " * 200_000
    (h, n), (g, m) = word_hashes([text]), word_hashes([text[:1700]])
    assert n[0] == 600_000 and m[0] == 300 and (h[:300] == g).all()
    assert shingle_sets([b"", b"  ", b"a b", b"A  b"])[1].tolist() == [0, 0, 1, 1]
    assert len(set(shingle_sets([b"a b", b"A  b"])[0].tolist())) == 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pool = [f"t{i}" for i in range(60)] + ["é", "the"] * 20
    items = [(i, prose(rng, n, pool)) for i, n in enumerate([3, 13, 14, 40, 20, 1])] + [(6, None), (7, "..."), (8, ""), (None, "t1 t2")]
    items.append((9, items[3][1]))
    texts = list(HOSTILE)
    for _ in range(40):
        w = prose(rng, rng.randint(5, 90), pool).split()
        for _ in range(rng.randint(0, 3)):
            source = items[rng.randrange(5)][1].split()
            a = rng.randrange(len(source))
            w[rng.randrange(len(w)) :] = source[a:] + w[rng.randrange(len(w)) :]
        texts.append(rng.choice([" ", "--", ", "]).join(w))
    texts.append("(" + items[3][1].upper() + ")!" + items[3][1])
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for s in range(max(1, len(w) - 12)):
                wins.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    want = []
    for d, t in enumerate(texts):
        w, hit, named = words(t), set(), set()
        for k, ids in wins.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    named |= ids
        want.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert list(map(tuple, decontaminate.contamination(docs(spark, texts), table).orderBy("doc_id").collect())) == want
    monkeypatch.setattr("leafmill.llm.wordcols.BROADCAST_BYTES", 0)  # the way for large benchmarks
    assert list(map(tuple, decontaminate.contamination(docs(spark, texts), table).orderBy("doc_id").collect())) == want
    assert decontaminate.contamination(docs(spark, texts).limit(0), table).count() == 0
    assert decontaminate.contamination(docs(spark, texts[:3]), table.limit(0)).where("contaminated").count() == 0


def near_by_hand(texts, items, width, slop):
    """doc -> (items, places of the rarest term) with all words of a window in a run of its size + slop words."""
    said = [words(t) for t in texts]
    count = Counter(w for t in said for w in t)
    found = {}
    for name, text in items:
        w = words(text)
        for k in {tuple(w[s : s + width]) for s in range(max(1, len(w) - width + 1))} - {()}:
            rarest = min((count[t], k.index(t), t) for t in k)[2]
            for d, t in enumerate(said):
                for p in [p for p, x in enumerate(t) if x == rarest]:
                    span = len(k) + slop
                    if any(set(k) <= set(t[s : s + span]) for s in range(max(0, p - span + 1), p + 1)):
                        found.setdefault(d, (set(), set()))[0].add(name)
                        found[d][1].add(p)
    return {d: (len(i), len(p)) for d, (i, p) in found.items()}


@pytest.mark.parametrize("slop", [0, 1, 4])
def test_proximity(spark, slop, monkeypatch):
    rng = random.Random(slop)
    pool = [f"t{i}" for i in range(12)]
    items = [(i, prose(rng, n, pool)) for i, n in enumerate([1, 2, 4, 5, 9])] + [(5, "alpha beta"), (6, None), (7, "t1 t1 t2"), (None, "t1 t2")]
    texts = ["x beta far alpha y", "alpha", "beta a b c d e f alpha", *HOSTILE] + [" ".join(prose(rng, rng.randint(1, 60), pool).split()) for _ in range(30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = near_by_hand(texts, [i for i in items if i[0] is not None], 4, slop)
    got = lambda: {r.doc_id: (r.n_items, r.n_places) for r in decontaminate.near_phrases(docs(spark, texts), table, slop, 4).collect()}
    assert (0 in want) == (slop > 0) and got() == want
    monkeypatch.setattr("leafmill.llm.wordcols.BROADCAST_BYTES", 0)
    assert got() == want
    assert decontaminate.near_phrases(docs(spark, texts).limit(0), table).count() == 0


def test_proximity_shuffles_only_postings_that_may_count(spark, monkeypatch):
    """Common words of the phrases are in every text; their postings don't travel."""
    kept_plans = []
    plain = decontaminate.written

    def noted(df, kind="stage"):
        if kind == "near":
            kept_plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, kind)

    monkeypatch.setattr(decontaminate, "written", noted)
    texts = ["the of and to in rare seldom the of", "the of and to in the of and"] * 3 + ["rare of the to and in seldom"]
    table = spark.createDataFrame([(0, "the of and to in rare seldom")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_places) for r in decontaminate.near_phrases(docs(spark, texts), table).collect()}
    assert got == near_by_hand(texts, [(0, "the of and to in rare seldom")], 13, 3) and set(got) == {0, 2, 4, 6}
    assert len(kept_plans) == 1 and "LeftSemi" in kept_plans[0]


def test_rows_of_one_doc_id_stay_apart(spark):
    """A phrase cut over two rows of a doc_id is no match."""
    rows = spark.createDataFrame([(1, "a b x x"), (1, "y y c d"), (2, "-a b c d"), (3, "A b c d e")], "doc_id long, text string")
    item = spark.createDataFrame([(0, "A b, c d")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(rows, item).collect()}
    assert got == {(1, 4, 0, False), (2, 4, 4, True), (3, 5, 4, True)}


def test_licenses_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    names = list(license_scan.TEMPLATES)
    texts = list(HOSTILE)
    for k in range(60):
        w = license_scan.TEMPLATES[names[k % len(names)]].split()
        for _ in range(k // 12):
            w[rng.randrange(len(w))] = "altered"
        texts.append(prose(rng, 50, ["foo", "bar", "baz"]) + " " + " ".join(w) + " " + prose(rng, 30, ["foo", "bar"]))

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for d, t in enumerate(texts):
        own = grams(t)
        for n, body in license_scan.TEMPLATES.items():
            shared, size = len(own & grams(body)), len(grams(body))
            if 100 * shared >= 75 * size:
                want[d, n] = (shared, size)
    rows = license_scan.license_matches(docs(spark, texts))
    assert {(r.doc_id, r.template_id): (r.n_shared, r.n_shingles) for r in rows.collect()} == want
    assert len(want) > 25
    monkeypatch.setattr("leafmill.llm.wordcols.BROADCAST_BYTES", 0)
    rows = license_scan.license_matches(docs(spark, texts))
    assert {(r.doc_id, r.template_id): (r.n_shared, r.n_shingles) for r in rows.collect()} == want
    assert license_scan.license_matches(docs(spark, texts).limit(0)).count() == 0


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(vocabulary()), packing.WordEncoder(vocabulary())
    rng = random.Random(3)
    alphabet = "aÀé́ß İıΣσς'sS'LLtd <|endoftext|> \n\t\r   \x1c\x85​漢字1½²ⅷ!?…<|startoftext|>�가가 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|> B<|ENDOFTEXT|>c it's"]
    for t in texts:
        assert own.encode([t])[0] == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    texts = [*HOSTILE, *(f"word {i} " * (i * 7 % 150) for i in range(120))]
    rows = packing.pack_documents(docs(spark, texts), vocabulary(), 256, with_ids=True).collect()
    n = check_packing(rows, 256)
    assert n == -(-sum(r.length for r in rows) // 256) or n <= 1.02 * sum(r.length for r in rows) / 256 + 1
    for d, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 256))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack_documents(docs(spark, texts).limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_demand(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    demand = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
    for runs in (packing.plan(demand, capacity), packing.best_fit_decreasing(demand, capacity)):
        total = Counter()
        for r in runs:
            assert sum(k * n for k, n in r.counts.items()) <= capacity
            total.update({k: n * r.times for k, n in r.counts.items()})
        assert total == demand
    assert sum(r.times for r in packing.plan(demand, capacity)) <= sum(r.times for r in packing.best_fit_decreasing(demand, capacity))
    assert packing.plan({}, capacity) == []


def test_linear_program_beats_greedy():
    demand = {6: 20, 7: 20, 10: 20, 11: 20, 13: 20, 17: 20}  # sums of 30 exist for all
    assert sum(r.times for r in packing.plan(demand, 30)) <= 44


SPEECH = {"en": "the and of with that this was from have not", "fr": "les des une dans pour est pas que sur avec", "de": "der die und das nicht ein mit sich auf ist"}


def test_languages(spark):
    rng = random.Random(5)
    rows = [(prose(rng, 30, SPEECH[k].split()), k) for k in SPEECH for _ in range(60)]
    table = docs(spark, [r[0] for r in rows], lang=[r[1] for r in rows])
    model = lang_id.learn_languages(table, F.col("doc_id") % 2 == 0)
    out = lang_id.predict_languages(table.withColumn("score", F.lit("clash")), model).where("doc_id % 2 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    odd = lang_id.predict_languages(docs(spark, [*HOSTILE, "123 456", "漢字"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[9].lang_pred == "und" and odd[-2].lang_pred == "und" and odd[-1].lang_pred != "und"
    nothing = lang_id.learn_languages(table.limit(0), F.lit(True))
    assert {r.lang_pred for r in lang_id.predict_languages(table, nothing).collect()} == {"und"}
    assert lang_id.predict_languages(table.limit(0), model).count() == 0


def test_code_books():
    for k in (2, 3, 4, 7, 8, 20):
        book = lang_id.code_book(k).astype(int)
        apart = [(book[i] != book[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else 2)


def test_quality(spark):
    rng = random.Random(6)
    good = [prose(rng, 60, SPEECH["en"].split()) + "." for _ in range(120)]
    bad = [prose(rng, 60, ["x|", "###", "%%%", "!!"]) for _ in range(120)]
    table = docs(spark, [*good, *bad, *HOSTILE])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(5000, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.learn_quality(table, labels, F.col("doc_id") % 2 == 0)
    out = quality.predict_quality(table, trees).orderBy("doc_id").collect()
    assert all(r.predicted == 1 for r in out[1:120:2]) and all(r.predicted == 0 for r in out[121:240:2])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    constant = quality.learn_quality(table, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.predict_quality(table, constant).collect()} == {0.5}


def test_language_model(spark):
    rng = random.Random(7)
    texts = [*HOSTILE, *(" ".join(x for _ in range(20) for x in ("red fox", rng.choice(["runs fast", "sits down"]))) for _ in range(60))]
    train = [i % 3 > 0 for i in range(len(texts))]
    out = lm.score_documents(docs(spark, texts, train=train), classes=50).orderBy("doc_id").collect()
    counts, ends = Counter(), 0
    for t, is_train in zip(texts, train):
        if is_train:
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    for t, r in zip(texts, out):
        w = (t or "").encode().lower().split()
        base = sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(counts[x] for x in w), ends])
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w) + 1, total, sum(counts[x] > 0 for x in w) + 1)
        assert r.base_score == pytest.approx(base)
    held = [r for r in out[len(HOSTILE) :] if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_documents(docs(spark, texts, train=train).limit(0)).count() == 0
    alone = lm.score_documents(docs(spark, ["a b"], train=[False])).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (3, 0, 0) and np.isfinite(alone.score)


def test_model_is_a_distribution():
    share = np.array([0.2, 0.5, 0.3])
    model = lm.LogBilinear(share)
    first, second, norm = model.tables()
    for a in range(4):
        for b in range(4):
            assert np.exp(first[a] + second[b] - norm[a, b]).sum() == pytest.approx(1)


def test_rare_words_have_classes(spark):
    rng = random.Random(8)
    rare = lambda end: "".join(rng.choice("bcdfg") for _ in range(6)) + end
    ends = {"left": "ing", "right": "ado"}
    texts = [" ".join(f"{k} {rare(ends[k])}" for k in rng.choices(["left", "right"], k=40)) for _ in range(300)]
    train = [True] * 300 + [False] * 3
    texts += ["left zzzzing right zzzzado", "left zzzzado right zzzzing", ""]
    out = lm.score_documents(docs(spark, texts, train=train), classes=2).orderBy("doc_id").collect()
    fit, unfit = out[300].score, out[301].score
    assert out[300].base_score == pytest.approx(out[301].base_score)
    assert fit > unfit + 0.1


def test_ending_classes_agree(spark):
    words = ["", "a", "ab.", "...", "é", "xé!!", "漢字", "word,***", "-x-", "a\x1cb", "w" * 300, "x\u2028"]
    table = spark.createDataFrame([(bytearray(w.encode()),) for w in words], "word binary")
    got = [r.e for r in table.select(lm.ending_class(F.col("word"), 97).alias("e")).collect()]
    own = lm._Classes(lm.Shape({}, np.zeros(98)))
    assert got == [own[w.encode()] - 1 for w in words]
    known = lm.Shape({b"ab.": 1, "é".encode(): 2}, np.zeros(100))
    each = lm._Classes(known)
    found = lm.classes_of(pa.array(words), known, pa.array(list(known.words), pa.binary()))
    assert found.tolist() == [each[w.encode()] for w in words]
    assert lm.classes_of(pa.array([], pa.string()), known, pa.array(list(known.words), pa.binary())).tolist() == []


@pytest.mark.parametrize("n", range(8))
def test_few_words_alone(n):
    hashes, counts = shingle_sets([b" ".join([b"a", b"b", b"c", b"d", b"e", b"f", b"g"][:n])])
    assert len(hashes) == counts.sum() == (0 if n == 0 else max(1, n - 4))


def test_one_document_of_three_words(spark):
    rows = near_dup.near_duplicates(docs(spark, ["a b c"]).coalesce(1)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(0, 1, 0, True)]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_short_notices_anywhere(spark, monkeypatch, limit):
    monkeypatch.setattr("leafmill.llm.wordcols.BROADCAST_BYTES", limit)
    texts = [*HOSTILE, "All rights reserved.", "(c) 2020 A. B. ALL RIGHTS\nRESERVED! Foo bar baz qux", "all rights are reserved by all of us", "overall rights reserved", "all rights reserved all rights reserved x", "rights reserved", license_scan.TEMPLATES["MIT"] + " All rights reserved"]
    short = spark.createDataFrame([("arr", "All rights reserved."), ("one", "Reserved"), ("four", "foo bar baz qux"), ("none", "!"), ("mit", license_scan.TEMPLATES["MIT"])], "template_id string, text string")
    rows = license_scan.license_matches(docs(spark, texts), short)
    n = len(HOSTILE)
    want = {(n + i, "arr") for i in (0, 1, 4, 6)} | {(n + i, "one") for i in (0, 1, 2, 3, 4, 5, 6)} | {(n + 1, "four"), (n + 6, "mit")}
    got = rows.collect()
    assert len(got) == len(want) and {(r.doc_id, r.template_id) for r in got} == want
    assert all(r.n_shared == r.n_shingles == 1 for r in got if r.template_id != "mit")


@pytest.mark.parametrize("size", [19, 20, 21, 22])
def test_licenses_in_documents_without_a_window(spark, size):
    body = [f"w{i}" for i in range(size + 4)]
    texts = [" ".join(body[:n]) for n in range(14, size + 5)]
    known = spark.createDataFrame([("x", " ".join(body))], "template_id string, text string")
    got = {r.doc_id: r.n_shared for r in license_scan.license_matches(docs(spark, texts), known).collect()}
    assert got == {n - 14: n - 4 for n in range(14, size + 5) if 100 * (n - 4) >= 75 * size}


def test_coded_tokens_are_tokens():
    each, many = lm.coded_tokens(pa.array([*HOSTILE, "A\tb\x0bC\x0cd\r\n e", "\x1ca \x85b É"]))
    want = [lm.tokens((t or "").encode()) for t in [*HOSTILE, "A\tb\x0bC\x0cd\r\n e", "\x1ca \x85b É"]]
    assert many.tolist() == [len(w) for w in want]
    assert [x.encode() for x in each.to_pylist()] == [x for w in want for x in w]


def test_scores_match_brute_force(spark, monkeypatch):
    kept = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda train, shape, rounds=lm.ROUNDS: kept.setdefault("model", fit(train, kept.setdefault("shape", shape), rounds)))
    rng = random.Random(9)
    words = [f"w{i}{rng.choice(['ing', 'ed', '.', ''])}" for i in range(120)]
    texts = [*HOSTILE, *(prose(rng, rng.randint(1, 40), words) for _ in range(80))]
    train = [i % 4 > 0 for i in range(len(texts))]
    table = docs(spark, texts, train=train)
    out = lm.score_documents(table.unionByName(table.limit(3)), classes=20).orderBy("doc_id").collect()
    assert len(out) == len(texts) + 3
    model, shape = kept["model"], kept["shape"]
    counts = Counter(w for t, k in zip([*texts, *texts[:3]], [*train, *train[:3]]) if k for w in lm.tokens((t or "").encode()))
    classes = lm._Classes(shape)
    rare = {}
    for w, n in counts.items():
        if w not in shape.words:
            c = rare.setdefault(classes[w], [0, 0])
            c[0], c[1] = c[0] + n, c[1] + 1
    q, r, b = (x.astype(float) for x in (model.q, model.r, model.b))
    one, two = q @ model.c1.astype(float) @ r.T, q @ model.c2.astype(float) @ r.T

    def score(text):
        before, total = [shape.outputs, shape.outputs], 0.0
        for w in [*lm.tokens((text or "").encode()), None]:
            c = 0 if w is None else classes[w]
            x = one[before[0]] + two[before[1]] + b
            total += x[c] - np.log(np.exp(x).sum())
            if w is not None and w not in shape.words:
                n, k = rare.get(c, (0, 0))
                total += np.log((counts[w] + 0.1) / (n + 0.1 * (k + 1)))
            before = [c, before[0]]
        return total / np.log(10)

    for row in out:
        assert row.score == pytest.approx(score(texts[row.doc_id]), rel=1e-3, abs=1e-3)


def test_languages_are_fitted_on_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    rows = [(k, ["en", "de", "de", "de", "de", "xx"][k % 6] if k % 50 else "rare") for k in range(3000)]
    ids = spark.createDataFrame(rows, "doc_id long, lang string").repartition(5)
    hashed = [tuple(r) for r in ids.select("lang", F.xxhash64("doc_id"), "doc_id").collect()]
    near = {r.doc_id for r in lang_id._smallest_hashes(ids, 40).collect()}
    for lang in ("en", "de", "xx", "rare"):
        mine = sorted(h for h in hashed if h[0] == lang)
        assert {h[2] for h in mine[:40]} <= near
    assert len(near) < 4 * 300
    assert lang_id._smallest_hashes(ids.limit(0), 40).count() == 0
