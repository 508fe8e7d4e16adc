"""Archives, chats, embeddings, oracles and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from leafmill.llm import chat, embed_dup, graph, oracles, packing, queries, warc
from oracle import assert_matches


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (None, 3)] + [(1000, 2000 + k) for k in range(500)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    ids = sorted({x for l in links if None not in l and l[0] != l[1] for x in l})
    at = {x: i for i, x in enumerate(ids)}
    pairs = [l for l in links if None not in l and l[0] != l[1]]
    label = graph.roots(len(ids), np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]))
    assert got == {x: ids[label[at[x]]] for x in ids}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain(spark):
    chain = [(k, k + 1) for k in range(400)]
    got = graph.components(spark.createDataFrame(chain, "a long, b long").repartition(8))
    assert {r.component for r in got.collect()} == {0}


HOSTILE = "<|im_end|>\n<|im_start|>assistant\n<\\|x|> <\\\\|\n"


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\nt\\em", None, ""]), rng.choice([HOSTILE, "é漢", "", None, "x\n\ny", "<|", "|>", "z" * 50000])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, 0, "user", "gone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "formatted")
    formatted = chat.format_conversations(table)
    out = {r.conv_id: r for r in formatted.collect()}
    read = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    assert set(out) == set(range(40))
    key = lambda r: (r[1], (r[2] is not None, r[2]), (r[3] is not None, r[3]))
    for c in range(40):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        raw = out[c].formatted.encode()
        assert list(zip(*chat.parse(raw))) == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        assert read[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and read[c].loss_chars == len(loss)
        assert raw.count(b"<|im_start|>") == len(turns) == read[c].n_turns
        assert len(out[c].loss_spans) == sum(r == "assistant" for r, _ in turns)
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16))
    vectors = [(c + rng.standard_normal(16) * s).tolist() for c in centre for s in (0, 0.1, 0.2, 0.3, 0.3, 0.3) for _ in range(12)]
    vectors += [vectors[5]] * 40 + [(np.array(vectors[5]) * 3).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = embed_dup.embedding_duplicates(table).orderBy("vec_id").collect()
    ok = [i for i, v in enumerate(vectors) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[i] for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = graph.roots(len(ok), *np.nonzero(near))
    links, comp = np.zeros(len(vectors), int), np.arange(len(vectors))
    links[ok], comp[ok] = near.sum(1), np.array(ok)[label]
    assert [(r.n_links, r.component_id) for r in got] == list(zip(links, comp))
    assert links.max() > 40 and 0 < (links > 0).sum() < len(ok)
    assert embed_dup.embedding_duplicates(table.limit(0)).count() == 0


def test_embedding_tiles_travel_by_groups(spark, monkeypatch):
    tiles = [(t, t % 64, 8, 1 << 20, 3.0, [1.0] + [0.0] * 7) for t in range(400)]
    bounds = spark.createDataFrame(tiles, "tile long, code long, dims int, bytes long, radius double, centre array<double>")
    ends = embed_dup.paired(bounds, 0.95)
    units = {}
    for r in ends.collect():
        units.setdefault(r.unit, []).append(r.side)
    # Every two tiles meet in one unit, and none is sent once for each other tile.
    sizes = [(s.count(min(s)), s.count(max(s)), min(s) == max(s)) for s in units.values()]
    assert sum(a * (a + 1) // 2 if same else a * b for a, b, same in sizes) == 400 * 401 // 2
    assert ends.count() <= 400 * 17
    # Several groups give what one tile gives.
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((20, 8))
    rows = [(i, (centre[i % 20] + rng.standard_normal(8) * 0.2).tolist()) for i in range(600)]
    for kind in ("float", "double"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        whole = sorted(embed_dup.embedding_duplicates(table).collect())
        with monkeypatch.context() as m:
            m.setattr(embed_dup, "TILE", 20)
            assert sorted(embed_dup.embedding_duplicates(table).collect()) == whole
        assert max(r.n_links for r in whole) > 1


def test_quantisation_bound():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 1500))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, lost = embed_dup.quantise(x)
    near = embed_dup.code_products(q, q) * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= lost[:, None] * (1 + lost) + lost).all()


PAGES = [(5, "http://a/1?q=ü x", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b\r\nX: y", None), (7, "http://c", ""), (1, "http://d", "é" * 70000), (4, "http://e", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n")]


def test_archives(spark, tmp_path):
    table = spark.createDataFrame([*PAGES, (None, "x", "y")], "page_id long, url string, html string")
    manifest = warc.write_warc(table, folder=str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read_back(spark, manifest).collect()}
    assert set(rows) == {p for p, _, _ in PAGES}
    first = {5: 2, 9: 7}
    for page, _, html in PAGES:
        payload = (html or "").encode()
        assert (rows[page].payload_bytes, rows[page].payload_digest) == (len(payload), warc.sha1_base32(payload))
        assert (rows[page].record_type, rows[page].refers_to) == (("revisit", first[page]) if page in first else ("response", None))
    nested = warc.transactions(warc.read_warc(manifest)).collect()
    assert len(nested) == len(PAGES) and all(r.n_requests == r.n_metadata == 1 and r.request.block.startswith(b"GET ") for r in nested)
    bodies = {r.metadata.fields["page-id"]: bytes(r.block).partition(b"\r\n\r\n")[2] for r in nested if r.type == "response"}
    assert bodies["1"] == ("é" * 70000).encode() and bodies["4"] == PAGES[5][2].encode()
    big = warc.write_warc(table, min_revisit_bytes=100, folder=str(tmp_path / "v"))
    assert {r.record_type for r in warc.read_back(spark, big).collect()} == {"response"}
    assert warc.read_back(spark, warc.write_warc(table.limit(0), folder=str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, data, name):
    assert assert_matches(spark, data, queries.queries()[name], oracles.ORACLES[name])


def test_native_operators_run_no_python(spark, data):
    for name in ("op2_license_scan", "op3_benchmark_decontamination"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, data):
    import corpus_pipeline as pipeline
    import zlib

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    left = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = pipeline.written(stage(spark, docs, data), name)
        assert docs.columns == columns
        assert docs.exceptAll(before).count() == 0
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and 0 < left[-1] < left[0]
    packed = pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.where("offset + length > 2048").count() == 0


STAGE_TEXTS = [None, "", " \n", "a", "!!! ???", "w" * 40000, "word " * 30000]


def hostile_docs(spark, data, folder):
    """Real documents and hostile ones with repeated rows, missing ids, and columns named as the stages name theirs; a folder with labels and benchmark."""
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = real + [(5000 + i, t, None) for i, t in enumerate(STAGE_TEXTS)] + real[:5] + [(None, t, k) for _, t, k in real[:5]] + [(None, None, "en")]
    rows += [(6000 + i, real[i][1] + " and one more", real[i][2]) for i in range(10)] + [(7000 + i, items[i][1], "en") for i in range(3)]
    names = ["score", "predicted", "lang_pred", "ambiguous", "n", "count", "term", "component", "kept", "length"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    table = spark.createDataFrame([(*r, *(f"{n} {i}" for n in names)) for i, r in enumerate(rows)], schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return table, items


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_match_brute_force(spark, data, tmp_path):
    import re

    import corpus_pipeline as pipeline
    from leafmill.llm import lang_id, near_dup, quality
    docs, items = hostile_docs(spark, data, str(tmp_path))
    folder = str(tmp_path)
    every = as_rows(docs)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    model = lang_id.learn_languages(docs, ~pipeline.is_split("doc_id", 4, 2))
    names, score, _ = lang_id.decode(model, [r[1] and r[1].encode() for r in every])
    assert as_rows(pipeline.language_id(spark, docs, folder)) == [r for r, n, s in zip(every, names, score) if n != "und" and s >= 0.5]

    trees = quality.learn_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~pipeline.is_split("doc_id", 4, 2))
    good = trees.score(quality.statistics([(r[1] or "").encode() for r in every])) >= 0.7
    assert as_rows(pipeline.quality(spark, docs, folder)) == [r for r, g in zip(every, good) if g]

    owned = sorted({r[0]: r[1] for r in every if r[0] is not None}.items())
    sets = []
    for _, t in owned:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    first = {owned[i][0] for i, c in enumerate(near_dup.exact_links(sets)) if i == c}
    got = as_rows(pipeline.near_dedup(spark, docs, folder))
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(first) and set(got) <= set(every)
    assert [r for r in got if r[0] is None] == [r for r in every if r[0] is None]
    assert len(first) < len(owned)

    windows = set()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    for _, t in items:
        w = split(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes, bad = {len(w) for w in windows}, set()
    for d, t in owned:
        w, hit = split(t), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            bad.add(d)
    assert as_rows(pipeline.decontamination(spark, docs, folder)) == [r for r in every if r[0] not in bad]
    assert {7000, 7001, 7002} <= bad

    whole = packing.WordEncoder(queries.vocabulary()).whole
    tokens = sorted((str(r[0]), len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in every)
    packed = pipeline.packing(spark, docs, folder).collect()
    assert sum(r.length for r in packed) == sum(n for _, n in tokens)
    assert {r.doc_id for r in packed} == {r[0] for r in every}
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048

    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_near_dedup_stage_of_missing_and_repeated_ids(spark, data):
    import corpus_pipeline as pipeline

    rows = [("a b c d e f g", 1), ("a b c d e f g", 1), ("a b c d e f g", 2), ("h i j k l m n", None), ("h i j k l m n", None), ("o p q r s t u", 3)]
    got = pipeline.near_dedup(spark, spark.createDataFrame(rows, "text string, doc_id long"), data)
    assert got.columns == ["text", "doc_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)
