"""The classifiers' queries against plain versions that read one text, one trigram and one tree at a time."""

import math
import re
import zlib

import numpy as np
from leafmill.llm import lang_id, quality, queries
from leafmill.llm.common import is_split


def bucket(a, b, c):
    code = ((a << 16) | (b << 8) | c) * 0x9E3779B1 & 0xFFFFFFFF
    code ^= code >> 15
    return (code * 0x85EBCA77 & 0xFFFFFFFF) >> 17


def language(model, text):
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    raw = b" " + re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()) + b"  "
    total = [0.0] * model.book.shape[1]
    for k in range(len(raw) - 2):
        row = model.weights[bucket(*raw[k : k + 3])]
        for b, w in enumerate(row.tolist()):
            total[b] += w
    margin = [lang_id.SCALE * t / (len(raw) - 2) + float(o) for t, o in zip(total, model.bias)]
    loss = [sum(math.log1p(math.exp(-abs(m * c))) + max(0.0, -m * c) for m, c in zip(margin, word)) for word in model.book.tolist()]
    best = min(range(len(loss)), key=lambda j: loss[j])
    return model.languages[best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_language_query_matches_a_plain_decoder(spark, data):
    docs = queries.table(spark, data, "documents")
    model = lang_id.learn_languages(docs, ~is_split("doc_id", 4, 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op8_language_id(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        name, score = language(model, texts[r.doc_id])
        assert r.held_out == held_out(r.doc_id, 4, 2) and r.lang_pred == name and abs(r.score - score) < 1e-3


def features(text):
    raw = (text or "").encode()
    n, out = max(1, len(raw)), [0.0] * quality.FEATURES
    k = len(quality._SETS)
    for j, members in enumerate(quality._SETS.values()):
        out[j] = sum(raw.count(bytes([m])) for m in set(members)) / n
    shares = [raw.count(bytes([c])) / n for c in set(raw)]
    out[k], out[k + 1] = -sum(s * math.log(s) for s in shares), math.log1p(len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    if words:
        long = [x for x in lines if x.strip()]
        many, kinds = len(words), len(set(words))
        out[k + 2 :] = [
            math.log1p(many), len(raw) / many, kinds / many, math.log(kinds + 1) / math.log(many + 1), 1 - len(set(long)) / len(long), math.log(many / len(long)),
            (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / many, sum(len(w) < 4 for w in words) / many, sum(w.isalpha() for w in words) / many,
            sum(w.isupper() for w in words) / many, sum(w.istitle() for w in words) / many, max(map(len, words)), max(map(len, lines)) / len(raw),
        ]
    return out


def walk(trees, x):
    total = trees.base
    for feature, cut, leaf in zip(trees.feature.tolist(), trees.cut.tolist(), trees.leaf.tolist()):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_quality_query_matches_plain_trees(spark, data):
    docs, labels = queries.table(spark, data, "documents"), queries.table(spark, data, "labels")
    trees = quality.learn_quality(docs, labels, ~is_split("doc_id", 4, 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op10_quality_classifier(spark, data).collect()
    assert len(rows) == len(texts) and len(trees.leaf)
    near = 0
    for r in rows:
        x = features(texts[r.doc_id])
        assert np.allclose(x, quality.statistics([(texts[r.doc_id] or "").encode()])[0], rtol=1e-9, atol=1e-12)
        score = walk(trees, x)
        near += abs(score - r.score) < 1e-9
        assert r.held_out == held_out(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.7)
    assert near >= 0.99 * len(rows)  # a value on a cut may fall either way by its last bit


def test_plain_and_vectorised_agree_on_odd_texts():
    odd = ["", " ", "\n\n", "A", "é漢\U0001f600", "x" * 5000, "A. B.\nC. ", "\x00\x7f", "ONE Two three\n\nONE Two three\n"]
    assert np.allclose(quality.statistics([t.encode() for t in odd]), [features(t) for t in odd])
    model = lang_id.fit_language_model([b"the and of with", b"der die und das", b"les des une dans"] * 3, ["en", "de", "fr"] * 3)
    names, scores, _ = lang_id.decode(model, [t.encode() for t in odd])
    for t, n, s in zip(odd, names, scores):
        name, score = language(model, t)
        assert n == name and abs(s - score) < 1e-4
