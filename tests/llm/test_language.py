import itertools
import random
import zlib

import numpy as np
import pytest

from logweave.llm import language

SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"
WORDS = {"en": "the house of water and light with seven rivers through green fields".split(),
         "de": "das haus aus wasser und licht mit sieben flüssen durch grüne felder".split(),
         "fr": "la maison d'eau et de lumière avec sept rivières à travers champs verts".split()}


def sentence(lang, rng, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows():
    rng = random.Random(1)
    out = [(i, sentence(lang, rng, rng.randrange(20, 80)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 240))]
    out += [(900, None, "en"), (901, "", "de"), (902, "123 !!! ---", "fr"), (903, sentence("de", rng, 40), None),
            (904, sentence("fr", rng, 30000), "fr"), (None, sentence("en", rng, 30), "en")]
    return out + [out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, 1, "s") for i, t, lang in rows()], SCHEMA).repartition(3)


def brute_posteriors(factors, move, start):
    """By enumerating every labelling."""
    n, size = factors.shape
    out = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        p = np.exp(start[labels[0]]) * factors[0, labels[0]]
        for t in range(1, n):
            p *= np.exp(move[labels[t - 1], labels[t]]) * factors[t, labels[t]]
        for t, k in enumerate(labels):
            out[t, k] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_of_uneven_texts_matches_enumeration():
    rng = np.random.default_rng(2)
    move, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [5, 3, 3, 1]
    each = [rng.random((n, 3)) + 0.1 for n in lengths]
    sizes = np.array([sum(n > t for n in lengths) for t in range(5)])
    laid = np.concatenate([[f[t] for f in each if len(f) > t] for t in range(5)])
    post, _ = language.forward_backward(laid.copy(), sizes, move, start)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for d, f in enumerate(each):
        assert np.allclose([post[at[t] + d] for t in range(len(f))], brute_posteriors(f, move, start))


def test_gradient_of_transitions_is_expected_pairs():
    rng = np.random.default_rng(3)
    factors, move, start = rng.random((4, 2)) + 0.1, rng.normal(size=(2, 2)), rng.normal(size=2)

    def log_z(m):
        v = np.exp(start) * factors[0]
        for f in factors[1:]:
            v = (v @ np.exp(m)) * f
        return np.log(v.sum())

    _, pairs = language.forward_backward(factors.copy(), np.ones(4, dtype=int), move, start)
    for i, j in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-6
        assert abs((log_z(move + step) - log_z(move - step)) / 2e-6 - pairs[i, j]) < 1e-6


def test_held_out_accuracy_and_contract(docs):
    got = language.identify(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "de" and by[904].lang_pred == "fr"
    held = [(by[i].lang_pred, lang) for i, t, lang in rows() if i is not None and i < 900 and by[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_code_switching_gives_runs(spark, docs):
    rng = random.Random(5)
    mixed = sentence("en", rng, 30) + " " + sentence("de", rng, 20)
    model = language.train(docs)
    row = language.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, runs=True).first()
    assert [x.lang for x in row.runs] == ["en", "de"] and abs(row.runs[0].words - 30) <= 3
    assert row.lang_pred == "en" and 0.5 < row.score < 0.7


def test_prediction_uses_text_alone(spark, docs):
    model = language.train(docs)
    a = spark.createDataFrame([(1, "das haus und licht", "fr", "src1")], "doc_id long, text string, lang string, source string")
    b = spark.createDataFrame([(77, "das haus und licht", None, "src9")], "doc_id long, text string, lang string, source string")
    assert language.label(a, model).first()[1:3] == language.label(b, model).first()[1:3]


def test_keep_and_empty(spark, docs):
    kept = language.keep(docs)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901, 902} and set(range(240)) <= ids
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty).collect() == [] and language.keep(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None, 1, "s")], SCHEMA)
    assert language.identify(unlabelled).first()[2:] == ("und", 0.0)
