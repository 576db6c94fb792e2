import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import quality

SCHEMA = "doc_id long, text string, q_n_words int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    spans = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for s in spans:
        seen[s] = seen.get(s, 0) + 1
    covered = {i + k for i, s in enumerate(spans) if seen[s] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


NOUNS = "cat dog bird house river mountain letter garden winter teacher engine island".split()


def good(i):
    rng = random.Random(i)
    lines = (" ".join(rng.choice(("the", "of", "in", "with", "a", "to")) + " " + rng.choice(NOUNS) for _ in range(9)) for _ in range(5))
    return "\n".join(line.capitalize() + "." for line in lines)


def corpus():
    texts = [good(i) for i in range(150)]
    texts += ["".join(f"wor{i}{k}ble*** " for k in range(60)) for i in range(15)]
    texts += ["".join(f"LOUD{i}X{k}!! " for k in range(60)) for i in range(15)]
    texts += ["buy this now and never look back again friend today\n" * 12 for _ in range(15)]
    texts += [None, "", " \n\t", "short text", "a b c d e f g h a b c d e f g h i", "x\n x\nx\n\n\nx",
              "é ü 日本 🙂 words\x0bof\x0cmany\rkinds a b c d e f g h i j k l m n o p",
              " ".join(f"w{i % 9000}" for i in range(20000))]
    return texts


def rows():
    out = list(enumerate(corpus()))
    return out + [out[0], out[0], (None, out[1][1])]


@pytest.fixture(scope="module")
def assessed(spark):
    docs = spark.createDataFrame([(i, t, 3, "k") for i, t in rows()], SCHEMA).repartition(3)
    return quality.assess(docs).collect()


def test_counts_match_plain_python(assessed):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in assessed), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows()), key=str)


def test_verdicts(assessed):
    by = {r.doc_id: r for r in assessed}
    assert all(by[i].kept for i in range(150))
    assert not any(by[i].kept for i in range(150, 195 + 3))
    assert not any(r.kept and r.base_failed for r in assessed)


def test_em_matches_plain_em(spark):
    patterns = [(0, 0, 2, 400), (0, 0, 1, 70), (0, 0, 0, 90), (-2, -1, 0, 60), (-1, 0, 0, 25), (0, -2, 0, 30), (-1, 0, 2, 8)]
    sides = {"a": -1, "b": -1, "c": 1}
    model = quality.estimate(spark.createDataFrame(patterns, "a int, b int, c int, n long"), sides, steps=7)
    good, prior = 0.8, {-1: ((0.98, 0.0195, 0.0005), (0.55, 0.15, 0.3)), 1: ((0.1, 0.25, 0.65), (0.25, 0.3, 0.45))}
    rates = {r: prior[s] for r, s in sides.items()}
    for _ in range(7):
        posts = []
        for *vs, _n in patterns:
            a, b = good, 1 - good
            for r, v in zip(sides, vs):
                a, b = a * rates[r][0][abs(v)], b * rates[r][1][abs(v)]
            posts.append(a / (a + b))
        total, mass = sum(p[-1] for p in patterns), sum(p[-1] * q for p, q in zip(patterns, posts))
        good = (mass + 1) / (total + 2)
        for k, (r, s) in enumerate(sides.items()):
            new = []
            for side, m in enumerate((mass, total - mass)):
                share = [q if side == 0 else 1 - q for q in posts]
                on = [sum(p[-1] * q for p, q in zip(patterns, share) if abs(p[k]) == g) for g in range(3)]
                new.append(tuple(0.7 * (n + 3 * b) / (m + 3) + 0.3 * b for n, b in zip(on, prior[s][side])))
            rates[r] = tuple(new)
    assert model.good == pytest.approx(good, rel=1e-6)
    for r in sides:
        assert model.on_good[r] == pytest.approx(rates[r][0], rel=1e-6)
        assert model.on_bad[r] == pytest.approx(rates[r][1], rel=1e-6)
    assert model.accuracy("b") > 0.9


def test_the_posterior_decides_beside_the_votes(spark):
    """One weak vote leaves a text with strong supports and removes one without; strong supports can outweigh a strong vote."""
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    _, model = quality._judged(quality.features(documents))
    silent = dict.fromkeys(model.sides, 0)
    full = {**silent, "letters": 2, "closed": 2, "function": 2}
    cases = {"full": full, "verse": {**silent, "letters": 2},
             "full, weak": {**full, "capitals": -1}, "bare, weak": {**silent, "capitals": -1},
             "full, two weak": {**full, "lines": -1, "repeats": -1}, "verse, two weak": {**silent, "letters": 2, "lines": -1, "capitals": -1},
             "full, strong": {**full, "lines": -2}, "verse, strong": {**silent, "letters": 2, "lines": -2},
             "full, two strong": {**full, "lines": -2, "symbols": -2}}
    rows_ = [(name, *(votes[r] for r in model.sides)) for name, votes in cases.items()]
    table = spark.createDataFrame(rows_, "name string, " + ", ".join(f"`{r}` int" for r in model.sides))
    unheard = frozenset(n for n, r in quality.rules().items() if not r.silence_counts)
    got = {r.name: r.p >= 0.5 for r in table.select("name", model.posterior(F.col, unheard).alias("p")).collect()}
    assert got == {"full": True, "verse": True, "full, weak": True, "bare, weak": False, "full, two weak": True,
                   "verse, two weak": False, "full, strong": True, "verse, strong": False, "full, two strong": False}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_against_the_given_labels(spark, scale):
    folder = f"/root/testdata/{scale}"
    got = {r.doc_id: r for r in quality.assess(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    junk = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(clean) / len(clean) >= 0.99 and sum(junk) / len(junk) <= 0.05


def test_keep_filters_rows_and_keeps_columns(spark, assessed):
    docs = spark.createDataFrame([(i, t, 3, "k") for i, t in rows()], SCHEMA)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in assessed if r.kept), key=str)


def test_native_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.assess(empty).collect() == []
    assert quality.keep(empty).collect() == []
    plan = quality.features(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


HINDI = "यह नदी के किनारे बसा हुआ एक पुराना गाँव है जहाँ लोग खेती करते हैं और शाम को साथ बैठते हैं।"
POLISH = "Rzeka płynie przez miasto obok starego młyna"
RUSSIAN = "Старый дом стоит у реки за лесом"


def test_clean_text_of_other_languages_is_kept(spark, assessed):
    rng = random.Random(7)
    hindi = "\n".join(" ".join(rng.sample(HINDI[:-1].split(), 9)) + "।" for _ in range(5))
    own = {"hindi": hindi, "polish list": "\n".join(f"{POLISH} {k}" for k in "abcde"),
           "russian verse": "\n".join(f"{RUSSIAN} {k}" for k in "абвгд")}
    shouted = {f"{name} shouted": text.upper() + " !!!" * 12 for name, text in own.items() if name in ("polish list", "russian verse")}
    texts = {**own, **shouted}
    rows_ = [(i, t, 3, "k") for i, t in rows()] + [(1000 + n, t, 3, "k") for n, t in enumerate(texts.values())]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows_, SCHEMA).repartition(3)).collect()}
    for n, name in enumerate(texts):
        assert got[1000 + n].kept == (name in own), name
    # Nothing but the language: as sure as of the listed ones without a defect.
    assert all(got[1000 + n].quality > 0.75 for n in range(len(own)))
    assert all(got[i].kept == r.kept for i, r in ((r.doc_id, r) for r in assessed) if i is not None)
