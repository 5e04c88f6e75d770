"""Cases that the operators once left out, one test for each."""

import random

import pytest

from outlinelake.llm.quality import classify, judge


def _words(rng, n):
    return [rng.choice("tha ion érel oust ber ndu wor pla mi ster".split()) + rng.choice("ea or un ti".split()) for _ in range(n)]


def test_toxic_words_reject_good_text(spark):
    rng = random.Random(4)

    def toxic():
        w = _words(rng, 400)
        for bad in ("zgrubb", "qwuck", "zgrubb"):
            w[rng.randrange(len(w))] = bad
        return " ".join(w)

    clean = [(i, " ".join(_words(rng, 400)), "en") for i in range(100)]
    labelled = [(200 + i, toxic(), "en") for i in range(30)]
    new = [(300 + i, toxic(), "en") for i in range(20)]
    docs = spark.createDataFrame(clean + labelled + new + [(400, "", "en"), (401, None, "en")], "doc_id long, text string, lang string")
    rows = [(i, 1, 0) for i in range(60)] + [(r[0], 1, 1) for r in labelled]
    got = {r["doc_id"]: r["keep"] for r in classify(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert not any(got[r[0]] for r in labelled + new) and all(got[r[0]] for r in clean) and not got[400] and not got[401]


def test_text_outside_the_alphabet_is_not_cheap(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    vocabulary = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(150)]

    def clean():
        w = [rng.choice(vocabulary) for _ in range(300)]
        return " ".join([*w, rng.choice("§¶") * 20, *w[:20]])

    good = [(i, clean(), "en") for i in range(80)]
    other = [(200 + i, "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(400)), "en") for i in range(5)]
    docs = spark.createDataFrame(good + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in classify(docs, labels).collect()}
    assert not any(got[r[0]] for r in other) and all(got[i] for i in range(50))


def test_toxic_words_are_judged_by_the_whole_models(spark):
    """Whatever rows are broadcast, each text's most toxic words have the bits that the whole models give."""
    rng = random.Random(8)

    def text(bad):
        w = _words(rng, 80)
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = "".join(rng.choice("zqxkwj") for _ in range(5))
        return " ".join(w)

    rows = [(i, text(i % 2), "en") for i in range(120)] + [(200, "", "en"), (201, None, "en"), (202, "字", "en"), (203, "\x00 \x00zq \t", None), (204, "  ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    want, *others = ({r["doc_id"]: (r["toxic_bits"], r["keep"]) for r in judge(docs, labels, n).collect()} for n in (1 << 20, 0, 200, 700))
    assert len(want) == len(rows) and want[200][0] is None and want[203][0] is not None
    assert any(b and b > 10 for b, _ in want.values())
    for got in others:
        assert {k: b if b is None else pytest.approx(b, abs=1e-4) for k, (b, _) in want.items()} == {k: b for k, (b, _) in got.items()}
        assert {k: keep for k, (_, keep) in want.items()} == {k: keep for k, (_, keep) in got.items()}


def test_pipeline_judges_by_the_whole_models(spark, tmp_path, monkeypatch):
    """Toxic text is found with all of the models' rows, however few of them the pipeline's first stage broadcasts."""
    import functools

    import corpus_pipeline

    rng = random.Random(12)

    def text(bad):
        w = _words(rng, 400)
        for word in ("zgrubb", "qwuck", "zgrubb") * bad:
            w[rng.randrange(len(w))] = word
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i % 2), "en", "web", 0) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "classify", functools.partial(classify, frequent=20))
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    monkeypatch.undo()
    assert kept == {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept and not any(i % 2 for i in kept)
