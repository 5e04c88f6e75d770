"""Each operator against brute force on a small table with nulls, empty and repeated rows, ties and clashing extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlinelake.llm import rans
from outlinelake.llm.decontamination import contaminated_spans, without_contaminated
from outlinelake.llm.fingerprints import fingerprints
from outlinelake.llm.licenses import KNOWN, known_digests, scan_licenses
from outlinelake.llm.mixing import capped_targets, min_cost_flow, mix_by_source
from outlinelake.llm.ngram_join import jaccard_classes
from outlinelake.llm.quality import classify
from outlinelake.llm.secrets import scan_secrets
from outlinelake.llm.suffix_dedup import HOT, WINDOW, _repeated, repeated_spans
from outlinelake.llm.token_counts import context_limits, length_histogram
from outlinelake.llm.token_output import token_output
from outlinelake.llm.tokenizer import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, key int, start int, n int"


def words(rng, n):
    return [rng.choice("tha ion érel oust ber ndu wor pla mi ster".split()) + rng.choice("ea or un ti".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (300, 120, 40, 7, 4, 1)]
    out = [(i, " ".join(w), "en", f"s{i % 3}") for i, w in enumerate(base)]
    near = list(base[0])
    near[20:22] = ["x", "y"]
    out += [(10, " ".join(near), "en", "s0"), (11, " ".join(base[1]).upper(), "en", None), (12, " ".join(base[0]), "fr", "s1"), (13, " ".join(base[0][:200] + base[1]), "en", "s1")]
    out += [(20, None, None, None), (21, "", "en", "s2"), (22, " \n\t", "en", "s2"), (23, "w " * 3000, "en", "s2"), (24, "aé" * 400, "en", "s2")]
    out += [(3, out[3][1], "en", "s0"), (None, "no id at all here", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_secrets(spark, docs, empty):
    key, secret = "AKIA" + "A1" * 8, "aB3/" * 10
    texts = [f"é password = 'abc123' token=ab {key}\n{secret} https://a.example", f"x {secret} https://a.example", "0f" * 12 + " API-KEY", f"{key} " + "z " * 400 + secret]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in scan_secrets(df).collect()}
    assert [(got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["n_linked"]) for i in range(4)] == [(1, 1, 0, 2), (0, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 0)]
    for span in got[0]["spans"].split(","):
        kind, a, b = span.split(":")
        assert texts[0][int(a) : int(b)] == {"assign": "password = 'abc123", "access": key, "secret": secret, "endpoint": "https://a.example"}[kind]
    base = ",".join(s for s in got[0]["spans"].split(",") if s[:2] in ("as", "ac"))
    assert got[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[4]["spans"] == got[0]["spans"]
    assert scan_secrets(docs).count() == docs.count() and scan_secrets(empty).count() == 0


def test_token_output_and_counts(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    ids = lambda t: model.encode(t or "", add_special_tokens=False).ids + [2]
    want, place = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((doc, place, len(ids(text)), zlib.crc32(np.array(ids(text), "<u4").tobytes())))
        place += len(ids(text))
    got = token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    lengths = [len(ids(r[1])) - 1 for r in rows]
    for r in context_limits(length_histogram(docs)).collect():
        n = r["n_tokens"]
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["docs_at_least"] == sum(x >= n for x in lengths) and r["total_tokens"] == sum(lengths)
    assert token_output(empty).count() == 0 and context_limits(length_histogram(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, rans.LANES + 3, rans.LANES * rans.CHECKPOINT + 77])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint16)
    tables = rans.Tables(rans.quantised(np.bincount(ids, minlength=5000)))
    block = rans.pack_block(np.array([7]), np.array([True]), np.array([n]), ids, tables)
    assert np.array_equal(rans.unpack_block(block, tables)[3], ids)
    payload, states, places, lanes = rans.encode(ids, tables)
    if len(states) > 1:
        assert np.array_equal(rans.decode(payload, states, places, n, tables, 1), ids[rans.CHECKPOINT * lanes :])
    damaged = block[:-1] + bytes([block[-1] ^ 1])
    with pytest.raises(ValueError):
        rans.unpack_block(damaged, tables)


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    clean = [(i, " ".join(words(rng, 60)), "en", "s", 1, 1, 1) for i in range(100, 160)]
    junk = [(i, " ".join(w + "###$$" for w in words(rng, 60)).upper(), "en", "s", 1, 1, 1) for i in range(200, 210)]
    df = spark.createDataFrame(clean + junk, SCHEMA).unionByName(docs)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in clean[:50]] + [(None, 1, 0), (100, 1, 0), (201, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in classify(df, labels).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk) and not got[20] and not got[21]
    assert classify(df, labels).count() == df.count()
    assert classify(docs, labels.limit(0)).where("keep").count() == docs.where("text <> ''").count()
    assert classify(empty, labels).count() == 0


def test_fingerprints(rows, docs, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    got = fingerprints(docs).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(zip([r[0] for r in order], texts, strict=True)):
        third = len(text) // 3
        edited = text[: len(text) - third] + texts[(i + 1) % len(texts)][:third]
        if doc != 3:
            assert (by_id[doc]["n_chars"], by_id[doc]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= by_id[doc]["near_edited"] <= 1
    assert by_id[0]["fingerprint"] == by_id[12]["fingerprint"] != by_id[1]["fingerprint"] and by_id[20]["fingerprint"] == ""
    assert by_id[0]["near_edited"] > 0.3 and len(by_id[0]["fingerprint"].split(",")) >= (300 - 5 + 1) // 16
    places = [int(x.split(":")[1]) for x in by_id[0]["fingerprint"].split(",")]
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= 16
    assert fingerprints(empty).count() == 0


def test_suffix_dedup(rows, docs, empty):
    raw = [(r[1] or "").encode() for r in rows]
    seen = {}
    for t in raw:
        for s in range(len(t) - WINDOW + 1):
            seen[t[s : s + WINDOW]] = seen.get(t[s : s + WINDOW], 0) + 1
    want = []
    for r, t in zip(rows, raw, strict=True):
        cut = np.zeros(len(t) + 1, dtype=int)
        for s in range(len(t) - WINDOW + 1):
            if seen[t[s : s + WINDOW]] > 1:
                cut[s : s + WINDOW] = 1
        kept = bytes(b for b, c in zip(t, cut, strict=False) if not c)
        want.append((r[0], len(t), int(cut.sum()), int((np.diff(cut) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    for hot in (HOT, 1500, 0):  # no gram, some, and all as hot ones
        got = repeated_spans(docs, hot).drop("spans").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(w[2] for w in want)
    assert repeated_spans(empty).count() == 0


def test_suffixes_of_one_fingerprint_are_told_apart_by_their_bytes():
    text = random.Random(2).randbytes(900)
    data = np.frombuffer(text + b"x" * 450 + text[:700], dtype=np.uint8)
    at = np.arange(len(data) - WINDOW + 1)
    windows = [data[i : i + WINDOW].tobytes() for i in at]
    want = [windows.count(w) > 1 for w in windows]
    for lead, finger in ((np.zeros(len(at)), np.zeros(len(at))), (np.array([hash(w) for w in windows]), np.array([hash(w) for w in windows]))):
        assert _repeated(data, at, lead, finger).tolist() == want


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = " ".join(words(rng, 40))
    edited = item[:60] + "X" + item[61:150] + item[151:]
    texts = [f"{'q ' * 50}{item}! tail", item.upper(), edited, " ".join(words(rng, 80)), item[30:230], "é " + item.replace(" ", ",  ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item, "y"), (1, item, "y"), (2, None, "y"), (3, "short", "y"), (None, item, "y")], "item_id long, text string, doc_id string")
    got = contaminated_spans(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (4, 1), (5, 1)]
    first = next(r for r in got if r["doc_id"] == 0)
    assert texts[0][first["start"] : first["end"]] == item
    assert without_contaminated(df, bench).select("doc_id", "item_id").collect() == [(3, "x")]
    assert contaminated_spans(docs, bench).count() == 0 and contaminated_spans(empty, bench).count() == 0
    assert contaminated_spans(df, bench.limit(0)).count() == 0 and without_contaminated(docs, bench).count() == docs.count()


def test_licenses(spark, docs, empty):
    texts = ["Copyright (c) 2020 Someone\n\n" + KNOWN["MIT"].replace(". ", ".\n"), KNOWN["ISC"].upper(), KNOWN["Zlib"].replace("acknowledgment", "Acknowledgement"), KNOWN["MIT"] + " more", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(df, known_digests(spark)).collect()}
    assert got == {0: "MIT", 1: "ISC", 2: "Zlib", 3: None, 4: None}
    assert scan_licenses(docs, known_digests(spark)).count() == docs.count() and scan_licenses(empty, known_digests(spark)).count() == 0


def test_ngram_join(spark, rows, docs, empty):
    rng = random.Random(3)
    base = words(rng, 150)
    family = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        family.append((500 + i, " ".join(w), "en", "s", 1, 1, 1))
    df = spark.createDataFrame(family, SCHEMA).unionByName(docs).where("doc_id is not null")
    sets = {}
    for r in df.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = jaccard_classes(df).collect()
    assert len(got) == df.count()
    assert all((r["component_id"], r["n_shingles"]) == (find(r["doc_id"]), len(sets[r["doc_id"]])) for r in got)
    assert len({r["component_id"] for r in got}) < len(sets)
    assert jaccard_classes(docs).count() == docs.count() and jaccard_classes(empty).count() == 0


def test_mixing(rows, docs, empty):
    assert [float(x) for x in capped_targets([100, 10, 50], [3, 1, 2])] == [132, 20, 88]  # 40 of 240 is above 2 * 10; the other 220 go 3 : 2
    flow = min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [15, 15])
    assert flow[0][0] + flow[1][0] == 15 and flow[1][1] + flow[2][0] == 15
    assert sum(flow[1]) <= 20 and flow[0][0] >= 10 and sum(flow[1]) >= 10 and flow[2][0] >= 5  # no repeat before all first copies
    got = mix_by_source(docs).collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert {str(r) for r in got} == {str(r) for r in mix_by_source(docs.repartition(2, "n")).collect()}
    assert all(r["size"] == len(re.findall(r"[^ \t-\r]+", r["text"] or "")) for r in got)
    assert mix_by_source(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "token-ID output":
            assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()
        docs = out
    assert docs.agg(F.sum("n_tokens")).first()[0] == docs.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
