"""Each operator that SQL can't express against its plain version in brute.py, row for row; then the pipeline."""

import itertools
import random

import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from outlinelake.llm import decontamination, fingerprints, mixing, quality, secrets, token_output
from outlinelake.llm.tokenizer import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of the operators' own columns, as extra columns of their input.
CLASHES = ["size", "taken", "target", "source_size", "bits", "adjusted_bits", "threshold", "keep", "start", "end", "kind", "spans", "bin", "mark", "hash", "fingerprint", "entries", "n_tokens", "key", "component_id", "n", "pattern", "_h", "_pattern", "h", "r", "p", "d", "digest", "row", "tie", "section", "part", "ghost", "any", "found", "m", "s", "own", "of_id", "of_text", "classes", "trusted"]


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def items():
    table = pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()
    return [(r["item_id"], r["text"]) for r in table[:10]] + [(None, table[0]["text"]), (901, None), (902, "too short"), (903, table[1]["text"])]


@pytest.fixture(scope="module")
def labels():
    return [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()] + [(None, 1, 0), (1, None, None), (10**9, 1, 0)]


@pytest.fixture(scope="module")
def rows(items):
    """Documents of the driver's table, and nulls, empty texts, copies, near copies, leaks, secrets and a long word."""
    rng = random.Random(7)
    read = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in read if r["n_chars"] < 1600]
    base = next(t for _, t, *_ in out if len(t.split()) > 150)
    near = base.split()
    near[70] = "changed"
    key, secret = "AKIA" + "Q7" * 8, "aB3/" * 10
    item = items[0][1]
    folded = brute.folded(item)
    texts = [base, base, " ".join(near), f"{base[:300]} {item} {base[300:600]}", item[:70] + item[71:], folded[:80], folded[80:96] + " and then other words follow here", f"{items[4][1].upper()}!", f"{base[:90]} {items[5][1][40:]}", items[6][1].replace("e", "é", 6), "", " \n\t ", None, "é" * 3000]
    texts += [f"Password:\x20 'hunter22' TOKEN=\"abc\" {key} é {secret} https://h.example:8080/x", f"{key}{'x' * 520} {secret}", f"{secret}= api-key api_key={'9' * 30} {'0f' * 13}", f"{'z ' * 300}{key} https://only.example"]
    out += [(100_000 + i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), 1) for i, t in enumerate(texts)]
    return out + [(100_000, texts[0], "en", "src0", 1), (None, "a row without an id, of seven words", None, "src2", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_secrets(docs, rows):
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for doc, text, *_ in rows:
        base, every = brute.secret_spans(text, secrets.SCOPE)
        want.append((doc, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), brute.sha(joined(base)), joined(every), len(every) - len(base)))
    got = [tuple(r) for r in secrets.scan_secrets(docs).collect()]
    assert by_text(got) == by_text(want)
    assert sum(w[6] for w in want) >= 2 and all(sum(w[k] for w in want) for k in (1, 2, 3))


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    edits = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:] + texts[:1], strict=True)]
    print_of = lambda t: brute.winnowed(t, fingerprints.K, fingerprints.W, fingerprints.PLACE_BITS)
    own, new = [print_of(t) for t in texts], [print_of(t) for t in edits]
    shown = lambda p: ",".join(f"{h:x}:{i}" for h, i in p)
    want = [(r[0], len(t), brute.sha(e), shown(a), shown(b), brute.alike(a, b), brute.alike(a, c)) for r, t, e, a, b, c in zip(order, texts, edits, own, new, own[1:] + own[:1], strict=True)]
    assert by_text(tuple(r) for r in fingerprints.fingerprints(docs).collect()) == by_text(want)


@pytest.mark.parametrize("frequent", [quality.FREQUENT, 300])
def test_quality(spark, docs, rows, labels, frequent):
    """With the whole model broadcast, and with most of its rows joined."""
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {r[:3]: j for r, j in zip(rows, brute.judged(rows, labels, quality), strict=True)}
    got = quality.classify(docs, frame, frequent).collect()
    assert len(got) == len(rows)
    for r in got:
        bits, adjusted, threshold = want[r["doc_id"], r["text"], r["lang"]]
        assert r["threshold"] == pytest.approx(threshold, abs=0.001)
        assert (r["bits"] is None) == (bits is None)
        if bits is None:
            assert not r["keep"]
            continue
        assert r["bits"] == pytest.approx(bits, abs=1e-4) and r["adjusted_bits"] == pytest.approx(adjusted, abs=1e-4)
        if abs(adjusted - threshold) > 0.002:
            assert r["keep"] == (adjusted <= threshold)
    assert {r["keep"] for r in got} == {True, False}


def test_decontamination(spark, docs, rows, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = [(rows[i][0], *rest) for i, *rest in brute.leaks([r[1] for r in rows], items, decontamination)]
    got = decontamination.contaminated_spans(docs.coalesce(1), frame)
    assert by_text(tuple(r) for r in got.select("doc_id", "item_id", "n_probes", "edits").collect()) == by_text(want)
    assert len({w[1] for w in want}) > 3
    texts = {r[0]: r[1] for r in rows}
    for r in got.collect():
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])


def test_an_item_cut_by_two_documents_is_in_neither(spark, items):
    text = brute.folded(items[0][1])[:96]
    frame = spark.createDataFrame([(1, text)], "item_id long, text string")
    cut = spark.createDataFrame([(1, text[:80]), (2, text[80:]), (3, text)], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in decontamination.contaminated_spans(cut, frame).collect()] == [3]


def test_mixing(docs, rows):
    by_source = brute.targets(rows)
    want = [(r[0], brute.size_of(r[1]), by_source[r[3]][0], float(by_source[r[3]][1]), n) for r, n in zip(rows, brute.taken(rows, mixing.SEED, 16), strict=True)]
    got = mixing.mix_by_source(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert by_text(tuple(r) for r in got) == by_text(want)


def test_flow_is_least_of_all_flows():
    rng = random.Random(11)
    for _ in range(60):
        supplies = [rng.randrange(4) for _ in range(rng.randrange(1, 4))]
        members = [sorted(rng.sample(range(2), rng.randrange(1, 3))) for _ in supplies]
        quotas = [rng.randrange(6) for _ in range(2)]
        spread = [[x for x in itertools.product(range(2 * n + 1), repeat=len(m)) if sum(x) <= 2 * n] for n, m in zip(supplies, members, strict=True)]
        best = None
        for flow in itertools.product(*spread):
            into = [sum(x[m.index(s)] for x, m in zip(flow, members, strict=True) if s in m) for s in range(2)]
            if all(a <= q for a, q in zip(into, quotas, strict=True)):
                rank = (-sum(into), sum(max(0, sum(x) - n) for x, n in zip(flow, supplies, strict=True)))
                best = min(best or rank, rank)
        found = mixing.min_cost_flow(supplies, members, quotas)
        into = [sum(x[m.index(s)] for x, m in zip(found, members, strict=True) if s in m) for s in range(2)]
        assert all(a <= q for a, q in zip(into, quotas, strict=True))
        assert (-sum(into), sum(max(0, sum(x) - n) for x, n in zip(found, supplies, strict=True))) == best


def test_extra_columns_with_the_operators_own_names(spark, docs, rows, labels, items):
    """They are dropped or passed over, and change no result."""
    from pyspark.sql import functions as F

    from outlinelake.llm.licenses import known_digests, scan_licenses
    from outlinelake.llm.ngram_join import jaccard_classes
    from outlinelake.llm.suffix_dedup import repeated_spans
    from outlinelake.llm.token_counts import length_histogram

    few = docs.where("doc_id >= 100000 or doc_id < 20 or doc_id is null")
    odd = few.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd_marked = marked.select("*", F.lit("x").alias("trusted_id"), F.lit("x").alias("text"), F.lit("x").alias("lang"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    runs = [
        (lambda d, o: secrets.scan_secrets(d)),
        (lambda d, o: fingerprints.fingerprints(d)),
        (lambda d, o: quality.classify(d, odd_marked if o else marked).select("doc_id", "lang", "bits", "adjusted_bits", "threshold", "keep")),
        (lambda d, o: decontamination.contaminated_spans(d, bench)),
        (lambda d, o: mixing.mix_by_source(d).select("doc_id", "source", "size", "taken", "source_size", "target")),
        (lambda d, o: jaccard_classes(d.where("doc_id is not null")).select("doc_id", "n_shingles", "component_id")),
        (lambda d, o: repeated_spans(d).drop("spans")),
        (lambda d, o: scan_licenses(d, known_digests(spark))),
        (lambda d, o: length_histogram(d)),
        (lambda d, o: token_output.token_output(d).select("doc_id", "start", "n_tokens", "ids_crc32")),
    ]
    for run in runs:
        assert sorted(map(str, run(odd, True).collect())) == sorted(map(str, run(few, False).collect()))


def test_pipeline(spark, tmp_path, rows, labels, items, model):
    import corpus_pipeline

    pq.write_table(pa.Table.from_pylist([dict(zip(corpus_pipeline.COLUMNS, r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [x[0] for x in items], "text": [x[1] for x in items]}), tmp_path / "benchmark.parquet")
    judged = brute.judged(rows, labels, quality)
    assert all(a is None or abs(a - t) > 0.001 for _, a, t in judged)  # none so near that half floats decide
    kept = [r for r, (_, a, t) in zip(rows, judged, strict=True) if a is not None and a <= t]
    least = brute.near_classes(kept)
    single = [r for i, r in enumerate(kept) if r[0] is None or least[r[0]] == r[0] and (r[0], r[1]) not in {(x[0], x[1]) for x in kept[:i]}]
    leaked = {i for i, *_ in brute.leaks([r[1] for r in single], items, decontamination)}
    clean = [r for i, r in enumerate(single) if i not in leaked]
    copies = [int(n / brute.size_of(r[1]) + 0.5) if brute.size_of(r[1]) else 0 for r, n in zip(clean, brute.taken(clean, mixing.SEED, 16), strict=True)]
    final = [r for r, n in zip(clean, copies, strict=True) for _ in range(n)]
    assert len(rows) > len(kept) > len(single) > len(clean) and 2 in copies
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert by_text(map(tuple, got)) == by_text(brute.token_rows(final, model))
