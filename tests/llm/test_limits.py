"""Beyond sizes at which an operator works in pieces, on empty tables, and with overlapping sources."""

import random
import zlib
from functools import reduce
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from outlinelake.llm import common, decontamination, fingerprints, mixing
from outlinelake.llm.decontamination import contaminated_spans
from outlinelake.llm.licenses import KNOWN, known_digests, scan_licenses
from outlinelake.llm.ngram_join import jaccard_classes
from outlinelake.llm.quality import judge
from outlinelake.llm.secrets import scan_secrets
from outlinelake.llm.suffix_dedup import repeated_spans
from outlinelake.llm.token_counts import context_limits, length_histogram
from outlinelake.llm.token_output import token_output
from outlinelake.llm.tokenizer import vocabulary


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "io", "ué")]
    text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(400_000))
    assert len(text.encode()) > 2 << 20
    return text


def test_texts_beyond_every_chunk(spark, long_text):
    from tokenizers import Tokenizer

    item = "which of these questions is asked only at the very end of a text that is longer than any chunk"
    key = "AKIA" + "Z3" * 8
    texts = [long_text, "x" * 500 + " " + long_text, f"{long_text[:1_500_000]} {item} {key}", "short", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    raw = [(t or "").encode() for t in texts]
    removed = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeated_spans(docs, hot=1 << 16).collect()}
    shared = len(long_text[:1_500_000].encode()) + 1  # a blank follows in both, or another word's letter
    assert removed[0] == (len(raw[0]), 1) and removed[1][0] >= len(raw[0]) and removed[3] == removed[4] == (0, 0)
    assert shared - 1 <= removed[2][0] <= shared
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_classes(docs).collect()}
    assert classes == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    (found,) = contaminated_spans(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert (found["doc_id"], texts[2][found["start"] : found["end"]]) == (2, item)
    secrets = {r["doc_id"]: r["spans"] for r in scan_secrets(docs).collect()}
    assert secrets[2] == f"access:{texts[2].index(key)}:{len(texts[2])}" and not secrets[0]
    model = Tokenizer.from_file(vocabulary())
    ids = [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, sum(map(len, ids[:i])), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    limits = {r["n_tokens"]: r for r in context_limits(length_histogram(docs)).collect()}
    lengths = sorted(len(x) - 1 for x in ids)
    for n, r in limits.items():
        up_to = sum(x <= n for x in lengths)
        assert (r["n_docs"], r["docs_up_to"], r["quantile"]) == (lengths.count(n), up_to, up_to / len(lengths))
        assert (r["tokens_at_least"], r["truncated_tokens"]) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
    judged = {r["doc_id"]: r["bits"] for r in judge(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert judged[0] < 4 < judged[3] and judged[4] is None


def test_fingerprints_over_many_small_ranges(spark, monkeypatch):
    """With ids of many rows, null ids, far and negative ids."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    monkeypatch.setattr(fingerprints, "SECTIONS", 4)
    rng = random.Random(3)
    ids = [5] * 30 + [None] * 12 + [-(1 << 62), 1 << 62, (1 << 63) - 1] + [rng.randrange(-50, 1000) for _ in range(60)]
    rows = [(i, f"text {n} " + "w " * (n % 7)) for n, i in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -brute.signed(brute.chained(r[1].encode()))))
    want = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        want.append((doc, len(text), brute.sha(text[: len(text) - third] + after[:third])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in fingerprints.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_overlapping_sources(spark):
    """Documents of several sources: the flow's words are taken, no more than twice a document, and every quota that can be met is."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice((["a"], ["a", "b"], ["b", "c"], ["c"], ["b", "a", "a"], [None], [])), "mine") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>, _h string")
    quotas = {"a": 2500, "b": 1200, "c": 900, None: 300}
    plan = mixing.mixing_plan(docs, F.col("of"), quotas)
    got = mixing.mixed(docs, F.col("of"), plan).collect()
    assert len(got) == len(rows) and {r["_h"] for r in got} == {"mine"}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and all(r["taken"] == 0 for r in got if not r["of"])
    patterns = sorted({tuple(sorted({str(x) for x in r["of"]})) for r in got if r["of"]})
    supply = {p: sum(r["size"] for r in got if tuple(sorted({str(x) for x in r["of"]})) == p) for p in patterns}
    flow = mixing.min_cost_flow([supply[p] for p in patterns], [[["a", "b", "c", "None"].index(x) for x in p] for p in patterns], [2500, 1200, 900, 300])
    taken = {p: sum(r["taken"] for r in got if tuple(sorted({str(x) for x in r["of"]})) == p) for p in patterns}
    assert abs(sum(taken.values()) - sum(map(sum, flow))) <= 2 * len(patterns)
    assert abs(taken[("None",)] - min(300, 2 * supply[("None",)])) <= 2


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([], schema), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [1], "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["an item of the benchmark"]}), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://driver:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


def test_a_wrapped_licence_keeps_its_sentences(spark):
    wrapped = KNOWN["BSD-2-Clause"].replace("above copyright", "above\ncopyright")
    docs = spark.createDataFrame([(1, wrapped)], "doc_id long, text string")
    assert scan_licenses(docs, known_digests(spark)).first()["license_id"] == "BSD-2-Clause"


def test_benchmark_places_do_not_depend_on_the_windows(monkeypatch):
    """Text that shares most of its q-grams with many probes, spread out in one piece and in the smallest windows."""
    rng = random.Random(5)
    phrase = "which of the following statements about the given passage is best supported by what the author says "
    items = [(i, phrase + " ".join(rng.choice(("red", "green", "blue", "old", "new")) for _ in range(12 + i % 9))) for i in range(60)]
    texts = [" ".join([phrase, items[i][1], "0 " * 80, items[-1 - i][1][:130]]) for i in range(12)] + [phrase * 30, None]
    probes = decontamination.Probes([*items, (99, "0 " * 70)])
    found = list(decontamination._found(pa.array(texts), probes))
    assert {(i, i) for i in range(12)} <= {row[:2] for row in found}
    pieces = len(list(probes.hits(decontamination._gram_hashes(decontamination._fold(" ".join(filter(None, texts)))[0]))))
    monkeypatch.setattr(decontamination, "HITS", 1)
    assert list(decontamination._found(pa.array(texts), probes)) == found
    assert pieces == 1 < len(list(probes.hits(decontamination._gram_hashes(decontamination._fold(texts[-2])[0]))))


def test_ranks_of_many_codes_take_little_memory():
    """Beside each of up to DENSE codes stood two 8-byte numbers: 537 MB and more at the most."""
    import tracemalloc

    import numpy as np

    from outlinelake.llm import quality

    codes = np.array([5, quality.DENSE - 1, 5, 0])
    tracemalloc.start()
    ranks, n = quality._ranked(codes, quality.DENSE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ranks.tolist(), n) == ([1, 2, 1, 0], 3) and peak < 6 * quality.DENSE


def test_rows_at_a_time(spark):
    from outlinelake.llm.common import rows_at_a_time

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(key), lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches)
    with rows_at_a_time(spark, 70):
        assert max(r["n"] for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()) == 70
    assert spark.conf.get(key) == before


def test_materialize_gives_the_drivers_freed_memory_back(spark):
    """What many threads of planning had freed outside the heap stayed with the driver: about 160 MB after a run of the pipeline."""
    own = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not own.exists() or not common.release_driver(spark):
        pytest.skip("memory can't be read or released here")

    def held():
        return sum(int(line.split()[1]) for line in own.read_text().splitlines() if line.startswith("Pss_Anon")) / 1024

    parts = [spark.range(500).groupBy((F.col("id") % n).alias("k")).agg(F.sum("id").alias("s")) for n in range(2, 42)]
    common.materialize(reduce(lambda a, b: a.unionByName(b), parts), "parts")
    before = held()
    common.release_driver(spark)
    assert before - held() < 15
