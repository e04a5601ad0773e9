"""Stages of the pipeline: nulls, repeats, clashing columns, empty tables, and the whole against its parts."""

import functools
import random

import pytest

import corpus_pipeline as P
from tidewright.llm import language, packing, pii

from .test_operators import jaccard_truth, prose

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score int, lang_pred string, accepted string, row_key string, component_id long"


@pytest.fixture(autouse=True)
def small_model(monkeypatch):
    """A model that is trained less: its spans don't matter here."""
    monkeypatch.setattr(pii, "train", functools.partial(pii.train, count=128, epochs=1))


EN, DE = "the of with and thing from".split(), "der die und nicht schön auch".split()


def rows():
    rng = random.Random(3)
    out = [[i, prose(rng, rng.randint(20, 90), DE if i % 3 == 0 else EN), "de" if i % 3 == 0 else "en", "s", 5, i, "x", "y", "z", 7] for i in range(60)]
    for i in range(60, 66):
        out.append([i, out[i - 60][1] + " more", *out[i - 60][2:]])
    out.append([3, "call +1 (743) 555-3824 " + prose(rng, 40, EN), *out[3][2:]])  # a repeated id with another text
    out += [[None, out[5][1], *out[5][2:]], [None, prose(rng, 50, EN), *out[5][2:]], [None, None, *[None] * 8], [90, "", *out[1][2:]], [91, "12 !!", *out[1][2:]], list(out[10])]
    return out


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(0, rows()[20][1]), (1, None), (None, rows()[21][1]), (2, "never seen anywhere " * 5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows(), SHAPE).write.parquet(f"{path}/documents.parquet")
    return path


def bag(frame):
    return sorted(map(repr, frame.collect()))


def test_stages(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = language.fit(docs)
    accepted = {r.doc_id for r in language.predict(docs, model).filter("accepted").collect()}
    first = P.identify_language(spark, docs, where)
    assert first.schema == docs.schema and {r.doc_id for r in first.collect()} == accepted
    assert {r.score for r in first.collect()} <= {r[5] for r in rows()} and first.filter("text is null or text = ''").count() == 0
    second = P.drop_near_duplicates(spark, docs, where)
    # brute force over rows numbered in order of (doc_id, text), nulls last
    ordered = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    truth = jaccard_truth([(i, r[1]) for i, r in enumerate(ordered)])
    groups = {c for _, c in truth.values()}
    kept = [(r.doc_id, r.text) for r in second.collect()]
    member = lambda r: [truth[i][1] for i, o in enumerate(ordered) if (o[0], o[1]) == r]
    assert second.schema == docs.schema and len(kept) == len(groups) and {member(r)[0] for r in kept} == groups
    assert [k for k in kept if k[0] == 3] and len({k[1] for k in kept if k[0] == 3}) == 2
    third = P.decontaminate_benchmark(spark, docs, where)
    gone = [r for r in rows() if r[1] and rows()[20][1] in r[1]]
    assert third.schema == docs.schema and third.count() == len(rows()) - len(gone)
    fourth = P.mask_personal_data(spark, docs, where)
    assert fourth.schema == docs.schema and fourth.filter("text like '%[PHONE]%'").count() == 1
    assert all(r.n_chars == len(r.text) for r in fourth.collect() if r.text is not None)


def test_whole_is_its_parts(spark, where):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, where).collect(), docs.schema)
    want = packing.pack(docs, packing.vocabulary())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert bag(P.run(spark, where).select(*columns)) == bag(want.select(*columns))


def test_empty(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:3]:
        assert stage(spark, docs, where).count() == 0
    assert pii.mask(docs, pii.train()).count() == 0
