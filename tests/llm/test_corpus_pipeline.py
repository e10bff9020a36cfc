import math

import numpy as np
import pytest

import corpus_pipeline as C
from tests.conftest import SF001, SF01
from tests.llm import test_jaccard, test_line_templates, test_mixing, test_quality


@pytest.fixture(scope="module", params=[SF001, SF01])
def stages(spark, request):
    from failcast.scratch import materialize
    docs = [materialize(spark.read.parquet(f"{request.param}/documents.parquet"))]
    for _, stage in C.STAGES:
        docs.append(materialize(stage(spark, docs[-1], request.param)))
    return request.param, docs


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_names_and_columns(stages):
    _, docs = stages
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    assert all(d.columns == docs[0].columns for d in docs[:5])


def test_quality_keeps_good_documents(spark, stages):
    folder, docs = stages
    kept, before = dict(rows(docs[1])), dict(rows(docs[0]))
    assert all(before[i] == t for i, t in kept.items())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for i, t in before.items():
        n, *_, repeats = test_quality.brute(t)
        failed = n < 50 or 100 * repeats > 50 * n
        assert not (failed and i in kept)
        if not failed and i in quality:
            assert (i in kept) == bool(quality[i])


def test_lines(stages):
    _, docs = stages
    assert rows(docs[2]) == sorted(((i, t) for i, t, _, _ in test_line_templates.brute(rows(docs[1]))), key=str)
    assert all(r.n_chars == len(r.text) for r in docs[2].collect())


def test_one_of_each_group(stages):
    folder, docs = stages
    if folder == SF001:  # all pairs
        want = {i for i, _, c in test_jaccard.brute(rows(docs[2]), 5, 80) if i == c}
        assert {i for i, _ in rows(docs[3])} == want
    assert set(rows(docs[3])) <= set(rows(docs[2])) and docs[3].count() == docs[3].select("doc_id").distinct().count()


def test_mix(stages):
    _, docs = stages
    size, taken, longest = {}, {}, {}
    for r in docs[3].collect():
        n = len(r.text.split())
        size[r.source] = size.get(r.source, 0) + n
        longest[r.source] = max(longest.get(r.source, 0), n)
    times = {}
    for r in docs[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = test_mixing.water(size)
    assert max(times.values()) <= 2
    assert all(abs(taken.get(s, 0) - t) <= longest[s] / 2 + 1 for s, t in want.items())
    assert {(r.doc_id, r.text) for r in docs[4].collect()} <= set(rows(docs[3]))


def test_tokens(stages):
    from tokenizers import Tokenizer
    library, (_, docs) = Tokenizer.from_file(C.tokenizer_path()), stages
    want = sorted((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in docs[4].collect())
    got = docs[5].collect()
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.exact and r.n_tokens == len(r.ids) // 4 for r in got) and math.isfinite(len(got))


def test_run_and_empty_table(spark, tmp_path, stages):
    folder, docs = stages
    if folder == SF001:
        got = C.run(spark, folder)
        assert sorted((r.doc_id, bytes(r.ids)) for r in got.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in docs[5].collect())
        for t in ("documents", "labels"):
            spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
        assert C.run(spark, str(tmp_path)).collect() == []
