"""The pipeline's stages: nulls, empty and long texts, repeated rows, clashing columns, empty tables; and run() against the stages one by one."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from edgeframe.llm import decontam, packing, queries

from test_queries import BENCH, documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, k1 long, score double, held_out boolean, length long, root long"


def rows():
    own = [(i, t, lang, s, 0) for i, t, lang, s, _ in documents()]
    own += [(None, own[0][1], "en", "s0", 0), (None, None, None, None, None), own[5], own[5], (7, own[8][1], "de", "s1", 0), (None, "", "fr", "s2", 0)]
    return [(*r, 1, "k", 2, 0.5, True, 3, 4) for r in own]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pipe")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    table = pa.table({n: pa.array([r[i] for r in rows()], kinds[c.split()[1]]) for i, (n, c) in enumerate(zip(names, COLUMNS.split(", "), strict=True))})
    pq.write_table(table, at / "documents.parquet")
    pq.write_table(pa.table({"item_id": [r[0] for r in BENCH], "text": [r[1] for r in BENCH]}), at / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [r[0] for r in documents()], "quality": [int(r[4]) for r in documents()], "toxic": [0] * 150}), at / "labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def kept(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_rows_as_they_are(spark, docs, folder, name, stage):
    out = stage(spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    left = kept(docs)
    for r in kept(out):
        left.remove(r)  # every row is one of the table's, as often at most
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_language(spark, docs, folder):
    out = corpus_pipeline.language(spark, docs, folder).collect()
    assert not {30, 31, 32, 33} & {r.doc_id for r in out} and all(r.text for r in out)
    assert len([r for r in out if r.doc_id == 5]) == 3 and any(r.doc_id is None for r in out)
    assert len({r.doc_id for r in out}) > 130


def test_quality(spark, docs, folder):
    out = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, folder).collect()}
    good = {r[0]: r[4] for r in documents() if r[0] < 30 or r[0] > 42}
    assert sum(good.values()) - len(out & {i for i, g in good.items() if g}) <= 2 and len(out & {i for i, g in good.items() if not g}) <= 2


def test_near_dedup(spark, docs, folder):
    out = corpus_pipeline.one_of_each(spark, docs, folder).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert ids.count(5) == 1 and not {20, 21, 22} & set(ids) and {10, 11, 30, 31, 32} <= set(ids)
    assert len([r for r in out if r.doc_id is None]) == 3  # linked with nothing
    assert sorted(r.text == documents()[8][1] for r in out if r.doc_id in (7, 8)) == [False, True]  # 7 has two texts, one of them is 8's


def test_decontamination(spark, docs, folder):
    out = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()}
    assert {r[0] for r in rows()} - out == {40, 41, 42}


def test_decontamination_by_join(spark, docs, folder):
    """A benchmark that is too large to broadcast drops the same rows."""
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert kept(decontam.clean(docs, bench, block_bytes=40)) == kept(decontam.clean(docs, bench))


def test_packing(spark, docs, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    out = corpus_pipeline.packed(spark, docs, folder).collect()
    want = sorted((str(r[0]), len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows())
    whole = [(str(r.doc_id), r.length) for r in out if r.n_pieces == 1]
    long = {}
    for r in out:
        if r.n_pieces > 1:
            long[str(r.doc_id)] = long.get(str(r.doc_id), 0) + r.length
    assert sorted([*whole, *long.items()]) == want and max(r.length for r in out) <= max(packing.CAPACITIES)
    assert corpus_pipeline.packed(spark, docs.where("false"), folder).count() == 0


def test_run_is_its_stages_in_turn(spark, docs, folder):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == now.columns and sorted((str(r.doc_id), r.piece, r.length) for r in got.collect()) == sorted((str(r.doc_id), r.piece, r.length) for r in now.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "decontamination", "packing"] and got.count() > 40
