import hashlib

import numpy as np
import pytest
import test_decontam
import test_dedup

import corpus_pipeline
from spindrift.llm import bpe, common, langid, line_dedup, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def brute_stages(spark, docs, benchmark):
    """What each stage should leave, from the rows of the one before."""
    prototypes = langid.train(docs)
    profiles = np.array([prototypes[k] for k in sorted(prototypes)])
    encoder, kept = langid.Encoder(), []
    for r in rows_of(docs):
        v = encoder.encode(r[1])
        if v is not None and (profiles @ v / np.linalg.norm(v)).max() >= corpus_pipeline.MIN_COSINE:
            kept.append(r)
    yield kept
    cleaned = {}
    for i, text, _, _ in test_dedup.brute_lines([(r[0], r[1], None, r[3]) for r in kept], line_dedup.RATIO, line_dedup.MIN_PAGES):
        cleaned.setdefault(i, []).append(text)
    kept = sorted(((r[0], t, r[2], r[3], len(t)) for r in kept for t in cleaned[r[0]]), key=repr)
    yield kept
    root = test_dedup.brute_components([test_dedup.brute_fingerprint(r[1]) for r in kept])
    least = {}
    for r, g in zip(kept, root, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    kept = [r for r, g in zip(kept, root, strict=True) if least[g] == r[0]]
    yield kept
    leaks = {d for d, _ in test_decontam.brute([(r[0], r[1]) for r in kept], benchmark)}
    kept = [r for r in kept if r[0] not in leaks]
    yield kept
    yield sorted((r[0], hashlib.sha256(bpe.load_vocabulary(bpe.default_vocabulary()).encode(r[1])).hexdigest()) for r in kept)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sizes = [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(spark, docs, benchmark), strict=True):
        out = common.materialize(stage(spark, docs, sf), name)
        sizes.append(out.count())
        if name == "bpe":
            assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == want
        else:
            assert out.columns == COLUMNS
            assert rows_of(out) == want, name
        docs = out
    assert sizes[0] > sizes[-1] > 100


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
    rows = [
        (1, None, "en", "s", 0, "k", "r"), (2, "", None, None, 0, "k", "r"), (None, "the of and that house", "en", None, 21, "k", "r"), (3, "the of and that house", "en", "s", 21, "k", "r"),
        (3, "the of and that house", "en", "s", 21, "k", "r"), (4, "1234", "en", "s", 4, "k", "r"), (5, "the other one is a text of its own", "en", "s", 33, "k", "r"),
    ]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        empty, docs = table.isEmpty(), table
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, sf), name)
            assert name == "bpe" or docs.columns == table.columns
        assert sorted(r.doc_id for r in docs.collect()) == ([] if empty else [3, 5])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf, name):
    import parity

    assert parity.differences(queries.queries()[name](spark, sf), parity.connect(sf), queries.oracle_sql()[name]) is None


def test_every_operator_is_registered(spark, sf):
    import __spark_entry__ as e

    known = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in known) for i in range(1, 11)) and "pipeline" in known


def test_native_operators_use_no_python():
    import inspect

    from spindrift.llm import decontam

    for module in (decontam, line_dedup):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("mapIn", "map_arrow", "udf", "pandas", "pyarrow", ".rdd"))
