"""The corpus pipeline's stages: what goes, what stays, and odd rows in each."""

import random

import pytest

import corpus_pipeline
import public_tokenizers
from matloom.llm import bpe, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, _t string, _key string, hit_spans string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "light", "garden"]) + rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(n))


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), "kept score", "kept words", "kept t", "kept key", "kept spans")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Good and bad documents with labels, a benchmark, and rows of every odd kind."""
    folder, rng = str(tmp_path_factory.mktemp("sf")), random.Random(21)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        rows.append(row(i, prose(rng, 60) if good else "BUY!! NOW!! $$$ ### " * 15 + str(i)))
        labels.append((i, int(good), 0))
    item = prose(rng, 20)
    base = rows[1][1]
    rows += [row(500, base + " tail"), row(501, f"{prose(rng, 20)} {item} {prose(rng, 5)}"), row(502, None), row(503, ""), row(504, prose(rng, 50) + " write to someone@example.org now"), row(505, prose(rng, 20_000)), rows[2], rows[2]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, prose(rng, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def untouched(before, after):
    """All columns but the text and its length are as they were."""
    for i, rows in after.items():
        for r in rows:
            assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in before[i][0].asDict().items() if k not in ("text", "n_chars")}


def test_quality_stage(spark, sf_dir, docs):
    out = STAGES["quality classifier"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    found = by_id(out)
    untouched(by_id(docs), found)
    assert all((i in found) == (i % 3 > 0) for i in range(240)) and {501, 504} <= set(found)


def test_near_duplicate_stage(spark, sf_dir, docs):
    out = STAGES["near duplicates"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    found = by_id(out)
    untouched(by_id(docs), found)
    assert 500 not in found and 1 in found and {502, 503, 505} <= set(found) and len(found[2]) == 1


def test_near_duplicates_by_row(spark):
    """Another text of a repeated doc_id stays, repeated rows leave one, rows without doc_id stay."""
    rng = random.Random(3)
    t, u = prose(rng, 60), prose(rng, 60)
    rows = [(3, t), (5, t), (5, u), (7, u + " zz"), (9, t), (9, t), (11, u), (11, u), (None, t), (None, t), (13, None), (13, None), (15, " "), (17, u.upper()), (17, u)]
    out = neardup.deduplicated(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(0, t), (0, t), (3, t), (5, u), (13, ""), (15, " ")])
    alone = [(4, u), (4, u), (4, u)]
    assert [tuple(r) for r in neardup.deduplicated(spark.createDataFrame(alone, "doc_id long, text string")).collect()] == [(4, u)]


def test_contamination_stage(spark, sf_dir, docs):
    out = STAGES["benchmark decontamination"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    found = by_id(out)
    untouched(by_id(docs), found)
    assert set(by_id(docs)) - set(found) == {501} and len(found[2]) == 3


def test_personal_data_stage(spark, sf_dir, docs):
    out = STAGES["personal data"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    before, found = by_id(docs), by_id(out)
    untouched(before, found)
    assert "[EMAIL]" in found[504][0]["text"] and "@" not in found[504][0]["text"]
    assert all(found[i][0]["text"] == before[i][0]["text"] for i in before if i != 504)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for rows in found.values() for r in rows)


def test_token_stage(spark, sf_dir, docs):
    found = by_id(STAGES["byte-level BPE"](spark, docs, sf_dir))
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in docs.collect():
        assert all(x["token_ids"] == enc.encode_ordinary(r["text"] or "") for x in found[r["doc_id"]])
    assert len(found[2]) == 3


def test_run(spark, sf_dir):
    """Each stage's decisions take effect in what the next one gets."""
    found = by_id(corpus_pipeline.run(spark, sf_dir))
    assert not {0, 3, 500, 501} & set(found) and {1, 2, 504} <= set(found) and len(found[2]) == 1


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf_dir, docs, name):
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0
