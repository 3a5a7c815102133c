"""The stages of the pipeline against brute-force versions on the smallest tables."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import naive_simhash, naive_spans
from tidemark.storage import written


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SMALL), name))
    return docs


def test_all_but_the_last_return_documents(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxic_documents_go_and_few_others(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    clean = [r["doc_id"] for r in labels if not r["toxic"]]
    assert sum(d in kept for d in clean) > 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    prints = {r["doc_id"]: naive_simhash(r["text"]) for r in stages[1].collect()}
    kept, left = {r["doc_id"] for r in stages[2].collect()}, sorted(prints)
    while left:
        group, todo = set(), [left[0]]
        while todo:
            d = todo.pop()
            if d not in group:
                group.add(d)
                todo += [e for e in left if e not in group and (prints[d] ^ prints[e]).bit_count() <= 3]
        assert kept & group == {min(group)}
        left = [d for d in left if d not in group]


def test_unlike_texts_stay_whatever_their_ids(spark, odd_documents):
    """One row of each group stays on odd tables, and of unlike texts that share an id or have none."""
    rng = random.Random(11)
    unlike = [" ".join(rng.choices("etaoinshrdlu", k=40)) for _ in range(6)]
    more = spark.createDataFrame([(500, unlike[0]), (500, unlike[1]), (500, unlike[1]), (None, unlike[2]), (None, unlike[3]), (None, unlike[3]),
                                  (501, unlike[4]), (None, unlike[4]), (None, None), (502, unlike[5]), (503, unlike[5])], "doc_id long, text string")
    docs = odd_documents.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    left, want = [(naive_simhash(t), (d, t)) for d, t in rows], []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            own = todo.pop()
            group.append(own[1])
            near = [x for x in left if (x[0] ^ own[0]).bit_count() <= 3]
            left = [x for x in left if (x[0] ^ own[0]).bit_count() > 3]
            todo += near
        want.append(min(group, key=order))
    got = corpus_pipeline.without_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted(want, key=order)
    assert {(500, unlike[0]), (500, unlike[1]), (None, unlike[2]), (None, unlike[3])} <= set(want)


def test_no_personal_data_is_left(stages):
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stages[2:4])
    assert before.keys() == after.keys()
    assert not any(naive_spans(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not any(c.isdigit() or c == "@" for c in t))


def test_ids_give_the_texts_back(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(library.encode(texts[r["doc_id"]]).ids) for r in rows)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
