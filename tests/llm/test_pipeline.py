import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows with known toxic texts, near copies and personal data."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(1500)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, toxic, copy_of = [], set(), {}
    for i in range(400):
        words = some(rng.randrange(30, 150))
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm"]))
        elif i % 7 == 0 and i > 50:
            other = i - 1 if (i - 1) % 5 and (i - 1) not in copy_of else i - 3
            if other % 5 and other not in copy_of:
                words = rows[other][1].split()
                words[len(words) // 2] = "edited" if len(words) > 100 else words[len(words) // 2]
                copy_of[i] = other
        elif i % 11 == 0:
            words.insert(5, f"name{i}@mail.example.com")
        text = " ".join(words)
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text), 0.5))
    rows += [(1000, None, None, "b", 0, None), (1001, "", "en", "b", 0, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i in toxic), 1) for i in range(0, 400)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, copy_of


def test_stages_against_plain_python(spark, tables, tmp_path):
    folder, rows, toxic, copy_of = tables
    text = {r[0]: r[1] for r in rows}
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen.append({"name": name, "rows": docs.collect()})
        if k < 4:
            assert docs.columns == before.columns
    tox, dedup, masked, mixed, last = (s["rows"] for s in seen)
    assert {r.doc_id for r in tox} == set(text) - toxic
    assert {r.doc_id for r in dedup} == set(text) - toxic - set(copy_of)
    for r in masked:
        want = text[r.doc_id]
        want = want if want is None else re.sub(r"name\d+@mail\.example\.com", "<EMAIL>", want)
        assert r.text == want and (want is None or r.n_chars == len(want))
    sizes, taken = {}, {}
    n = {r.doc_id: len((r.text or "").split()) for r in masked}
    for r in masked:
        sizes[r.source] = sizes.get(r.source, 0) + n[r.doc_id]
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + n[r.doc_id]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in names if o not in full) for s in names}
        above = {s for s in names if share[s] > 3 * sizes[s] and s not in full}
        if not above:
            break
        full |= above
    for s in names:
        assert abs(taken.get(s, 0) - share[s]) <= max(n.values())
    library = Tokenizer.from_file(TOKENIZER)
    of = {r.doc_id: r.text or "" for r in masked}
    assert len(last) == len(mixed)
    for r in last:
        assert r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == library.encode(of[r.doc_id], add_special_tokens=False).ids


def test_run_and_empty_documents(spark, tables, tmp_path):
    folder = tables[0]
    assert corpus_pipeline.run(spark, folder).count() > 100
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_the_toxicity_stage_rejects_what_op3_calls_toxic(spark, tables, monkeypatch):
    """A document with a hit scores 0.40 here, one without 0.05."""
    lexicon = corpus_pipeline.toxicity.Lexicon({" vileword ": 1.0}, (), (-3.0, 3.75, 0.0))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *args, **more: lexicon)
    docs = spark.createDataFrame([(1, "one vileword here"), (2, "none here"), (3, None)], "doc_id long, text string")
    assert 0.3 <= corpus_pipeline.toxicity.score_texts(docs, lexicon).filter("doc_id = 1").first().score < 0.5
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, tables[0]).collect()) == [2, 3]


def test_encoding_and_decoding_are_not_tasks_of_one_job(spark, tables):
    """Else each task has two Python workers, which the executors keep."""
    docs = spark.createDataFrame([(1, "en", "a", "some text")], "doc_id long, lang string, source string, text string")
    made = corpus_pipeline.encode(spark, docs, tables[0])
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert made.first().round_trip


def test_a_python_worker_keeps_the_tables_of_one_operator(spark, monkeypatch):
    """The functions that tasks run, all in this process."""
    docs = spark.createDataFrame([], "id long, text string")
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["some harmless text of a few words"]})
    lexicon = corpus_pipeline.toxicity.Lexicon({" vileword ": 1.0}, (), (-3.0, 3.75, 0.0))
    bpe, toxicity, order_minhash = corpus_pipeline.bpe, corpus_pipeline.toxicity, corpus_pipeline.order_minhash
    sent, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: sent.append(f) or plain(df, f, schema))
    bpe.encode(docs, TOKENIZER)
    toxicity.without_toxic(docs, lexicon)
    order_minhash._sketched(docs.withColumnRenamed("id", "tid"))
    encode, reject, sketch = (lambda f=f: list(f(iter([batch]))) for f in sent)
    for _ in range(2):  # a second task finds the first one's tables
        encode()
        assert bpe._LOADED and not toxicity._FOLDED
    codec = next(iter(bpe._LOADED.values()))
    encode()
    assert next(iter(bpe._LOADED.values())) is codec
    for _ in range(2):
        reject()
        assert toxicity._FOLDED and not bpe._LOADED
    sketch()
    assert not toxicity._FOLDED and not bpe._LOADED
