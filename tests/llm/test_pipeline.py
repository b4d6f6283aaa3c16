import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import decontam, langid, ngram_join, pii, queries

from .conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in docs.collect()}
    profiles = langid.fit(langid.training_rows(docs))
    told = langid.predict(docs, profiles).collect()
    held = {r[0]: held[r[0]] for r in told if r[1] != "und" and r[2] >= corpus_pipeline.LEAST_SCORE}
    near = ngram_join.brute_force([(i, d[1]) for i, d in held.items()])
    held = {i: held[i] for i, _, c in near if i == c}
    hit = {r[0] for r in decontam.brute_force([(i, d[1]) for i, d in held.items()], items) if r[5]}
    assert hit
    held = {i: d for i, d in held.items() if i not in hit}
    texts = {i: pii.replace_text(d[1], pii.DEFAULT_KEY, {})[0] for i, d in held.items()}
    assert any(texts[i] != held[i][1] for i in held)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(held)
    for i, r in got.items():
        assert r["text"] == texts[i] and (r["lang"], r["source"]) == held[i][2:4]
        ids = lib.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)


def test_stages_over_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.columns == docs.columns, name
                docs = out
            out.write.format("noop").mode("overwrite").save()


def test_one_of_equal_rows_stays(odd_docs, spark):
    out = corpus_pipeline.near_copies(spark, odd_docs, SF)
    ids = sorted(r["doc_id"] or -1 for r in out.collect())
    assert ids.count(1) == 1
    assert ids.count(5) == 2  # equal ids, different texts
    assert 6 not in ids  # near copy of 5


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_short_texts_of_large_scripts_stay(spark):
    rnd = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3500)]
    weight = [1 / (i + 10) for i in range(3500)]
    big = ["".join(rnd.choices(letters, weight, k=n)) for n in (50, 100, 300) for _ in range(60)]
    small = [" ".join(rnd.choices("the cat sat on a mat with some other dogs and birds".split(), k=40)) for _ in range(90)]
    odd = ["".join(chr(0x3B1 + rnd.randrange(17)) for _ in range(n)) for n in (50, 100, 300)]  # in no learned language
    rows_ = [(t, "zz") for t in big] + [(t, "en") for t in small] + [(t, None) for t in odd]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, (t, lang) in enumerate(rows_)], DOC_SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == set(range(len(big) + len(small)))
