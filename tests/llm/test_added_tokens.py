"""op2, op9 and the pipeline's packing against a fresh tokenizer, on texts with added tokens' strings."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tillroll.llm import queries, token_scan
from tillroll.llm.ship import ship
from tillroll.llm.tokens import CachedEncoder
from tillroll.sources.stage import scratch_path

TEXTS = ["end <|endoftext|> x", "<|endoftext|>", "plain words only", "a<|startoftext|>b <|ENDOFTEXT|> c", "<|endoftext|><|endoftext|> é 漢字", None, "", "<| endoftext |>", "it's\n\n two  lines " * 300]


def fresh(name):
    tok = Tokenizer.from_file(queries.vocabulary(name))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ship(spark)
    path = str(tmp_path_factory.mktemp("added"))
    spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoder_equals_a_fresh_tokenizer(kind, name):
    ids, lens = CachedEncoder(queries.vocabulary(name), kind, added=True).encode(TEXTS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == fresh(name)


def test_op2_added_tokens(spark, folder):
    want, at = [], 0
    for i, ids in enumerate(fresh("word_bpe_49k.json")):
        x = np.array([*ids, 1], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, queries.op2_orc_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op9_added_tokens(spark, folder):
    ids = [np.array([*x, 0], "<u4") for x in fresh("byte_bpe_50k.json")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for out in (queries.op9_min_bin_slack(spark, folder), corpus_pipeline.packed(spark, docs, folder)):
        seen = dict.fromkeys(range(len(ids)), 0)
        for r in out.collect():
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            seen[r["doc_id"]] += len(part)
        assert list(seen.values()) == [len(x) for x in ids]


def test_op1_keeps_its_separator_out_of_texts(spark, folder):
    docs, path = spark.read.parquet(f"{folder}/documents.parquet"), scratch_path(spark, "added")
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = [(i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)]
    out = token_scan.token_counts(token_scan.write(docs, path, queries.vocabulary("word_bpe_49k.json")), path)
    assert sorted(map(tuple, out.select("doc_id", "n_tokens").collect())) == want
