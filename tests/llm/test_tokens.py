"""Packing, the token index, byte-level BPE and the pipeline."""

from collections import defaultdict

import base64
import hashlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tagwright.llm import bpe, packing, token_index, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    keys = sorted(texts)
    return {k: [*e.ids, 2] for k, e in zip(keys, tokenizer.encode_batch([texts[k] for k in keys], add_special_tokens=False))}


def test_added_tokens_in_texts():
    """As the library has them by default, wherever they stand."""
    tokenizer = Tokenizer.from_file(PATH)
    encoder = tokens.library_encoder(PATH)
    texts = ["end <|endoftext|> of text", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "é <|endoftext|> ü " * 300]
    flat, counts = encoder.encode(texts)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(got[0]) == 5 and got[1] == [50256]


@pytest.mark.parametrize("width,limit", [(2, 50), (4, 100_000)])
def test_remembered_pieces_change_nothing(texts, ids, width, limit, monkeypatch):
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    encoder = tokens.library_encoder(PATH, width)
    encoder.pieces.limit = encoder.pretokens.limit = limit
    keys, got = sorted(texts), []
    for _, flat, counts in encoder.batches([texts[k] for k in keys], chars=50_000):
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [ids[k][:-1] for k in keys]
    assert list(encoder.batches([])) == []


def check_packing(rows, ids, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        at = 0
        for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, brute.crc(ids[key][at : at + r.length]))
            assert i == 0 or r.length == capacity
            at += r.length
        assert at == len(ids[key])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 100])
def test_packing(docs, ids, capacity):
    used = check_packing(packing.pack(docs, PATH, capacity=capacity).collect(), ids, capacity)
    least = -(-sum(map(len, ids.values())) // capacity)
    assert least <= used <= least + 2


def test_packing_repeats_and_nothing(spark, docs, empty):
    assert packing.pack(empty, PATH).count() == 0
    twice = packing.pack(docs.unionByName(docs), PATH).collect()
    places = [(r.sequence_id, r.offset) for r in twice]
    assert len(set(places)) == len(places)


def test_plan_is_best_fit_on_counts():
    slots, sequences = packing.best_fit_plan({6: 2, 5: 3, 4: 2, 1: 5}, 10)
    assert sequences == 4 and {s[0] for s in slots} == {6, 5, 4, 1}  # 40 tokens in 4 sequences of 10
    assert packing.best_fit_plan({}, 10) == ([], 0)
    assert packing.best_fit_plan({10: 7}, 10)[1] == 7
    assert packing.best_fit_plan({3: 10}, 10)[1] == 4


def test_token_index(docs, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_index.round_trip(docs, PATH).collect()}
    at, want = 0, {}
    for key in sorted(ids):
        want[key] = (at, len(ids[key]), brute.crc(ids[key]))
        at += len(ids[key])
    assert got == want


def test_token_index_repeats_missing_keys_and_nothing(spark, empty):
    rows = [(3, "b"), (None, "x"), (3, "a longer one"), (1, None), (7, "c")]
    got = token_index.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "3", "7", "None"]
    ordered = sorted(got, key=lambda r: r.start)
    assert ordered[0].doc_id is None and [r.doc_id for r in ordered[1:]] == [1, 3, 3, 7]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:]))
    assert token_index.round_trip(empty, PATH).count() == 0


def test_lookup_tells_strangers(spark, docs, tmp_path):
    folder = str(tmp_path / "index")
    token_index.write(docs, folder, PATH)
    asked = spark.createDataFrame([(k,) for k in [0, 5, -3, 10**9, 10**9 + 1]], "doc_id long")
    assert {r.doc_id for r in token_index.lookup(asked, folder).collect()} == {0, 5, -3}


def test_minimal_perfect_hash():
    keys = np.random.default_rng(2).choice(10**12, 20_000, replace=False) - 10**11
    mph = token_index.MinimalPerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))
    again = token_index.MinimalPerfectHash(mph.sizes, mph.bits)
    assert (again.slots(keys) == mph.slots(keys)).all()
    assert len(token_index.MinimalPerfectHash.build(np.empty(0, np.int64)).slots(keys)) == len(keys)


@pytest.fixture(scope="module")
def own_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, texts, own_encoding):
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        want = own_encoding.encode_ordinary(text)
        assert got[key].n_tokens == len(want)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_tables(docs, texts, empty):
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == texts
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pipeline_against_brute_force(spark):
    """Every stage against its definition, on what the stage before kept."""
    import corpus_pipeline

    from tagwright.llm import toxicity
    from tagwright.sources.shared import publish

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {"start": {r.doc_id: r for r in docs.collect()}}
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet")))
    toxic = {r.doc_id for r in scores.where("toxic").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = publish(stage(spark, docs, d), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        rows[name] = {r.doc_id: r for r in docs.collect()}
    assert set(rows["toxicity"]) == set(rows["start"]) - toxic
    failed = {k for k, r in rows["toxicity"].items() if brute.quality(r.text)[5]}
    symbols = {k for k, r in rows["toxicity"].items() if brute.quality(r.text)[2] > 0.2 * brute.quality(r.text)[0]}
    assert set(rows["quality_rules"]) == set(rows["toxicity"]) - failed - symbols
    prints = {k: brute.fingerprint(r.text) for k, r in rows["quality_rules"].items()}
    assert set(rows["simhash_near_dedup"]) == set(brute.classes(prints).values())
    assert set(rows["pii"]) == set(rows["simhash_near_dedup"])
    assert not any(brute.personal(r.text) for r in rows["pii"].values())
    tokenizer = Tokenizer.from_file(PATH)
    ids = {k: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for k, r in rows["pii"].items()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, d).collect(), ids, 1024)
