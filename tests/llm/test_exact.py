"""Duplicates, tokens and packing: against brute force, another tokenizer, and exact invariants."""

import json
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import formatting, packing, tokens

DATA = "/root/testdata/sf0.001"


def plain(x):
    return "".join(ch for ch in ("" if x is None else str(x)).upper().lower() if ch.isalnum())


def test_prompt_copies(raw_of):
    texts = ["Hello,  World 1", "HELLO world1!", "hello-world\t1", "other", None, "?!", " ?", "Straße", "STRASSE", ""]
    raw = raw_of([[("system", "x", None), ("User ", t, None), ("user", "later", None)] for t in texts] + [None, []])
    got = {tuple(r) for r in formatting.copies(raw, "row_id", formatting.prompt_key(F.col("conversation"))).collect()}
    assert got == {(0, 1), (0, 2), (7, 8)}
    groups = {r["first_id"]: r["n_copies"] for r in formatting.collapse(raw, "row_id", formatting.prompt_key(F.col("conversation"))).collect()}
    assert groups == {0: 3, 3: 1, 7: 2}


def test_payload_encodings(spark):
    m = [{"role": "user", "content": "A b", "language": "en"}, {"role": "assistant", "content": "c", "language": None}]
    other = [{"language": "EN", "content": "a  B!", "role": "USER"}, {"content": "C", "role": "Assistant"}]
    base = {"conversation_id": "i", "model": "m", "turn": 1}
    payloads = [
        {**base, "conversation": [[m[0]], [m[1]]]},
        {"conversation": other, "turn": 1, "model": "M", "conversation_id": "I"},
        {**base, "conversation": json.dumps([other])},
        {**base, "turn": 2, "conversation": m},
        {**base, "conversation": m[::-1]},
    ]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(10, '{"conversation": ['), (11, None), (12, ""), (13, "[]"), (14, '{"conversation": "no json"}')]
    df = spark.createDataFrame(rows, "payload_id long, payload string")
    got = {tuple(r) for r in formatting.copies(df, "payload_id", formatting.payload_key(F.col("payload"))).collect()}
    assert got == {(0, 1), (0, 2)}


def test_hot_keys_are_split_and_whole(spark):
    rows = [(i, "same TEXT" if i % 3 == 0 else f"t {i % 700}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string")
    key = F.unhex(F.sha2(formatting.letters_and_digits(F.col("t")), 256))
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    assert formatting.hot_keys(df.select(key.alias("_key")), 0.1).count() == 1
    got = {(r["first_id"], r["n_copies"]) for r in formatting.collapse(df, "id", key, share=0.1).collect()}
    assert got == {(min(g), len(g)) for g in groups.values()}
    copies = {tuple(r) for r in formatting.copies(df, "id", key, share=0.1).collect()}
    assert copies == {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_duplicates_of_odd_rows(spark, odd_raw):
    payloads = spark.createDataFrame([], "payload_id long, payload string")
    assert {tuple(r) for r in formatting.found(odd_raw, payloads).collect()} == set()
    assert formatting.found(odd_raw.limit(0), payloads).count() == 0
    assert {r["first_id"]: r["n_copies"] for r in formatting.groups(odd_raw, payloads).collect()} == {5: 1, 6: 2}


def test_found_equals_brute_force(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    raw, pay = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("raw_corpus", "raw_payloads"))
    groups = defaultdict(list)
    for r in raw.select("row_id", "conversation").collect():
        users = [m for t in r[1] or [] if t for m in t if m and (m["role"] or "").strip().lower() == "user"]
        if users and plain(users[0]["content"]):
            groups["raw_corpus", plain(users[0]["content"])].append(r[0])
    for r in pay.select("payload_id", "payload").collect():
        try:
            o = json.loads(r[1])
            c = o["conversation"]
            c = json.loads(c) if isinstance(c, str) else c
        except ValueError:
            continue
        ms = [m for x in c for m in (x if isinstance(x, list) else [x])]
        groups["raw_payloads", (plain(o["conversation_id"]), plain(o["model"]), plain(o["turn"]), tuple((plain(m["role"]), plain(m["content"]), plain(m["language"])) for m in ms))].append(r[0])
    want = {(k[0], min(v), x) for k, v in groups.items() for x in v if x != min(v)}
    assert {tuple(r) for r in formatting.found(raw, pay).collect()} == want


TEXTS = [
    "Hello world", "they'll  go \n\n x", "\r\n\r\n\t y", "中文字" * 300, "a" * 40_000, "aaa aaaa aaaaa", "é​﻿ 😀😀", " \x1c\x1f x　　y \x85", "<|endoftext|> x", "1234567890" * 50, "́x ﬁ",
]


@pytest.fixture(scope="module")
def vocabulary():
    if not Path(tokens.VOCABULARY).exists():
        pytest.skip("no tokenizer files here")
    return tokens.VOCABULARY


def test_ids_equal_those_of_the_library(spark, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(100, None, "x"), (101, "", "x"), (102, " ", "x"), (0, TEXTS[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[100] == by[101] == []
    for i, x in enumerate(TEXTS):
        assert by[i] == t.encode(x, add_special_tokens=False).ids
        assert tokens.decode(by[i]) == x
    assert tokens.encode(df.limit(0)).count() == 0


def test_ids_of_long_words(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    import random

    draw = random.Random(3)
    t = tokenizers.Tokenizer.from_file(vocabulary)
    of_byte, merges, held = tokens.vocabulary(vocabulary)
    merger = tokens.Merger(of_byte, merges, tokens.Reach.of(held))
    long = ["a" * 5000, "".join(draw.choice("etaoinshrdlu") for _ in range(5000)), "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(2000)), "=-" * 2000, "²ab³ 1½", "", None]
    sizes, ids = merger.encode(long)
    assert tokens.lists(sizes, ids).to_pylist() == [t.encode(x or "", add_special_tokens=False).ids for x in long]


def test_real_documents_round_trip(spark, vocabulary):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    for r in tokens.encode(docs).collect():
        assert tokens.decode(r["ids"]) == texts[r["doc_id"]]


def test_hilbert_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing(spark, vocabulary):
    rows = [(i, "word " * (i % 97)) for i in range(600)] + [(600, None), (601, ""), (602, "word " * 700), (603, "same"), (604, "same"), (604, "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = packing.pack(df, 256).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 256
    assert set(got.doc_id) == {r[0] for r in rows} and (got.doc_id == 604).sum() == 2
    sizes = {r["doc_id"]: len(r["ids"]) for r in tokens.encode(df).collect()}
    assert got[got.doc_id != 604].groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in sizes.items() if k != 604}
    whole = got.groupby("doc_id").size()
    assert (whole[[k for k, v in sizes.items() if v <= 256 and k != 604]] == 1).all()
    used = packing.fill(df, 256).first()
    assert used["used_share"] > 0.97
    empty = packing.pack(df.limit(0), 256)
    assert empty.count() == 0 and packing.fill(df.limit(0)).first()["n_containers"] == 0
