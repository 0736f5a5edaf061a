import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row

from icekeel.llm import bpe

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts(n: int = 400) -> list[str]:
    r = random.Random(5)
    parts = ["a", "Word", "don't", "é", "é", "́", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "　", "\x1c", "\x85", "!", "...", "12", "３", "漢字", "😀", "‍", "<|endoftext|>", "<|startoftext|>", "_", "'s", "'RE", "İ", "ſ", "Σ", "﻿", "​", "\x00"]
    return ["", " ", "\n", "a  ", *("".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(n)), " ".join(r.choices(parts, k=4000)), "x" * 20000]


def library(path: str, texts: list) -> list[list[int]]:
    return [e.ids for e in bpe.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("split", [bpe.SPLIT_BYTES, 40])
def test_splits_encode_alike(monkeypatch, split):
    monkeypatch.setattr(bpe, "SPLIT_BYTES", split)
    all_texts = [*odd_texts(), None, "two lines\nof plain words", "one", "a b\nc d\ne"]
    for path, blanks in ((BYTE, True), (WORD, False)):
        want = library(path, all_texts)
        order, words, numbers, sizes = bpe.numbered(pa.array(all_texts), blanks)
        words = words.to_pylist()
        assert sorted(order) == list(range(len(all_texts))) and sizes.sum() == len(numbers) and len(set(words)) == len(words)
        ids, at = library(path, words), 0
        for i, n in zip(order, sizes, strict=True):
            assert [x for w in numbers[at : at + n] for x in ids[w]] == want[i], repr(all_texts[i])
            at += n


def test_units_cover_all_rows():
    rows = [(k, "x" * (k * 7 % 23) if k % 5 else None) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows[a:b]]), pa.array([t for _, t in rows[a:b]], pa.string())], ["doc_id", "text"]) for a, b in ((0, 1), (1, 1), (1, 33), (33, 60))]
    got = list(bpe.units(iter(batches), 10))
    assert [tuple(r.values()) for t in got for r in t.to_pylist()] == rows
    assert all(sum(len(x or "") for x in t.column("text").to_pylist()[:-1]) < 10 for t in got) and len(got) > 20


def test_pieces_decode_alike():
    t = bpe.tokenizer(BYTE)
    for ids in ([], [50256], [220, 50256, 198], list(range(500)), [128, 129, 250]):
        assert b"".join(bpe.pieces(BYTE)[i] for i in ids).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


def test_round_trip_and_digests(spark):
    texts = [None, *odd_texts(60)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, unit=1, ids="x") for i, t in enumerate([*texts, *texts[:3]])], "doc_id long, text string, unit int, ids string").repartition(3)
    encoded = bpe.encode(docs, BYTE)
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()}
    assert decoded == {i: t or "" for i, t in enumerate([*texts, *texts[:3]])}
    got = {r.doc_id: r for r in bpe.encode(docs, BYTE, then=bpe.digests(BYTE), schema=bpe.DIGESTS).collect()}
    assert len(got) == len(texts) + 3
    for i, (text, ids) in enumerate(zip(texts, library(BYTE, texts), strict=True)):
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_units_and_batches_split(spark, monkeypatch):
    monkeypatch.setattr(bpe, "ROW_WORDS", 5)
    texts = ["a b c", "d " * 50 + "e", "", "x y"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.ids for r in bpe.encode(docs, BYTE).orderBy("doc_id").collect()] == library(BYTE, texts)
    monkeypatch.setattr(bpe, "BATCH_IDS", 7)
    for path, blanks in ((BYTE, True), (WORD, False)):
        assert [r.ids for r in bpe.encode_by_unit(docs, path, blanks).orderBy("doc_id").collect()] == library(path, texts)


def test_tails_are_parted(spark):
    r = random.Random(8)
    parts = ["a", "Word", "Straße", "ÀÉÿ", "ªº", "é", "\u0301", "漢", "12", "½", "²", "Ⅷ", "'s", "_", "-", ",", ".", "?!", "#*", "%", "$", ":;", "<|endoftext|>", "…"]
    texts = ["", ",", *(" ".join("".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(r.randint(1, 30))) for _ in range(300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.ids for r in bpe.encode_by_unit(docs, WORD, False, "!#$%*,.:;?").orderBy("doc_id").collect()]
    assert got == library(WORD, texts)


def test_empty_table_and_null_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), BYTE).collect() == []
    docs = spark.createDataFrame([(None, "one two"), (None, "one two")], "doc_id long, text string")
    assert [r.ids for r in bpe.encode(docs, BYTE).collect()] == library(BYTE, ["one two"] * 2)


@pytest.mark.parametrize("most", [1000, 5, 0])
def test_later_units_encode_new_words_alone(monkeypatch, most):
    sent, real = [], bpe.tokenizer(WORD)

    class Library:
        def encode_batch_fast(self, texts, **options):
            sent.extend(w for t in texts for w in t.split())
            return real.encode_batch_fast(texts, **options)

    monkeypatch.setattr(bpe, "tokenizer", lambda path: Library())
    monkeypatch.setattr(bpe, "KNOWN_WORDS", most)
    bpe._known.cache_clear()
    r = random.Random(3)
    units = [["Straße", "straße", "STRASSE", "ÀÉÿ", "àéÿ", "don't", "a1", "ªº", "漢"], ["STRAßE", "àÉÿ", "new", "12", "a1"], [], ["".join(r.choices("abÄéZ", k=4)) for _ in range(700)], ["a1", "<|endoftext|>"]]
    for unit in units:
        words = list(dict.fromkeys(unit))
        ids, starts, lengths = bpe._ids_of(pa.array(words, pa.large_string()), WORD)
        assert [ids[a : a + n].tolist() for a, n in zip(starts, lengths, strict=True)] == [real.encode(w, add_special_tokens=False).ids for w in words]
    bpe._known.cache_clear()
    again = sum(sent.count(w) for w in ("straße", "àéÿ"))
    assert again == (2 if most else 4) and not {"Straße", "STRAßE", "ÀÉÿ"} & set(sent)


def test_case_is_only_dropped_by_tokenizers_that_do(tmp_path):
    assert bpe._lowers(WORD) and not bpe._lowers(BYTE)
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    for k, change in enumerate(({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 0, "content": "Word"}]})):
        at = tmp_path / f"{k}.json"
        at.write_text(json.dumps(spec | change))
        assert not bpe._lowers(str(at))
