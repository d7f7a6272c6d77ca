from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tesserine.llm import pieces
from tesserine.llm.bpe import default_path

PATH = default_path("piece_bpe_32k.model")


def test_equal_to_the_library():
    rng = random.Random(7)
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Transducer(PATH)
    atoms = [" ", "  ", " " * 17, "\n", "the", "ing", "é", "日", "\U0001f600", "͸", "a", "un", "believ", "able", ".", ",", "12", "</s>", "<0x41>", "▁", "tion", "er", "th", "S"]
    texts = ["", " ", "a  b", "   ", " " * 40, "tab\tx\nline  ", "ﬁ ½ Ａ"] + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t
        assert model.decode(model.encode(t)) == library.decode(ids) == t.replace("▁", " ")


SAMPLE = ["the theatre and then", "an unbelievable thing happened in the night", "sing a song of singing things", "Äpfel ﬁnden ½ ＡＢＣ", "日本 語です", "12 and 1,200.5 tables", "aaaa aaaaaaaa ababab"]


def message(*fields):
    """A serialised message of (number, value) fields."""
    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


def model_file(path, seed=1, kind="unigram", rule="identity", bytes_=False, front=True, trims=True, user=(), within=False, suffix=False):
    """A model with single characters, and substrings of SAMPLE with random scores: no tokenizer is trained."""
    rng = random.Random(seed)
    shown = ["▁" + t.replace(" ", "▁") for t in SAMPLE]
    words = shown if within else [x for t in shown for w in t.split("▁") if w for x in (w, "▁" + w)]
    found = {w[i : i + n] for w in words for n in range(2, 7) for i in range(len(w) - n + 1)}
    chars = sorted({c for w in words for c in w if rng.random() < 0.9 or c == "▁"})
    several = rng.sample(sorted(found), 150)
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(u, 0.0, 4) for u in user]
    pieces_ += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_ else []
    scores = [-float(x) for x in rng.sample(range(1, 1000), len(several))] if kind == "bpe" else [-rng.uniform(1, 12) for _ in several]
    pieces_ += [(t, x, 1) for t, x in zip(several, scores) if t not in user]
    pieces_ += [(c, -1000.0 - i if kind == "bpe" else -rng.uniform(5, 14), 1) for i, c in enumerate(chars) if c not in user]
    charsmap = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3] if rule != "identity" else b""
    charsmap = dict(pieces._fields(charsmap)).get(2, b"")
    own = [(1, message((1, t), (2, x), (3, k))) for t, x, k in pieces_]
    trainer = message((3, {"unigram": 1, "bpe": 2, "char": 4}[kind]), (24, int(suffix)), (35, int(bytes_)))
    with open(path, "wb") as f:
        f.write(message(*own, (2, trainer), (3, message((1, rule), (2, charsmap), (3, int(front)), (4, int(trims)), (5, 1)))))
    return path


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"bytes_": True, "trims": False},
        {"rule": "nmt_nfkc_cf", "front": False},
        {"within": True, "bytes_": True},
        {"kind": "bpe"},
        {"kind": "bpe", "seed": 2, "trims": False, "bytes_": True},
        {"kind": "bpe", "seed": 3, "trims": False},
        {"kind": "bpe", "rule": "nfkc_cf", "bytes_": True},
    ],
)
def test_other_models_equal_the_library(tmp_path, options):
    path = model_file(str(tmp_path / "m.model"), **options)
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path), random.Random(8)
    atoms = [" ", "  ", "\t", "\n", "the", "ing", "é", "e\u0301", "日", "本 語", "\U0001f600\U0001f601", "ﬁ", "½", "Ａ", "ＡＢ", "Ä", "S", "<sep>", "12", "\u00a0", "\u200b", "\u3000", "un", "thing", "sing", ".", "aa", "aaaaa", "ab"]
    texts = ["", " ", "   ", " a  b ", "ﬁ ½ Ａ", "x" * 300, "a" * 301, "singthing" * 40, "日" * 90] + SAMPLE + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t
        assert model.decode(model.encode(t)) == library.decode(ids), t
    if not model.unigram:
        assert model.merges.lost.any() and model.merges.odd.any()


def test_long_parts(monkeypatch):
    """A text without spaces, one that repeats a character, and one of characters without pieces."""
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Transducer(PATH)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["the", "ing", "un", "日本", "S", "="]) for _ in range(20_000)), "=" * 20_000, "龘" * 20_000, "x" * 65]
    for t in texts:
        assert np.frombuffer(model.encode(t), "<u4").tolist() == library.encode(t)
    told = [(len(i := library.encode(t)), zlib.crc32(np.array(i, "<u4").tobytes())) for t in texts]
    for most in (10, 10**6):
        monkeypatch.setattr(pieces, "REMEMBERED", most)
        small = pieces.Transducer(PATH)
        got = [(int(s.sum()), zlib.crc32(small.pool.at(k, s).tobytes())) for t in texts for _, k, s in small.encode_batch(pa.array([t]))]
        assert got == told


def test_models_that_would_come_out_wrong_are_refused(tmp_path):
    for options in ({"kind": "bpe", "user": ("the",)}, {"user": ("the",)}, {"suffix": True}, {"kind": "char"}, {"kind": "bpe", "within": True}):
        with pytest.raises(ValueError):
            pieces.Transducer(model_file(str(tmp_path / "m.model"), **options))


def test_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op7_pieces(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    out = df.withColumn("ids", pieces.encode_texts("text")).withColumn("back", pieces.decode_ids("ids")).orderBy("doc_id").collect()
    assert [r.back for r in out] == ["a b", "", ""]
    assert df.limit(0).select(pieces.encode_texts("text")).count() == 0


def test_odd_tables(spark):
    """Repeated rows, long texts, columns with the operator's own names, an empty table."""
    long = "the thing " * 20_000
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, long, 2, "y"), (None, None, None, None), (3, "▁a\tb\n", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_pieces bigint, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    told = df.select("doc_id", "n_pieces", pieces.pieces_told("text").alias("p")).select("doc_id", F.col("n_pieces").alias("own"), "p.*")
    want = [(d, o, len(i := library.encode(t or "")), zlib.crc32(np.array(i, "<u4").tobytes()), "▁" not in (t or "")) for d, t, o, _ in rows]
    assert sorted(map(tuple, told.collect()), key=str) == sorted(want, key=str)
    assert df.limit(0).select(pieces.pieces_told("text")).count() == 0
