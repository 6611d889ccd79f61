import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.ByteBPE(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)
HARD = ["", " ", "a", "aaaaaaaaaaa" * 50, "ab" * 3000, "\n\n \t x  ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's we'll I'D", "été 日本語 🙂🙂", "  a　", "\x1c\x1d\x85 b", "١٢٣ ½ x²", "a" * 20001]


def same(texts):
    for text, ids in zip(texts, OURS.encode_block(texts), strict=True):
        want = THEIRS.encode(text, add_special_tokens=False).ids
        ids = ids.tolist()
        assert ids == want, text
        assert OURS.decode(ids) == THEIRS.decode(want, skip_special_tokens=False)


def test_hard_texts():
    same(HARD)


def test_every_character():
    same([f"a{chr(c)}b {chr(c)}{chr(c)} c" for c in range(0x3200) if not 0xD800 <= c < 0xE000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_random_texts(texts):
    same(texts)


RANKS = bpe.rank_encoder(OURS)


def test_rank_encoder_on_hard_texts():
    texts = [*HARD, " " * 300_000 + "x", "ab " * 100_000, "é日" * 50_000, *(f"a{chr(c)}b {chr(c)}{chr(c)} c" for c in range(0x3200) if not 0xD800 <= c < 0xE000)]
    for text in texts:
        assert RANKS(text).tolist() == next(OURS.encode_block([text])).tolist(), text[:50]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdehinorst' .\n", max_size=120)))
def test_rank_encoder_on_random_texts(text):
    assert RANKS(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_rank_encoder_on_documents():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        assert RANKS(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_cut_decoding_replaces_broken_bytes():
    ids = next(OURS.encode_block(["日本🙂"])).tolist()
    for i in range(len(ids)):
        assert OURS.decode(ids[: i + 1]) == THEIRS.decode(ids[: i + 1], skip_special_tokens=False)


def test_round_trip_query(spark):
    rows = [(i, t, 1) for i, t in enumerate(HARD)] + [(None, "null key", 1), (5, None, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.round_trip(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame(list(enumerate([*HARD, None])), "doc_id long, text string").repartition(3)
    for r in bpe.decode(bpe.encode(df, PATH), PATH).collect():
        text = [*HARD, None][r.doc_id] or ""
        assert r.ids == THEIRS.encode(text, add_special_tokens=False).ids and r.decoded == text


def test_rank_encoder_on_very_long_whitespace():
    for text in ["a" + " " * 1_200_000 + "x", "\n" * 1_200_000, "b　" + "　" * 1_200_000 + "<|endoftext|> y"]:
        assert RANKS(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids
