import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import foldbpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = foldbpe.read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", None, " ", "a", "ab" * 60, "x" * 127, "y" * 128, "z" * 129, "ab" * 3000, "\n\n \t x  ", "<|endoftext|>", "it's we'll I'D", "été 日本語 🙂🙂", "  a　", "\x1c\x1d\x85 b", "١٢٣ ½ x²", "=" * 5000]


def test_equals_tiktoken(spark):
    texts = [*HARD, *HARD[:3], *(f"a{chr(c)}b {chr(c)}{chr(c)} c" for c in range(0x3200) if not 0xD800 <= c < 0xE000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    out = {r.doc_id: r for r in foldbpe.decode(foldbpe.encode(df, PATH, block=5000), PATH).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        want = THEIRS.encode_ordinary(text or "")
        assert out[i].ids == want, text
        assert bytes(out[i].packed) == np.array(want, "<u4").tobytes()
        assert bytes(out[i].decoded) == (text or "").encode()


def test_words_met_before_are_not_sent_again(spark):
    """Blocks of one task share their words, long ones too, also after the task has forgotten them."""
    texts = [*HARD, "it's a zz " + "z" * 129, *HARD, "x" * 127 + " new words", *HARD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    chars = foldbpe.CHARS
    for limit in (chars, 300):
        foldbpe.CHARS = limit
        try:
            got = {r.doc_id: r.ids for r in foldbpe.encode(df, PATH, block=200).collect()}
        finally:
            foldbpe.CHARS = chars
        assert got == {i: THEIRS.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_heap_equals_tiktoken():
    rng = np.random.default_rng(1)
    for word in [b"a" * 3001, *(bytes(rng.choice(list(b"abethinors"), 700)) for _ in range(30))]:
        assert foldbpe.heap_merge(word, RANKS) == THEIRS.encode_ordinary(word.decode())


def test_null_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id int, text string")
    got = foldbpe.round_trip(rows, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (0, 2), (3, 0)]
    assert {r.ids_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert foldbpe.round_trip(rows.limit(0), PATH).count() == 0


def test_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in foldbpe.round_trip(rows, PATH).collect()}
    for doc_id, text in rows.select("doc_id", "text").collect():
        ids = THEIRS.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_fold_begins_with_the_ranks_of_its_bytes():
    words = [b"", b"ab", b"", "é日".encode(), b"z" * 128]
    for word, state in zip(words, foldbpe.begin(words, *foldbpe.byte_ranks(RANKS)).to_pylist(), strict=True):
        want = [(RANKS.get(word[i : i + 2], foldbpe.NONE) if i + 2 <= len(word) else foldbpe.NONE, i + 1, RANKS[word[i : i + 1]]) for i in range(len(word))]
        assert [(x // foldbpe.RANK, x // foldbpe.START % 256, x % foldbpe.START) for x in state] == [*want, (foldbpe.NONE, len(word) + 1, 0)]


def test_words_are_settled_in_one_number(spark):
    """Ranks that are in no order of merging too: a token of low rank that comes to be two parts late."""
    rng = np.random.default_rng(3)
    rare = [bytes([b]) for b in range(256)] + [bytes(x) for x in {tuple(rng.choice(list(b"abc"), n)) for n in rng.integers(2, 6, 400)}]
    for ranks in (RANKS, {t: int(r) for t, r in zip(rare, rng.permutation(len(rare)), strict=True)}):
        words = [b"", b"a", b"abcabc" * 5, *(bytes(rng.choice(list(b"abc"), n)) for n in rng.integers(2, 31, 400)), *(w.encode()[:30] for w in HARD if w)]
        held = foldbpe.Tokens(ranks)
        raw, sizes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.array([*map(len, words)])
        df = spark.createDataFrame([(i, x) for i, x in enumerate(held.found(raw, sizes).to_pylist())], "i long, tokens array<bigint>")
        gone = [r.gone for r in df.orderBy("i").select(foldbpe.settle(F.col("tokens")).alias("gone")).collect()]
        ids = held.spelled(raw, sizes, np.array(gone)).to_pylist()
        assert ids == [merged(w, ranks) for w in words]


def merged(word, ranks):
    """Pair by pair, the leftmost of the least rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]
