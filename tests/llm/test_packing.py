import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        hist = {n: lengths.count(n) for n in lengths}
        bins, ranks = {}, {}
        for n, lo, hi, per, first, at in packing.plan(hist, cap):
            for r in range(lo, hi):
                ranks.setdefault(n, []).append(r)
                bins.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * n, n))
        assert ranks == {n: list(range(c)) for n, c in hist.items()}
        for slots in bins.values():
            end = 0
            for at, n in sorted(slots):
                assert at == end
                end += n
            assert end <= cap
        assert len(bins) == best_fit_decreasing(lengths, cap)


def test_pack(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", " ", "gamma.", "\n", "délta"]
    rows = [(i, "".join(rng.choices(words, k=rng.choice([0, 3, 40, 700, 2500]))), "x") for i in range(80)]
    rows += [(80, None, "x"), (81, "", "x"), (5, rows[5][1], "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    out = packing.pack(df, PATH, capacity=1024).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        lo, k = 0, 0
        while lo < len(ids):
            hi = lo + ((len(ids) - lo) % 1024 or 1024)
            want.append((i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
            lo, k = hi, k + 1
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in bins.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end += n
        assert end <= 1024
    assert len(bins) == best_fit_decreasing([r.length for r in out], 1024)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_parts_change_nothing(spark):
    cut = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(id % 7 + 1 as long) as length", "id as ids_crc32")
    for n in (1, 9):
        parts = cut.withColumn("part", (F.col("doc_id") % n).cast("int"))
        parts = parts.withColumn("nth", (F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id")) - 1).cast("long"))
        out = packing.assign(parts, 16).collect()
        slots = {(r.sequence_id, r.offset + i) for r in out for i in range(r.length)}
        assert len(out) == 500 and len(slots) == sum(r.length for r in out) and max(o for _, o in slots) < 16


def test_sequences_can_be_built(spark):
    texts = {i: "alpha béta " * (i * 37 % 900) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tok, sequences, docs = Tokenizer.from_file(PATH), {}, {}
    for r in packing.pack(df, PATH).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, {}).update(dict(enumerate(ids, r.offset)))
        docs.setdefault(r.doc_id, {})[r.piece] = ids
    assert all(sorted(s) == list(range(len(s))) and len(s) <= 1024 for s in sequences.values())
    for i, t in texts.items():
        assert sum((docs[i][k] for k in sorted(docs[i])), []) == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_equal_rows_without_keys_are_spread(spark):
    df = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "'alpha beta' as text", "id % 1 as lane")
    out = packing.pack(df, PATH, capacity=16)
    n, slots, bins = out.selectExpr("count(*)", "count(distinct sequence_id, offset)", "count(distinct sequence_id)").first()
    assert n == slots == 30_000 and bins == -(-n // (16 // out.first().length))
