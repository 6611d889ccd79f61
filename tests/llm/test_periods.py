import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import periods, queries


def brute(t, least=12):
    """All runs by comparing the sequence with itself at every distance."""
    t, out = np.asarray(t), {}
    for p in range(1, len(t) // 2 + 1):
        same = np.append(t[p:] == t[:-p], False)
        edge = np.flatnonzero(np.diff(same.astype(int), prepend=0))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            if hi - lo + p >= max(least, 2 * p):
                out.setdefault((int(lo), int(hi) + p), p)
    return sorted((s, e, p) for (s, e), p in out.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(rng, n):
    """Roots of roots, with words changed here and there."""
    t = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
    while len(t) < n:
        t = t * rng.randrange(1, 5) + [rng.randrange(4) for _ in range(rng.randrange(4))] + t[: rng.randrange(len(t) + 1)]
    t = t[:n]
    for _ in range(rng.randrange(3)):
        t[rng.randrange(len(t))] = rng.randrange(4)
    return t


def cases():
    rng = random.Random(7)
    yield from ([], [1], [1] * 11, [1] * 12, [0, 1] * 6, list(range(64)) * 2, list(range(63)) * 3, list(range(200)) * 2, list(range(1000)) * 2 + [5])
    yield from ([0] * 1000, [0, 1] * 300 + [1, 0] * 300, [0, 1, 0] * 200 + [0] + [0, 1, 0] * 200, fibonacci(2500), ([0] * 100 + [1]) * 2, ([0] * 300 + [1]) * 5)
    for q in (1, 2, 3, 5, 7, 21):
        root = [rng.randrange(9) for _ in range(q)]
        yield (root * 700)[: 700 + q // 2] + (root[::-1] * 700)[:611]
        yield (root * 700)[:801] + (root * 700)[: 640 + q]
    for n in (150, 300, 700, 1500, 3000):
        for _ in range(60 if n < 1000 else 15):
            yield nested(rng, n)


def test_equals_brute_force():
    for t in cases():
        got = periods.find_runs(np.array(t, np.int64), len(t))
        assert [tuple(x) for x in got.tolist()] == brute(t), t


def test_texts_are_searched_apart():
    texts = [[b"a", b"b"] * 9, [], [b"b"] * 30, [b"a", b"b"] * 9, [str(i % 90).encode() for i in range(400)], [str(i).encode() for i in range(300)]]
    got = periods.runs_of_texts(texts)
    assert sorted(got) == [0, 2, 3, 4]
    for i, runs in got.items():
        assert [tuple(x) for x in runs.tolist()] == brute([hash(w) for w in texts[i]])


def expected(doc_id, text):
    """The contract row of one document, step by step."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {}
    runs = sorted((s, e - s, p) for s, e, p in brute([number.setdefault(w, len(number)) for w in words]))
    dropped = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    said = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("rows", ["documents", "odd"])
def test_query_equals_brute_force(spark, rows, tmp_path):
    if rows == "documents":
        sf = "/root/testdata/sf0.001"
    else:
        odd = [None, "", " \n\t", "a", "w " * 12, "w " * 11, "é x " * 20, "a b c " * 200, ("x " * 80 + "y ") * 6, "a\x1cb " * 15, "w " * 12, " ".join(map(str, range(9000))) * 3]
        made = spark.createDataFrame([(i % 40, odd[i % len(odd)]) for i in range(60)], "doc_id long, text string")
        made.withColumns({"runs": F.lit(1), "key": F.lit("x"), "collapsed": F.lit(None).cast("string")}).write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    got = sorted((tuple(r) for r in queries.op13_synchronised_runs(spark, sf).collect()), key=repr)
    want = [expected(*r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert periods.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
