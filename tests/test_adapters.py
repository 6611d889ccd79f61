"""Blocks of documents: every real line is in one, whole."""

from paperloom.sources import adapters as A


def test_blocks_hold_every_line_whole(spark):
    rows = [(d, "s", "\n".join(f"line {d} {i}" for i in range(n))) for d, n in enumerate([1, 2, 5, 6, 7, 8, 15, 40])] + [(50, "s", None), (51, "s", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {}
    for r in sorted(A.blocks(docs).collect(), key=lambda r: (r.doc_id, r.block_no)):
        got.setdefault(r.doc_id, []).append(r)
    assert 50 not in got
    for d, _, text in rows:
        if text:
            assert [r.block_no for r in got[d]] == list(range(len(got[d])))
            assert [r.page for r in got[d]] == [r.block_no // 8 for r in got[d]]
            marked = [t[-len(x):] for t in (r.text for r in got[d]) for x in text.split("\n") if t == x or t in (f"- {x}", f"1) {x}", f"a. {x}")]
            assert marked == text.split("\n")
