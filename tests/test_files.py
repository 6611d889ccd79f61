"""Files read in shares of their pages, and tool calls of many questions in rounds."""

import os

from pyspark.sql import functions as F

from paperloom.functions import providers as P
from paperloom.sources import extract as E


def counts(folder):
    return {n: len(open(f"{folder}/{n}").readlines()) for n in os.listdir(folder)}


def test_shares_of_pages_in_one_pass(spark, tmp_path):
    folder = str(tmp_path / "seen")
    os.mkdir(folder)

    class Counted(E.TextFile):
        """Notes what is opened and parsed, a line a call."""

        lines = 1

        def __init__(self, content, password):
            self._note("open")
            super().__init__(content, password)

        def _note(self, what):
            with open(f"{folder}/{what}", "a") as f:
                f.write("x\n")

        def spans(self, page):
            self._note("page")
            if self.text[page] == "bad":
                raise RuntimeError("bad page")
            return super().spans(page)

    big = "\n".join(f"line {i}" if i != 70 else "bad" for i in range(100))
    held = {"big": (big, None), "small": ("one\ntwo", None), "broken": ("%broken\n" + "z" * 500, None), "locked": ("%locked k\nsecret", None), "wrong": ("%locked k\nsecret", "j"), "right": ("%locked k\nsecret", "k"), "none": (None, None)}
    rows = [(p, len(c) if c is not None else None, c.encode() if c is not None else None, w) for p, (c, w) in held.items()]
    files = spark.createDataFrame(rows, "path string, length long, content binary, password string").withColumn("modificationTime", F.lit(1))
    E.read_documents(files, Counted, share_bytes=200).write.parquet(f"{tmp_path}/read")
    read = spark.read.parquet(f"{tmp_path}/read")
    shares = -(-len(big) // 200)
    assert read.where("path = 'big'").count() == shares > 3
    assert sorted((r.path, r.page, r.error) for r in E.failures_of(read).collect()) == [
        ("big", 70, "RuntimeError: bad page"), ("broken", None, "ValueError: broken file"), ("locked", None, "ValueError: password needed"), ("wrong", None, "ValueError: wrong password"),
    ]
    spans = {(r.path, r.page): r.text for r in E.spans_of(read).collect()}
    assert spans == {("big", i): f"line {i}" for i in range(100) if i != 70} | {("small", 0): "one", ("small", 1): "two", ("right", 0): "secret", ("none", 0): ""}
    assert {r.path: (r.pages, r.metadata["encrypted"]) for r in E.documents_of(read).collect()} == {"big": (100, "false"), "small": (2, "false"), "right": (1, "true"), "none": (1, "false")}
    assert counts(folder) == {"open": shares + 3 + 5, "page": 100 + 2 + 1 + 1}  # the broken file has three shares
    told = E.progress_of(read).where("path = 'big'").orderBy("share").collect()
    assert [(r.page, r.total) for r in told] == [(100 * (i + 1) // shares, 100) for i in range(shares)]


def test_limit_of_pages(spark):
    class Three:
        page_count, metadata = 3, {}

    files = spark.createDataFrame([("a", 9, b"x\ny\nz")], "path string, length long, content binary")
    assert [(r.page, r.error) for r in E.failures_of(E.read_documents(files, lambda c, p: Three(), max_pages=2)).collect()] == [(None, "too many pages")]
    assert E.read_documents(files.limit(0), E.TextFile).count() == 0


def test_rounds_of_tools(spark):
    asked = [(1, "hello"), (2, "double:7"), (3, "double:1 double:2 double:3 double:4"), (4, "nothing:here"), (5, None)]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    double = lambda calls: calls.select("key", F.concat(F.lit("="), (F.col("arguments")["of"].cast("int") * 2).cast("string")).alias("result"))
    got = {r.question_id: (r.answer, [tuple(u) for u in r.used]) for r in P.tool_turns(questions, {"double": double}, "scripted").collect()}
    assert got[1] == ("nothing to look up", []) and got[5] == got[1]
    assert got[2] == ("=14", [("double", "=14")])
    assert got[3] == ('{"tool": "double", "arguments": {"of": "4"}}', [("double", "=2"), ("double", "=4"), ("double", "=6")])  # three rounds, then the last answer
    assert got[4] == ('{"error":"no result of tool nothing"}', [("nothing", '{"error":"no result of tool nothing"}')])
    cut = {r.question_id: r.answer for r in P.tool_turns(questions, {"double": double}, "scripted", cut=2).collect()}
    assert cut[2] == "=1"
    assert {r.answer for r in P.tool_turns(questions, {}, "scripted", turns=0).collect()} >= {"nothing to look up"}
