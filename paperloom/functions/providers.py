"""Model providers: what a model does is plugged in; the defaults are deterministic and need nothing installed."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...

    def embed(self, text: str) -> list[float]: ...


@lru_cache(maxsize=500_000)
def word_place(word: str, dim: int) -> int:
    """Where a word counts in a hashed vector of ``dim``: its place if up, ``dim`` more if down."""
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
    return h % dim + (0 if h >> 63 else dim)


class HashProvider:
    """Answers with the start of the last message, embeds words by hash: for tests and offline runs."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def chat(self, messages: list[dict[str, str]]) -> str:
        return messages[-1]["content"][:200]

    def embed(self, text: str) -> list[float]:
        places = [word_place(w, self.dim) for w in re.findall(r"\w+", text.lower())]
        n = np.bincount(np.array(places, int), minlength=2 * self.dim).astype(float)
        v = n[: self.dim] - n[self.dim :]
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


PROVIDERS: dict[str, Callable[[], Provider]] = {"hash": HashProvider, "hash64": lambda: HashProvider(64)}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]()


def embed(df: DataFrame, name: str = "hash", text: str = "text", out: str = "vec") -> DataFrame:
    """``df`` with the provider's vector of ``text``; the provider is made once a task. A text that fails gives null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(name)
        for b in batches:
            yield b.assign(**{out: [model.embed(t or "") for t in b[text]]})

    return df.mapInPandas(run, schema)


def ask(df: DataFrame, name: str = "hash", prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """``df`` with the provider's answer to ``prompt``."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(name)
        for b in batches:
            yield b.assign(**{out: [model.chat([{"role": "user", "content": p or ""}]) for p in b[prompt]]})

    return df.mapInPandas(run, schema)


def expand(df: DataFrame, name: str = "hash", query: str = "query", n: int = 3) -> DataFrame:
    """(…, query_no, variant): each query and up to ``n`` non-blank lines that the provider answers."""
    asked = ask(df.withColumn("prompt", F.concat(F.lit("Rephrase:\n"), query)), name)
    lines = F.slice(F.filter(F.split(F.coalesce("answer", F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, n)
    return asked.select(*df.columns, F.posexplode(F.concat(F.array(F.col(query)), lines)).alias("query_no", "variant"))


def tool_call(answer: Column) -> Column:
    """struct<tool, arguments> of a JSON answer; null for free text, which is a final answer."""
    call = F.from_json(answer, "tool string, arguments map<string,string>")
    return F.when(call["tool"].isNotNull(), call)


MESSAGES = "array<struct<role:string,content:string>>"


def converse(df: DataFrame, name: str, said: str = "said", out: str = "answer") -> DataFrame:
    """``df`` with the provider's answer to the messages of ``said``; null where they are null. The provider is made once a task."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(name)
        for b in batches:
            yield b.assign(**{out: [None if x is None else model.chat([{"role": m["role"], "content": m["content"]} for m in x]) for x in b[said]]})

    return df.mapInPandas(run, schema)


def tool_turns(questions: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], name: str = "hash", turns: int = 3, cut: int = 2000, key: str = "question_id") -> DataFrame:
    """(key, answer, used) of all ``questions`` (key, question) together: ``turns`` rounds of answers and tools, then a last answer.

    In a round every open question is answered once; free text ends it. An answer that is a tool call goes with all others
    of its tool, as rows (key, arguments map), to that tool, a function of DataFrames which gives (key, result) with one
    JSON string a call. The result's first ``cut`` characters are the next message. A tool that is not known, or gives
    nothing, has an error as its result. ``used`` lists (tool, result) in order. The plan has ``turns`` rounds whatever the
    number of questions; nothing comes to the driver. A state is kept on disk so that no model is asked twice.
    """
    from pyspark import StorageLevel

    user = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    state = questions.select(
        F.col(key).alias("key"), F.array(user(F.coalesce("question", F.lit("")))).alias("said"), F.lit(None).cast("string").alias("final"),
        F.array().cast("array<struct<tool:string,result:string>>").alias("used"),
    )
    for _ in range(turns):
        asked = converse(state.withColumn("open", F.when(F.col("final").isNull(), F.col("said"))), name, "open").drop("open")
        asked = asked.withColumn("call", tool_call(F.col("answer"))).persist(StorageLevel.DISK_ONLY)
        results = None
        for tool, handler in tools.items():
            calls = asked.where(F.col("final").isNull() & (F.col("call.tool") == tool)).select("key", F.coalesce("call.arguments", F.create_map().cast("map<string,string>")).alias("arguments"))
            one = handler(calls).select("key", F.col("result").cast("string").alias("result"))
            results = one if results is None else results.unionByName(one)
        met = asked.withColumn("result", F.lit(None).cast("string")) if results is None else asked.join(results, "key", "left")
        result = F.coalesce("result", F.to_json(F.struct(F.concat(F.lit("no result of tool "), F.col("call.tool")).alias("error"))))
        told = F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")), user(F.substring(result, 1, cut)))
        again = F.col("final").isNull() & F.col("call").isNotNull()
        state = met.select(
            "key", F.when(again, F.concat("said", told)).otherwise(F.col("said")).alias("said"),
            F.coalesce("final", F.when(F.col("call").isNull(), F.col("answer"))).alias("final"),
            F.when(again, F.concat("used", F.array(F.struct(F.col("call.tool").alias("tool"), result.alias("result"))))).otherwise(F.col("used")).alias("used"),
        )
    last = converse(state.withColumn("open", F.when(F.col("final").isNull(), F.col("said"))), name, "open")
    return last.select(F.col("key").alias(key), F.coalesce("final", "answer").alias("answer"), "used")


class ScriptedProvider(HashProvider):
    """Calls the tools that a question names as ``tool:argument``, one a turn, then answers with what they gave: for tests and offline runs."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        wanted = re.findall(r"(\w+):(\w+)", messages[0]["content"])
        turn = len(messages) // 2
        if turn < len(wanted):
            return json.dumps({"tool": wanted[turn][0], "arguments": {"of": wanted[turn][1]}})
        return "; ".join(m["content"] for m in messages[2::2]) or "nothing to look up"


PROVIDERS["scripted"] = ScriptedProvider


class Tools:
    """Named tools over DataFrames, and a loop of at most ``turns`` calls for one question at the driver; see `tool_turns` for many."""

    def __init__(self) -> None:
        self.handlers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, handler: Callable[..., DataFrame]) -> None:
        self.handlers[name] = handler

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.handlers:
            raise ValueError(f"unknown tool {name!r}")
        return self.handlers[name](**arguments)

    def loop(self, model: Provider, question: str, turns: int = 3, cut: int = 2000, rows: int = 20) -> str:
        said = [{"role": "user", "content": question}]
        for _ in range(turns):
            answer = model.chat(said)
            try:
                call = json.loads(answer)
            except ValueError:
                return answer
            if not isinstance(call, dict) or "tool" not in call:
                return answer
            shown = [r.asDict() for r in self.call(call["tool"], **call.get("arguments", {})).limit(rows).collect()]
            said += [{"role": "assistant", "content": answer}, {"role": "user", "content": json.dumps(shown, default=str)[:cut]}]
        return model.chat(said)


def describe_images(images: DataFrame, describer: Callable[[bytes], str], key: str = "doc_id", cap: int = 10) -> DataFrame:
    """``images`` (key, page, image_no, data binary) with description: the first ``cap`` a document by ``describer``, the rest a placeholder."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(key).orderBy("page", "image_no"))
    rows = images.withColumn("described", k <= cap)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, description string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(description=[describer(bytes(d)) if ok else "[image]" for d, ok in zip(b["data"], b["described"], strict=True)])

    return rows.mapInPandas(run, schema).drop("described")
