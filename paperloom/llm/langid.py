"""Language identification by Bayesian evidence fusion.

The text's likelihood under hashed letter-trigram models is combined with the language its markup declares, the suffix of
its address, and a prior of its host. Host priors come from grouped sums of the text's own posteriors, smoothed towards the
host's suffix, and that towards the whole corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import rows_of
from .scratch import materialize, small

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Address suffixes and the language they speak for.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
#: Three-letter language codes (ISO 639-3) of languages that tags write with two letters (ISO 639-1).
TWO_LETTERS = """
afr af amh am ara ar aze az bel be ben bn bos bs bul bg cat ca ces cs cym cy dan da deu de ell el eng en epo eo est et eus eu
fas fa fin fi fra fr gle ga glg gl guj gu hau ha heb he hin hi hrv hr hun hu hye hy ibo ig ind id isl is ita it jav jv jpn ja
kan kn kat ka kaz kk khm km kor ko kur ku lao lo lat la lav lv lit lt ltz lb mal ml mar mr mkd mk mlt mt mon mn msa ms mya my
nep ne nld nl nno nn nob nb nor no oci oc pan pa pol pl por pt pus ps que qu ron ro rus ru sin si slk sk slv sl som so spa es
sqi sq srp sr sun su swa sw swe sv tam ta tat tt tel te tgk tg tgl tl tha th tur tr uig ug ukr uk urd ur uzb uz vie vi xho xh
yid yi yor yo zho zh zul zu
""".split()


class Trigrams:
    """Hashed trigrams over the letters of lower-cased text; everything else is a word break."""

    def __init__(self) -> None:
        self.letter = np.full(256, 32, np.uint32)
        self.letter[97:123] = np.arange(97, 123)
        self.letter[128:] = np.arange(128, 256)

    def ids(self, text: str | None, step: int = 1 << 20) -> Iterator[np.ndarray]:
        """The trigram buckets of ``text``, at most about ``step`` at a time."""
        raw = np.frombuffer((text or "").lower().encode(), np.uint8)
        for lo in range(0, len(raw), step):
            b = self.letter[raw[max(0, lo - 2) : lo + step]]
            keep = np.ones(len(b), bool)
            keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
            b = b[keep]
            if len(b) > 2:
                h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
                yield h >> np.uint32(16)


def train(docs: DataFrame, per_language: int = 400) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each bucket under each, plus a last column for no language at all.

    ``docs`` has (text, lang); null labels take no part, null texts count nothing, repeated rows count each. Every label that occurs gets a model, fitted on a sample of about ``per_language`` whole
    rows chosen by a hash of the row; a smaller class gives all its rows. Only bucket counts come to the driver.
    """
    sizes = docs.where("lang is not null").groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return [], np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in sizes], "lang string, _share double")
    chance = F.pmod(F.xxhash64("text", "lang", F.lit(31)), F.lit(1_000_003)) / 1_000_003
    sample = docs.select("text", "lang").join(F.broadcast(shares), "lang").where(chance < F.col("_share"))

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bucket", "n"])
        total.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total = Trigrams(), {}
        for batch in batches:
            for text, lang in zip(rows_of(batch, "text"), batch["lang"].to_pylist(), strict=True):
                if lang not in total and len(total) == 64:
                    yield from counted(total)
                held = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for ids in cut.ids(text):
                    held += np.bincount(ids, minlength=BUCKETS)
        yield from counted(total)

    got = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {x: i for i, x in enumerate(names)}
    column = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    logs = np.full((BUCKETS, len(names) + 1), 0.05, np.float32)
    if len(column):
        logs[got["bucket"].to_numpy(), column] += got["n"].to_numpy()
    logs /= logs.sum(axis=0, dtype=np.float64).astype(np.float32)
    np.log(logs, out=logs)
    logs[:, -1] = -np.log(BUCKETS)
    return names, logs


def likelihoods(docs: DataFrame, logs: np.ndarray, temper: float) -> DataFrame:
    """``docs`` (text and carried columns) without its text, with ``ll``: the tempered log likelihood of each class, null without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(logs)
    rest = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, table = Trigrams(), sent.value
        for batch in batches:
            out = []
            for text in rows_of(batch, "text"):
                n, total = 0, np.zeros(table.shape[1])
                for ids in cut.ids(text):
                    n += len(ids)
                    total += np.bincount(ids, minlength=BUCKETS) @ table if len(ids) > BUCKETS else table[ids].sum(axis=0, dtype=np.float64)
                out.append((total * temper).tolist() if n else None)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(out, pa.list_(pa.float64()))], names=[*rest, "ll"])

    return docs.mapInArrow(score, "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", ll: array<double>>")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    grown = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
    return F.transform(grown, lambda x: x / total)


SHORT = dict(zip(TWO_LETTERS[::2], TWO_LETTERS[1::2], strict=True))


def primary(tag: Column) -> Column:
    """The language that a tag such as ``EN-us`` names: its first subtag in lower case, with two letters where there are such; null stays null."""
    first = F.lower(F.element_at(F.split(F.trim(tag), "[-_]"), 1))
    return F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(SHORT)), "map<string,string>"), first), first)


def primary_of(label: str) -> str:
    """As `primary`, for a label."""
    first = label.strip(" ").replace("_", "-").split("-")[0].lower()
    return SHORT.get(first, first)


def evidence(said: Column, names: list[str], trust: float) -> Column:
    """Log likelihood of a declared language (see `primary`) under each class: ``trust`` shared by the classes whose labels name it; nothing for null or unknown ones."""
    n = len(names)
    tags = F.from_json(F.lit(json.dumps([primary_of(x) for x in names])), "array<string>")
    shares = F.greatest(F.size(F.filter(tags, lambda t: t == said)), F.lit(1))
    own, other = F.log(F.lit(trust) / shares), F.log((1 - trust) / F.greatest(n - shares, F.lit(1)))
    known = F.concat(F.transform(tags, lambda t: F.when(t == said, own).otherwise(other)), F.array(F.lit(float(np.log(1 / max(2, n))))))
    return F.when(F.array_contains(tags, said), known).otherwise(F.array_repeat(F.lit(0.0), n + 1))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def attach(rows: DataFrame, table: DataFrame, key: str, hot: int = 1_000_000) -> DataFrame:
    """``rows`` with the columns of ``table`` (key, values, _rows) but _rows; null where it lacks the key.

    A table small in bytes is broadcast. A larger one is for the keys with over ``hot`` rows, so at most one in ``hot`` rows;
    the others meet their rows in a shuffled join, and rows without a key go by.
    """
    held = table.drop("_rows")
    if (ready := small(held)) is not held:
        return rows.join(ready, key, "left")
    often = F.broadcast(table.where(F.col("_rows") > hot).drop("_rows"))
    empty = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns if c != key]
    rest = rows.where(F.col(key).isNotNull()).join(often.select(key), key, "left_anti").join(held, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *empty)
    return rows.join(often, key).unionByName(rest).unionByName(none)


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = 400, temper: float = 0.3, trust: float = 0.9, suffix_trust: float = 0.7, kappa: float = 20.0, keep: float = 0.5, models: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``docs`` without its text, with language, posterior, kept and text_language, one row for each of its rows.

    ``docs`` has text, declared, host and suffix (any may be null: no evidence of that kind) and columns to carry along;
    ``labelled`` has (text, lang) for `train`, unless ``models`` gives what that returned. ``language`` is the most probable class given all evidence, ``text_language``
    by the text alone; both are "und" where no language fits the text better than chance does, where the text is null, empty or
    has no letters, and where nothing is labelled. ``kept`` says that a language was found with posterior >= ``keep``. Ties go
    to the alphabetically first. Priors use every row; the scored table is written once and holds no texts.
    """
    names, logs = models or train(labelled, per_language)
    size = len(names) + 1
    start = F.concat(F.array_repeat(F.lit(float(np.log(0.999 / max(1, len(names))))), len(names)), F.array(F.lit(float(np.log(0.001 if names else 1.0)))))
    rows = materialize(likelihoods(docs, logs, temper), "likelihoods")
    rows = rows.withColumn("_text", F.when(F.col("ll").isNotNull(), softmax(plus(F.col("ll"), start))))

    # Each level's sums of posteriors; small, since only sums leave a task.
    sums = [F.sum(F.col("_text")[i]).alias(f"s{i}") for i in range(size)]
    as_array = F.array(*[F.col(f"s{i}") for i in range(size)])
    seen = rows.where("_text is not null")
    whole = seen.agg(*sums).first()
    total = sum((x or 0.0) for x in whole) or 1.0
    base = [((x or 0.0) + 1 / size) / (total + 1) for x in whole]
    over = lambda c, parent: F.zip_with(c, parent, lambda x, p: (x + kappa * p) / (F.aggregate(c, F.lit(0.0), lambda a, y: a + y) + kappa))
    top = F.array(*[F.lit(float(x)) for x in base])
    counted = [*sums, F.count("*").alias("_rows")]
    by_suffix = seen.where("suffix is not null").groupBy("suffix").agg(*counted).select("suffix", over(as_array, top).alias("_parent"), "_rows")
    by_suffix = materialize(by_suffix, "suffixes")
    by_host = seen.where("host is not null").groupBy("host").agg(F.max("suffix").alias("suffix"), *counted)
    by_host = by_host.join(small(by_suffix.drop("_rows")), "suffix", "left").select("host", over(as_array, F.coalesce("_parent", top)).alias("_prior"), "_rows")
    by_host = materialize(by_host, "hosts")
    rows = attach(attach(rows, by_host, "host"), by_suffix, "suffix")
    prior = F.transform(F.coalesce("_prior", "_parent", top), lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    tags = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    spoken = F.try_element_at(tags, F.coalesce("suffix", F.lit("")))
    logits = plus(plus(F.col("ll"), prior), plus(evidence(primary(F.col("declared")), names, trust), evidence(spoken, names, suffix_trust)))
    rows = rows.withColumn("_all", F.when(F.col("ll").isNotNull(), softmax(logits)))
    label = F.from_json(F.lit(json.dumps([*names, UNKNOWN])), "array<string>")
    best = lambda c: F.coalesce(F.try_element_at(label, F.array_position(c, F.array_max(c)).cast("int")), F.lit(UNKNOWN))
    out = rows.withColumn("language", best(F.col("_all"))).withColumn("text_language", best(F.col("_text"))).withColumn("posterior", F.array_max("_all"))
    out = out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.coalesce("posterior", F.lit(0.0)) >= keep))
    return out.drop("ll", "_text", "_all", "_prior", "_parent")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, suffix) of raw pages (page_id, url, html): declared is the html element's lang.

    A null html has no text and declares nothing, a null url or one without host gives no host and suffix; rows stay as
    they are, other columns are ignored.
    """
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]*://([^/?#:]*)", 1))
    return pages.select("page_id", body.alias("text"), F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,8}(?:[-_][A-Za-z0-9]+)*)", 1), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))


def document_evidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, declared, host, suffix) of documents (text, source): the source is the host.

    Documents have no markup, so nothing is declared; their lang column only labels rows for `train`. Nulls stay null.
    """
    source = F.col("source").cast("string")
    suffix = F.nullif(F.regexp_extract(source, r"\.([a-z]+)$", 1), F.lit(""))
    return docs.select(F.col(key).alias(key), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("declared"), source.alias("host"), suffix.alias("suffix"))


def label_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(table, doc_id, page_id, language, posterior, declared, text_language, kept) of every document and every page; see `identify`.

    The models are fitted on the labelled documents; page_id is null for documents and doc_id for pages. Documents supply
    the host (their source), and a suffix where the source has one; pages supply the html element's lang, host and
    suffix. Null ids, texts and urls stay as rows; empty tables give no rows; other columns are ignored.
    """
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    models = train(labelled)
    told = ["language", "posterior", "declared", "text_language", "kept"]
    of_docs = identify(document_evidence(docs), labelled, models=models).select(F.lit("documents").alias("table"), "doc_id", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), *told)
    of_pages = identify(page_evidence(pages), labelled, models=models).select(F.lit("pages").alias("table"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "page_id", *told)
    return of_docs.unionByName(of_pages)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, source and others) whose language `identify` finds; columns stay.

    A row's verdict depends on its text and source alone, so rejected rows are matched by two hashes of these: rows that
    repeat go or stay together. Null, empty and letterless texts go. Columns of any type and name are carried.
    """
    text, source = docs["text"].cast("string"), docs["source"].cast("string")
    marks = [F.xxhash64(F.lit(i), text.isNull(), text, source) for i in (1, 2)]
    asked = document_evidence(docs.select("text", "source", F.struct(*(m.alias(n) for m, n in zip(marks, "ab", strict=True))).alias("mark")), "mark")
    scored = identify(asked, docs.select(text.alias("text"), docs["lang"].cast("string").alias("lang")))
    gone = small(materialize(scored.where(~F.col("kept")).select("mark.a", "mark.b").distinct(), "rejected"))
    return docs.join(gone, (marks[0] == gone["a"]) & (marks[1] == gone["b"]), "left_anti")
