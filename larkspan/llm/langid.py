"""Language identification by rank-order n-gram profiles.

A profile is a list of the most frequent character n-grams (n = 1 to 3, words padded by a space), most frequent first.
A text gets the language whose profile has the least out-of-place distance to its own: the sum over the text's n-grams
of the difference of ranks, or the longest possible one for n-grams that the profile lacks.

Profiles are learned from labelled texts, all of each text. `sample` bounds the texts learned from per language (in
expectation, by a hash of the id); it is a parameter. Null texts and texts without a letter are `und`, with score 0.
Null ids and null labels teach nothing. Ties go to the language that sorts first; with nothing learned all is `und`.
Repeated rows give repeated results, an empty table an empty one; a very long text is read in stretches. Columns other
than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common as C

#: n-grams in a profile; texts learned from per language; languages at most, as profiles are sent to all tasks.
PROFILE, SAMPLE, LANGUAGES = 300, 3000, 1000
#: Characters of a text that are read at a time.
STRETCH = 1 << 20

_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> np.ndarray:
    s = _OTHER.sub(" ", f" {text.lower()} ")
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that begin at the first n characters: 21 bits a character, the last in the lowest."""
    c = c.astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    one = c[:n]
    return np.concatenate([one[one != 32], two[:n], (c[:-2] << 42 | two[1:])[:n]])


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text."""
    c = _letters(text)
    return _grams(c, len(c)) if len(c) > 1 else np.zeros(0, np.int64)


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and how often each comes, or the sums of n."""
    order = np.argsort(codes, kind="stable") if n is not None else None
    codes = np.sort(codes) if order is None else codes[order]
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(np.append(edge, len(codes))) if order is None else np.add.reduceat(n[order], edge) if len(edge) else n


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a text and how often each comes. A very long one is counted a stretch at a time."""
    c = _letters(text)
    if len(c) <= STRETCH:
        return counted(_grams(c, len(c)) if len(c) > 1 else np.zeros(0, np.int64))
    parts = [counted(_grams(c[i : i + STRETCH + 2], STRETCH)) for i in range(0, len(c), STRETCH)]
    return counted(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))


def ranked(codes: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, equal ones by code."""
    return codes[np.argsort(-n, kind="stable")[:most]]


def profile(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    return ranked(*counted(codes), most)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages of docs, at most LANGUAGES of them with `most` codes each."""
    C.arrow_limits(spark)
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    place = (F.xxhash64(F.col("id"), F.lit("profile")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    chosen = taught.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1)
            for lang in sorted(set(langs)):
                u, n, parts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
                for i in np.flatnonzero(langs == lang).tolist():
                    parts.append(gram_counts(texts[i].as_py()))
                    held += len(parts[-1][0])
                    if held > STRETCH:
                        u, n = counted(np.concatenate([u, *(c for c, _ in parts)]), np.concatenate([n, *(k for _, k in parts)]))
                        parts, held = [], 0
                u, n = counted(np.concatenate([u, *(c for c, _ in parts)]), np.concatenate([n, *(k for _, k in parts)]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u), pa.array(n)], names=["lang", "code", "n"])

    sums = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = sums.withColumn("rank", rank).where(F.col("rank") <= most).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return found


class Judge:
    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most = sorted(profiles), most
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names:
            return "und", 0.0
        if not any(map(str.isalpha, text)):
            return "und", 0.0
        mine = ranked(*gram_counts(text), self.most)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        theirs = self.ranks[:, at]
        far = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.most * len(mine)))


def identify(spark: SparkSession, docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """docs with the columns lang_pred and lang_score after the others, which stay."""
    C.arrow_limits(spark)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    source = docs.select(*names).withColumn(text_col, F.col(text_col).cast("string"))
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, most)
        for batch in batches:
            out = [judge.judge(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=[*names, "lang_pred", "lang_score"])

    return source.mapInArrow(run, T.StructType(list(source.schema)).add("lang_pred", "string").add("lang_score", "double"))
