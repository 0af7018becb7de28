"""Many strings looked for in many texts at once: an automaton over the strings reads each text once, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Characters of patterns that one automaton takes. More are dealt into parts; each part is a broadcast and a pass of its own.
PART = 8_000_000
_HIT = "pattern string, first int, n int"
#: Hits after which a task hands on a batch.
BATCH = 50_000


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in patterns:
        found.add_word(p)
    found.make_automaton()
    return found


def _hits(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[int]]:
    """Each pattern of the text with its first place (from 1) and the number of its places, overlapping ones included."""
    out: dict[str, list[int]] = {}
    for end, size in automaton.iter(text):
        word = text[end - size + 1 : end + 1]
        if word in out:
            out[word][1] += 1
        else:
            out[word] = [end - size + 2, 1]
    return out


def _pass(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(_tid, pattern, first, n) of the patterns of one part."""
    sent = texts.sparkSession.sparkContext.broadcast(patterns)
    kind = texts.schema["_tid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:  # there is no automaton of no patterns
            return
        automaton = _automaton(sent.value)
        for batch in batches:
            ids, hits = batch.column("_tid"), []
            for at, text in enumerate(batch.column("_t")):
                hits += [(at, word, first, n) for word, (first, n) in _hits(text.as_py(), automaton).items()]
                if len(hits) >= BATCH or hits and at + 1 == len(ids):
                    rows, words, firsts, counts = zip(*hits)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(words), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())], ["_tid", "pattern", "first", "n"])
                    hits = []

    return texts.mapInArrow(run, f"_tid {kind}, {_HIT}")


def occurrences(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern_col: str, text_id: str, text_col: str, part: int = PART) -> DataFrame:
    """(pattern_id, text_id, first, n) for each pattern that a text contains: its first place, from 1, and how often it stands there.

    Equal patterns are looked for once and joined to their ids afterwards. The patterns are measured first: as long as they have no
    more than ``part`` characters they are broadcast, and the result is lazy; beyond, they are dealt into parts by hash and the hits of
    each part are written before the next is sent, so that driver and tasks hold one part at a time. Null and empty patterns and null
    texts give nothing. Places count code points.
    """
    given = patterns.select(F.col(pattern_id).alias("_pid"), F.col(pattern_col).alias("pattern")).where("pattern <> ''")
    asked = texts.select(F.col(text_id).alias("_tid"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    distinct = given.select("pattern").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("pattern") + 8), F.lit(0))).first()[0]  # 8: what a pattern costs besides its characters
    spark, parts = texts.sparkSession, -(-size // part)
    collect = lambda df: df.toArrow().column("pattern").to_pylist()
    if parts <= 1:
        found = _pass(asked, collect(distinct))
    else:
        path = scratch.folder(spark, "pattern-hits")
        dealt = distinct.withColumn("_part", F.pmod(F.xxhash64("pattern"), F.lit(parts)))
        for k in range(parts):
            _pass(asked, collect(dealt.where(F.col("_part") == k))).write.mode("append").parquet(path)
        found = spark.read.parquet(path)
    return found.join(given, "pattern").select(F.col("_pid").alias(pattern_id), F.col("_tid").alias(text_id), "first", "n")
