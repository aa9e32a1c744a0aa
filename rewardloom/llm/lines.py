"""Line dedup: boilerplate that spreads over many sites, found by merged HyperLogLog sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.session import cut_lineage


def _lines(documents: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """Each document's distinct lines that are not blank: ``key, site, line`` (a hash)."""
    distinct = F.array_distinct(F.transform(F.split(F.col(text), "\n"), F.trim))
    each = documents.select(F.col(key).alias("key"), F.col(site).alias("site"), F.explode(distinct).alias("text"))
    return each.filter("text <> ''").select("key", "site", F.unhex(F.md5("text")).alias("line"))


def spread_lines(
    documents: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", sites: int = 10,
    margin: float = 0.25, precision: int = 12,
) -> DataFrame:
    """Lines on at least ``sites`` distinct sites: ``line`` (a hash), ``least`` (the smallest key with it).

    A HyperLogLog sketch of sites for each line hash is merged by the aggregation,
    before and after the shuffle, so that a line that everybody has costs one
    sketch a task. Estimates off the threshold by more than ``margin`` decide;
    lines nearer to it are counted exactly over their distinct sites. With
    2**``precision`` registers the error is 1.6 percent, far inside the margin.
    Null sites count for nothing.
    """
    lines = cut_lineage(_lines(documents, key, site, text), "lines")
    often = lines.groupBy("line").agg(
        F.min("key").alias("least"), F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("estimate"))
    often = cut_lineage(often.filter(F.col("estimate") >= (1 - margin) * sites), "spread")
    sure = often.filter(F.col("estimate") > (1 + margin) * sites).select("line", "least")
    near = often.filter(F.col("estimate") <= (1 + margin) * sites)
    exact = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(
        F.count("site").alias("exact"))
    return sure.union(near.join(exact.filter(F.col("exact") >= sites), "line").select("line", "least"))


_CUT = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])


def _cut() -> Callable:
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            rows = []
            for text, found in zip(texts, marks, strict=True):
                text = text.as_py()
                if text is None:
                    rows.append({"text": None, "n_lines": 0, "n_removed": 0})
                    continue
                lines = text.split("\n")
                if not found.is_valid:
                    rows.append({"text": text, "n_lines": len(lines), "n_removed": 0})
                    continue
                first = {m["line"]: m["first"] for m in found.as_py()}
                kept = []
                for line in lines:
                    own = hashlib.md5(line.strip(" ").encode()).digest()
                    if own not in first:
                        kept.append(line)
                    elif first[own]:  # the one document that keeps the line, once
                        kept.append(line)
                        first[own] = False
                rows.append({"text": "\n".join(kept), "n_lines": len(lines), "n_removed": len(lines) - len(kept)})
            yield pa.array(rows, _CUT)

    return F.arrow_udf(cut, "text string, n_lines long, n_removed long", F.ArrowUDFType.SCALAR_ITER)


def without_boilerplate(
    documents: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", out: str = "lines",
    **options: float,
) -> DataFrame:
    """Documents with a struct ``out``: the text that stays, n_lines, n_removed.

    Lines are the parts between newlines, compared without the blanks around them;
    blank lines always stay. A line on at least ``sites`` distinct sites goes from
    every document but the one with the smallest key, which keeps its first
    occurrence, so that no content is lost altogether. A null text stays null and
    has no lines; a document whose lines all go keeps an empty text. Rows of one key
    share what is found in any of them. Rows with a null key count towards the
    spread and stay as they are. A column named ``out`` is replaced.
    """
    spread = spread_lines(documents, key, site, text, **options)
    hits = _lines(documents, key, site, text).filter("key is not null").join(spread, "line")
    marks = hits.groupBy(F.col("key").alias("mark_key")).agg(
        F.collect_set(F.struct("line", F.coalesce(F.col("key") == F.col("least"), F.lit(False)).alias("first"))).alias("marks"))
    # References bound to their table, so that documents may have columns of any name.
    joined = documents.join(marks, documents[key] == marks["mark_key"], "left")
    return joined.select(
        *[documents[c] for c in documents.columns if c != out], _cut()(documents[text], marks["marks"]).alias(out))
