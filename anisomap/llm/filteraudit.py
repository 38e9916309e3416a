"""Filter interaction audit: what each of five filters removes in every order, from one histogram of failures.

A document fails some of the filters A to E, which is a number of five bits. Rows are counted by part (language) and by
that number: all of them, those of good quality, the toxic ones. These three histograms are stacked as rows of an
integer matrix with 32 columns, and its products with four fixed 32 x 600 incidence matrices (120 orders of 5 steps)
are the rows kept, removed, redundant and failing alone at every step. So the corpus is read once, whatever the number
of orders; only histograms, at most 32 rows a part, meet in a task.

* A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * characters A-Z > 3 * code points. D: one of the
  characters ``#$%&*|``. E: the text of a smaller doc_id, anywhere in the table. Words lie between ASCII white space.

Copies are told by SHA-256 of the text. Counts by digest are summed before rows of a digest meet, so that a text that a
third of all documents have is a row a task. Null texts are empty texts, and copies of each other; a null language is
the part ''. A row without a doc_id is no copy and makes no copies, and has no labels. Repeated rows count as often as
they stand there, and those of the smallest doc_id are no copies of each other. Repeated labels count as their maximum;
a document without a label is neither good nor toxic. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm.common import written

FILTERS = "ABCDE"
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Thresholds of the filters: fixed values.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 200, 50, 3, re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
COPY = 1 << FILTERS.index("E")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(raw: bytes, code_points: int) -> int:
    """Which of A to D a text fails, A in the lowest bit."""
    words = raw.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_SHARE * code_points) << 2
        | (MARKS.search(raw) is not None) << 3
    )


def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        masks, digests = [], []
        for t in texts:
            t = t if isinstance(t, str) else ""
            raw = t.encode("utf-8", "surrogatepass")
            masks.append(text_mask(raw, len(t)))
            digests.append(hashlib.sha256(raw).digest())
        yield pd.DataFrame({"mask": np.array(masks, np.int32), "digest": digests})


def incidence() -> dict[str, np.ndarray]:
    """The four 32 x 600 matrices; column 5 * order + step - 1."""
    before, own = np.zeros(len(ORDERS) * STEPS, np.int64), np.zeros(len(ORDERS) * STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        seen = 0
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            before[STEPS * o + s], own[STEPS * o + s] = seen, bit
            seen |= bit
    mask = np.arange(MASKS)[:, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    return {k: v.astype(np.int64) for k, v in found.items()}


def products(part: str | None, masks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The 600 rows of a part; ``counts`` has the columns all, good, toxic of the failures in ``masks``."""
    stacked = np.zeros((3, MASKS), np.int64)
    np.add.at(stacked.T, masks, counts)
    by = incidence()
    got = {k: stacked @ m for k, m in by.items()}
    letter = np.array([FILTERS.index(x) for o in ORDERS for x in o])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, letter, got["removed"][0])
    return pd.DataFrame({
        "part": part, "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)),
        "kept": got["kept"][0], "removed": got["removed"][0], "redundant": got["redundant"][0], "unique_fails": got["unique_fails"][0],
        "good_lost": got["removed"][1], "toxic_lost": got["removed"][2], "shapley": shapley[letter],
    })


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail."""
    rows = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.pandas_udf(_masked, "mask int, digest binary")("text").alias("m")).select("doc_id", "part", "m.*")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    flags = [F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("bad")]
    ids = rows.groupBy("doc_id", "digest", "part", "mask", *flags).agg(F.count("*").alias("n"))
    # The least id of a group and its number of rows: all rows of other ids may be copies.
    groups = ids.groupBy("digest", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.expr("sum(n) filter (where doc_id is not null)").alias("known"), F.expr("min(struct(doc_id, n)) filter (where doc_id is not null)").alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("copies", F.coalesce(F.col("known") - F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0), F.lit(0)))
    split = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n")))).alias("s")
    one = groups.select("part", "good", "bad", split).select("part", "good", "bad", "s.*")
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return one.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("bad").alias("toxic"))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; shapley is the filter's removals, summed over all orders."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return products(key[0], rows["mask"].to_numpy(), rows[["n", "good", "toxic"]].to_numpy())

    return written(failures(documents, labels), "failures").groupBy("part").applyInPandas(work, AUDIT)
