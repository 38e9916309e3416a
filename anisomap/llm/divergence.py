"""Source divergence audit: how far the word distributions of a language's sources lie apart, and by which terms.

Everything comes from two scans of sorted streams. For the first one, every task sums its documents' terms (document
frequency and count by language, source and term) up to a bound of held terms and hands them on; rows are dealt by
(language, term) and sorted by (language, term, source, document), and a run-length scan adds up runs, keeps terms that
are in enough documents of the language, and writes their counts by source. So a term that all documents have is a row
a task and source before rows meet.

For the second scan the terms of a language are dealt to blocks, the language's sources stand before the terms of every
block, and rows are sorted by (language, block, term, source). The scan fills a bounded matrix of terms by sources and
emits partial sums of pairs of sources and the best terms of each source for every block. Sources beyond ``TILE`` are
dealt to tiles, so that a task holds ``TILE`` rows of pairs. What remains is a sum of partial pairs and a rank.

All arithmetic is on integers: p = 1 + floor(1e9 * (count + 5) / (N + 5 V)) by long division in three steps of 1000,
exact for N + 5 V below 9.2e15. Null text, language and source are ''. A row is one document of the language, so that
repeated rows count as often as they stand there; doc_id, which may be null, only orders partial counts. Documents
without terms still make their source one of the language's. Ties in value go to the item that is first in UTF-8. An
empty table gives no rows; a language without kept terms has pairs of value 0. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm.common import written

#: A-Z to a-z, and all other ASCII characters that are no letters to spaces; bytes above 127 stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms a task holds before it hands partial counts on (some 200 MB); terms of a block; cells of a matrix; sources of a tile.
HELD, BLOCK, CELLS, TILE = 1_000_000, 8192, 1 << 20, 512
#: Rows that a scan looks at together.
ROWS = 1 << 15
LEAST_DOCUMENTS, SMOOTH, SCALE, TOP = 30, 5, 1000, 50
PARTIAL = "lang string, term string, source string, document long, docs long, n long"
KEPT = "lang string, term string, source string, n long, first long"
FOUND = "lang string, source string, part string, item string, value long"


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _text(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies and counts of a task's documents; the term '' stands for a source as such."""
    held: dict[tuple[str, str], tuple[int | None, Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (document, docs, n) in held.items():
            names = list(n)
            for low in range(0, len(names), ROWS):
                part = names[low : low + ROWS]
                size = len(part)
                columns = [
                    pa.repeat(pa.scalar(lang), size), _text(part), pa.repeat(pa.scalar(source), size), pa.repeat(pa.scalar(document, pa.int64()), size),
                    pa.array([docs[t] for t in part], pa.int64()), pa.array([n[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "docs", "n"])
        held.clear()

    size = 0
    for rows in batches:
        for lang, source, document, raw in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "document", "raw")), strict=True):
            own = held.get((lang, source))
            if own is None:
                own = held[lang, source] = (document, Counter(), Counter({b"": 0}))
            words = terms(raw)
            before = len(own[2])
            own[2].update(words)
            own[1].update(set(words))
            size += len(own[2]) - before
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(rows: pa.Table, *keys: str) -> np.ndarray:
    """Where runs of equal keys begin, for columns of text."""
    new = np.ones(rows.num_rows, bool)
    same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (rows.column(k).combine_chunks() for k in keys)]
    if rows.num_rows > 1:
        new[1:] = ~np.logical_and.reduce([np.asarray(x.to_numpy(zero_copy_only=False), bool) for x in same])
    return np.flatnonzero(new)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches as tables of ``ROWS`` rows or more, as far as there are so many."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _scan_terms(least: int):
    """Runs of (lang, term, source): their counts, if the runs of (lang, term) together have ``least`` documents."""

    def emit(runs: pa.Table) -> Iterator[pa.RecordBatch]:
        at = _runs(runs, "lang", "term")
        size = np.diff(np.append(at, runs.num_rows))
        docs = np.repeat(np.add.reduceat(runs.column("docs").to_numpy(), at), size)
        first = np.zeros(runs.num_rows, np.int64)
        first[at] = 1
        word = np.asarray(pc.not_equal(runs.column("term"), "").to_numpy(), bool)
        got = runs.select(["lang", "term", "source", "n"]).append_column("first", pa.array(first * word))
        yield from got.filter(pa.array((docs >= least) | ~word)).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in _gathered(batches):
            rows = rows.select(["lang", "term", "source", "docs", "n"])
            rows = rows if held is None else pa.concat_tables([held, rows])
            at = _runs(rows, "lang", "term", "source")
            sums = {c: pa.array(np.add.reduceat(rows.column(c).to_numpy(), at)) for c in ("docs", "n")}
            runs = rows.select(["lang", "term", "source"]).take(pa.array(at))
            for c, v in sums.items():
                runs = runs.append_column(c, v)
            last = _runs(runs, "lang", "term")[-1]
            held = runs.slice(last)
            if last:
                yield from emit(runs.slice(0, last))
        if held is not None:
            yield from emit(held)

    return scan


def kept_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n, first) of kept terms where they occur, and the term '' for every (lang, source); first is 1 once a term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text("lang").alias("lang"), text("source").alias("source"), F.col("doc_id").try_cast("long").alias("document"), text("text").cast("binary").alias("raw"))
    dealt = rows.mapInArrow(_partial, PARTIAL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(_scan_terms(least), KEPT)


def scaled(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * count / whole), exactly, for count <= whole < 9.2e15."""
    rest, got = count.astype(np.int64), 0
    for _ in range(3):
        rest = rest * SCALE
        got = got * SCALE + rest // whole
        rest = rest % whole
    return got + 1


class _Block:
    """The terms of one block of a language against all its sources; those of one tile as the first of a pair."""

    def __init__(self, lang: str, tile: int):
        self.lang, self.tile, self.names, self.sums, self.v = lang, tile, [], [], 0
        self.rows: list[pd.DataFrame] = []
        self.held, self.pairs, self.best = 0, None, {}

    def sources(self, rows: pd.DataFrame) -> None:
        self.names += rows["source"].tolist()
        self.sums += rows["n"].tolist()
        self.v = int(rows["v"].iloc[0])

    def begin(self) -> None:
        if self.pairs is None:
            self.place = {s: i for i, s in enumerate(self.names)}
            self.own = np.arange(self.tile * TILE, min(len(self.names), (self.tile + 1) * TILE))
            self.whole = np.array(self.sums, np.int64) + SMOOTH * self.v
            self.all = np.int64(sum(self.sums) + SMOOTH * self.v)
            self.pairs = np.zeros((len(self.own), len(self.names)), np.int64)

    def add(self, rows: pd.DataFrame) -> None:
        self.begin()
        self.rows.append(rows[["term", "source", "n"]])
        self.held += len(rows)
        if self.held * len(self.names) >= CELLS:
            got = pd.concat(self.rows, ignore_index=True)
            last = _changes(got["term"].to_numpy(object))[-1]
            self.count(got.iloc[:last])
            self.rows, self.held = [got.iloc[last:]], len(got) - last

    def count(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            return
        term = rows["term"].to_numpy(object)
        at = _changes(term)
        names, step = term[at], max(1, CELLS // len(self.names))
        row, column, n = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(term)))), np.array([self.place[s] for s in rows["source"]]), rows["n"].to_numpy()
        for low in range(0, len(at), step):
            high = min(len(at), low + step)
            use = slice(*np.searchsorted(row, [low, high]))
            c = np.zeros((high - low, len(self.names)), np.int64)
            c[row[use] - low, column[use]] = n[use]
            p = scaled(c + SMOOTH, self.whole[None, :])
            over = p - scaled(c.sum(1) + SMOOTH, self.all)[:, None]
            for i, s in enumerate(self.own):
                self.pairs[i] += np.abs(p - p[:, s : s + 1]).sum(0)
                hit = np.flatnonzero((c[:, s] > 0) & (over[:, s] > 0))
                if len(hit):
                    both = self.best.get(s, []) + [(-v, t) for v, t in zip(over[hit, s].tolist(), names[low + hit], strict=True)]
                    self.best[s] = sorted(both)[:TOP]

    def end(self) -> Iterator[pd.DataFrame]:
        self.begin()
        if self.rows:
            self.count(pd.concat(self.rows, ignore_index=True))
        for i, s in enumerate(self.own):
            other = np.arange(len(self.names)) != s
            yield pd.DataFrame({"lang": self.lang, "source": self.names[s], "part": "pair", "item": np.array(self.names, object)[other], "value": self.pairs[i][other]})
            if s in self.best:
                yield pd.DataFrame({"lang": self.lang, "source": self.names[s], "part": "term", "item": [t for _, t in self.best[s]], "value": [-v for v, _ in self.best[s]]})


def _scan_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block, key = None, None
    for rows in batches:
        if not len(rows):
            continue
        cuts = _changes(rows["lang"].to_numpy(object), *(rows[c].to_numpy() for c in ("block", "tile", "kind")))
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            part = rows.iloc[a:b]
            now = (part["lang"].iloc[0], part["block"].iloc[0], part["tile"].iloc[0])
            if now != key:
                if block:
                    yield from block.end()
                block, key = _Block(now[0], int(now[2])), now
            (block.add if part["kind"].iloc[0] else block.sources)(part)
    if block:
        yield from block.end()


def divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources by distance, and the terms that a source has above its language."""
    kept = written(kept_counts(documents, least), "kept")
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("f")).withColumn("v", F.sum("f").over(Window.partitionBy("lang"))), "groups")
    most = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("s")).agg(F.max("v"), F.max("s")).first()
    blocks, tiles = max(1, -(-(most[0] or 0) // BLOCK)), max(1, -(-(most[1] or 0) // TILE))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = groups.select("lang", "source", "n", "v", upto(blocks).alias("block")).select("lang", "block", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", "n", "v")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    rows = heads.union(kept.where("term <> ''").select("lang", block, F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("long").alias("v")))
    rows = rows.select("*", upto(tiles).alias("tile")).repartition("lang", "block", "tile").sortWithinPartitions("lang", "block", "tile", "kind", "term", "source")
    sums = rows.mapInPandas(_scan_blocks, FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
