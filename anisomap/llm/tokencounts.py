"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas in idempotent commits.

A batch of changes is a set of signed counts: inserted documents add, deleted ones subtract, revised ones do both. Its
sums by key are added to the totals, which is all that a commit reads and writes. A commit leaves new totals in a folder
of its own and says in a small file, which also has the batch's name, that these are the next version. That file is
written under another name and renamed, which fails if that version is there already: so a commit that dies or loses
a race leaves no trace in the totals, and a file without content is none. (Rename must not replace files: so it is on
HDFS and local disks.) A batch that was applied before changes nothing. Totals of versions before the last are deleted.

Null texts count as documents without tokens; null sources and languages are keys like others. Keys whose documents
and tokens are all taken back disappear. Repeated rows count as often as they stand there. An empty table gives no rows.
Columns of documents that are named like those that ``count_tokens`` adds are replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.llm.common import fold, scratch, written
from anisomap.llm.tokens import encode, encoder, public_ranks

KEYS = ["source", "lang", "tokenizer_version"]
COMMIT = "number long, batch string, folder string"
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Versions that need no vocabulary: words between ASCII white space, and bytes of UTF-8.
PLAIN = {"words_v1": lambda raw: len(raw.split()), "bytes_v1": len}


def count_tokens(documents: DataFrame, versions: dict[str, tuple[str, str] | None]) -> DataFrame:
    """Every row of ``documents`` once for each version, with tokenizer_version and n_tokens.

    ``versions``: name to (path of ranks, pattern), or None for a plain version. Counts are those of the vocabulary's
    .json file: its special token counts once, wherever it stands in a text.
    """
    names, sources = list(versions), list(versions.values())

    @F.pandas_udf("array<long>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        each = [(PLAIN[n], None) if s is None else (None, encoder(*s)) for n, s in zip(names, sources, strict=True)]
        for texts in batches:
            out = []
            for t in texts:
                t = t if isinstance(t, str) else ""
                raw = t.encode("utf-8", "surrogatepass")
                out.append([plain(raw) if plain else len(encode(e, t)) for plain, e in each])
            yield pd.Series(out, dtype="object")

    documents = documents.drop("n_tokens", "tokenizer_version")
    rows = documents.withColumn("_n", counts(F.col("text")))
    return rows.select(*documents.columns, F.posexplode("_n").alias("_v", "n_tokens")).withColumn("tokenizer_version", F.element_at(F.array(*map(F.lit, names)), F.col("_v") + 1)).drop("_v")


def signed(counted: DataFrame, sign: int = 1, *by: str) -> DataFrame:
    """Sums by key (and further columns ``by``) of counted rows, with a sign: the deltas of a batch."""
    keys = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("tokenizer_version")]
    return counted.groupBy(*by, *keys).agg((F.count("*") * sign).alias("n_docs"), (F.sum("n_tokens") * sign).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of counted rows that replace others: the old are taken back, the new added."""
    return signed(before, -1).union(signed(after))


class Rollup:
    """Totals under ``path``, which all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._kept = spark.sparkContext._gateway.new_array(rename, 1)
        self._kept[0] = rename.NONE
        self._fs.mkdirs(self._path(f"{self.path}/commits"))

    def _commits(self) -> DataFrame:
        """(number, batch, folder) of all commits; files without content have no row."""
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits").where("folder is not null")

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _totals(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{folder}/totals") if folder else self.spark.createDataFrame([], TOTALS)

    def _last(self, n: int) -> list[str]:
        return [r.folder for r in self._commits().orderBy(F.desc("number")).limit(n).collect()]

    def totals(self) -> DataFrame:
        return self._totals(next(iter(self._last(1)), None))

    def batches(self) -> DataFrame:
        return self._commits().select("batch")

    def commit(self, batch: str, deltas: DataFrame, tries: int = 16) -> bool:
        """Add the deltas of a batch; False, and nothing is changed, if that batch was applied before."""
        deltas = deltas.select(*KEYS, F.col("n_docs").cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))
        for _ in range(tries):
            number = max(self._numbers(), default=0) + 1
            if not self.batches().where(F.col("batch") == batch).isEmpty():
                return False
            before = self._last(2)
            folder = f"{self.path}/data-{uuid.uuid4().hex}"
            sums = self._totals(next(iter(before), None)).union(deltas).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            sums.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{folder}/totals")
            if self._publish(number, {"number": number, "batch": batch, "folder": folder}):
                for old in before[1:]:
                    self._fs.delete(self._path(old), True)
                return True
            self._fs.delete(self._path(folder), True)  # another commit came first
        raise RuntimeError(f"batch {batch} could not be committed in {tries} tries")

    def _publish(self, number: int, commit: dict) -> bool:
        """Make a commit's file appear as a whole, unless that number is taken."""
        made = self._path(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        try:
            self._files.rename(made, self._path(f"{self.path}/commits/{number:012d}"), self._kept)
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True


def rollup_of(documents: DataFrame, versions: dict[str, tuple[str, str] | None] | None = None, batches: int = 4) -> DataFrame:
    """Totals of ``documents``, after a history that uses every kind of change.

    The documents are loaded in ``batches`` batches, the first of them delivered twice. Those of the second batch are
    loaded as drafts, the first halves of their texts, and then revised; those of the third are deleted and restored.
    """
    versions = versions or {"words_v1": None, "byte_bpe_50k": public_ranks()}
    batch = F.pmod(fold("doc_id", batches), F.lit(batches))
    final = documents.select("source", "lang", "text", batch.alias("batch"))
    drafts = final.where(F.col("batch") == 1).withColumn("text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    sums = signed(count_tokens(final, versions), 1, "batch").withColumn("draft", F.lit(False))
    sums = written(sums.union(signed(count_tokens(drafts, versions), 1, "batch").withColumn("draft", F.lit(True))), "deltas")

    def deltas(b: int, draft: bool = False, sign: int = 1) -> DataFrame:
        own = sums.where((F.col("batch") == b) & (F.col("draft") == draft))
        return own.select(*KEYS, (F.col("n_docs") * sign).alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))

    rollup = Rollup(documents.sparkSession, scratch(documents.sparkSession, "rollup"))
    for b in [*range(batches), 0]:
        rollup.commit(f"load-{b}", deltas(b, draft=b == 1))
    rollup.commit("revise-1", deltas(1, draft=True, sign=-1).union(deltas(1)))
    rollup.commit("delete-2", deltas(2, sign=-1))
    rollup.commit("restore-2", deltas(2))
    return rollup.totals()
