"""Token counts as delta-maintained rollups.

A batch of changes becomes signed deltas: an insert adds its documents and tokens, a delete takes away what
was counted, a revised count takes away the old and adds the new. A batch stores two small tables: its deltas
summed by source, language and tokenizer version, and its ledger, the deltas of every document it touched, dealt
into buckets by document. Totals are those of the last base and the few batches after it; neither the corpus
nor the totals are read to apply a batch. Of the ledger only the buckets are read in which the batch takes
something away, to see that this was counted before: a batch that would leave a document with less than nothing is
refused as a whole.

What is in force is written in a log of numbered entries: entry n names the base and the batches after it. A
commit writes its tables first and then renames its entry onto the next number, which the store does for one writer
only. Who comes second reads the entry that came first and looks again: is its batch id known now, was what it takes
away taken by the other? So a batch id counts once, a batch may be sent again after any failure, and of two batches
that take the same away one is refused. ``compact`` replaces those batches that it has read, no others. Readers see the
tables of one entry; what an entry replaces stays until ``clean``, which is told for how long readers may need it. A
store must rename folders atomically.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.llm import bpe, common, tokenfile

KEYS = ("source", "lang", "tokenizer")
CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"
SUMS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
LEDGER = "doc_id long, " + SUMS + ", bucket int"
BUCKETS = 64


def deltas(changes: DataFrame) -> DataFrame:
    """Signed deltas by document and key of changes (op, doc_id, source, lang, tokenizer, n_tokens, old_n_tokens).

    op is insert, delete or revise. A revision changes the tokens of a document that stays, from
    ``old_n_tokens`` to ``n_tokens``. Null counts are 0; null ids and keys are ids and keys of their own; rows that
    repeat count as often as they come. An unknown op fails the query rather than being passed over.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_n_tokens", F.lit(0)).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    docs = docs.otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))).cast("long")
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    found = changes.groupBy("doc_id", *KEYS).agg(F.sum(docs).alias("d_docs"), F.sum(tokens).alias("d_tokens"), F.max((F.col("op") != "insert").cast("int")).alias("takes"))
    return found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))


class Refused(ValueError):
    """A batch that takes away what isn't counted."""


class Rollup:
    """Totals kept in a folder: tables of bases and batches, and a log that says which of them are in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("log", "data"):
            self.fs.mkdirs(self._at(f"{self.path}/{name}"))

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, time in seconds) of what a folder holds, by name."""
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self._at(f"{self.path}/{folder}")))

    def _entry(self, name: str) -> dict:
        stream = self.fs.open(self._at(f"{self.path}/log/{name}/entry.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self) -> tuple[int, dict]:
        """(number, entry) in force: ``base`` is a folder of data or null, ``batches`` (id, folder) in the order of commits."""
        while True:
            names = [n for n, _ in self._listed("log")]
            if not names:
                return -1, {"base": None, "batches": []}
            try:
                return int(names[-1]), self._entry(names[-1])
            except Exception:
                if self.fs.exists(self._at(f"{self.path}/log/{names[-1]}/entry.json")):
                    raise
                # cleaned away since it was listed: a later one is in force

    def _names(self, kind: str) -> list[str]:
        """What is in force: ids of batches that no base holds, or the folder of the base."""
        entry = self._now()[1]
        return sorted(b for b, _ in entry["batches"]) if kind == "batches" else [x for x in (entry["base"],) if x]

    def _based(self, entry: dict) -> DataFrame:
        """Ids of the batches that the base holds."""
        schema = "batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{entry['base']}/ids") if entry["base"] else self.spark.createDataFrame([], schema)

    def _holds(self, entry: dict, batch: str) -> bool:
        return any(b == batch for b, _ in entry["batches"]) or not self._based(entry).where(F.col("batch") == batch).isEmpty()

    def committed(self, batch: str) -> bool:
        return self._holds(self._now()[1], self._checked(batch))

    @staticmethod
    def _checked(batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        return batch

    def _commit(self, number: int, entry: dict) -> bool:
        """Rename an entry onto its number; False if another writer has that number (a rename onto a folder would move this one inside it)."""
        mine = uuid.uuid4().hex
        half, place = f"{self.path}/unfinished/{mine}", f"{self.path}/log/{number:012d}"
        stream = self.fs.create(self._at(f"{half}/entry.json"))
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        if not self.fs.exists(self._at(place)) and self.fs.rename(self._at(half), self._at(place)):
            inside = self._at(f"{place}/{mine}")
            if not self.fs.exists(inside):
                return True
            self.fs.delete(inside, True)
        self.fs.delete(self._at(half), True)
        return False

    def _read(self, table: str, schema: str, entry: dict) -> DataFrame:
        """The union of a table of all that is in force; each is a folder of plain or of bucketed files."""
        parts = [f"{self.path}/data/{p}" for p in [entry["base"], *(p for _, p in entry["batches"])] if p]
        made = self.spark.createDataFrame([], schema)
        if parts and table == "sums":
            return self.spark.read.schema(schema).parquet(*(f"{p}/{table}" for p in parts))
        for p in parts:
            made = made.unionByName(self.spark.read.schema(schema).parquet(f"{p}/{table}"))
        return made

    def _bucketed(self, df: DataFrame, path: str) -> None:
        """Written by bucket, few files each: a bucket goes to a few tasks, whichever wrote its rows."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(max(1, n // BUCKETS)))
        df.repartition(n, "bucket", share).write.partitionBy("bucket").parquet(path)

    def _refusal(self, entry: dict, taking: DataFrame, buckets: list[int]) -> list:
        """Some of the documents that a batch would leave with less than nothing, if what is in force is that of an entry."""
        taken = taking.select("doc_id", *KEYS, "d_docs", "d_tokens")
        before = self._read("ledger", LEDGER, entry).where(F.col("bucket").isin(buckets)).select("doc_id", *KEYS, "d_docs", "d_tokens")
        both = taken.withColumn("own", F.lit(1)).unionAll(before.withColumn("own", F.lit(0)))
        left = both.groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("docs"), F.sum("d_tokens").alias("tokens"), F.max("own").alias("own"))
        return left.where("own = 1 and (docs < 0 or tokens < 0 or (docs = 0 and tokens <> 0))").limit(3).collect()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before. Nothing half-written is ever read.

        Raises :class:`Refused`, and commits nothing, if a document would be left with fewer than no documents or
        tokens of its key: a delete of what was never inserted, or a revision of more than was counted. That is looked
        at against the very entry that the batch comes after, again whenever another writer was faster.
        """
        self._checked(batch)
        number, entry = self._now()
        if self._holds(entry, batch):
            return False
        folder = uuid.uuid4().hex
        data = f"{self.path}/data/{folder}"
        self._bucketed(deltas(changes).select("doc_id", *KEYS, "d_docs", "d_tokens", "takes", "bucket"), f"{data}/ledger")
        own = self.spark.read.schema(LEDGER.replace(", bucket", ", takes int, bucket")).parquet(f"{data}/ledger")
        own.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{data}/sums")
        taking = own.where("takes = 1")
        buckets = [r.bucket for r in taking.select("bucket").distinct().collect()]  # BUCKETS at most
        while True:
            wrong = self._refusal(entry, taking, buckets) if buckets else []
            if not wrong and self._commit(number + 1, {**entry, "batches": [*entry["batches"], (batch, folder)]}):
                return True
            if not wrong:
                number, entry = self._now()
            if wrong or self._holds(entry, batch):
                self.fs.delete(self._at(data), True)
                if wrong:
                    raise Refused(f"batch {batch} takes away what isn't counted, such as {wrong}")
                return False

    def batches(self) -> list[str]:
        entry = self._now()[1]
        return sorted({b for b, _ in entry["batches"]} | {r.batch for r in self._based(entry).toLocalIterator()})

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens``; keys whose documents are all gone are left out.

        They are those of now, whenever they are read before a ``clean`` that keeps less.
        """
        held = self._read("sums", SUMS, self._now()[1])
        return held.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """One base in place of the base in force and the batches after it; False if another compaction came first.

        A batch committed meanwhile isn't in the base and stays in force after it.
        """
        number, entry = self._now()
        folder = uuid.uuid4().hex
        data = f"{self.path}/data/{folder}"
        sums = self._read("sums", SUMS, entry).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.parquet(f"{data}/sums")
        ledger = self._read("ledger", LEDGER, entry).groupBy("doc_id", *KEYS, "bucket").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        self._bucketed(ledger.where("d_docs <> 0 or d_tokens <> 0"), f"{data}/ledger")
        own = self.spark.createDataFrame([(b,) for b, _ in entry["batches"]], "batch string")
        self._based(entry).unionByName(own).write.parquet(f"{data}/ids")
        now = entry
        while now["base"] == entry["base"]:
            after = now["batches"][len(entry["batches"]) :]  # batches are only ever added at the end
            if self._commit(number + 1, {"base": folder, "batches": after}):
                return True
            number, now = self._now()
        self.fs.delete(self._at(data), True)
        return False

    def clean(self, keep_seconds: float = 7 * 86_400) -> None:
        """Remove entries and tables that were replaced, or never committed, more than ``keep_seconds`` ago.

        That must be longer than any reader takes after ``totals()`` and any writer from its first table to its commit.
        """
        oldest = time.time() - keep_seconds
        log = self._listed("log")
        # an entry was in force until the next one came
        until = [*(at for _, at in log[1:]), float("inf")]
        kept = [n for (n, _), end in zip(log, until, strict=True) if end > oldest]
        held = set()
        for n in kept:
            entry = self._entry(n)
            held |= {entry["base"], *(p for _, p in entry["batches"])}
        for n, _ in log:
            if n not in kept:
                self.fs.delete(self._at(f"{self.path}/log/{n}"), True)
        for p, at in self._listed("data"):
            if p not in held and at <= oldest:
                self.fs.delete(self._at(f"{self.path}/data/{p}"), True)


#: Tokenizer versions: blank-separated words and bytes, which SQL can state as well, and the two byte-level BPE
#: encoders, by merge ranks and by the tokenizers library.
WORDS_V1, BYTES_V1 = "words-v1", "bytes-v1"
BPE_50K, BPE_50K_LIBRARY = "byte_bpe_50k", "byte_bpe_50k.json"


def counted(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``tokenizer``, ``n_tokens`` of documents; null texts have no tokens.

    Repeated rows are counted one by one; other columns, whatever their names, are passed over. A tokenizer that
    isn't known raises an error.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.col(text), F.lit("")).alias("t"))
    if tokenizer == WORDS_V1:
        n = F.regexp_count("t", F.lit("[^\\x20\\x09-\\x0D]+"))
    elif tokenizer == BYTES_V1:
        n = F.octet_length("t")
    elif tokenizer in (BPE_50K, BPE_50K_LIBRARY):
        import public_tokenizers

        if tokenizer == BPE_50K:
            of = bpe.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            of = tokenfile.counter(public_tokenizers.path("byte_bpe_50k.json"))
        kept, n = bpe.token_counts(kept, of, "t", "n"), F.col("n")
    else:
        raise ValueError(f"no tokenizer version {tokenizer!r}")
    return kept.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), n.cast("long").alias("n_tokens"))


def history(docs: DataFrame, path: str | None = None, versions: tuple[str, str] = (BPE_50K, BPE_50K_LIBRARY)) -> DataFrame:
    """Totals after a fixed history of batches over all documents, one of them sent twice.

    1 inserts every document by the first version; 2 deletes those whose id is divisible by 7; 3 revises the counts
    of those left whose id is divisible by 5 to one more; 4 inserts every document by the second version. Then the
    batches are compacted and batch 2 is sent again. Counts are taken once for each version and written down.
    """
    spark = docs.sparkSession
    roll = Rollup(spark, path or common.scratch(spark, "rollup"))
    first, second = (common.written(counted(docs, v), "counted") for v in versions)
    as_change = lambda df, op, n="n_tokens", old="null": df.selectExpr(f"'{op}' as op", "doc_id", "source", "lang", "tokenizer", f"{n} as n_tokens", f"cast({old} as bigint) as old_n_tokens")
    gone = as_change(first.where("doc_id % 7 = 0"), "delete")
    roll.apply("0001", as_change(first, "insert"))
    roll.apply("0002", gone)
    roll.apply("0003", as_change(first.where("doc_id % 5 = 0 and doc_id % 7 <> 0"), "revise", "n_tokens + 1", "n_tokens"))
    roll.apply("0004", as_change(second, "insert"))
    roll.compact()
    roll.apply("0002", gone)
    return roll.totals()


#: The history by the two versions that SQL can state; tests hold it against :func:`history`.
HISTORY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, strlen(coalesce(text, '')) AS b FROM documents
)
SELECT source, lang, 'words-v1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(w + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_tokens
FROM d WHERE doc_id IS NULL OR doc_id % 7 <> 0 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-v1', count(*)::BIGINT, sum(b)::BIGINT FROM d GROUP BY source, lang
"""
