"""Token totals by source, language and tokenizer version, maintained by signed changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import scratch_path, written
from spanloom.llm.mixing import words
from spanloom.llm.tokens import byte_tokenizer

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Batches after which a commit adds them up into a new base.
COMPACT = 64


class TokenRollup:
    """Additive totals in a folder of committed batches.

    A batch is reduced to its own signed totals, written aside, and moved into
    place under its id in one step, which is its commit: a batch committed again,
    by a retry or by another driver, changes nothing, and one that fails on the way
    leaves nothing behind that counts. The step is a rename, which must be atomic and
    refuse an existing name, as on HDFS and local disks; object stores need a committer in between.

    ``compact`` adds committed batches up into a base, in the same way; ``totals`` is the
    newest base and the batches since, so its work doesn't grow with the history. After
    every ``COMPACT`` batches a commit compacts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "bases"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of signed changes once; False if that id is committed already.

        ``changes`` has op (insert, delete or revise), source, lang, tokenizer,
        tokens and, for revisions, old_source, old_lang, old_tokenizer and old_tokens.
        A delete carries what was inserted. A revision takes the old counts out and
        puts the new ones in, wherever either belongs. Null keys are groups of their own;
        null counts add no tokens; other ops, null ones included, are refused by an error
        before anything is committed. An empty batch is committed and changes nothing.
        Other columns don't matter. Totals are combined on the map side.
        """
        name = quote(batch_id, safe="")
        if self._fs.exists(self._path(f"{self.root}/commits/{name}")):
            return False
        have = set(changes.columns)
        old = [F.col(f"old_{c}") if f"old_{c}" in have else F.lit(None).cast("long" if c == "tokens" else "string") for c in (*KEYS, "tokens")]
        known = F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))
        op = F.when(known, F.col("op")).otherwise(F.raise_error(F.lit("op must be insert, delete or revise")))
        part = lambda sign, cols: F.struct(*[c.cast("string").alias(k) for c, k in zip(cols, KEYS, strict=False)], F.lit(sign).cast("long").alias("d"), (F.lit(sign) * F.coalesce(cols[3].cast("long"), F.lit(0).cast("long"))).alias("t"))
        new = [F.col(c) for c in (*KEYS, "tokens")]
        parts = F.when(F.col("_op") == "insert", F.array(part(1, new))).when(F.col("_op") == "delete", F.array(part(-1, new))).otherwise(F.array(part(-1, old), part(1, new)))
        signed = changes.withColumn("_op", op).select(F.inline(parts))
        delta = signed.groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        aside = self._aside()
        delta.write.parquet(aside)
        done = self._move(aside, f"{self.root}/commits/{name}")
        if done and len(self._state()[1]) >= COMPACT:
            self.compact()
        return done

    def _aside(self) -> str:
        return f"{self.root}/.aside-{uuid.uuid4().hex}"

    def _move(self, aside: str, target: str) -> bool:
        """Move a folder into place in one step; False, and nothing left of it, if there is one already."""
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(aside), self._path(target)):
            self._fs.delete(self._path(aside), True)
            return False
        nested = self._path(f"{target}/{aside.rsplit('/', 1)[1]}")
        if self._fs.exists(nested):  # another driver came between, and the move went below its folder
            self._fs.delete(nested, True)
            return False
        return True

    def _listed(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def batches(self) -> list[str]:
        """Folder names of the committed batches."""
        return self._listed("commits")

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest base's folder, and the batches that it doesn't hold."""
        bases = self._listed("bases")
        if not bases:
            return None, self.batches()
        base = f"{self.root}/bases/{bases[-1]}"
        held = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()}  # names alone
        return base, [x for x in self.batches() if x not in held]

    def compact(self) -> bool:
        """Put the committed batches into a new base; False if another driver did so first or there is nothing to do.

        The folders of batches stay, as marks that they are committed.
        """
        base, since = self._state()
        if not since:
            return False
        number = 1 + (int(base.rsplit("/", 1)[1]) if base else 0)
        aside = self._aside()
        self._summed(base, since).write.parquet(f"{aside}/totals")
        named = self.spark.createDataFrame([(x,) for x in since], "batch string")
        if base:
            named = self.spark.read.schema("batch string").parquet(f"{base}/batches").unionByName(named)
        named.coalesce(1).write.parquet(f"{aside}/batches")
        return self._move(aside, f"{self.root}/bases/{number:012d}")

    def _summed(self, base: str | None, since: list[str]) -> DataFrame:
        paths = [f"{base}/totals"] * (base is not None) + [f"{self.root}/commits/{x}" for x in since]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        summed = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS)
        summed = summed.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens; groups that came back to nothing are left out."""
        return self._summed(*self._state())


def byte_bpe_counts(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Columns ``keep``, and tokens: how many byte-level BPE tokens each whole text has; a null text has none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_tokenizer(path, pattern)
        for batch in batches:
            tokens = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tokens, pa.int64())], [*keep, "tokens"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(counted, f"{fields}, tokens long")


def op7(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents in two tokenizer versions, after loads, a revision and deletes.

    All documents are loaded with their counts of words and of byte-level BPE tokens. Then
    every count of words is revised to one of runs of letters and digits, as a new
    version of that tokenizer, and documents that ``labels`` calls toxic are deleted.
    Every batch is committed twice, as a retry would, and the batches become a base.
    """
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, versions = F.col("text"), ("words-1", "words-2", "byte_bpe_50k-1")
    parts = F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", "lang", "text", words(text).alias("words"), parts.alias("parts"))
    kept = ("doc_id", "source", "lang", "words", "parts")
    # texts are read once; batches are made of narrow counts, and only those are joined
    counts = written(byte_bpe_counts(rows, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, keep=kept), "counts")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))

    def made(df: DataFrame, op: str, version: str, tokens: str) -> DataFrame:
        old = {f"old_{c}": F.col(c) for c in ("source", "lang")} | {"old_tokenizer": F.lit(versions[0]), "old_tokens": F.col("words")}
        new = {"op": F.lit(op), "tokenizer": F.lit(version), "tokens": F.col(tokens)}
        return df.withColumns(new | (old if op == "revise" else {}))

    batches = {
        "load-words": made(counts, "insert", versions[0], "words"),
        "load-bpe": made(counts, "insert", versions[2], "tokens"),
        "revise-words": made(counts, "revise", versions[1], "parts"),
        "delete-words": made(gone, "delete", versions[1], "parts"),
        "delete-bpe": made(gone, "delete", versions[2], "tokens"),
    }
    for name, changes in batches.items():
        rollup.commit(name, changes)
        rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()
