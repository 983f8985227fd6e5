"""Token-count rollups that are kept up by deltas.

Changes are signed rows: an insert adds a document and its tokens, a delete takes them away, a revision adds
the difference of two counts. A batch is summed by source, language and tokenizer version and committed as
one small table under its batch id; a batch that was committed before changes nothing. Totals are the sum over
committed batches. Folding old batches into a base keeps them few, and remembers the ids it folded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, numbered, remove_folder, shared_dir

KEYS = ("source", "lang", "version")
SUMS = ("n_docs", "n_tokens", "n_bytes")
SCHEMA = ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} long" for s in SUMS)])


@cache
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters that are encoded at once, about; longer texts are cut before a blank after a letter, which no token spans.
ENCODED = 1 << 16
CUT = re.compile(r"(?<=[^\W\d_]) ")


def _count(encoding, text: str) -> int:
    n = at = 0
    while len(text) - at > ENCODED and (m := CUT.search(text, at + ENCODED)):
        n, at = n + len(encoding.encode_ordinary(text[at : m.start()])), m.start()
    return n + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, text: str = "text", rank_file: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out``: tokens of the text by a rank file that every executor has; 0 for a null or empty text.

    Long texts are encoded in parts whose counts add up. Repeated rows and ids are rows like any other, an empty
    table gives an empty result, and columns other than ``out`` (which is replaced) may have any names.
    """
    if rank_file is None:
        import public_tokenizers

        rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    base = docs.drop(out)
    place = base.columns.index(text)
    schema = base.limit(0).withColumn(out, F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _ranks(rank_file)
        for b in batches:
            counts = [_count(encoding, t) if t else 0 for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=schema.names)

    return numbered(base).mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def deletes(rows: DataFrame) -> DataFrame:
    return inserts(rows).select(*KEYS, *((-F.col(s)).alias(s) for s in SUMS))


def revisions(rows: DataFrame, old: str = "old_tokens") -> DataFrame:
    """Counts that were ``old`` and are now n_tokens: no document comes or goes."""
    change = F.coalesce("n_tokens", F.lit(0)) - F.coalesce(old, F.lit(0))
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes"))


class TokenRollup:
    """Totals in a folder that driver and executors share. One writer at a time.

    ``commit`` writes a batch's sums and then Spark's success mark; without the mark the batch doesn't count and
    is written anew. Null sources and languages are groups of their own.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, folder: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{folder}/_SUCCESS"))

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(n for n in names if n.startswith(("base-", "batch-")) and self._committed(n))

    @staticmethod
    def _name(batch_id: str) -> str:
        return "batch-" + batch_id.encode().hex()

    def _folded(self, base: str | None, names: list[str]) -> set[str]:
        """Which of the batches ``names`` the newest base has taken in; the lookup goes to the base, its list stays there."""
        if not base or not names:
            return set()
        wanted = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return {r.batch for r in self.spark.read.parquet(f"{self.path}/{base}").select("batch").join(wanted, "batch", "left_semi").distinct().collect()}

    def _state(self) -> tuple[str | None, list[str]]:
        """(newest base, batches in folders of their own that aren't folded into it)."""
        folders = self._folders()
        base = max((f for f in folders if f.startswith("base-")), default=None)
        batches = [f for f in folders if f.startswith("batch-")]
        folded = self._folded(base, batches)  # some only if a fold stopped before it removed them
        return base, [f for f in batches if f not in folded]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Whether the batch was new. ``deltas``: KEYS and SUMS, from inserts, deletes and revisions."""
        name = self._name(batch_id)
        base = max((f for f in self._folders() if f.startswith("base-")), default=None)
        if self._committed(name) or self._folded(base, [name]):
            return False
        sums = deltas.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def totals(self) -> DataFrame:
        """KEYS and SUMS over all committed batches, without groups that have come to nothing."""
        base, batches = self._state()
        every = self.spark.createDataFrame([], SCHEMA)
        if batches:
            every = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{f}" for f in batches))
        if base:
            every = every.unionByName(self.spark.read.parquet(f"{self.path}/{base}").where("batch IS NULL").select(*KEYS, *SUMS))
        sums = every.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
        return sums.where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def fold(self) -> None:
        """Fold all committed batches into a new base; totals stay as they are."""
        base, batches = self._state()
        if not batches:
            return
        number = int(base.removeprefix("base-")) + 1 if base else 1
        rows = self.totals().withColumn("batch", F.lit(None).cast("string"))
        rows = rows.unionByName(self.spark.createDataFrame([(n,) for n in batches], "batch string"), allowMissingColumns=True)
        if base:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/{base}").where("batch IS NOT NULL").select(*rows.columns))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{number:08d}")
        for f in [*batches, *([base] if base else [])]:
            self._fs.delete(self._at(f"{self.path}/{f}"), True)


#: Parts that the copies of one text are dealt into where they meet their first.
SALTS = 32


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose text (by digest) a row with a smaller id has.

    Counts and smallest ids are summed up before the shuffle, and the rows of a text that has many copies meet
    them in ``SALTS`` parts. Rows with a null id are never first and never go.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("copies")).where("copies > 1")
    dealt = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "part"]).where(F.col("doc_id") > F.col("first")).drop("part", "first")


def op7_rollups(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come, the same batch comes again, documents whose text a smaller id has go, counts are revised to include an end token."""
    import uuid

    from .common import read_table

    docs = count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    rows = checkpoint(docs.select("doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("version"), "n_tokens", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
    repeats = repeated(rows)
    folder = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rollup = TokenRollup(spark, folder)
    rollup.commit("first", inserts(rows))
    rollup.commit("first", inserts(rows))
    rollup.commit("repeats", deletes(repeats))
    left = rows.withColumns({"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 1})
    gone = repeats.withColumns({"old_tokens": F.col("n_tokens") + 1, "n_tokens": F.col("n_tokens")})
    rollup.commit("end token", revisions(left).unionByName(revisions(gone)))
    totals = checkpoint(rollup.totals())
    remove_folder(spark, folder)
    return totals
