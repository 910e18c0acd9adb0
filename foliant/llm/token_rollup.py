"""Token counts kept up to date by signed deltas.

A change row says ``insert``, ``delete`` or ``revise``; ``deltas`` turns it into
signed counts by (source, lang, tokenizer), summed before the shuffle's end and
again by it. ``Rollup`` keeps one small delta table per numbered batch in a
folder of any Hadoop file system. A batch is written aside and renamed into
place, so it is there as a whole or not at all, and committing a number twice
changes nothing. ``totals`` adds the deltas up; ``compact`` folds them into one
snapshot named after the last batch it holds.

Defined results: null keys form groups of their own; a null count counts as 0;
an unknown or null ``op`` raises when the batch is built from it; totals that
return to no documents and no tokens vanish; an empty batch is a commit without
rows; repeated change rows count repeatedly (they are different changes), the
repeated batch does not; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Sums of ``changes`` (op, source, lang, tokenizer, n_tokens, and for
    ``revise`` the count it replaces in old_tokens) by key."""
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in changes.columns else F.lit(0) for c in ("n_tokens", "old_tokens"))
    op = F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op.cast("string"), F.lit("null")))).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad)
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(bad)
    keyed = changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))
    return summed(keyed)


def summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


@dataclass
class Rollup:
    spark: SparkSession
    path: str

    def __post_init__(self):
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _found(self, kind: str) -> dict[int, str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return {int(n.split("-")[1]): f"{self.path}/{n}" for n in names if n.startswith(f"{kind}-")}

    def _place(self, rows: DataFrame, name: str) -> bool:
        own = f"_aside-{name}-{uuid.uuid4().hex}"
        aside, at = self._path(f"{self.path}/{own}"), self._path(f"{self.path}/{name}")
        rows.coalesce(1).write.parquet(f"{self.path}/{own}")
        done = not self._fs.exists(at) and self._fs.rename(aside, at)
        # Where another committer was faster, some stores move the folder into its;
        # readers pass over such names.
        late = self._path(f"{self.path}/{name}/{own}")
        if done and self._fs.exists(late):
            self._fs.delete(late, True)
            done = False
        elif not done:
            self._fs.delete(aside, True)
        return done

    def committed(self, batch: int) -> bool:
        return batch in self._found("batch") or batch <= max(self._found("upto"), default=-1)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing done, if it is there already."""
        return not self.committed(batch) and self._place(deltas(changes), f"batch-{batch}")

    def _parts(self) -> tuple[int, list[str]]:
        snaps, batches = self._found("upto"), self._found("batch")
        last = max(snaps, default=-1)
        newest = [snaps[last]] if snaps else []
        return last, newest + [p for b, p in sorted(batches.items()) if b > last]

    def totals(self) -> DataFrame:
        _, parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*parts))

    def compact(self) -> None:
        """Folds all batches into one snapshot. Batches must be numbered in the
        order of their commits: numbers up to the last count as committed."""
        last, parts = self._parts()
        upto = max(self._found("batch"), default=-1)
        if upto > last:
            self._place(self.totals(), f"upto-{upto}")
        for kind, below in (("batch", upto + 1), ("upto", max(upto, last))):
            for n, p in self._found(kind).items():
                if n < below:
                    self._fs.delete(self._path(p), True)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, words, quarters, long_words) of each whole text:
    words between blanks, fourths of its bytes, and words of two bytes or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(c).cast("string").alias(c) for c in ("source", "lang")),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.floor((F.octet_length(text) + 3) / 4).cast("long").alias("quarters"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{2,}")).cast("long").alias("long_words"),
    )


def replayed(counts: DataFrame, store: Rollup) -> DataFrame:
    """A life of the table in five batches: all documents under two tokenizers;
    a revision of every seventh; deletion of every eleventh; the revision and the
    first load again, which change nothing; a compaction between."""
    change = lambda rows, op, tokenizer, n, old=None: rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
    seventh, eleventh = counts.filter(F.col("doc_id") % 7 == 0), counts.filter(F.col("doc_id") % 11 == 0)
    load = change(counts, "insert", "words", "words")
    revision = change(seventh, "revise", "words", "long_words", "words")
    gone = eleventh.withColumn("now", F.when(F.col("doc_id") % 7 == 0, F.col("long_words")).otherwise(F.col("words")))
    store.commit(1, load)
    store.commit(2, change(counts, "insert", "quarters", "quarters"))
    store.compact()
    store.commit(3, revision)
    store.commit(4, change(gone, "delete", "words", "now").union(change(gone, "delete", "quarters", "quarters")))
    store.commit(3, revision)
    store.commit(1, load)
    return store.totals()


ROLLUP_SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]{2,}')) AS long_words,
         (octet_length(encode(coalesce(text, ''))) + 3) // 4 AS quarters
  FROM documents),
live AS (SELECT * FROM c WHERE doc_id IS NULL OR doc_id % 11 <> 0),
rows AS (
  SELECT source, lang, 'words' AS tokenizer, CASE WHEN doc_id % 7 = 0 THEN long_words ELSE words END AS n FROM live
  UNION ALL SELECT source, lang, 'quarters', quarters FROM live)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM rows GROUP BY source, lang, tokenizer
"""
