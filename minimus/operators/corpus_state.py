"""Mergeable corpus state: O25 vocabulary, O23 IDF and the score histogram of O29, kept
up to date by signed counts instead of being rebuilt.

A *version* is a set of documents that join the corpus and a set that leaves it (a changed
document does both). Each version appends, once, the signed counts of its documents:

* ``vocab``: (lang, token, n): +1 or -1 per document that holds the token;
* ``sizes``: (lang, n): documents;
* ``hist``: (level, bin, n): segments by score bin, for documents that have a level.

The state at version v is the sum of all counts up to v, exactly that of a rebuild from the
documents that are in the corpus then, whatever the order of versions. Scores depend on
the IDF table, so the histogram belongs to a pinned one: the IDF table of version ``pin``.

``compact(v)`` writes the merged counts as a base; later reads take the last base and the deltas
after it. Deltas stay, so every earlier version can still be read and a run that names its
version can be replayed. Sums have partial aggregation: a token of every document costs
one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.log_store import Log
from .select import histogram, thresholds_of
from .vocab import build_vocab, corpus_sizes, idf_table

KEYS = {"vocab": ("lang", "token"), "sizes": ("lang",), "hist": ("level", "bin")}


def _schema(name: str) -> T.StructType:
    kinds = {"bin": T.LongType()}
    return T.StructType([T.StructField(k, kinds.get(k, T.StringType())) for k in KEYS[name]] + [T.StructField("n", T.LongType())])


class CorpusState:
    """The state in the folder ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str):
        self.deltas = {n: Log(spark, f"{path}/{n}", _schema(n)) for n in KEYS}
        self.bases = {n: Log(spark, f"{path}/{n}-base", _schema(n)) for n in KEYS}

    def versions(self) -> list[int]:
        """Complete versions, in order. ``sizes`` is written last and completes one."""
        return sorted(e for _, e in self.deltas["sizes"].committed())

    def apply(self, version: int, added: DataFrame | None = None, removed: DataFrame | None = None,
              added_scores: DataFrame | None = None, removed_scores: DataFrame | None = None) -> bool:
        """Append a version: documents (lang, text: clean-up done) and, if the histogram is
        kept, their segments' scores (level, score) under the pinned IDF table. Running a version
        again changes nothing; False then."""
        if version in self.versions():
            return False

        def signed(name, plus, minus, count):
            key, log = KEYS[name], self.deltas[name]
            parts = [count(df).select(*key, (F.col("n") * sign).alias("n")) for df, sign in ((plus, 1), (minus, -1)) if df is not None]
            if parts:
                both = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")
                log.append(both, "delta", version)
            elif name == "sizes":
                log.append(log.read().limit(0), "delta", version)

        signed("vocab", added, removed, lambda df: build_vocab(df).withColumnRenamed("df", "n"))
        signed("hist", added_scores, removed_scores, histogram)
        signed("sizes", added, removed, lambda df: corpus_sizes(df).withColumnRenamed("n_docs", "n"))
        return True

    def _base(self, name: str, version: int) -> int:
        return max((e for _, e in self.bases[name].committed() if e <= version), default=-1)

    def _merged(self, name: str, version: int | None) -> DataFrame:
        known = self.versions()
        last = known[-1] if known else -1
        v = last if version is None else version
        base = self._base(name, v)
        rows = self.deltas[name].read_epochs("delta", [x for x in known if base < x <= v])
        if base >= 0:
            rows = rows.unionByName(self.bases[name].read_epochs("base", [base]))
        return rows.groupBy(*KEYS[name]).agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self, version: int) -> None:
        """Write the merged counts up to ``version`` as the base of later reads."""
        for name, log in self.bases.items():
            log.append(self._merged(name, version), "base", version)

    def vocab(self, version: int | None = None) -> DataFrame:
        """(lang, token, df) at a version (the last one by default)."""
        return self._merged("vocab", version).withColumnRenamed("n", "df")

    def sizes(self, version: int | None = None) -> DataFrame:
        """(lang, n_docs)."""
        return self._merged("sizes", version).withColumnRenamed("n", "n_docs")

    def idf(self, version: int | None = None) -> DataFrame:
        """O23 at a version, as ``idf_table`` gives it."""
        return idf_table(self.vocab(version), self.sizes(version))

    def thresholds(self, plan: DataFrame, version: int | None = None) -> DataFrame:
        """T per (level, attempt) from the merged histogram."""
        return thresholds_of(self._merged("hist", version), plan)
