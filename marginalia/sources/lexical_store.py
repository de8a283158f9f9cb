"""A stored lexical index: postings, document lengths and term statistics as Parquet, in segments under a versioned manifest.

Postings are partitioned by a bucket of their term and sorted by term, so a query reads the row groups of its own few terms
and nothing else.  Adding writes a new segment; deleting writes the manuals that are gone and lists them with the segments
they are gone from; optimising merges all segments into one.  Every change ends with a new manifest, written in one step under
a name that must not exist yet: readers see the old or the new index, and of two writers one fails.

Defined results: null contents are empty documents, which count as documents; rows without chunk id are left out; repeated
chunk ids within one call count once (the greatest content); chunks of a manual that is added again replace those before;
an index without documents answers nothing; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import lexical
from marginalia.operators.library import LibraryError
from marginalia.sources.manifest import Manifested, united

_POST = "chunk_id string, manual_id string, dl int, term string, tf bigint, bucket int"
_DOCS = "chunk_id string, manual_id string, dl int"
#: Documents beyond which a bucket is written in more than one file.
_SPREAD = 200_000


class LexicalStore(Manifested):
    """One index in one folder of the shared file system."""

    what = "lexical index"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        super().__init__(spark, folder)
        self.buckets = buckets

    def create(self, chunks: DataFrame) -> None:
        """A new index of ``chunks`` (chunk_id, manual_id, content)."""
        if self.exists():
            raise LibraryError("invalid", f"{self.folder} has an index already")
        self._write({"buckets": self.buckets, "segments": [self._segment(chunks)]})

    def _segment(self, chunks: DataFrame) -> dict:
        once = chunks.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.struct(F.coalesce("content", F.lit("")).alias("content"), "manual_id")).alias("r"))
        rows = once.select("chunk_id", "r.manual_id", "r.content")
        name = os.urandom(8).hex()
        base = f"{self.folder}/segments/{name}"
        seen = Observation()
        docs = rows.select("chunk_id", "manual_id", F.size(lexical.tokens(F.col("content"))).alias("dl"))
        docs.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.parquet(f"{base}/docs")
        totals = (seen.get["n"], seen.get["total"])
        self._posted(lexical.postings(rows), base, totals[0])
        return {"name": name, "gone": [], "n_docs": totals[0], "total_tokens": totals[1]}

    def _posted(self, posts: DataFrame, base: str, n_docs: int) -> None:
        # A term in every document fills its bucket: documents spread each bucket over several files.
        spread = F.pmod(F.crc32(F.col("chunk_id").cast("binary")), F.lit(n_docs // _SPREAD + 1))
        placed = posts.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int"))
        files = max(1, min(self.buckets * (n_docs // _SPREAD + 1), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        placed.repartition(files, "bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{base}/postings")
        self._stored(base).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition(files, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{base}/terms")

    def _stored(self, base: str) -> DataFrame:
        if not self._fs.exists(self._path(f"{base}/postings/_SUCCESS")):
            raise LibraryError("not_found", f"{base} is incomplete")
        return self.spark.read.schema(_POST).parquet(f"{base}/postings")

    def add(self, chunks: DataFrame) -> None:
        """``chunks`` as a new segment; what the index had of their manuals is gone from then on."""
        manifest = self._without(self._read(), chunks.select("manual_id"))
        manifest["segments"].append(self._segment(chunks))
        self._write(manifest)

    def delete(self, manuals: DataFrame) -> None:
        """Everything of ``manuals`` (manual_id) leaves the index."""
        self._write(self._without(self._read(), manuals))

    def _without(self, manifest: dict, manuals: DataFrame) -> dict:
        name = self._listed(manuals, "manual_id")
        for segment in manifest["segments"]:
            segment["gone"].append(["manual_id", name])
            left = self._alive(self.spark.read.schema(_DOCS).parquet(f"{self._base(segment)}/docs"), segment)
            segment["n_docs"], segment["total_tokens"] = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return manifest

    def optimize(self) -> None:
        """All segments as one, without what is gone; the files before stay until ``vacuum``."""
        manifest = self._read()
        name = os.urandom(8).hex()
        base = f"{self.folder}/segments/{name}"
        docs = [self._alive(self.spark.read.schema(_DOCS).parquet(f"{self.folder}/segments/{g['name']}/docs"), g) for g in manifest["segments"]]
        united(docs).write.parquet(f"{base}/docs")
        n, total = sum(g["n_docs"] for g in manifest["segments"]), sum(g["total_tokens"] for g in manifest["segments"])
        self._posted(self.postings().drop("bucket"), base, n)
        self._write(manifest | {"segments": [{"name": name, "gone": [], "n_docs": n, "total_tokens": total}]})

    # Reading.
    def _of(self, rows: DataFrame, terms: Sequence[str] | None) -> DataFrame:
        if terms is None:
            return rows
        low = sorted({t.lower() for t in terms})
        return rows.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in low})) & F.col("term").isin(low))

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings of ``terms``, a query's short list, or all of them."""
        manifest = self._read()
        self.buckets = manifest["buckets"]
        parts = [self._alive(self._of(self._stored(f"{self.folder}/segments/{g['name']}"), terms), g) for g in manifest["segments"]]
        return united(parts)

    def term_stats(self, terms: Sequence[str] | None = None) -> DataFrame:
        """term and df: as stored, but counted anew in segments from which something is gone."""
        manifest = self._read()
        self.buckets = manifest["buckets"]
        parts = []
        for g in manifest["segments"]:
            base = f"{self.folder}/segments/{g['name']}"
            if g["gone"]:
                parts.append(lexical.term_stats(self._alive(self._of(self._stored(base), terms), g)))
            else:
                parts.append(self._of(self.spark.read.schema("term string, df bigint, bucket int").parquet(f"{base}/terms"), terms).select("term", "df"))
        return united(parts).groupBy("term").agg(F.sum("df").alias("df"))

    def corpus_stats(self) -> DataFrame:
        """One row, from the manifest: n_docs and total_tokens."""
        segments = self._read()["segments"]
        n, total = sum(g["n_docs"] for g in segments), sum(g["total_tokens"] for g in segments)
        return self.spark.range(1).select(F.lit(n).cast("bigint").alias("n_docs"), F.lit(total).cast("bigint").alias("total_tokens"))

    def search(self, terms: Sequence[str], manuals: Sequence[str] | DataFrame | None = None, ratio: float = lexical.MAX_DF_RATIO) -> DataFrame:
        """chunk_id and BM25 score of every chunk with a gated term."""
        return lexical.bm25(self.postings(terms), self.corpus_stats(), terms, manuals, ratio, self.term_stats(terms))
