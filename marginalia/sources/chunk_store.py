"""A store of chunks with their vectors: Parquet segments under a versioned manifest, stamped with the embedding model.

Defined results: rows without id are left out; of repeated ids in one call the row with the greatest document stays; an id
that is added again is overwritten; reading an empty or reset store gives no rows; unknown ids are not answered.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import vectors
from marginalia.operators.library import LibraryError
from marginalia.sources.manifest import Manifested, united

_TEXT, _VECTOR = T.StringType(), T.ArrayType(T.FloatType())
CHUNK = T.StructType(
    [T.StructField(n, _TEXT) for n in ("id", "manual_id", "bookmark_id", "kind")]
    + [T.StructField("page", T.IntegerType()), T.StructField("chunk_index", T.DoubleType()), T.StructField("figure_id", _TEXT), T.StructField("document", _TEXT), T.StructField("embedding", _VECTOR)]
)


def add_missing_columns(rows: DataFrame, schema: T.StructType = CHUNK) -> DataFrame:
    """``rows`` with exactly the columns of ``schema``: missing ones are null, others are left out.  Changes nothing twice."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def check_model(stored: str | None, expected: str) -> None:
    """Vectors of one model can't be searched with another's."""
    if stored != expected:
        raise LibraryError("invalid", f"the store was made with {stored or 'an unknown model'}, not with {expected}")


class ChunkStore(Manifested):
    what = "chunk store"

    def reset(self, model: str | None = None) -> None:
        """An empty store, for vectors of ``model``."""
        self.drop()
        self._write({"segments": [], "model": model})

    def recorded_model(self) -> str | None:
        return self._read()["model"]

    def add(self, chunks: DataFrame, model: str | None = None) -> None:
        """``chunks`` over those of the same ids."""
        manifest = self._read()
        if model is not None:
            check_model(manifest["model"], model)
        whole = add_missing_columns(chunks).filter(F.col("id").isNotNull())
        rest = [c for c in CHUNK.names if c not in ("id", "document")]
        once = whole.groupBy("id").agg(F.max_by(F.struct("document", *rest), F.struct(F.coalesce("document", F.lit("")), F.xxhash64(*rest))).alias("r")).select("id", "r.*")
        segment = {"name": os.urandom(8).hex(), "gone": []}
        once.select(*CHUNK.names).write.parquet(self._base(segment))
        if manifest["segments"]:
            name = self._listed(self.spark.read.schema(CHUNK).parquet(self._base(segment)), "id")
            for other in manifest["segments"]:
                other["gone"].append(["id", name])
        manifest["segments"].append(segment)
        self._write(manifest)

    def delete(self, manuals: DataFrame) -> None:
        """All chunks of ``manuals`` (manual_id)."""
        manifest = self._read()
        name = self._listed(manuals, "manual_id")
        for segment in manifest["segments"]:
            segment["gone"].append(["manual_id", name])
        self._write(manifest)

    def optimize(self) -> None:
        """All segments as one; the files before stay until ``vacuum``."""
        manifest = self._read()
        segment = {"name": os.urandom(8).hex(), "gone": []}
        self.scroll().write.parquet(self._base(segment))
        self._write(manifest | {"segments": [segment]})

    def scroll(self, where: Column | None = None) -> DataFrame:
        """All chunks that ``where`` holds for; the filter reaches the scan."""
        segments = self._read()["segments"]
        if not segments:
            return self.spark.createDataFrame([], CHUNK)
        parts = [self.spark.read.schema(CHUNK).parquet(self._base(g)) for g in segments]
        return united([self._alive(p if where is None else p.filter(where), g) for p, g in zip(parts, segments)])

    def get(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """Chunks of ``ids``: a short list, whose order the column ``place`` keeps, or rows of any number (id)."""
        if isinstance(ids, DataFrame):
            return self.scroll().join(ids.select("id").distinct(), "id", "left_semi")
        places = F.create_map(*[F.lit(x) for i, v in enumerate(dict.fromkeys(ids)) for x in (v, i)]) if ids else None
        found = self.scroll(F.col("id").isin(list(ids)) if ids else F.lit(False))
        return found.withColumn("place", F.lit(0) if places is None else places[F.col("id")])

    def count(self, where: Column | None = None) -> int:
        return self.scroll(where).count()

    def search(self, query: Sequence[float], k: int, where: Column | None = None, model: str | None = None) -> DataFrame:
        """id and cosine of the ``k`` most similar chunks, the filter before the ranking."""
        if model is not None:
            check_model(self.recorded_model(), model)
        return vectors.dense_top(self.scroll(where), query, k)
