"""Models of large groups in pieces of whole trees.

A forest grows with the rows of its group, and a cell of a table passes whole through a task, several times copied, and has fewer
than 2 GB. So a forest that many tasks have grown is kept as rows of some trees each. The cell ``model_bytes`` is
put together of them where it is read; scoring, bundles and streams take the pieces, which Spark deals to many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from manyfold.functions import trees
from manyfold.functions.keys import KeyCode
from manyfold.schema import SUCCESS
from manyfold.sources.settled import settle

#: The number of the first tree of a piece; the pieces of a model in this order are the model.
PIECE = "_piece"


@dataclass(frozen=True)
class Pieced:
    """A table of models in three parts."""

    cells: DataFrame  # models that are cells
    slim: DataFrame  # the other models without their cell, and rows without a model
    pieces: DataFrame  # keys, PIECE, model_bytes
    keys: list[str]

    def models(self) -> DataFrame:
        """All models as one table that knows its parts."""
        code = KeyCode(self.slim.schema, self.keys)
        pieces = self.pieces.select(*code.coded(), F.struct(PIECE, "model_bytes").alias("p"))
        # Whoever does not read the cells has all pieces made, and none put together.
        whole = pieces.groupBy(*code.names).agg(joined(F.sort_array(F.collect_list("p"))).alias("model_bytes"))
        good = self.slim.filter(F.col("status") == SUCCESS).drop("model_bytes")
        # Models in pieces are those of hot groups, of which there are few.
        made = whole.join(F.broadcast(good.select(*code.coded(), "*")), code.names).select(*self.slim.columns)
        found = self.cells.unionByName(made).unionByName(self.slim.filter(F.col("status") != SUCCESS))
        return with_pieces(found, self)

    def rest(self) -> DataFrame:
        """All models, without the cells of those that are in pieces."""
        return self.cells.unionByName(self.slim)

    def keys_in_pieces(self) -> DataFrame:
        return self.slim.filter(F.col("status") == SUCCESS).select(*self.keys)


def pieces_of(models: DataFrame) -> Pieced | None:
    """The parts of a table of models as it came from a training, a search or a bundle; None of any other."""
    return getattr(models, "_manyfold_pieces", None)


def with_pieces(models: DataFrame, parts: Pieced | None) -> DataFrame:
    """The same table, that knows its parts; a table that is derived from it does not."""
    models._manyfold_pieces = parts
    return models


def settle_models(models: DataFrame, label: str) -> DataFrame:
    """A stored table of models; what is in pieces is stored so."""
    parts = pieces_of(models)
    if parts is None:
        return settle(models, label)
    stored = (settle(part, label) for part in (parts.cells, parts.slim, parts.pieces))
    return Pieced(*stored, parts.keys).models()


@F.arrow_udf(T.BinaryType())
def joined(models: pa.Array) -> pa.Array:
    """The cells of models of their pieces."""
    cells = []
    for model in models:
        bodies = model.values.field("model_bytes")
        body = trees.join([memoryview(bodies[k].as_buffer()) for k in range(len(bodies))])
        ends = pa.py_buffer(np.array([0, len(body)], "<i4").tobytes())
        cells.append(pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(body)]))
    return cells[0] if len(cells) == 1 else pa.concat_arrays(cells)
