"""Models that learn from mini-batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.topics import OnlineLDA


class TopicStream:
    """Feeds each micro-batch of documents (doc_id, tokens) to an online topic model; `model` is the latest one.

    on_update(model, batch_id) is called after every step, e.g. to write the topics. The vocabulary is that of the
    first micro-batch unless the model has one.
    """

    def __init__(self, model: OnlineLDA, on_update: Callable[[OnlineLDA, int], None] | None = None):
        self.model, self.on_update = model, on_update

    def step(self, docs: DataFrame, batch_id: int) -> None:
        if docs.isEmpty():
            return
        self.model = self.model.partial_fit(docs)
        if self.on_update:
            self.on_update(self.model, batch_id)

    def write(self, docs: DataFrame) -> DataStreamWriter:
        return docs.writeStream.foreachBatch(self.step)
