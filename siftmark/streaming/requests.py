"""A stream of requests against the standing catalog: retrieval has no state of its own, so each batch is a batch query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftmark.functions.text import C
from siftmark.operators.ranking import sparse_scores, top_k


def serve(requests: DataFrame, postings: DataFrame, idf: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10) -> StreamingQuery:
    """Answer a stream (id, text): the k best rows (id, row, score, rank) of each request go to sink(frame, batch number).

    postings(row, lemma) and idf(lemma, idf) are the standing index.  A batch that is run again gives the same rows, and
    the sink gets its number, so a sink that replaces by number sees each answer once."""

    def answer(batch: DataFrame, number: int) -> None:
        found = sparse_scores(C.rows(batch, ["id"], "text", distinct=True), postings, idf, "id", "row")
        sink(top_k(found, "id", "score", k, "row"), number)

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
