"""Apply on streams.  Beyond the reference: a definition without keys to compare is stateless, so the plan is that of a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Entity, Settings


def apply_stream(entity: Entity, stream: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The applied frame of a streaming frame: projections only, no state."""
    return entity.apply(stream, settings=settings).df


def diff_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Batches of a stream to ``merge`` (a keyed diff or a uniqueness rule over a stored table); its scope is the micro-batch."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
