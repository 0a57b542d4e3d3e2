"""Chat sessions as keyed state of a stream of turns.

Each conversation has a session: its language, its number, how many messages and words it holds, and the last messages, which are
what a reply is given as memory. A turn in another language clears the session, as does an idle time: a timer clears it where no turn
comes, and a turn that comes late but before the timer finds it expired as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "conv_id long, turn long, lang string, session int, n_before long, n_words long, memory string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Sessions(StatefulProcessor):
    """Rows (conv_id, turn, lang, text, n_words) of a conversation, in order of turn within a batch (null first)."""

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "lang string, number int, n long, words long, seen long")
        self.messages = handle.getListState("messages", "text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        lang, number, n, words, seen = self.session.get() or (None, 0, 0, 0, now)
        held = [x[0] for x in self.messages.get()] if n else []
        if n and self.idle_ms and now - seen >= self.idle_ms:
            n, words, held, lang = 0, 0, [], None
        for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.text or "")):
            if not n or r.lang != lang:
                number, n, words, held, lang = number + 1, 0, 0, [], r.lang
            words += r.n_words
            yield Row(conv_id=key[0], turn=r.turn, lang=r.lang, session=number, n_before=n, n_words=words, memory="\n".join(held))
            n, held = n + 1, [*held, r.text or ""][-self.keep :]
        self.session.update((lang, number, n, words, now))
        self.messages.put([(x,) for x in held])
        if self.idle_ms:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The session goes but for its number, so a later one is told from it."""
        _, number, _, _, seen = self.session.get()
        self.session.update((None, number, 0, 0, seen))
        self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, keep: int = 2, idle_ms: int = 0) -> DataFrame:
    """A stream of turns (conv_id, turn, lang, text, n_words) with each turn's session, messages and words so far in it, and the last ``keep`` messages before it."""
    return turns.groupBy("conv_id").transformWithState(Sessions(keep, idle_ms), OUT, "append", "ProcessingTime" if idle_ms else "None")


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state with several variables needs the RocksDB store; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drained(stream: DataFrame, folder: str, timers: bool = False) -> DataFrame:
    """What a stream gives for all its input up to now, by files below ``folder``; a restart goes on from its checkpoint. Timers of processing time ask for batches without end, so with them all input is one batch."""
    spark = stream.sparkSession
    until = {"once": True} if timers else {"availableNow": True}
    with state_store(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(**until).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
