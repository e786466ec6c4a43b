"""Answer tokens assembled to messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarry.functions import text as T


def _messages(replies: DataFrame) -> DataFrame:
    """``content`` of each reply from ``raw``: without memory tags, but the partial text as it is after an abort.

    A reply that was cut off before its first text is no message.
    """
    cut = F.col("finish_reason").isin("abort", "abandoned")
    content = F.when(cut, F.col("raw")).otherwise(T.strip_memory_tags(F.col("raw")))
    said = F.when(cut, F.trim("raw") != "").otherwise((F.col("finish_reason") == "finish") | (content != ""))
    return replies.withColumn("content", content).filter(said)


def assemble(tokens: DataFrame) -> DataFrame:
    """One message per reply: tokens joined in order, with the reason it ended.

    ``tokens``: chat_id, reply_id, seq, kind (token, finish or abort), token.
    Keyed by reply, so a chat with many messages is spread over many tasks.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "token"))))
    whole = F.array_join(F.transform(ordered, lambda s: s["token"]), "")
    ended = F.max(F.when(F.col("kind") != "token", F.col("kind")))
    return _messages(
        tokens.groupBy("chat_id", "reply_id").agg(whole.alias("raw"), F.coalesce(ended, F.lit("open")).alias("finish_reason"))
    )


_PACKED = "chat_id bigint, reply_id bigint, seqs array<bigint>, texts array<string>, kind string, last bigint"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a batch put together by reply: its tokens in the order of arrival, and the first of its ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = []
        for column in batch.columns[1::-1]:
            keys += [column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)]
        order = np.lexsort(keys)
        new = np.append(True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0))
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        chat, reply, seq, kind, token = (c.take(pa.array(order)) for c in batch.columns)
        is_token = pc.fill_null(pc.equal(kind, "token"), False).to_numpy(zero_copy_only=False)
        told, ends = np.flatnonzero(is_token), np.flatnonzero(~is_token)
        offsets = pa.array(np.append(np.append(0, np.cumsum(is_token))[starts], len(told)).astype(np.int32))
        ends = ends[np.lexsort((seq.fill_null(1 << 62).to_numpy(zero_copy_only=False)[ends], group[ends]))]
        first = ends[np.append(True, np.diff(group[ends]) != 0)] if len(ends) else ends
        end_of = np.full(len(starts), -1)
        end_of[group[first]] = first
        end_of = pa.array(end_of, mask=end_of < 0)
        lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(told))) for c in (seq, token)]
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([chat.take(at), reply.take(at), *lists, kind.take(end_of), seq.take(end_of)],
                                         ["chat_id", "reply_id", "seqs", "texts", "kind", "last"])


def _assembly(idle_ms: int, first_seq: int):
    """State of a reply that is still being told: its tokens so far, how it ends, and a timer for its silence."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Assembly(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.parts = handle.getListState("parts", "seqs array<bigint>, texts array<string>")
            self.known = handle.getValueState("known", "n bigint, kind string, last bigint, timer bigint")

        def _told(self, key, parts: dict, kind: str) -> Row:
            text = "".join(token for _, token in sorted(parts.items()) if token is not None)
            return Row(chat_id=key[0], reply_id=key[1], raw=text, finish_reason=kind)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            stored = self.known.get()
            n, kind, last, timer = stored or (0, None, None, None)
            new, ends = [], []
            for row in rows:
                if row.seqs:
                    new.append((row.seqs, row.texts))
                    n += len(row.seqs)
                if row.kind is not None:
                    ends.append((row.last, row.kind))
            if kind is None and ends:
                last, kind = min(ends)
            if kind is not None and n >= last - first_seq:
                parts = _tokens([*(self.parts.get() if stored else ()), *new])
                if len(parts) >= last - first_seq:
                    if stored:
                        self._forget(timer)
                    yield self._told(key, parts, kind)
                    return
            if new:
                self.parts.appendList(new)
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + idle_ms
            self.handle.registerTimer(timer)
            self.known.update((n, kind, last, timer))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            stored = self.known.get()
            if stored:
                parts, kind = _tokens(self.parts.get()), stored[1]
                self._forget(None)
                yield self._told(key, parts, kind or "abandoned")

        def _forget(self, timer: int | None) -> None:
            self.parts.clear()
            self.known.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)

        def close(self) -> None:
            pass

    return Assembly()


def _tokens(parts) -> dict:
    """Token of each number; of repeated numbers the one that came last."""
    return {seq: token for seqs, texts in parts for seq, token in zip(seqs, texts)}


def assemble_stream(tokens: DataFrame, idle_ms: int = 600_000, first_seq: int = 0) -> DataFrame:
    """Streaming form of :func:`assemble`: every message comes out once, in append mode; needs the RocksDB state store.

    Records of a reply are numbered from ``first_seq``; one that ends comes out as soon as all records before its end are
    there, in whatever order they arrive, and its state is cleared. A reply that is silent for ``idle_ms`` comes out with
    what there is: as it ended if its end is known, otherwise as ``abandoned``. Records that come still later begin a new
    reply. A reply that begins and ends in one micro-batch never touches the state. Records are put together by reply
    before they are shuffled, so a reply costs its state some rows a micro-batch, not one for each token.
    """
    records = tokens.select(*[F.col(c).cast("bigint") for c in ("chat_id", "reply_id", "seq")], "kind", "token")
    packed = records.mapInArrow(_pack, _PACKED)
    found = packed.groupBy("chat_id", "reply_id").transformWithState(
        statefulProcessor=_assembly(idle_ms, first_seq),
        outputStructType="chat_id bigint, reply_id bigint, raw string, finish_reason string",
        outputMode="Append", timeMode="ProcessingTime",
    )
    return _messages(found)
