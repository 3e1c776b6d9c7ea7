"""Keep-first over a stream by place, not by arrival."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: What comes first: by term, then page, then place on the page, as in a batch (`sources.landed.dedupe_keep_first`).
ORDER = ("term_no", "page_no", "pos")
#: Characters of rows that are stored as one value, and how: every byte of state passes through several copies on its way to the disk and back.
PIECE, CODEC = 4_000_000, "zstd"
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _keep(delay_ms: int):
    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            payload = state.get[-1]
            state.remove()
            yield pd.DataFrame({"payload": [payload]})
            return
        held = [state.get] if state.exists else []
        for batch in batches:
            for row in batch["row"].tolist():
                o0, o1, o2, at, payload = row.split(",", 4)
                held.append((int(o0), int(o1), int(o2), int(at) + delay_ms, payload))
        # Rows of one place are copies; the payload decides, so that arrival does not.
        first_row = min(held, key=lambda row: (*row[:3], row[4]))
        until = min(row[3] for row in held)
        state.update((*first_row[:3], until, first_row[4]))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    return first


class _KeepInBuckets(StatefulProcessor):
    """What `_keep` does for a key, for all keys of a bucket at once.

    `index` has for each held key its order, until when it is held, the watermark it was last seen at, and where its row lies. `rows` has the
    rows in pieces, which are written once, read when their rows are handed on, and removed when no key holds a row of them any more.
    """

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "entries binary")
        self.rows = handle.getMapState("rows", "piece long", "rows binary, size long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, pieces, timer = self._load()
        fresh: dict[str, str] = {}
        piece, size, read = max(pieces, default=0) + 1, 0, {}
        for batch in rows:
            for k, row in zip(batch["k"].tolist(), batch["row"].tolist(), strict=True):
                o0, o1, o2, at, payload = row.split(",", 4)
                order, until = (int(o0), int(o1), int(o2)), int(at) + self.delay_ms
                if k in held:
                    best, first_until, _, lies, place = held[k]
                    until = min(until, first_until)
                    # Rows of one place are copies; the payload decides, so that arrival does not.
                    if order > best or order == best and payload >= (fresh[k] if k in fresh else self._piece(lies, read)[place]):
                        held[k] = (best, until, now, lies, place)
                        continue
                held[k] = (order, until, now, None, None)
                fresh[k] = payload
                size += len(payload)
                if size > PIECE:
                    self._write(piece, fresh, held)
                    pieces.add(piece)
                    piece, size = piece + 1, 0
        if fresh:
            self._write(piece, fresh, held)
            pieces.add(piece)
        self._save(held, pieces, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, pieces, _ = self._load()
        due: dict[int, list[int]] = {}
        rest = {}
        for k, entry in held.items():
            if self._fires(entry) < now:
                due.setdefault(entry[3], []).append(entry[4])
            else:
                rest[k] = entry
        out, size = [], 0
        for piece, places in due.items():
            rows = self._piece(piece, {})
            out += [rows[i] for i in places]
            size += sum(map(len, rows))
            if size > PIECE:
                yield pd.DataFrame({"payload": out})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"payload": out})
        self._save(rest, pieces, None, expiredTimerInfo.getExpiryTimeInMs() + 1)

    @staticmethod
    def _fires(entry: tuple) -> int:
        """A row that comes when its key is due already is still waited for until the watermark moves on."""
        return max(entry[1], entry[2] + 1)

    def _load(self) -> tuple[dict, set, int | None]:
        stored = self.index.get()
        return pickle.loads(stored[0]) if stored else ({}, set(), None)

    def _piece(self, piece: int, read: dict) -> list[str]:
        """`read` keeps the piece that was read last."""
        if piece not in read:
            read.clear()
            rows, size = self.rows.getValue((piece,))
            read[piece] = pa.decompress(rows, decompressed_size=size, codec=CODEC, asbytes=True).decode().split("\n")
        return read[piece]

    def _write(self, piece: int, fresh: dict, held: dict) -> None:
        # As JSON a row holds no line break.
        rows = "\n".join(fresh.values()).encode()
        self.rows.updateValue((piece,), (pa.compress(rows, codec=CODEC, asbytes=True), len(rows)))
        for place, k in enumerate(fresh):
            held[k] = (*held[k][:3], piece, place)
        fresh.clear()

    def _save(self, held: dict, pieces: set, timer: int | None, least: int = 0) -> None:
        """One timer for the bucket: when its first key is due, or earlier."""
        if not held:
            self.rows.clear()
            self.index.clear()
            return
        live = {entry[3] for entry in held.values()}
        for piece in pieces - live:
            self.rows.removeKey((piece,))
        first_due = max(least, min(map(self._fires, held.values())))
        if timer is None or first_due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first_due)
            timer = first_due
        self.index.update((pickle.dumps((held, live, timer), 5),))


def keep_first_stream(posts: DataFrame, *key: str, delay: str = "1 day", time: str = "fetched_at", buckets: int = 4096) -> DataFrame:
    """One row per key of a stream: the first by term, page and place among all that come within `delay` of the earliest one.

    A key's best row is held as state and handed on by a timer, once the watermark of `time` has passed the earliest copy by `delay`, so the
    order of arrival has no influence. Copies that come later than that are new rows. Columns of ORDER that are missing or
    null count as 0. What is still held when a stream stops goes on with it.

    Keys are held together by the hash of the key, in so many `buckets`: a call of Python takes the rows of a bucket, not of a key. Their number
    is fixed when a stream starts: choose it so that one bucket's keys (not their rows) suit a task. This needs the state store RocksDB, which
    `rolling.write_available` asks for. With 0 buckets each key has a state of its own, in any state store, whole rows in memory: for few keys, and
    for checkpoints made before there were buckets.
    """
    names = posts.columns
    delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    order = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c in names else F.lit(0).cast("long") for c in ORDER]
    # One text per row: every column that goes to Python is converted anew, for each key or bucket.
    packed = F.concat_ws(",", *order, F.unix_millis(time), F.to_json(F.struct(*names), _TIME))
    posts = posts.withWatermark(time, delay)
    if buckets:
        rows = posts.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*key), _TIME).alias("k"), time, packed.alias("row"))
        kept = rows.groupBy("bucket").transformWithStateInPandas(_KeepInBuckets(delay_ms), "payload string", "Append", "EventTime")
    else:
        rows = posts.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], time, packed.alias("row"))
        kept = rows.groupBy(*[f"k{i}" for i in range(len(key))]).applyInPandasWithState(
            _keep(delay_ms), "payload string", "o0 long, o1 long, o2 long, until long, payload string", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("payload", posts.schema, _TIME).alias("row")).select("row.*")
