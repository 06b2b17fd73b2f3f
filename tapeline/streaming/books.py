"""Per-symbol state machines over live book, delta and block streams.

Continuity of a book is sequential by nature: each symbol keeps a small state and its
rows are taken in ``ord`` order within a micro-batch. Bound a batch with the source's
``maxFilesPerTrigger``; across symbols everything runs in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tapeline.operators.reorg import advance

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VENUES = ("spot", "futures")
#: Deltas that a book keeps while it waits for a snapshot.
MAX_BUFFER = 5_000
# Stands for a hash that stays in the state unread.
_UNREAD = object()


def _use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _int(value: Any) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("ord", kind="stable")


class Sync:
    """Whether a depth event continues the snapshot: DROP, APPLY or RESYNC."""

    def __init__(self, venue: str, snapshot: int | None, last: int | None):
        self.venue, self.snapshot, self.last = venue, snapshot, last

    def feed(self, first: int, final: int, prev: int | None) -> str:
        if self.snapshot is None:
            return "DROP"
        spot = self.venue == "spot"
        if self.last is not None:
            joins = first == self.last + 1 if spot else prev == self.last
        else:
            # the first event must span the snapshot's number (spot: the one after it)
            edge = self.snapshot + 1 if spot else self.snapshot
            if final < edge:
                return "DROP"
            joins = first <= edge
        if not joins:
            return "RESYNC"
        self.last = final
        return "APPLY"


class BookSync(StatefulProcessor):
    """One action per delta; a snapshot row sets the anchor."""

    def __init__(self, venue: str):
        self.venue = venue

    def init(self, handle) -> None:
        self.state = handle.getValueState("sync", "snapshot long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None)
        sync = Sync(self.venue, _int(held[0]), _int(held[1]))
        batch = _ordered(rows)
        out = []
        for ord_, is_snapshot, first, final, prev in zip(
            batch["ord"], batch["is_snapshot"], batch["first_id"], batch["final_id"], batch["prev_id"]
        ):
            if is_snapshot:
                sync.snapshot, sync.last = int(final), None
                continue
            out.append((key[0], int(ord_), sync.feed(int(first), int(final), _int(prev))))
        self.state.update((sync.snapshot, sync.last))
        yield pd.DataFrame(out, columns=["symbol", "ord", "action"])

    def close(self) -> None:
        pass


def book_sync(events: DataFrame, venue: str = "spot") -> DataFrame:
    """(symbol, ord, action) for a stream of depth events and snapshots.

    Columns: symbol, ord, is_snapshot, first_id, final_id (a snapshot's number), prev_id.
    """
    _check(venue)
    _use_rocksdb(events)
    return events.groupBy("symbol").transformWithStateInPandas(
        BookSync(venue), "symbol string, ord long, action string", "Append", "None"
    )


def _check(venue: str) -> None:
    if venue not in VENUES:
        raise ValueError(f"venue must be one of {VENUES}, got {venue!r}")


def _covers(venue: str, snapshot: int, kept: list[tuple]) -> bool:
    """Whether buffered deltas (ord, first, final, prev) continue the snapshot unbroken."""
    last = None
    for _, _, final, prev in kept:
        if venue == "futures":
            ok = prev is not None and (prev < snapshot <= final if last is None else prev == last)
        else:
            ok = final == (snapshot if last is None else last) + 1
        if not ok:
            return False
        last = final
    return True


class BookResync(StatefulProcessor):
    """Emit deltas while in sync; buffer them while waiting for a new snapshot."""

    def __init__(self, venue: str, max_buffer: int):
        self.venue, self.max_buffer = venue, max_buffer

    def init(self, handle) -> None:
        self.state = handle.getValueState("sync", "snapshot long, last long, resyncing boolean")
        self.buffer = handle.getListState(
            "buffer", "ord long, first_id long, final_id long, prev_id long"
        )

    def joins(self, before: tuple, delta: tuple) -> bool:
        return delta[1] == before[2] + 1 if self.venue == "spot" else delta[3] == before[2]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None, False)
        sync = Sync(self.venue, _int(held[0]), _int(held[1]))
        waiting = bool(held[2])
        buffer = (
            [(int(o), int(a), int(b), _int(c)) for o, a, b, c in self.buffer.get()]
            if self.buffer.exists()
            else []
        )
        kept_from = len(buffer)
        out: list[tuple] = []
        batch = _ordered(rows)
        cleared = False
        for ord_, is_snapshot, first, final, prev in zip(
            batch["ord"], batch["is_snapshot"], batch["first_id"], batch["final_id"], batch["prev_id"]
        ):
            ord_, final = int(ord_), int(final)
            if is_snapshot:
                if not waiting:
                    sync.snapshot, sync.last = final, None
                    out.append((key[0], ord_, "snapshot"))
                    continue
                floor = final if self.venue == "futures" else final + 1
                kept = [d for d in buffer if d[2] >= floor]
                if _covers(self.venue, final, kept):
                    sync.snapshot, sync.last = final, (kept[-1][2] if kept else None)
                    out.append((key[0], ord_, "snapshot"))
                    out.extend((key[0], d[0], "kept") for d in kept)
                else:
                    out.append((key[0], ord_, "resync_failed"))
                waiting, buffer, cleared = False, [], True
                continue
            delta = (ord_, int(first), final, _int(prev))
            if waiting:
                if buffer and not self.joins(buffer[-1], delta):
                    buffer, cleared = [], True
                elif len(buffer) >= self.max_buffer:
                    out.append((key[0], ord_, "buffer_full"))
                    buffer, cleared = [], True
                buffer.append(delta)
                continue
            action = sync.feed(*delta[1:])
            if action == "APPLY":
                out.append((key[0], ord_, "delta"))
            elif action == "RESYNC":
                waiting = True
                buffer.append(delta)
        if cleared:
            self.buffer.clear()
            kept_from = 0
        for delta in buffer[kept_from:]:
            self.buffer.appendValue(delta)
        self.state.update((sync.snapshot, sync.last, waiting))
        yield pd.DataFrame(out, columns=["symbol", "ord", "emitted"])

    def close(self) -> None:
        pass


def book_resync(events: DataFrame, venue: str = "spot", max_buffer: int = MAX_BUFFER) -> DataFrame:
    """(symbol, ord, emitted) in output order: delta, snapshot, kept, resync_failed or
    buffer_full.

    A break starts buffering; the next snapshot releases the buffered deltas past it
    when they continue it unbroken. A break among the buffered deltas starts the buffer
    anew, since nothing before it could follow the snapshot. So does a delta that finds
    ``max_buffer`` others waiting, and ``buffer_full`` tells of it: a state never grows
    beyond that, and a snapshot from before the new start fails.
    """
    _check(venue)
    if max_buffer < 1:
        raise ValueError(f"max_buffer must be positive, got {max_buffer}")
    _use_rocksdb(events)
    return events.groupBy("symbol").transformWithStateInPandas(
        BookResync(venue, max_buffer), "symbol string, ord long, emitted string", "Append", "None"
    )


class BookGap(StatefulProcessor):
    """The batch rule of ``operators.sequence.book_gap``, one row after the other."""

    def init(self, handle) -> None:
        self.state = handle.getValueState(
            "book", "started boolean, last long, after_snapshot boolean, content string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (False, None, False, None)
        started, last, fresh, content = bool(held[0]), _int(held[1]), bool(held[2]), held[3]
        batch = _ordered(rows)
        out = []
        for ord_, is_snapshot, seq, prev, text in zip(
            batch["ord"], batch["is_snapshot"], batch["seq"], batch["prev_seq"], batch["content"]
        ):
            seq, prev = _int(seq), _int(prev)
            if is_snapshot:
                started, last, fresh = True, seq, True
                out.append((key[0], int(ord_), "ok"))
                continue
            if not started:
                continue
            if seq is not None and seq == last:
                status = "gap" if not fresh and text != content else "duplicate"
            elif prev is not None:
                ok = last is not None and (
                    (seq is not None and prev < last <= seq) if fresh else prev == last
                )
                status = "ok" if ok else "gap"
            else:
                status = "gap" if None not in (seq, last) and seq != last + 1 else "ok"
            out.append((key[0], int(ord_), status))
            last = last if seq is None else seq
            fresh, content = False, text
        self.state.update((started, last, fresh, content))
        yield pd.DataFrame(out, columns=["symbol", "ord", "status"])

    def close(self) -> None:
        pass


def stream_book_gap(records: DataFrame) -> DataFrame:
    """(symbol, ord, status) for snapshots and deltas (ord, is_snapshot, seq, prev_seq,
    content); rows before the first snapshot are left out."""
    _use_rocksdb(records)
    return records.groupBy("symbol").transformWithStateInPandas(
        BookGap(), "symbol string, ord long, status string", "Append", "None"
    )


class LiveBook(StatefulProcessor):
    """Price levels as map state; one top-of-book row per symbol and micro-batch."""

    def init(self, handle) -> None:
        self.started = handle.getValueState("started", "yes boolean")
        self.levels = handle.getMapState("levels", "side string, price double", "size double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started = self.started.exists()
        changes: dict[tuple[str, float], float] = {}
        wipe, last = False, None
        batch = _ordered(rows)
        for ord_, is_snapshot, bids, asks in zip(
            batch["ord"], batch["is_snapshot"], batch["bids"], batch["asks"]
        ):
            if is_snapshot:
                started, wipe, changes = True, True, {}
            if not started:
                continue
            last = int(ord_)
            for side, levels in (("bid", bids), ("ask", asks)):
                for level in levels if levels is not None else ():
                    changes[(side, round(level["price"], 8))] = level["size"]
        if last is None:
            return
        if wipe:
            self.levels.clear()
        for place, size in changes.items():
            if size > 0:
                self.levels.updateValue(place, (size,))
            elif self.levels.containsKey(place):
                self.levels.removeKey(place)
        self.started.update((True,))
        prices: dict[str, list[float]] = {"bid": [], "ask": []}
        for side, price in self.levels.keys():
            prices[side].append(price)
        bid = max(prices["bid"], default=None)
        ask = min(prices["ask"], default=None)
        count = len(prices["bid"]) + len(prices["ask"])
        yield pd.DataFrame(
            {"symbol": [key[0]], "ord": [last], "best_bid": [bid], "best_ask": [ask], "levels": [count]}
        ).astype({"best_bid": float, "best_ask": float})

    def close(self) -> None:
        pass


def stream_book(records: DataFrame) -> DataFrame:
    """Live top of book from snapshots and deltas (symbol, ord, is_snapshot, bids, asks)."""
    _use_rocksdb(records)
    return records.groupBy("symbol").transformWithStateInPandas(
        LiveBook(),
        "symbol string, ord long, best_bid double, best_ask double, levels long",
        "Append",
        "None",
    )


class Reorg(StatefulProcessor):
    """Forks of a chain's blocks, by the rule of `operators.reorg`.

    The numbers held are one value; hashes are keyed by number, and a micro-batch reads
    only those of numbers just before its own blocks.
    """

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", "held array<long>")
        self.hashes = handle.getMapState("hashes", "number long", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        before = set(self.numbers.get()[0]) if self.numbers.exists() else set()
        parents = batch["block_number"] - 1
        asked = before & set(parents)
        read = {n: self.hashes.getValue((int(n),))[0] for n in asked}
        # a block is doubtful if a hash for the number before it is not its parent
        own = batch.groupby("block_number")["block_hash"].agg(["min", "max"])
        doubtful = pd.Series(False, index=batch.index)
        for known in (parents.map(read), parents.map(own["min"]), parents.map(own["max"])):
            doubtful |= known.notna() & (known != batch["parent_hash"])
        forks, held = advance(
            {n: read.get(n, _UNREAD) for n in before},
            batch["block_number"].tolist(),
            batch["block_hash"].tolist(),
            batch["parent_hash"].tolist(),
            doubtful.to_numpy().nonzero()[0].tolist(),
            self.depth,
        )
        for number in before - held.keys():
            self.hashes.removeKey((int(number),))
        for number, hash_ in held.items():
            if hash_ is not _UNREAD and read.get(number, _UNREAD) != hash_:
                self.hashes.updateValue((int(number),), (hash_,))
        self.numbers.update((sorted(int(n) for n in held),))
        yield pd.DataFrame(
            [(key[0], *fork) for fork in forks],
            columns=["chain", "block_number", "fork_point", "expected", "got"],
        )

    def close(self) -> None:
        pass


def stream_reorg(blocks: DataFrame, *, depth: int = 100) -> DataFrame:
    """Fork points of a block stream (chain, ord, block_number, block_hash, parent_hash).

    A block whose parent is not the one held before it names that as the fork point; it
    and the blocks above it are forgotten, and the odd block itself is not held.
    """
    _use_rocksdb(blocks)
    return blocks.groupBy("chain").transformWithStateInPandas(
        Reorg(depth),
        "chain string, block_number long, fork_point long, expected string, got string",
        "Append",
        "None",
    )
