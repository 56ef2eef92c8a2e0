"""Keyed state processors: one key's rows in arrival order within and across micro-batches.

A micro-batch does not order the rows of a key, so each processor sorts its
batch by ``arrival_seq``. A row at or below the last sequence already handled is
late: it goes out with ``late = true`` and does not touch the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from medialake.functions.timing import AAC_FRAME_SAMPLES
from medialake.operators.sequence import DEFAULT_VIDEO_FRAME_US, LONGEST_FRAME_US
from medialake.operators.subscribe import SUBSCRIPTION, apply_update

LONG, STR = T.LongType(), T.StringType()


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


class Expiring:
    """A state handle whose variables forget what has not been written for ``ttl_ms`` of processing time."""

    def __init__(self, handle: StatefulProcessorHandle, ttl_ms: int):
        self.handle, self.ttl_ms = handle, ttl_ms

    def getValueState(self, name, schema):
        return self.handle.getValueState(name, schema, self.ttl_ms)

    def getListState(self, name, schema):
        return self.handle.getListState(name, schema, self.ttl_ms)

    def getMapState(self, name, key, value):
        return self.handle.getMapState(name, key, value, self.ttl_ms)


class Ordered(StatefulProcessor):
    """Base: sorted batches, late rows split off, output frames built from row dicts.

    With ``ttl_ms`` the state of a key that has been idle for so long is dropped, as a
    whole, since every batch writes all of it; a key that comes back starts anew.
    """

    order = "arrival_seq"
    columns: tuple[str, ...] = ()
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms is not None:
            handle = Expiring(handle, self.ttl_ms)
        self.seen = handle.getValueState("seen", struct_of(v=LONG))
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        """Read the key's state before its rows."""

    def step(self, row: dict) -> Iterator[dict]:
        raise NotImplementedError

    def end(self) -> None:
        """Write the key's state after its rows."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.key = key
        last = self.seen.get()[0] if self.seen.exists() else -(1 << 62)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        self.begin()
        out: list[dict] = []
        for row in batch.to_dict("records"):
            if row[self.order] <= last:
                out.append({**{c: row.get(c) for c in self.columns}, "late": True})
                continue
            last = row[self.order]
            out.extend({**{c: r.get(c) for c in self.columns}, "late": False} for r in self.step(row))
        self.end()
        self.seen.update((int(last),))
        if out:
            yield frame(out, [*self.columns, "late"])

    def close(self) -> None:
        pass


def frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as nullable columns: integers stay integers beside NULLs."""
    data = {}
    for c in columns:
        values = [r.get(c) for r in rows]
        ints = [v for v in values if v is not None]
        if ints and all(isinstance(v, int) and not isinstance(v, bool) for v in ints) and len(ints) < len(values):
            data[c] = pd.array(values, dtype="Int64")
        else:
            data[c] = pd.Series(values, dtype=object) if len(ints) < len(values) else values
    return pd.DataFrame(data, columns=columns)


class Columnar(Ordered):
    """Base of rules that are scans: a key's batch as sorted columns, with what the state carries, out in frames of ``FRAME`` rows."""

    FRAME = 16384

    def scan(self, d: pd.DataFrame) -> pd.DataFrame:
        """The output columns of the rows on time, in order; the state moves on."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.key = key
        last = self.seen.get()[0] if self.seen.exists() else -(1 << 62)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        seq = batch[self.order].to_numpy()
        late = seq <= last
        late[1:] |= seq[1:] == seq[:-1]
        self.begin()
        on = batch[~late].reset_index(drop=True)
        out = self.scan(on)[list(self.columns)].assign(late=False)
        self.end()
        self.seen.update((int(max(last, seq.max())),))
        for k in range(0, len(out), self.FRAME):
            yield out.iloc[k : k + self.FRAME]
        if late.any():
            missed = batch[late]
            yield frame([{**{c: r.get(c) for c in self.columns}, "late": True} for r in missed.to_dict("records")], [*self.columns, "late"])


def true(c: pd.Series) -> np.ndarray:
    return c.eq(True).fillna(False).to_numpy(bool)


def numbered(group: np.ndarray, track: pd.Series, carried: dict, at: int) -> tuple[np.ndarray, dict]:
    """Number of each row among those of its (group, track), and the counts of the last group; counts of group ``at`` go on from ``carried``."""
    rows = pd.DataFrame({"g": group, "t": track.to_numpy()})
    n = rows.groupby(["g", "t"], sort=False, dropna=False).cumcount().to_numpy()
    n = n + np.where(group == at, rows["t"].map(carried).fillna(0).to_numpy(), 0).astype(np.int64)
    if not len(rows):
        return n, dict(carried)
    top = rows["g"].max()
    counts = rows.loc[rows["g"] == top, "t"].value_counts(dropna=False).to_dict()
    if top == at:
        counts = {t: carried.get(t, 0) + counts.get(t, 0) for t in {*carried, *counts}}
    return n, counts


class LiveGroups(Columnar):
    """Key-frame groups and object numbers of one feed."""

    columns = ("feed_id", "arrival_seq", "track_name", "group_id", "object_id")

    def open(self, handle):
        self.group = handle.getValueState("group", struct_of(v=LONG))
        self.counts = handle.getMapState("counts", struct_of(k=STR), struct_of(v=LONG))

    def begin(self):
        self.g = self.group.get()[0] if self.group.exists() else -1
        self.n = {k[0]: v[0] for k, v in self.counts.iterator()}

    def scan(self, d):
        opens = (d["handler_type"] == "vide").to_numpy(bool) & true(d["is_sync"])
        group = self.g + np.cumsum(opens)
        d = d.assign(group_id=group)[group >= 0]
        number, counts = numbered(d["group_id"].to_numpy(), d["track_name"], self.n, self.g)
        if len(d):
            self.g, self.n = int(group[-1]), counts
        return d.assign(object_id=number)

    def end(self):
        self.group.update((int(self.g),))
        self.counts.clear()
        for k, v in self.n.items():
            self.counts.updateValue((k,), (int(v),))


class SharedGroups(Columnar):
    """Groups shared by all renditions of one session; ``has_video`` rows follow the shared rule."""

    columns = ("session_id", "arrival_seq", "track_name", "group_id", "object_id")

    def open(self, handle):
        self.head = handle.getValueState("head", struct_of(group=LONG, start=LONG))
        self.tracks = handle.getMapState("tracks", struct_of(k=STR), struct_of(objects=LONG, started=LONG))

    def begin(self):
        self.g, self.start = self.head.get() if self.head.exists() else (-1, -(1 << 62))
        self.t = {k[0]: list(v) for k, v in self.tracks.iterator()}

    def scan(self, d):
        shared = true(d["has_video"])
        parts = []
        # whether a session has video does not change, so there is one run as a rule
        cuts = [0, *(np.flatnonzero(shared[1:] != shared[:-1]) + 1).tolist(), len(d)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                parts.append(self._shared(d.iloc[a:b]) if shared[a] else self._alone(d.iloc[a:b]))
        return pd.concat(parts) if parts else d.assign(group_id=0, object_id=0)

    def _alone(self, d):
        number, counts = numbered(np.zeros(len(d), np.int64), d["track_name"], {t: v[0] for t, v in self.t.items()}, 0)
        self.t |= {t: [n, self.t.get(t, [0, 0])[1]] for t, n in counts.items()}
        return d.assign(group_id=number, object_id=0)

    def _shared(self, d):
        video = (d["handler_type"] == "vide").to_numpy(bool)
        key, start = video & true(d["is_sync"]), d["start_us"].to_numpy()
        reached = np.maximum.accumulate(np.concatenate(([self.start], np.where(key, start, -(1 << 62)))))
        before = reached[:-1]
        group = self.g + np.cumsum(key & (start > before))
        d = d.assign(group_id=group, __key=key & (start >= before))
        d, video = d[~(key & (start < before))], video[~(key & (start < before))]
        carried = {t for t, v in self.t.items() if v[1]}
        begun = d.groupby(["group_id", "track_name"], sort=False, dropna=False)["__key"].cummax().to_numpy(bool) if len(d) else np.zeros(0, bool)
        begun |= (d["group_id"] == self.g).to_numpy() & d["track_name"].isin(carried).to_numpy()
        started = d[begun & (d["group_id"] == (group[-1] if len(group) else self.g)).to_numpy()]["track_name"]
        kept = d[(d["group_id"] >= 0).to_numpy() & (~video | begun)]
        number, counts = numbered(kept["group_id"].to_numpy(), kept["track_name"], {t: v[0] for t, v in self.t.items()}, self.g)
        if len(group):
            same = int(group[-1]) == self.g
            top = counts if len(kept) and kept["group_id"].iloc[-1] == group[-1] or same else {}
            names = {*top, *started, *(self.t if same else ())}
            flags = {*started, *(carried if same else ())}
            self.t = {t: [top.get(t, 0), int(t in flags)] for t in names}
            self.g, self.start = int(group[-1]), int(reached[-1])
        return kept.assign(object_id=number)

    def end(self):
        self.head.update((int(self.g), int(self.start)))
        self.tracks.clear()
        for k, v in self.t.items():
            self.tracks.updateValue((k,), (int(v[0]), int(v[1])))


class SampleClock(Columnar):
    """Duration estimate and monotone clock of one track."""

    columns = ("feed_id", "track_name", "arrival_seq", "duration_us", "sample_ticks", "decode_time")

    def open(self, handle):
        self.state = handle.getValueState("clock", struct_of(pts=LONG, good=LONG, clock=LONG))

    def begin(self):
        self.pts, self.good, self.clock = self.state.get() if self.state.exists() else (0, 0, 0)

    def scan(self, d):
        pts, scale, video = d["pts_us"].to_numpy(), d["timescale"].fillna(0).to_numpy(np.int64), true(d["is_video"])
        before = np.concatenate(([self.pts], pts[:-1]))
        step = pts - before
        sure = (before != 0) & (step > 0) & (step <= LONGEST_FRAME_US)
        at = np.maximum.accumulate(np.where(sure, np.arange(len(d)), -1))
        good = np.where(at >= 0, step[np.maximum(at, 0)], self.good) if len(d) else step
        usual = np.where(video, DEFAULT_VIDEO_FRAME_US, AAC_FRAME_SAMPLES * 1000000 // np.where(scale == 0, 48000, scale))
        duration = np.where(good != 0, good, usual)
        ticks = np.where(video, np.maximum(duration * scale // 1000000, 1), AAC_FRAME_SAMPLES)
        clock = self.clock + np.cumsum(ticks)
        out = d.assign(duration_us=duration, sample_ticks=ticks, decode_time=clock - ticks)
        if len(d):
            self.pts, self.good, self.clock = int(pts[-1]), int(good[-1]), int(clock[-1])
        return out

    def end(self):
        self.state.update((int(self.pts), int(self.good), int(self.clock)))


class LatestGroups(Columnar):
    """Keeps the latest ``n`` groups of a feed and emits a group's rows when it leaves, or a row that comes after its group has left."""

    columns = ("feed_id", "arrival_seq", "group_id")

    def __init__(self, n: int = 2):
        self.n = n

    def open(self, handle):
        self.kept = handle.getListState("kept", struct_of(seq=LONG, group=LONG))

    def begin(self):
        self.rows = pd.DataFrame([tuple(r) for r in self.kept.get()] if self.kept.exists() else [], columns=["arrival_seq", "group_id"], dtype="int64")

    def scan(self, d):
        held = pd.concat([self.rows, d[["arrival_seq", "group_id"]]], ignore_index=True)
        out = held["group_id"] <= held["group_id"].max() - self.n
        self.rows = held[~out]
        return held[out].assign(feed_id=self.key[0])

    def end(self):
        self.kept.put(list(zip(self.rows["arrival_seq"].astype(int).tolist(), self.rows["group_id"].astype(int).tolist())))


class NewestRows(Columnar):
    """Keeps the newest ``n`` rows of a session and emits each row that is pushed out."""

    columns = ("session_id", "arrival_seq")

    def __init__(self, n: int = 128):
        self.n = max(n, 1)

    def open(self, handle):
        self.kept = handle.getListState("kept", struct_of(seq=LONG))

    def begin(self):
        self.rows = [r[0] for r in self.kept.get()] if self.kept.exists() else []

    def scan(self, d):
        held = self.rows + d["arrival_seq"].tolist()
        self.rows = held[-self.n :]
        return pd.DataFrame({"session_id": self.key[0], "arrival_seq": np.array(held[: -self.n], np.int64)})

    def end(self):
        self.kept.put([(int(s),) for s in self.rows])


class Subscriptions(Ordered):
    """Subscription state of one request: a subscribe row (seq below all updates), then updates."""

    order = "update_seq"
    columns = ("request_id", "update_seq", "accepted", *SUBSCRIPTION)

    def open(self, handle):
        self.state = handle.getValueState("sub", struct_of(**{c: LONG for c in SUBSCRIPTION}))

    def begin(self):
        self.sub = dict(zip(SUBSCRIPTION, self.state.get())) if self.state.exists() else None

    def step(self, row):
        if row["is_subscribe"]:
            self.sub = {c: int(row[c]) for c in SUBSCRIPTION}
            return
        if self.sub is None:
            yield {"request_id": row["request_id"], "update_seq": row["update_seq"], "accepted": False}
            return
        self.sub, ok = apply_update(self.sub, row)
        yield {"request_id": row["request_id"], "update_seq": row["update_seq"], "accepted": ok, **self.sub}

    def end(self):
        if self.sub is not None:
            self.state.update(tuple(int(self.sub[c]) for c in SUBSCRIPTION))


class LastCatalog(Columnar):
    """Latest catalog object of one broadcast, re-emitted when it changes."""

    columns = ("broadcast_id", "arrival_seq", "group_id", "object_id", "payload")

    def open(self, handle):
        self.state = handle.getValueState("last", struct_of(seq=LONG, group=LONG, object=LONG, payload=STR))

    def scan(self, d):
        self.row = d.iloc[-1] if len(d) else None
        return d.tail(1)

    def end(self):
        if self.row is not None:
            r = self.row
            self.state.update((int(r["arrival_seq"]), int(r["group_id"]), int(r["object_id"]), r["payload"]))


class Republish(StatefulProcessor):
    """Re-emits a broadcast's last catalog each ``interval_ms`` of processing time; 0 is off."""

    columns = ("broadcast_id", "version_seq", "published_ms", "again")

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", struct_of(version=LONG, at=LONG))

    def _arm(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if self.interval > 0:
            self.handle.registerTimer(now + self.interval)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = pd.concat(list(rows), ignore_index=True).sort_values("version_seq")
        version = int(batch["version_seq"].iloc[-1])
        self.last.update((version, now))
        self._arm(now)
        yield pd.DataFrame([(key[0], int(v), now, False) for v in batch["version_seq"]], columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.last.exists():
            return
        version, _at = self.last.get()
        self.last.update((version, now))
        self._arm(now)
        yield pd.DataFrame([(key[0], int(version), now, True)], columns=list(self.columns))

    def close(self):
        pass


class Liveness(StatefulProcessor):
    """Live, gap and finished transitions of one feed; a gap is ``gap_ms`` of silence while the feed is open.

    A feed that has been finished, or silent, for ``forget_ms`` leaves no state.
    """

    columns = ("feed_id", "at_ms", "state")

    def __init__(self, gap_ms: int, forget_ms: int | None = None):
        self.gap, self.forget = gap_ms, forget_ms

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", struct_of(state=STR, closed=LONG))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        before, closed = self.state.get() if self.state.exists() else (None, 0)
        batch = pd.concat(list(rows), ignore_index=True)
        closed = 1 if closed or bool(batch["is_close"].any()) else 0
        state = "finished" if closed else "live"
        self.state.update((state, closed))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if not closed:
            self.handle.registerTimer(now + self.gap)
        elif self.forget is not None:
            self.handle.registerTimer(now + self.forget)
        if state != before:
            yield pd.DataFrame([(key[0], now, state)], columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.state.get()[0] if self.state.exists() else None
        if state != "live":  # finished, or silent for the second time
            self.state.clear()
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.state.update(("gap", 0))
        if self.forget is not None:
            self.handle.registerTimer(now + self.forget)
        yield pd.DataFrame([(key[0], now, "gap")], columns=list(self.columns))

    def close(self):
        pass


class Transitions(Columnar):
    """Running bytes, objects and group changes of one track."""

    columns = ("broadcast_id", "track_name", "bytes", "objects", "groups")
    order = "plan_index"

    def open(self, handle):
        self.state = handle.getValueState("stats", struct_of(bytes=LONG, objects=LONG, groups=LONG, last=LONG))

    def begin(self):
        self.s = list(self.state.get()) if self.state.exists() else [0, 0, 0, -1]

    def scan(self, d):
        if len(d):
            group = d["group_id"].to_numpy()
            moved = int((group != np.concatenate(([self.s[3]], group[:-1]))).sum())
            self.s = [self.s[0] + int(d["payload_bytes"].sum()), self.s[1] + len(d), self.s[2] + moved, int(group[-1])]
        return d.tail(1).assign(bytes=int(self.s[0]), objects=int(self.s[1]), groups=int(self.s[2]))

    def end(self):
        self.state.update(tuple(int(v) for v in self.s))
