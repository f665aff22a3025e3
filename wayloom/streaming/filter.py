"""A particle filter per session as a keyed operator: heading, speed scale and position from motion, speed and fix rows.

Rows: session, arrival (ns), t (ns), kind (motion: a = yaw rate rad/s; speed: a = km/h; fix: a = lat, b = lon, c =
accuracy m, d = course deg or negative), a, b, c, d. ``replay`` runs whole sessions of a batch frame; ``stream`` runs
the same steps as state of a streaming frame, so a stream gives what a batch of the same rows gives. State is the
particles' arrays, so it doesn't grow with a session's length. Sessions are independent: one shuffle by session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

PARTICLES = 500
STEP = 100_000_000
# fixed values: noise of the model
SIGMA_SCALE, FIX_LEAST, CLEAN, EFFECTIVE, COURSE_LEAST = 1.51, 5.0, 15.0, 0.5, np.radians(2.0)
HEADING_NOISE, ALONG_NOISE, SCALE_NOISE, HOLD = np.radians(0.05), 0.6, 1e-4, 2_000_000_000
DEGREE = 111_319.49

ESTIMATE = "session long, t long, lat double, lon double, heading double, east_std double, north_std double, ess double, particles int"


class Cloud:
    """Particles of one session in a plane about its first fix."""

    def __init__(self, session: int, n: int = PARTICLES):
        self.rng = np.random.default_rng(session & 0xFFFFFFFF)
        self.n, self.ready, self.now, self.next = n, False, 0, 0
        self.speed, self.speed_at, self.yaw = 0.0, -(1 << 62), 0.0

    def start(self, lat: float, lon: float, sigma: float, course: float, t: int) -> None:
        g = self.rng.standard_normal
        self.lat0, self.lon0, self.k = lat, lon, np.cos(np.radians(lat))
        self.e, self.nn = sigma * g(self.n), sigma * g(self.n)
        self.h = np.radians(course) + np.radians(5) * g(self.n) if course >= 0 else self.rng.uniform(0, 2 * np.pi, self.n)
        self.scale = 1.0 + 0.01 * g(self.n)
        self.w = np.full(self.n, 1 / self.n)
        self.ready, self.now = True, t
        self.next = (t // 1_000_000_000 + 1) * 1_000_000_000

    def advance(self, to: int) -> None:
        """Steps of at most 0.1 s; after long silences longer ones, at most 600."""
        if to <= self.now:
            return
        step = max(STEP, (to - self.now) // 600 + 1)
        spans, moving = [], 0
        while self.now < to:
            moving += self.speed > 0 and self.now - self.speed_at <= HOLD * 5
            spans.append(min(step, to - self.now) / 1e9)
            self.now += int(spans[-1] * 1e9)
            if to - self.now < 1000:
                self.now = to
        # all steps at once: draws and sums in the order of the steps, those that move first
        dt = np.array(spans)[:, None]
        g = self.rng.standard_normal((len(spans), 3, self.n))
        h, scale = np.empty((2, len(spans) + 1, self.n))
        h[0], scale[0] = self.h, self.scale
        h[1:] = self.yaw * dt + HEADING_NOISE * np.sqrt(dt) * g[:, 1]
        scale[1:] = SCALE_NOISE * np.sqrt(dt) * g[:, 2]
        for k in range(len(spans)):
            h[k + 1] += h[k]
            scale[k + 1] += scale[k]
        self.h, self.scale = h[-1].copy(), scale[-1].copy()
        if moving:
            dt = dt[:moving]
            d = self.speed / 3.6 * dt * scale[:moving]
            d += ALONG_NOISE * np.sqrt(np.abs(d)) * g[:moving, 0] * 0.3
            mid = h[:moving] + self.yaw * dt / 2
            for east, north in zip(d * np.sin(mid), d * np.cos(mid)):
                self.e += east
                self.nn += north

    def fix(self, lat: float, lon: float, accuracy: float, course: float) -> None:
        sigma = max(FIX_LEAST, accuracy / SIGMA_SCALE)
        e, n = (lon - self.lon0) * DEGREE * self.k, (lat - self.lat0) * DEGREE
        log = -0.5 * ((self.e - e) ** 2 + (self.nn - n) ** 2) / sigma**2
        if course >= 0 and accuracy <= CLEAN:
            turn = (self.h - np.radians(course) + np.pi) % (2 * np.pi) - np.pi
            log -= 0.5 * (turn / max(COURSE_LEAST, np.radians(10))) ** 2
        w = np.log(np.maximum(self.w, 1e-300)) + log
        w = np.exp(w - w.max())
        self.w = w / w.sum() if np.isfinite(w).all() and w.sum() > 0 else np.full(self.n, 1 / self.n)
        if 1 / (self.w**2).sum() < EFFECTIVE * self.n:  # systematic resampling
            at = np.minimum(np.searchsorted(np.cumsum(self.w), (np.arange(self.n) + self.rng.uniform()) / self.n), self.n - 1)
            jitter = 0.1 * sigma * self.rng.standard_normal((2, self.n))
            self.e, self.nn, self.h, self.scale = self.e[at] + jitter[0], self.nn[at] + jitter[1], self.h[at], self.scale[at]
            self.w = np.full(self.n, 1 / self.n)

    def estimate(self, session: int, t: int) -> tuple:
        e, n = self.w @ self.e, self.w @ self.nn
        heading = np.degrees(np.arctan2(self.w @ np.sin(self.h), self.w @ np.cos(self.h))) % 360
        return session, t, self.lat0 + n / DEGREE, self.lon0 + e / DEGREE / self.k, heading, np.sqrt(self.w @ (self.e - e) ** 2), np.sqrt(self.w @ (self.nn - n) ** 2), 1 / (self.w**2).sum(), self.n

    def feed(self, session: int, kind: str, arrival: int, a: float, b: float, c: float, d: float) -> Iterator[tuple]:
        """Takes a row; gives the estimates of whole seconds that it makes due, before it counts."""
        if self.ready:
            due = 0
            while self.next <= arrival and due < 600:
                self.advance(self.next)
                yield self.estimate(session, self.next)
                self.next += 1_000_000_000
                due += 1
            self.next = max(self.next, arrival // 1_000_000_000 * 1_000_000_000 + 1_000_000_000) if due == 600 else self.next
            self.advance(arrival)
        if kind == "motion":
            self.yaw = a
        elif kind == "speed" and a >= 0:
            self.speed, self.speed_at = a, arrival
        elif kind == "fix" and c >= 0:
            if self.ready:
                self.fix(a, b, c, d)
            else:
                self.start(a, b, max(FIX_LEAST, c / SIGMA_SCALE), d, arrival)


COLUMNS = [x.split()[0] for x in ESTIMATE.split(", ")]
TYPES = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]] for x in ESTIMATE.split(", ")]


def _run(cloud: Cloud, session: int, rows: pd.DataFrame) -> list[tuple]:
    rows = rows.sort_values(["arrival", "line_no"], kind="stable")
    out: list[tuple] = []
    for kind, arrival, a, b, c, d in zip(*(rows[x].tolist() for x in ("kind", "arrival", "a", "b", "c", "d"))):
        out.extend(cloud.feed(session, kind, arrival, a, b, c, d))
    return out


def replay(rows: DataFrame) -> DataFrame:
    """Estimates of whole sessions (session, line_no, arrival, kind, a, b, c, d), one a second.

    A task takes its sessions one after the other in order of arrival and holds one cloud and one batch, however long a
    session is. A row costs far more than its bytes, so tasks are as many as asked for and aren't merged by size."""
    columns = ["session", "line_no", "arrival", "kind", "a", "b", "c", "d"]
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cloud, last = None, None
        for t in batches:
            out: list[tuple] = []
            values = [t.column(x).to_pylist() for x in ("session", "kind", "arrival")] + [t.column(x).to_numpy(zero_copy_only=False).tolist() for x in "abcd"]
            for session, kind, arrival, a, b, c, d in zip(*values):
                if cloud is None or session != last:
                    cloud, last = Cloud(session), session
                out.extend(cloud.feed(session, kind, arrival, a, b, c, d))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 9, TYPES)], COLUMNS)

    return rows.select(columns).repartition(tasks, "session").sortWithinPartitions("session", "arrival", "line_no").mapInArrow(run, ESTIMATE)


def stream(rows: DataFrame) -> DataFrame:
    """The same over a streaming frame. A micro-batch's rows of a session are taken in order of arrival; the state is one
    pickled cloud per session."""
    import pickle

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cloud = pickle.loads(state.get[0]) if state.exists else Cloud(key[0])
        pdf = pd.concat(list(batches))
        out = _run(cloud, key[0], pdf)
        state.update((pickle.dumps(cloud),))
        yield pd.DataFrame(out, columns=COLUMNS)

    return rows.groupBy("session").applyInPandasWithState(step, ESTIMATE, "cloud binary", "append", GroupStateTimeout.NoTimeout)


def synthetic_drive(spark, sessions: int = 4, seconds: int = 60) -> DataFrame:
    """Rows of drives along a circle: speed and yaw ten times a second, a fix a second until half time. Built by expressions."""
    k = F.col("k")
    t = k * F.lit(STEP).cast("long")
    x = spark.range(sessions).select(F.col("id").alias("session")).select("session", F.explode(F.sequence(F.lit(0), F.lit(seconds * 10))).alias("k"))
    yaw, v = 0.02, 15.0
    angle = k / 10 * yaw
    lat, lon = 50.0 + F.sin(angle) * v / yaw / DEGREE, 30.0 + (1 - F.cos(angle)) * v / yaw / (DEGREE * 0.6427876)
    row = lambda kind, a, b, c, d: F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"), d.cast("double").alias("d"))
    zero = F.lit(0.0)
    rows = F.array(row("motion", F.lit(yaw), zero, zero, zero), row("speed", F.lit(v * 3.6), zero, zero, zero), row("fix", lat, lon, F.lit(8.0), F.degrees(angle)))
    x = x.select("session", "k", t.alias("arrival"), F.posexplode(rows).alias("p", "r")).where("r.kind <> 'fix' or (k % 10 = 0 and k <= " + str(seconds * 5) + ")")
    return x.select("session", (k * 3 + F.col("p")).cast("long").alias("line_no"), F.col("arrival").cast("long").alias("arrival"), "r.kind", "r.a", "r.b", "r.c", "r.d")
