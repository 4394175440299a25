"""Steps of the keyed fold: gradient models, quantile markers, change detectors, model selection, policies and replay."""

from __future__ import annotations

import bisect
import math
import struct
from collections import deque
from dataclasses import dataclass
from types import SimpleNamespace as State

import numpy as np

from .fold import Reject


def number(x: float) -> float:
    if x is None or not math.isfinite(x):
        raise Reject("not finite")
    return float(x)


def vector(xs, n: int | None = None) -> np.ndarray:
    out = np.asarray([number(x) for x in xs], float)
    if n is not None and len(out) != n:
        raise Reject(f"{len(out)} features, not {n}")
    return out


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


@dataclass
class EwMean:
    """Exponentially weighted mean after each row; columns: x, or w too where weighted."""

    alpha: float
    weighted: bool = False
    out: str = "ew double"

    def init(self):
        return State(m=None)

    def step(self, s, row):
        x, w = number(row.x), number(row.w) if self.weighted else 1.0
        if w > 0:
            a = 1 - (1 - self.alpha) ** w if self.weighted else self.alpha
            s.m = x if s.m is None else a * x + (1 - a) * s.m
        return (s.m,)


@dataclass
class DecayedMean:
    """Mean with ages discounted by exp(-decay * age); columns: t (s), x. Time that goes back is rejected."""

    decay: float
    out: str = "decayed double"

    def init(self):
        return State(t=None, top=0.0, bottom=0.0)

    def step(self, s, row):
        t, x = number(row.t), number(row.x)
        if s.t is not None and t < s.t:
            raise Reject("time goes back")
        keep = 1.0 if s.t is None else math.exp(-self.decay * (t - s.t))
        s.t, s.top, s.bottom = t, s.top * keep + x, s.bottom * keep + 1
        return (s.top / s.bottom,)


class Scaler:
    """Running mean and squared deviations of each feature."""

    def __init__(self, n: int):
        self.n, self.mean, self.m2 = 0, np.zeros(n), np.zeros(n)

    def update(self, x: np.ndarray) -> None:
        self.n += 1
        d = x - self.mean
        self.mean = self.mean + d / self.n
        self.m2 = self.m2 + d * (x - self.mean)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.n:
            return x - self.mean
        v = self.m2 / self.n
        return (x - self.mean) / np.where(v < 1e-12, 1.0, np.sqrt(np.maximum(v, 0)))


@dataclass
class Linear:
    """Linear or logistic model by gradient steps, predicted before it learns; columns: features, y, and w where weighted.

    optimizer: "sgd" or "adagrad"; loss: "squared", "huber" or "log" (y in {0, 1}). The intercept has no L2 term. With scale, rows
    are scaled by what the stream has shown: before the row for its prediction, with it for learning.
    """

    d: int
    optimizer: str = "sgd"
    rate: float = 0.01
    l2: float = 0.0
    loss: str = "squared"
    delta: float = 1.0
    eps: float = 1e-8
    scale: bool = False
    weighted: bool = False
    out: str = "pred double, y double"

    def init(self):
        return State(w=np.zeros(self.d), b=0.0, g=np.zeros(self.d), gb=0.0, scaler=Scaler(self.d) if self.scale else None)

    def predict(self, s, x: np.ndarray) -> float:
        z = float(s.w @ x) + s.b
        return logistic(z) if self.loss == "log" else z

    def learn(self, s, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        r = self.predict(s, x) - y
        if self.loss == "huber":
            r = max(-self.delta, min(self.delta, r))
        r *= weight
        g = r * x
        if self.optimizer == "adagrad":
            s.g, s.gb = s.g + g * g, s.gb + r * r
            s.w = s.w - self.rate / np.sqrt(s.g + self.eps) * (g + self.l2 * s.w)
            s.b -= self.rate / math.sqrt(s.gb + self.eps) * r
        else:
            s.w = s.w - self.rate * (g + self.l2 * s.w)
            s.b -= self.rate * r

    def step(self, s, row):
        x, y = vector(row.features, self.d), number(float(row.y))
        weight = number(row.w) if self.weighted else 1.0
        if weight < 0:
            raise Reject("negative weight")
        p = self.predict(s, s.scaler(x) if s.scaler else x)
        if weight > 0:
            if s.scaler:
                s.scaler.update(x)
                x = s.scaler(x)
            self.learn(s, x, y, weight)
        return (p, y)


@dataclass
class Ftrl:
    """FTRL-proximal over sparse features [(id, value)], linear or (classify) logistic; columns: features, y.

    The intercept has no L1 term. most: at that many features, new ones make the row rejected or (ignore) are left out.
    """

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    classify: bool = False
    most: int | None = None
    ignore: bool = False
    out: str = "pred double, y double, n_features int"

    def init(self):
        return State(z={}, n={}, bz=0.0, bn=0.0)

    def weight(self, z: float, n: float, l1: float) -> float:
        return 0.0 if abs(z) <= l1 or n == 0 else -(z - math.copysign(l1, z)) / (self.l2 + (self.beta + math.sqrt(n)) / self.alpha)

    def _moved(self, z: float, n: float, g: float, l1: float) -> tuple[float, float]:
        sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha
        return z + g - sigma * self.weight(z, n, l1), n + g * g

    def step(self, s, row):
        xs = [(f["id"] if isinstance(f, dict) else f[0], number(f["value"] if isinstance(f, dict) else f[1])) for f in row.features]
        if not xs:
            raise Reject("no features")
        y = number(float(row.y))
        new = [i for i, _ in xs if i not in s.z]
        if self.most is not None and len(s.z) + len(new) > self.most:
            if not self.ignore:
                raise Reject("too many features")
            room = set(new[: max(0, self.most - len(s.z))])
            xs = [(i, v) for i, v in xs if i in s.z or i in room]
        z = self.weight(s.bz, s.bn, 0.0) + sum(v * self.weight(s.z.get(i, 0.0), s.n.get(i, 0.0), self.l1) for i, v in xs)
        p = logistic(z) if self.classify else z
        r = p - y
        for i, v in xs:
            s.z[i], s.n[i] = self._moved(s.z.get(i, 0.0), s.n.get(i, 0.0), r * v, self.l1)
        s.bz, s.bn = self._moved(s.bz, s.bn, r, 0.0)
        return (p, y, len(s.z))


@dataclass
class P2:
    """Quantiles by five markers each; columns: x. Exact, by linear interpolation, below five values."""

    quantiles: tuple[float, ...] = (0.5,)
    out: str = "estimates array<double>"

    def init(self):
        return State(first=[], h=None, at=None, n=0)

    def _goal(self, q: float, n: int) -> list[float]:
        return [1 + (n - 1) * share for share in (0.0, q / 2, q, (1 + q) / 2, 1.0)]

    def _move(self, h: list[float], at: list[int], q: float, x: float, n: int) -> None:
        cell = min(max(bisect.bisect_right(h, x) - 1, 0), 3)
        h[0], h[4] = min(h[0], x), max(h[4], x)
        for i in range(cell + 1, 5):
            at[i] += 1
        for i, goal in list(enumerate(self._goal(q, n)))[1:4]:
            d = 1 if goal - at[i] >= 1 and at[i + 1] - at[i] > 1 else -1 if goal - at[i] <= -1 and at[i] - at[i - 1] > 1 else 0
            if not d:
                continue
            up, down = (h[i + 1] - h[i]) / (at[i + 1] - at[i]), (h[i] - h[i - 1]) / (at[i] - at[i - 1])
            bent = h[i] + d * ((at[i] - at[i - 1] + d) * up + (at[i + 1] - at[i] - d) * down) / (at[i + 1] - at[i - 1])
            h[i] = bent if h[i - 1] < bent < h[i + 1] else h[i] + d * (up if d > 0 else down)
            at[i] += d

    def step(self, s, row):
        x = number(row.x)
        s.n += 1
        if s.n <= 5:
            bisect.insort(s.first, x)
            if s.n == 5:
                s.h, s.at = [list(s.first) for _ in self.quantiles], [[1, 2, 3, 4, 5] for _ in self.quantiles]
        else:
            for h, at, q in zip(s.h, s.at, self.quantiles):
                self._move(h, at, q, x, s.n)
        return ([h[2] for h in s.h] if s.n >= 5 else [float(np.quantile(s.first, q)) for q in self.quantiles],)


@dataclass
class PageHinkley:
    """Upward shifts of the mean; columns: x. alpha below 1 forgets."""

    threshold: float = 50.0
    warning: float = 25.0
    alpha: float = 1.0
    delta: float = 0.005
    least: int = 30
    out: str = "level string, statistic double"

    def init(self):
        return State(n=0, mean=0.0, sum=0.0, low=0.0)

    def level(self, s, x: float) -> tuple[str, float]:
        s.n += 1
        s.mean += (x - s.mean) / s.n
        s.sum = self.alpha * s.sum + x - s.mean - self.delta
        s.low = min(s.low, s.sum)
        rise = s.sum - s.low
        return ("None" if s.n < self.least or rise <= self.warning else "Drift" if rise > self.threshold else "Warning"), rise

    def step(self, s, row):
        return self.level(s, number(row.x))


@dataclass
class Adwin:
    """Change of the mean anywhere in a window that shrinks when it drifts; columns: x."""

    delta: float = 0.002
    warning_delta: float = 0.01
    most: int = 1000
    least: int = 10
    out: str = "level string, window int, window_mean double"

    def init(self):
        return State(win=[])

    def level(self, s, x: float) -> str:
        s.win.append(x)
        if len(s.win) > self.most:
            s.win.pop(0)
        n = len(s.win)
        if n < max(self.least, 2):
            return "None"
        sums = np.cumsum(s.win)
        k = np.arange(1, n)
        gap = np.abs(sums[:-1] / k - (sums[-1] - sums[:-1]) / (n - k))
        harmonic = k * (n - k) / n
        bound = lambda d: np.sqrt(np.log(4 * max(1.0, math.log(n)) / d) / (2 * harmonic))
        drift = np.flatnonzero(gap > bound(self.delta))
        if len(drift):
            del s.win[: int(k[drift[0]])]
            return "Drift"
        return "Warning" if (gap > bound(self.warning_delta)).any() else "None"

    def step(self, s, row):
        level = self.level(s, number(row.x))
        return (level, len(s.win), float(np.mean(s.win)))


@dataclass
class DriftAware:
    """A linear model whose absolute error feeds a detector; on a drift the model starts anew. columns: features, y."""

    model: Linear
    detector: PageHinkley | Adwin
    out: str = "pred double, error double, level string, action string"

    def init(self):
        return State(model=self.model.init(), detector=self.detector.init())

    def step(self, s, row):
        x, y = vector(row.features, self.model.d), number(float(row.y))
        p = self.model.predict(s.model, x)
        found = self.detector.level(s.detector, abs(y - p))
        level = found if isinstance(found, str) else found[0]
        action = "ResetModel" if level == "Drift" else "NotifyOnly"
        if level == "Drift":
            s.model = self.model.init()
        self.model.learn(s.model, x, y)
        return (p, abs(y - p), level, action)


@dataclass
class Selector:
    """Which of several models to trust; columns: y, preds (one each).

    The model of least mean error over a window leads, the first among equals. The choice follows only at the moment when the lead
    changes, if the leader has enough rows and the last switch is long enough ago; a refused leader isn't tried again until the lead
    changes once more.
    """

    models: int
    window: int = 50
    least: int = 10
    cooling: int = 20
    out: str = "leader int, chosen int, switched boolean"

    def init(self):
        return State(errors=[deque(maxlen=self.window) for _ in range(self.models)], n=0, leader=None, chosen=None, since=0)

    def step(self, s, row):
        y, preds = number(row.y), vector(row.preds, self.models)
        for e, p in zip(s.errors, preds):
            e.append(abs(y - p))
        s.n, s.since = s.n + 1, s.since + 1
        means = [sum(e) / len(e) for e in s.errors]
        lead = means.index(min(means))
        moved, s.leader, before = lead != s.leader, lead, s.chosen
        if moved and s.n >= self.least and lead != s.chosen and (s.chosen is None or s.since >= self.cooling):
            s.chosen, s.since = lead, 0
        return (s.leader, s.chosen, s.chosen != before)


LEVELS = ("None", "Warning", "Drift")


@dataclass
class Consensus:
    """One drift level from several detectors' votes in each window; columns: votes [(detector, level, available)], generation."""

    warning_votes: int = 1
    drift_votes: int = 2
    confirm: int = 2
    clear: int = 3
    cooldown: int = 5
    merge: int = 20
    warming: int = 1
    most: int = 16
    out: str = "level string, n_warning int, n_drift int, new_event boolean, merged_event boolean, event_id int, occurrences int"

    def init(self):
        return State(window=0, own=0, generation=None, level="None", run={x: 0 for x in LEVELS}, cooling=0, event=None, events=0)

    def _event(self, s, level: str, names: list[str]) -> tuple[bool, bool]:
        s.cooling = self.cooldown
        e = s.event
        if e and e["generation"] == s.generation and s.window - e["last"] <= self.merge:
            e.update(last=s.window, occurrences=e["occurrences"] + 1, peak=max(e["peak"], level, key=LEVELS.index), detectors=sorted({*e["detectors"], *names})[: self.most])
            return False, True
        s.events += 1
        s.event = {"id": s.events, "first": s.window, "last": s.window, "peak": level, "detectors": sorted({*names})[: self.most], "occurrences": 1, "generation": s.generation}
        return True, False

    def step(self, s, row):
        votes = [(v["detector"], v["level"], v["available"]) if isinstance(v, dict) else tuple(v) for v in row.votes]
        if len({n for n, _, _ in votes}) < len(votes) or len(votes) > self.most:
            raise Reject("a detector votes twice, or too many do")
        if s.generation is not None and s.generation != row.generation:
            s.own, s.level, s.cooling, s.run = 0, "None", 0, {x: 0 for x in LEVELS}
        s.generation, s.window, s.own = row.generation, s.window + 1, s.own + 1
        ready, s.cooling = s.cooling == 0, max(0, s.cooling - 1)
        there = [(n, x) for n, x, ok in votes if ok]
        names = [n for n, x in there if x != "None"]
        drifts = sum(x == "Drift" for _, x in there)
        new = merged = False
        if s.own <= self.warming or len(there) < self.warning_votes:
            s.run["Warning"] = s.run["Drift"] = 0
        else:
            raw = "Drift" if drifts >= self.drift_votes else "Warning" if len(names) >= self.warning_votes else "None"
            s.run = {x: s.run[x] + 1 if x == raw else 0 for x in LEVELS}
            n = s.run[raw]
            if raw == "None" and s.level != "None" and n >= self.clear:
                s.level, s.run["None"] = "None", 0
            elif raw == "Drift" and n >= self.confirm and (s.level != "Drift" or n % self.confirm == 0) or raw == "Warning" and n >= self.confirm and s.level == "None":
                s.level = raw
                if ready:
                    new, merged = self._event(s, raw, names)
        e = s.event or {}
        return (s.level, len(names), drifts, new, merged, e.get("id"), e.get("occurrences"))


@dataclass
class LinUcb:
    """Upper confidence bounds of linear rewards, with inverses kept up by rank-one updates; columns: context, arm, reward."""

    arms: int
    d: int
    alpha: float = 1.0
    out: str = "chosen int, scores array<double>"

    def init(self):
        return State(inv=[np.eye(self.d) for _ in range(self.arms)], b=[np.zeros(self.d) for _ in range(self.arms)])

    def scores(self, s, x: np.ndarray) -> list[float]:
        return [float(b @ inv @ x) + self.alpha * math.sqrt(max(0.0, float(x @ inv @ x))) for inv, b in zip(s.inv, s.b)]

    def update(self, s, arm: int, x: np.ndarray, reward: float) -> None:
        u = s.inv[arm] @ x
        s.inv[arm] = s.inv[arm] - np.outer(u, u) / (1 + x @ u)
        s.b[arm] = s.b[arm] + reward * x

    def step(self, s, row):
        x, r = vector(row.context, self.d), number(row.reward)
        if not 0 <= row.arm < self.arms:
            raise Reject("no such arm")
        scores = self.scores(s, x)
        self.update(s, row.arm, x, r)
        return (scores.index(max(scores)), scores)


@dataclass
class Replay:
    """A log of decisions and delayed rewards played against a bandit; a row is one event: decision before outcome at equal times.

    columns: kind (0 decision, 1 outcome), at, and the record: timestamp, decision_id, context, selected_arm, outcome_time, reward,
    generation, schema_hash, baseline_reward, optimal_reward, drift. Counters, rewards and the digest stand after each event.
    """

    bandit: LinUcb
    delay: int
    schema: str = ""
    out: str = (
        "reward double, regret double, baseline double, pulls array<int>, pending int, completed int, expired int, missing int, "
        "duplicate int, rejected int, generations int, drifts int, latency_mean double, latency_p95 bigint, digest string"
    )

    def init(self):
        return State(
            model=self.bandit.init(), generation=0, pending={}, done=set(), latencies=[], waited=0, reward=0.0, regret=0.0, baseline=0.0, pulls=[0] * self.bandit.arms,
            expired=0, missing=0, duplicate=0, rejected=0, generations=0, drifts=0, digest=0xCBF29CE484222325,
        )

    def _mix(self, s, row, mark: bytes) -> None:
        data = mark + struct.pack("<Q", row.timestamp) + int(row.decision_id).to_bytes(16, "little") + struct.pack("<QQ", row.selected_arm, row.generation)
        data += b"".join(struct.pack("<d", x) for x in row.context) + (b"" if missing(row.reward) else struct.pack("<d", row.reward))
        for byte in data:
            s.digest = (s.digest ^ byte) * 0x100000001B3 & (1 << 64) - 1

    def _decide(self, s, row) -> bool:
        if row.schema_hash != self.schema or row.generation < s.generation:
            return False
        if row.generation > s.generation:
            s.model, s.generation, s.generations = self.bandit.init(), row.generation, s.generations + 1
        if row.drift:
            s.model, s.drifts = self.bandit.init(), s.drifts + 1
        scores = self.bandit.scores(s.model, vector(row.context, self.bandit.d))
        if scores.index(max(scores)) != row.selected_arm:
            return False
        if row.decision_id not in s.pending and row.decision_id not in s.done:
            s.pending[row.decision_id] = (row.timestamp, row.timestamp + self.delay, row.generation, row.selected_arm, tuple(row.context))
            self._mix(s, row, b"d")
            s.missing += missing(row.outcome_time)
        return True

    def _reward(self, s, row) -> bool:
        if missing(row.reward) or row.generation != s.generation:
            return False
        if row.decision_id in s.done:
            s.duplicate += 1
            return True
        if row.decision_id not in s.pending:
            return False
        start, end, generation, arm, context = s.pending[row.decision_id]
        if row.outcome_time > end:
            gone = [k for k, v in s.pending.items() if v[1] < row.outcome_time]
            s.expired += len(gone)
            for k in gone:
                del s.pending[k]
            return True
        if row.outcome_time < start or row.generation != generation or row.selected_arm != arm:
            return False
        del s.pending[row.decision_id]
        s.done.add(row.decision_id)
        self.bandit.update(s.model, arm, np.array(context), row.reward)
        s.reward += row.reward
        s.baseline += 0.0 if missing(row.baseline_reward) else row.baseline_reward
        s.regret += 0.0 if missing(row.optimal_reward) else max(0.0, row.optimal_reward - row.reward)
        s.pulls[arm] += 1
        waited = int(row.outcome_time) - int(row.timestamp)
        bisect.insort(s.latencies, waited)
        s.waited += waited
        self._mix(s, row, b"o")
        return True

    def step(self, s, row):
        s.rejected += not (self._reward(s, row) if row.kind else self._decide(s, row))
        lag = s.latencies
        return (
            s.reward, s.regret, s.baseline, list(s.pulls), len(s.pending), len(s.done), s.expired, s.missing, s.duplicate, s.rejected, s.generations, s.drifts,
            s.waited / len(lag) if lag else None, lag[-((len(lag) - 1) * -95 // 100)] if lag else None, f"{s.digest:016x}",
        )


def missing(x) -> bool:
    return x is None or x != x
