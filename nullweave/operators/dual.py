"""One convex dual for every fit, and its minimiser.

All fitted models minimise F(theta) = sum over free pairs of ln Z_ij - theta . targets,
with ln q_ij = a_i + b_j - gamma d_ij and, for zero-inflated laws, occupation
odds ln v_ij = ln lambda, or n_i + o_j.  The gradient is expected minus target.

Nodes of equal targets have equal multipliers, so such nodes are one variable
with a multiplicity (`Problem.collapsed`): sums, gradients and steps are those of
all nodes.  Pairs are evaluated in row blocks: by numpy on the driver while the
pair count is small, else by one Spark job an iteration (`range(blocks).mapInArrow`),
whose partial sums are one row a partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from ..functions import kernels as K
from ..schema import Family

#: Pairs up to which the driver evaluates alone.
LOCAL_PAIRS = 1 << 25
#: Variables up to which steps use all second derivatives (72 MB), and most such steps.
NEWTON, NEWTON_STEPS = 3000, 200
#: Logarithms of multipliers stay within these bounds.
BOUND = 46.0
#: -ln of the multiplier that stands for 0 where every weight of a node is 1.
LIMIT = 18.0
#: Iterations without a tenth less of residual after which a fit ends.
STALLED = 1000


@dataclass
class Problem:
    """Targets and support of a fit over n nodes; the dual's variables are laid out by `slices`."""

    family: Family
    layers: int
    self_loops: bool
    s_out: np.ndarray
    s_in: np.ndarray
    k_out: np.ndarray | None = None  # zero-inflated by node odds
    k_in: np.ndarray | None = None
    edges: float | None = None  # zero-inflated by one lambda
    cost: float | None = None  # with gamma
    coordinates: np.ndarray | None = None
    frozen: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
    bernoulli: bool = False  # degrees alone: k_out, k_in through odds a_i + b_j
    signed_gamma: bool = False
    scale: float = 1.0  # of distances
    many: tuple[np.ndarray, np.ndarray] | None = None  # nodes that a row and a column stand for; targets above are of one of them

    def __post_init__(self):
        self.n = len(self.s_out)
        if self.cost is not None:
            c = self.coordinates
            spread = np.abs(c - c.mean(axis=0)).sum(axis=1).mean()
            self.scale = float(spread) or 1.0
        names = ["a", "b"] + (["n", "o"] if self.k_out is not None and not self.bernoulli else []) + (["lam"] if self.edges is not None else []) + (["gamma"] if self.cost is not None else [])
        self.slices, at = {}, 0
        for name in names:
            size = 1 if name in ("lam", "gamma") else self.n
            self.slices[name] = slice(at, at + size)
            at += size
        self.size = at
        out, incoming = (self.k_out, self.k_in) if self.bernoulli else (self.s_out, self.s_in)
        self.nodes = np.ones(at)  # that a variable belongs to
        if self.many is not None:
            for name, side in (("a", 0), ("b", 1), ("n", 0), ("o", 1)):
                if name in self.slices:
                    self.nodes[self.slices[name]] = self.many[side]
        self.targets = np.zeros(at)
        self.targets[self.slices["a"]], self.targets[self.slices["b"]] = out, incoming
        if "n" in self.slices:
            self.targets[self.slices["n"]], self.targets[self.slices["o"]] = self.k_out, self.k_in
        if self.edges is not None:
            self.targets[self.slices["lam"]] = self.edges
        if self.cost is not None:
            self.targets[self.slices["gamma"]] = -self.cost / self.scale
        self.targets *= self.nodes
        # a node without strength has no pairs on that side
        self.rows, self.cols = np.flatnonzero(out > 0), np.flatnonzero(incoming > 0)
        self.inflated = "n" in self.slices or self.edges is not None
        by_row: dict[int, list[int]] = {}
        for i, j in zip(*self.frozen):
            by_row.setdefault(int(i), []).append(int(j))
        self._frozen = {i: np.array(j) for i, j in by_row.items()}
        self.full = self.edges is not None and abs(self.edges - self.open_pairs()) <= 1e-9 * self.edges

    def open_pairs(self) -> float:
        """Free pairs of nodes that may hold an edge."""
        out, incoming = (np.ones(self.n), np.ones(self.n)) if self.many is None else self.many
        pairs = out[self.rows].sum() * incoming[self.cols].sum()
        if not self.self_loops:
            pairs -= out[np.intersect1d(self.rows, self.cols)].sum()
        held = {(i, j) for i, js in self._frozen.items() for j in js.tolist() if self.self_loops or i != j}
        rows, cols = set(self.rows.tolist()), set(self.cols.tolist())
        return float(pairs) - sum(i in rows and j in cols for i, j in held)

    def collapsed(self) -> tuple[Problem, np.ndarray]:
        """The problem over classes of nodes with equal targets, and the place of each variable in it; itself where pairs differ by more than targets."""
        if self.cost is not None or len(self.frozen[0]) or self.many is not None:
            return self, np.arange(self.size)
        degrees = self.k_out is not None
        sides = [np.stack([self.s_out, self.k_out] if degrees else [self.s_out]), np.stack([self.s_in, self.k_in] if degrees else [self.s_in])]
        if not self.self_loops:  # rows and columns of a class leave out the same pairs
            sides = [np.concatenate(sides)] * 2
        (first, of, many), (first_in, of_in, many_in) = (np.unique(x, axis=1, return_index=True, return_inverse=True, return_counts=True)[1:] for x in sides)
        of, of_in, size = of.ravel(), of_in.ravel(), max(len(first), len(first_in))
        if size >= self.n:
            return self, np.arange(self.size)
        pad = lambda x, at: np.concatenate([x[at], np.zeros(size - len(at))])
        own = {"s_out": pad(self.s_out, first), "s_in": pad(self.s_in, first_in)}
        if degrees:
            own |= {"k_out": pad(self.k_out, first), "k_in": pad(self.k_in, first_in)}
        counts = tuple(np.concatenate([c, np.ones(size - len(c))]) for c in (many, many_in))
        small = Problem(self.family, self.layers, self.self_loops, edges=self.edges, bernoulli=self.bernoulli, many=counts, **own)
        place = np.zeros(self.size, np.int64)
        for name, at in self.slices.items():
            place[at] = small.slices[name].start + (0 if name == "lam" else of if name in ("a", "n") else of_in)
        return small, place

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        c = self.coordinates
        return np.hypot(c[i, 0][:, None] - c[j, 0], c[i, 1][:, None] - c[j, 1])

    def free(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.ones((len(i), len(j)), bool)
        if not self.self_loops:
            ok &= i[:, None] != j if self.many is None else (i[:, None] != j) | (self.many[0][i] > 1)[:, None]
        for r, node in enumerate(i.tolist()):
            held = self._frozen.get(node)
            if held is not None:
                ok[r] &= ~np.isin(j, held)
        return ok

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of nodes that each pair of classes stands for."""
        out = self.many[0][i][:, None] * self.many[1][j]
        return out if self.self_loops else out - np.where(i[:, None] == j, self.many[0][i][:, None], 0)

    def pair_terms(self, theta: np.ndarray, i: np.ndarray):
        """(ln Z, E[t] (or pi of Bernoulli pairs), pi, d / scale) of the free pairs of rows i with all active columns; 0 elsewhere."""
        j, s = self.cols, self.slices
        log_q = theta[s["a"]][i][:, None] + theta[s["b"]][j]
        ok = self.free(i, j)
        d = None
        if self.cost is not None:
            d = self.distances(i, j) / self.scale
            log_q = log_q - theta[s["gamma"]] * d
        log_q = np.where(ok, log_q, -700.0)
        if self.bernoulli:
            pi = np.where(ok, 1 / (1 + np.exp(-log_q)), 0)
            return np.where(ok, np.logaddexp(0, log_q), 0), pi, pi, d
        u = K.exponent(self.family, self.layers, log_q)
        if not self.inflated:
            return np.where(ok, u, 0), np.where(ok, K.mean(self.family, self.layers, log_q), 0), np.where(ok, -np.expm1(-u), 0), d
        odds = theta[s["lam"]] if self.edges is not None else theta[s["n"]][i][:, None] + theta[s["o"]][j]
        g = odds + K.log_growth(u)
        z = np.logaddexp(0, g)
        pi = np.exp(g - z)
        return np.where(ok, z, 0), np.where(ok, pi * K.positive_mean(self.family, self.layers, log_q), 0), np.where(ok, pi, 0), d

    def feasible(self, theta: np.ndarray) -> bool:
        if self.family != Family.W or self.bernoulli or not len(self.rows) or not len(self.cols):
            return True
        s = self.slices
        a, b = theta[s["a"]][self.rows], theta[s["b"]][self.cols]
        if a.max() + b.max() < -1e-12:
            return True
        if self.self_loops and self.cost is None and not len(self.frozen[0]):
            return False
        # the largest sum is not allowed: look at the pairs that exist
        for k in range(0, len(self.rows), 256):
            i = self.rows[k : k + 256]
            q = theta[s["a"]][i][:, None] + b
            if self.cost is not None:
                q = q - theta[s["gamma"]] * self.distances(i, self.cols) / self.scale
            if (q[self.free(i, self.cols)] >= -1e-12).any():
                return False
        return True

    def block(self, theta: np.ndarray, i: np.ndarray) -> np.ndarray:
        """[sum of ln Z, expectations by variable] of a block of rows."""
        out, s, j = np.zeros(self.size + 1), self.slices, self.cols
        z, e, pi, d = self.pair_terms(theta, i)
        if self.many is not None:
            pairs = self.pairs(i, j)
            z, e, pi = z * pairs, e * pairs, pi * pairs
        out[0] = z.sum()
        grad = out[1:]
        grad[s["a"]][i], grad[s["b"]][j] = e.sum(axis=1), e.sum(axis=0)
        if "n" in s:
            grad[s["n"]][i], grad[s["o"]][j] = pi.sum(axis=1), pi.sum(axis=0)
        if self.edges is not None:
            grad[s["lam"]] = pi.sum()
        if self.cost is not None:
            grad[s["gamma"]] = -(e * d).sum()
        return out

    def curvature(self, theta: np.ndarray) -> np.ndarray:
        """Second derivatives of the dual, size x size; without cost."""
        s, j, h = self.slices, self.cols, np.zeros((self.size, self.size))
        step = max(1, (1 << 18) // max(1, len(j)))
        for k in range(0, len(self.rows), step):
            i = self.rows[k : k + step]
            ok = self.free(i, j)
            log_q = np.where(ok, theta[s["a"]][i][:, None] + theta[s["b"]][j], -700.0)
            _, _, pi, _ = self.pair_terms(theta, i)
            pairs = ok if self.many is None else ok * self.pairs(i, j)
            both = alone = None
            if self.bernoulli:
                second = pi * (1 - pi) * pairs
            elif not self.inflated:
                second = K.variance(self.family, self.layers, log_q) * pairs
            else:
                mu, alone = K.positive_mean(self.family, self.layers, log_q), pi * (1 - pi) * pairs
                both = alone * mu
                second = both * mu + pi * K.positive_variance(self.family, self.layers, log_q) * pairs

            def add(rows, cols, m):
                h[np.ix_(rows, cols)] += m
                h[np.ix_(cols, rows)] += m.T

            def diagonal(rows, m):
                h[rows, rows] += m

            a, b = s["a"].start + i, s["b"].start + j
            diagonal(a, second.sum(axis=1))
            diagonal(b, second.sum(axis=0))
            add(a, b, second)
            if both is None:
                continue
            if self.edges is not None:
                lam = np.array([s["lam"].start])
                diagonal(lam, alone.sum())
                add(a, lam, both.sum(axis=1)[:, None])
                add(b, lam, both.sum(axis=0)[:, None])
                continue
            n, o = s["n"].start + i, s["o"].start + j
            diagonal(n, alone.sum(axis=1))
            diagonal(o, alone.sum(axis=0))
            add(n, o, alone)
            for rows, cols, m in ((a, n, both.sum(axis=1)), (b, o, both.sum(axis=0))):
                h[rows, cols] += m
                h[cols, rows] += m
            add(a, o, both)
            add(n, b, both)
        return h

    def local(self, theta: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 20) // max(1, len(self.cols)))
        return sum((self.block(theta, self.rows[k : k + step]) for k in range(0, len(self.rows), step)), np.zeros(self.size + 1))

    def distributed(self, spark) -> Callable[[np.ndarray], np.ndarray]:
        """Evaluates by Spark: each task works off row blocks and returns one row of partial sums."""
        step = max(1, (1 << 20) // max(1, len(self.cols)))
        count = -(-len(self.rows) // step)
        shared = spark.sparkContext.broadcast(self)

        def evaluate(theta: np.ndarray) -> np.ndarray:
            def run(batches):
                import pyarrow as pa

                p, total = shared.value, None
                for batch in batches:
                    for k in batch.column("id").to_pylist():
                        part = p.block(theta, p.rows[k * step : (k + 1) * step])
                        total = part if total is None else total + part
                if total is not None:
                    yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

            tasks = min(count, 2 * spark.sparkContext.defaultParallelism)
            got = spark.range(0, count, 1, tasks).mapInArrow(run, "sums binary").collect()
            return sum((np.frombuffer(r[0]) for r in got), np.zeros(self.size + 1))

        return evaluate

    def evaluator(self, spark=None) -> Callable[[np.ndarray], np.ndarray]:
        if spark is not None and len(self.rows) * len(self.cols) > LOCAL_PAIRS:
            return self.distributed(spark)
        return self.local

    def start(self) -> np.ndarray:
        s, theta = self.slices, np.full(self.size, 0.0)
        out, incoming = (self.targets / self.nodes)[s["a"]], (self.targets / self.nodes)[s["b"]]
        total = max(self.targets[s["a"]].sum(), 1e-300)
        with np.errstate(divide="ignore"):
            a, b = np.log(out / np.sqrt(total)), np.log(incoming / np.sqrt(total))
        if self.family != Family.ME and not self.bernoulli:
            a, b = a - np.log(self.layers) / 2, b - np.log(self.layers) / 2
        if self.family == Family.W and not self.bernoulli:  # x / (1 + x) keeps every q below 1
            a, b = a - np.logaddexp(0, a), b - np.logaddexp(0, b)
            a, b = np.minimum(a, -1e-3), np.minimum(b, -1e-3)
        theta[s["a"]], theta[s["b"]] = np.where(out > 0, a, -BOUND), np.where(incoming > 0, b, -BOUND)
        if "n" in s:
            t = max(self.targets[s["n"]].sum(), 1e-300)
            with np.errstate(divide="ignore"):
                theta[s["n"]] = np.where(self.k_out > 0, np.log(self.k_out / np.sqrt(t)), -BOUND)
                theta[s["o"]] = np.where(self.k_in > 0, np.log(self.k_in / np.sqrt(t)), -BOUND)
        return theta


@dataclass
class Solution:
    theta: np.ndarray
    objective: float
    expected: np.ndarray
    iterations: int
    converged: bool
    residual: float  # largest |expected - target| over the largest target


def _ready(p: Problem, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first point, the variables that move, and what residuals are measured by."""
    theta = p.start() if start is None else start.copy()
    moves = np.abs(p.targets) > 0
    moves[: 2 * p.n] = False
    moves[p.slices["a"]] = p.targets[p.slices["a"]] > 0
    moves[p.slices["b"]] = p.targets[p.slices["b"]] > 0
    if p.cost is not None:
        moves[p.slices["gamma"]] = True
    if "n" in p.slices:  # a node all of whose weights are 1: its multiplier's limit is 0, its odds take over
        for side, odds, s, k in (("a", "n", p.s_out, p.k_out), ("b", "o", p.s_in, p.k_in)):
            ones = (k > 0) & (s - k <= 1e-9 * np.maximum(s, 1))
            if start is None:
                theta[p.slices[side]][ones] = -LIMIT
                theta[p.slices[odds]][ones] += LIMIT
            moves[p.slices[side]] &= ~ones
    if p.full:  # every pair holds an edge: lambda's limit is infinite
        theta[p.slices["lam"]], moves[p.slices["lam"]] = BOUND, False
    strengths = np.zeros(p.size, bool)
    strengths[: 2 * p.n] = True
    each = p.targets / p.nodes
    largest = {True: max(each[strengths].max(initial=0), 1e-300), False: max(np.abs(each[~strengths]).max(initial=0), 1e-300)}
    unit = np.where(strengths, largest[True], largest[False]) * p.nodes
    if p.cost is not None:
        unit[p.slices["gamma"]] = max(abs(p.targets[p.slices["gamma"]][0]), 1e-300)
    return theta, moves, unit


def newton(p: Problem, evaluate: Callable[[np.ndarray], np.ndarray], tolerance: float, iterations: int, start: np.ndarray | None = None) -> Solution:
    """Newton steps by the whole matrix of second derivatives, backtracking that stays feasible; for few variables and no cost."""
    theta, moves, unit = _ready(p, start)

    def value(t):
        got = evaluate(t)
        return got[0] - t[moves] @ p.targets[moves], np.where(moves, got[1:] - p.targets, 0.0), got[1:]

    f, g, expected = value(theta)
    best, count = float(np.abs(g / unit).max(initial=0)), 0
    for count in range(1, iterations + 1):
        if best <= tolerance:
            break
        on = np.flatnonzero(moves & ((np.abs(theta) < BOUND) | (theta * g > 0)))  # not those that a bound holds
        h = p.curvature(theta)[np.ix_(on, on)]
        floor = 1e-9 * np.maximum(np.abs(expected), np.abs(p.targets))[on]
        root = 1 / np.sqrt(np.maximum(np.maximum(h.diagonal(), floor), 1e-300))
        h *= root[:, None] * root
        h[np.arange(len(on)), np.arange(len(on))] += 1e-9  # sums a + b and n + o alone matter
        d = np.zeros(p.size)
        d[on] = -root * np.linalg.solve(h, root * g[on])
        slope = g @ d
        if not slope < 0:
            break
        step = min(1.0, 4.0 / max(np.abs(d).max(), 1e-300))
        for _ in range(40):
            new = np.clip(theta + step * d, -BOUND, BOUND)
            if p.feasible(new):
                fn, gn, en = value(new)
                size = float(np.abs(gn / unit).max(initial=0))
                if np.isfinite(fn) and (fn <= f + 1e-4 * step * slope or abs(fn - f) <= 1e-13 * abs(f) and size < best):
                    break
            step /= 2
        else:
            break
        theta, f, g, expected, best = new, fn, gn, en, size
    return Solution(theta, float(f), expected, count, best <= tolerance, best)


def minimise(p: Problem, evaluate: Callable[[np.ndarray], np.ndarray], tolerance: float, iterations: int, start: np.ndarray | None = None) -> Solution:
    """Limited-memory BFGS with a diagonal first scaling and backtracking that stays feasible."""
    theta, moves, unit = _ready(p, start)

    def value(t):
        got = evaluate(t)
        return got[0] - t[moves] @ p.targets[moves], np.where(moves, got[1:] - p.targets, 0.0), got[1:]

    def blocked(t, g):
        """Gamma at 0 that would fall below it."""
        if p.cost is None or p.signed_gamma:
            return g
        g = g.copy()
        at = p.slices["gamma"]
        if t[at][0] <= 0 and g[at][0] > 0:
            g[at] = 0
        return g

    f, g, expected = value(theta)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    count, best, least, since = 0, np.inf, np.inf, 0
    for count in range(1, iterations + 1):
        g = blocked(theta, g)
        best = float(np.abs(g / unit).max(initial=0))
        if best < 0.9 * least:
            least, since = best, count
        if best <= tolerance or count - since > STALLED:
            break
        diagonal = 1 / np.maximum(np.maximum(np.abs(expected), np.abs(p.targets)), 1e-12)
        d, alphas = g.copy(), []
        for s, y, r in reversed(history):
            alphas.append(r * (s @ d))
            d -= alphas[-1] * y
        if history:
            s, y, r = history[-1]
            d *= diagonal * ((s @ y) / max(y @ (diagonal * y), 1e-300))
        else:
            d *= diagonal
        for (s, y, r), al in zip(history, reversed(alphas)):
            d += (al - r * (y @ d)) * s
        d = np.where(moves, -np.where(g == 0, 0, d) if p.cost is not None and not p.signed_gamma else -d, 0)
        slope = g @ d
        if slope >= 0:
            history, d = [], -diagonal * g
            slope = g @ d
        step = min(1.0, 4.0 / max(np.abs(d).max(), 1e-300))
        accepted = False
        for _ in range(40):
            new = np.clip(theta + step * d, -BOUND, BOUND)
            if p.cost is not None and not p.signed_gamma:
                new[p.slices["gamma"]] = np.maximum(new[p.slices["gamma"]], 0)
            if p.feasible(new):
                fn, gn, en = value(new)
                if np.isfinite(fn) and (fn <= f + 1e-4 * step * slope or abs(fn - f) <= 1e-13 * abs(f) and np.abs(gn / unit).max() <= best):
                    accepted = True
                    break
            step /= 2
        if not accepted:
            if not history:
                break
            history = []
            continue
        s, y = new - theta, gn - g
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            history = [*history[-11:], (s, y, 1 / (s @ y))]
        theta, f, g, expected = new, fn, gn, en
    best = float(np.abs(blocked(theta, g) / unit).max(initial=0))
    return Solution(theta, float(f), expected, count, best <= tolerance, best)


def solve(p: Problem, spark, tolerance: float, iterations: int, start: np.ndarray | None = None) -> Solution:
    """The minimiser over all nodes, by way of their classes."""
    small, place = p.collapsed()
    first = None
    if start is not None:
        first = np.zeros(small.size)
        first[place] = start
    evaluate = small.evaluator(spark)
    s = None
    if small.cost is None and small.size <= NEWTON and len(small.rows) * len(small.cols) <= LOCAL_PAIRS:
        s = newton(small, evaluate, tolerance, min(iterations, NEWTON_STEPS), first)
    if s is None or not s.converged:
        slow = minimise(small, evaluate, tolerance, iterations, first)
        s = slow if s is None or slow.residual < s.residual else s
    return replace(s, theta=s.theta[place], expected=(s.expected / small.nodes)[place])
