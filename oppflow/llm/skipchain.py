"""A skip-chain conditional random field in numpy.

Potentials: each token's own features and those of the two tokens on either
side, transitions between neighbouring labels, and skip edges between tokens of
one document that read the same or nearly so, which reward equal kinds of label.
All are fitted together: the chains by their likelihood, the rewards of the skip
edges by the same likelihood given the label at the other end of each edge.
Inference is loopy message passing: the chains are summed exactly forward and
backward, the skip edges send messages between rounds.

All features of a token depend on its type (its text, or its shape for numbers),
so the scores of a type are summed once and a batch is scored by gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions from which a token's type speaks to a label: itself, one and two to the left, one and two to the right.
OFFSETS = (0, -1, -2, 1, 2)
#: Rounds of messages over the skip edges.
ROUNDS = 3
#: Sorts of skip edges: tokens that read the same, and nearly so.
SORTS = ("same", "similar")


def kind_numbers(labels: list[str]) -> np.ndarray:
    kinds: dict[str, int] = {}
    return np.array([kinds.setdefault(label[2:], len(kinds)) for label in labels])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray  # offsets x features x labels
    step: np.ndarray  # labels x labels
    first: np.ndarray  # labels
    agree: np.ndarray  # sorts of skip edges x kinds of label: reward of equal kinds, not negative

    @property
    def kind_of(self) -> np.ndarray:
        """Number of the kind of each label (the part after the dash), none being 0."""
        return kind_numbers(self.labels)

    def type_scores(self, features: list[str]) -> np.ndarray:
        """offsets x labels of a type."""
        ids = [self.features[f] for f in features if f in self.features]
        return self.weights[:, ids].sum(axis=1) if ids else np.zeros((self.weights.shape[0], self.weights.shape[2]), dtype=self.weights.dtype)


def marginals(u: np.ndarray, real: np.ndarray, step: np.ndarray, first: np.ndarray, steps: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of each label at each token, log normaliser of all chains together, expected transitions (if steps).

    Sums are kept in proportion at every step, so they are products of matrices instead of sums of exponentials.
    """
    chains, n, width = u.shape
    top = u.max(axis=2, keepdims=True)
    e, a = np.exp(u - top), np.exp(np.clip(step, -30, 30))
    fore, back, scale = np.empty_like(e), np.ones_like(e), np.ones((chains, n), dtype=u.dtype)
    fore[:, 0] = e[:, 0] * np.exp(np.clip(first, -30, 30))
    scale[:, 0] = fore[:, 0].sum(axis=1)
    fore[:, 0] /= scale[:, 0, None]
    every = real.all(axis=0).tolist()  # positions that no chain ends before
    for t in range(1, n):
        new = (fore[:, t - 1] @ a) * e[:, t]
        c = np.maximum(new.sum(axis=1), 1e-30)
        if every[t]:
            scale[:, t] = c
            np.divide(new, c[:, None], out=fore[:, t])
        else:
            go = real[:, t]
            scale[:, t] = np.where(go, c, 1)
            fore[:, t] = np.where(go[:, None], new / c[:, None], fore[:, t - 1])
    pairs = np.zeros((width, width))
    for t in range(n - 2, -1, -1):
        from_next = e[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        if not every[t + 1]:
            go = real[:, t + 1, None]
            from_next = np.where(go, from_next, 0)
            back[:, t] = np.where(go, from_next @ a.T, 1)
        else:
            np.matmul(from_next, a.T, out=back[:, t])
        if steps:
            pairs += fore[:, t].T @ from_next
    p = fore * back
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-30)
    return p, float(np.log(scale[real]).sum(dtype=np.float64) + top[real].sum(dtype=np.float64)), pairs * a


def buckets(lengths: np.ndarray, cells: int = 40_000) -> list[np.ndarray]:
    """Chains in groups of like length, so that padding stays small."""
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    out, at = [], 0
    while at < len(order):
        least = int(sorted_[at])
        longest = int(1.25 * least + 4)
        end = int(np.searchsorted(sorted_, longest, side="right"))
        # as many as fit in the cells at the length of the last of them
        while end > at + 1 and int(sorted_[end - 1]) * (end - at) > cells:
            end = at + max(1, min(end - at - 1, cells // max(1, int(sorted_[end - 1]))))
        out.append(order[at:end])
        at = end
    return out


def flat_unary(scores: np.ndarray, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """tokens x labels, for chains that stand one after another."""
    chain = np.repeat(np.arange(len(lengths)), lengths)
    out = scores[types, 0].copy()
    for k, o in enumerate(OFFSETS[1:], 1):
        at = np.arange(len(types)) + o
        fit = (at >= 0) & (at < len(types))
        fit[fit] &= chain[at[fit]] == chain[fit]
        out[fit] += scores[types[at[fit]], k]
    return out


def chain_marginals(field: Field, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """tokens x labels: the probabilities by the chains alone."""
    starts = np.cumsum(lengths) - lengths
    out = np.zeros_like(u)
    for g in buckets(lengths):
        at, real = _cells(starts[g], lengths[g])
        out[at[real]] = marginals(u[at], real, field.step, field.first, False)[0][real]
    return out


def passed(field: Field, u: np.ndarray, lengths: np.ndarray, edges: np.ndarray, sorts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The unaries with the messages of the skip edges added. edges: pairs of token positions; sorts: the sort of each."""
    if not len(edges):
        return u
    starts = np.cumsum(lengths) - lengths
    kind = field.kind_of
    agree = np.where(kind[:, None] == kind[None, :], field.agree[:, kind][:, :, None], 0).astype(u.dtype)[sorts]
    messages = np.zeros((2, len(edges), u.shape[1]), dtype=u.dtype)
    chain = np.repeat(np.arange(len(lengths)), lengths)
    linked = np.unique(chain[edges.ravel()])  # only chains with edges change
    groups = [linked[g] for g in buckets(lengths[linked])]
    belief = np.zeros_like(u)

    def summed() -> np.ndarray:
        total = u.copy()
        for side in (0, 1):
            np.add.at(total, edges[:, side], messages[side])
        return total

    for _ in range(rounds):
        total = summed()
        for g in groups:
            at, real = _cells(starts[g], lengths[g])
            belief[at[real]] = np.log(marginals(total[at], real, field.step, field.first, False)[0][real] + 1e-12)
        sent = [belief[edges[:, 1 - side]] - messages[1 - side] for side in (0, 1)]
        for side in (0, 1):
            got = log_sum(sent[side][:, :, None] + agree, 1)
            messages[side] = 0.5 * messages[side] + 0.5 * (got - got.max(axis=1, keepdims=True))
    return summed()


def best_labels(field: Field, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label of each token in the best sequence of each chain."""
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(u), dtype=np.int16)
    for g in buckets(lengths):
        at, real = _cells(starts[g], lengths[g])
        out[at[real]] = viterbi(u[at], real, field.step, field.first)[real]
    return out


def decode(field: Field, u: np.ndarray, lengths: np.ndarray, edges: np.ndarray, sorts: np.ndarray) -> np.ndarray:
    """Label of each token: the best sequence by the unaries and the messages of the skip edges."""
    return best_labels(field, passed(field, u, lengths, edges, sorts), lengths)


def _cells(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    longest = int(lengths.max(initial=0))
    real = np.arange(longest)[None, :] < lengths[:, None]
    return np.where(real, np.arange(longest)[None, :] + starts[:, None], 0), real


def viterbi(u: np.ndarray, real: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    chains, n, width = u.shape
    best, come = u[:, 0] + first if n else np.zeros((chains, width)), np.zeros((chains, n, width), dtype=np.int16)
    for t in range(1, n):
        options = best[:, :, None] + step
        come[:, t] = options.argmax(axis=1)
        new = options.max(axis=1) + u[:, t]
        go = real[:, t, None]
        come[:, t] = np.where(go, come[:, t], np.arange(width))
        best = np.where(go, new, best)
    out = np.zeros((chains, n), dtype=np.int16)
    label = best.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        out[:, t] = label
        label = come[np.arange(chains), t, label]
    return out


def fit(
    chains: list[list[int]],
    gold: list[list[int]],
    type_features: list[list[str]],
    labels: list[str],
    edges: list[tuple[int, int, int, int, int]] = (),
    rounds: int = 60,
    shrink: float = 0.02,
    shrink_around: float = 0.15,
    shrink_skips: float = 0.3,
    least: int = 3,
) -> Field:
    """Fit all potentials by L-BFGS. chains: types of the tokens; gold: labels; edges: chain, position, chain, position, sort.

    The likelihood of each chain is exact; a skip edge enters it at either end with the gold label of the other one.
    shrink: weight of the squares of the weights of a token's own features and of transitions; shrink_around: of those
    of its neighbours, which are held smaller, as texts vary more than items do; shrink_skips: of the rewards of skip
    edges, which the known label at the other end would make too large. Features of fewer than least tokens have none.
    """
    uses = np.bincount(np.concatenate([np.asarray(c, dtype=np.int64) for c in chains]), minlength=len(type_features)) if chains else np.zeros(len(type_features), dtype=int)
    seen: dict[str, int] = {}
    for features, n in zip(type_features, uses.tolist()):
        for f in features:
            seen[f] = seen.get(f, 0) + n
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    width, types_n, wide = len(labels), len(type_features), max(1, len(index))
    kind = kind_numbers(labels)
    kinds = int(kind.max()) + 1
    # of each type the numbers of its features, filled up with the number of none
    ids = [[index[f] for f in features if f in index] for features in type_features] + [[]]
    of_type = np.full((types_n + 1, max(map(len, ids)) or 1), wide)
    for i, own in enumerate(ids):
        of_type[i, : len(own)] = own
    sizes = (len(OFFSETS) * wide * width, width * width, width, len(SORTS) * kinds)
    at_step, at_first, at_agree = sizes[0], sizes[0] + sizes[1], sizes[0] + sizes[1] + sizes[2]
    total = sum(len(c) for c in chains)
    penalty = np.concatenate([np.full(wide * width, shrink), np.full((len(OFFSETS) - 1) * wide * width, shrink_around), np.full(sizes[1] + sizes[2], shrink), np.full(sizes[3], shrink_skips)]).astype(np.float32)
    lengths = np.array([len(c) for c in chains], dtype=np.int64)
    ends: dict[int, list[tuple[int, int]]] = {}  # of a chain: position, sort and kind at the other end
    for c, i, d, j, sort in edges:
        ends.setdefault(c, []).append((i, sort * kinds + int(kind[gold[d][j]])))
        ends.setdefault(d, []).append((j, sort * kinds + int(kind[gold[c][i]])))
    groups = []
    for g in buckets(lengths, 60_000):
        n = int(lengths[g].max())
        types, truth, real = np.full((len(g), n), types_n), np.zeros((len(g), n), dtype=np.int64), np.zeros((len(g), n), dtype=bool)
        skips = []
        for k, c in enumerate(g):
            types[k, : lengths[c]], truth[k, : lengths[c]], real[k, : lengths[c]] = chains[c], gold[c], True
            skips += [(k, i, way) for i, way in ends.get(int(c), ())]
        groups.append((np.pad(types, ((0, 0), (2, 2)), constant_values=types_n), truth, real, np.array(skips, dtype=np.int64).reshape(-1, 3)))
    of_kind = (kind[None, :] == np.arange(kinds)[:, None]).astype(np.float32)  # kinds x labels

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, step, first, agree = x[:at_step].reshape(len(OFFSETS), wide, width), x[at_step:at_first].reshape(width, width), x[at_first:at_agree], x[at_agree:]
        w = np.concatenate([w, np.zeros((len(OFFSETS), 1, width), dtype=w.dtype)], axis=1)
        scores = [w[o][of_type].sum(axis=1) for o in range(len(OFFSETS))]
        by_type = np.zeros((len(OFFSETS), types_n + 1, width))
        g_step, g_first, g_agree, loss = np.zeros((width, width)), np.zeros(width), np.zeros(sizes[3]), 0.0
        for types, truth, real, skips in groups:
            n = real.shape[1]
            u = sum(scores[k][types[:, 2 + o : 2 + o + n]] for k, o in enumerate(OFFSETS))
            if len(skips):
                rewards = of_kind[skips[:, 2] % kinds] * agree[skips[:, 2]][:, None]
                np.add.at(u, (skips[:, 0], skips[:, 1]), rewards)
            p, z, pairs = marginals(u, real, step, first)
            loss += z - float(np.take_along_axis(u, truth[:, :, None], 2)[:, :, 0][real].sum(dtype=np.float64)) - float(first[truth[:, 0]].sum(dtype=np.float64))
            off = p.copy()
            np.put_along_axis(off, truth[:, :, None], np.take_along_axis(off, truth[:, :, None], 2) - 1, 2)
            if len(skips):
                g_agree += np.bincount(skips[:, 2], (off[skips[:, 0], skips[:, 1]] * of_kind[skips[:, 2] % kinds]).sum(axis=1), sizes[3])
            off = off[real]
            for k, o in enumerate(OFFSETS):
                at = types[:, 2 + o : 2 + o + n][real]
                for label in range(width):
                    by_type[k, :, label] += np.bincount(at, off[:, label], types_n + 1)
            a, b = truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]
            seen_pairs = np.bincount(a * width + b, minlength=width * width).reshape(width, width)
            loss -= float((seen_pairs * step).sum(dtype=np.float64))
            g_step += pairs - seen_pairs
            g_first += p[:, 0].sum(axis=0) - np.bincount(truth[:, 0], minlength=width)
        flat, each = of_type.ravel(), of_type.shape[1]
        g_w = np.stack([np.stack([np.bincount(flat, np.repeat(by_type[k, :, label], each), wide + 1)[:wide] for label in range(width)], axis=1) for k in range(len(OFFSETS))])
        grad = np.concatenate([g_w.ravel(), g_step.ravel(), g_first, g_agree]).astype(np.float32)
        return loss + 0.5 * float((penalty * x * x).sum(dtype=np.float64)), grad + penalty * x

    x = descend(objective, np.zeros(sum(sizes), dtype=np.float32), rounds) if total else np.zeros(sum(sizes), dtype=np.float32)
    return Field(
        labels, index, x[:at_step].reshape(len(OFFSETS), wide, width), x[at_step:at_first].reshape(width, width), x[at_first:at_agree],
        np.maximum(x[at_agree:].reshape(len(SORTS), kinds), 0),
    )


def descend(objective, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, grad = objective(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = grad.astype(np.float64), []
        for s, y, r in reversed(past):
            k = r * float(s @ q)
            kept.append(k)
            q = q - k * y
        if past:
            s, y, _ = past[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= max(1.0, float(np.abs(q).sum())) / 10
        for (s, y, r), k in zip(past, reversed(kept)):
            q = q + s * (k - r * float(y @ q))
        slope, size = -float(grad @ q), 1.0
        for _ in range(12):
            trial = (x - size * q).astype(x.dtype)
            new, new_grad = objective(trial)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = (trial - x).astype(np.float64), (new_grad - grad).astype(np.float64)
        if float(s @ y) > 1e-10:
            past = [*past, (s, y, 1 / float(s @ y))][-memory:]
        done = value - new < 1e-5 * max(1.0, abs(new))
        x, value, grad = trial, new, new_grad
        if done:
            break
    return x
