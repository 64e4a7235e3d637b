"""Logistic mixing of bit predictors: the code of symbols as binary decisions, context tables, and the online mixer."""

from __future__ import annotations

import heapq

import numpy as np

from tessella.llm.common import mix, steps

END, BLANK, ESCAPE = 256, 32, 257
#: Places of a symbol and the one before it in their word (0: none), each plus one, as the number of a code tree's context.
PAIRS = 258 * 258
#: Predictors over contexts within a word: the last three symbols, the last five, all of them; the match comes after these.
CONTEXTS = 3
INPUTS = CONTEXTS + 1
#: Classes of trust in the longest context, and of the length of a match (0: none); together they choose the weights.
TRUST, MATCH = 4, 5
SETS = TRUST * MATCH
#: Cells of the refinement map over the mixed logit from -8 to 8.
CELLS = 33
SCALE = 16
#: Decisions after which weights and map move.
STEP = 8
#: How many times the rates of weights and map are added to these at a lane's first step; ``settle`` steps later half of it.
HASTE = 8, 4
#: What the match says for its predicted bit, by its class.
SAYS = np.array([0, 2, 3, 4, 5], dtype=np.float32)
_SALTS = mix(np.arange(1, CONTEXTS + 1, dtype=np.uint64))


def _tree(weights: list[float]) -> list[list[tuple[int, int]]]:
    """For each leaf of a Huffman tree its path of (node, outcome) from the root, which is node 0."""
    n = len(weights)
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    up, node = {}, n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node))
        node += 1
    out = []
    for k in range(n):
        path = []
        while k in up:
            k, outcome = up[k]
            path.append((node - 1 - k, outcome))
        out.append(path[::-1])
    return out


class Code:
    """Huffman trees of the symbols after each of the given contexts (the two symbols before, within the word).

    A tree has the symbols seen in its context, and an escape to the tree of all symbols, number 0.
    """

    def __init__(self, seen: dict[int, dict[int, int]]) -> None:
        every = dict.fromkeys(range(257), 0.5)
        for symbols in seen.values():
            for s, n in symbols.items():
                every[s] += n
        self.tree_of = np.zeros(PAIRS, np.int32)
        self.leaf_at = np.full((len(seen) + 1, 258), -1, np.int32)
        depth, nodes, outcomes, held = [], [], [], 0
        for k, (context, symbols) in enumerate([(None, every), *sorted(seen.items())]):
            if context is not None:
                self.tree_of[context] = k
                symbols = symbols | {ESCAPE: 0.5}
            for s, path in zip(sorted(symbols), _tree([symbols[s] for s in sorted(symbols)]), strict=True):
                self.leaf_at[k, s] = len(depth)
                depth.append(len(path))
                nodes += [held + x for x, _ in path]
                outcomes += [o for _, o in path]
            held += len(symbols)
        self.depth = np.array(depth, np.int64)
        self.first = np.cumsum(self.depth) - self.depth
        self.node, self.outcome = np.array(nodes, np.uint64), np.array(outcomes, np.uint8)
        # the number of decisions of every symbol in every tree, one tree after another
        known = self.leaf_at >= 0
        after = np.where(self.leaf_at[0] >= 0, self.depth[self.leaf_at[0]], 0)
        escape = np.where(self.leaf_at[:, ESCAPE] >= 0, self.depth[self.leaf_at[:, ESCAPE]], 0)
        self.length = np.where(known, self.depth[self.leaf_at], escape[:, None] + after).astype(np.int16).ravel()

    def leaves(self, tree: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the leaf in its own tree, or the escape, and the leaf in tree 0 after an escape, else -1."""
        leaf = self.leaf_at[tree, symbols]
        missed = leaf < 0
        return np.where(missed, self.leaf_at[tree, ESCAPE], leaf), np.where(missed, self.leaf_at[0, symbols], -1)

    def sizes(self, leaf: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The number of each symbol's decisions."""
        return self.depth[leaf] + np.where(after >= 0, self.depth[after], 0)

    def path(self, tree: int, symbol: int) -> np.ndarray:
        """The outcomes of one symbol's decisions."""
        leaf = self.leaf_at[tree, symbol]
        if leaf >= 0:
            return self.outcome[self.first[leaf] : self.first[leaf] + self.depth[leaf]]
        return np.concatenate([self.outcome[self.first[k] : self.first[k] + self.depth[k]] for k in (self.leaf_at[tree, ESCAPE], self.leaf_at[0, symbol])])


def since(n: int, starts: np.ndarray) -> np.ndarray:
    """For ``n`` symbols of words that begin at ``starts``: how many of its word stand before each."""
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    return np.arange(n) - np.maximum.accumulate(begin)


def _back(s: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(s), s.dtype)
    out[k:] = s[:-k]
    out[place < k] = 0
    return out


def pairs(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The context of the code's trees at each symbol."""
    s = symbols.astype(np.int64) + 1
    return _back(s, place, 1) + 258 * _back(s, place, 2)


def decisions(symbols: np.ndarray, starts: np.ndarray, bits: int, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words one after another: the outcome of each decision, its slot in each predictor's table (CONTEXTS x n), and each symbol's number of decisions.

    A word's contexts begin with the word, so equal words have equal decisions wherever they stand.
    """
    place = since(len(symbols), starts)
    leaf, after = code.leaves(code.tree_of[pairs(symbols, place)], symbols)
    size = code.sizes(leaf, after)
    if (after >= 0).any():
        both = np.stack([leaf, after], axis=1).ravel()
        leaf = both[both >= 0]
    at = steps(code.first[leaf], code.depth[leaf])
    s = symbols.astype(np.uint64) + np.uint64(1)
    context = np.zeros((CONTEXTS, len(symbols)), np.uint64)
    for k in range(1, 6):
        context[1] |= _back(s, place, k) << np.uint64(9 * (k - 1))
        if k == 3:
            context[0] = context[1]
    total = np.cumsum(mix(s << np.uint64(40) | place.astype(np.uint64)), dtype=np.uint64)
    before = np.append(np.uint64(0), total[:-1])
    context[2] = before - before[np.arange(len(symbols)) - place]
    node = code.node[at] * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((CONTEXTS, len(at)), np.int32)
    for m in range(CONTEXTS):
        own = np.repeat(mix(context[m] ^ _SALTS[m]), size)
        own += node
        own *= np.uint64(0xBF58476D1CE4E5B9)
        own >>= np.uint64(64 - bits)
        out[m] = own
    return code.outcome[at], out, size


def quantised(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a slot says, as a logit in sixteenths, and the class of its count."""
    logit = np.clip(np.rint(SCALE * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)
    return logit, np.digitize(zeros + ones, [2, 12, 100]).astype(np.uint8)


class Start:
    """Weights of every set, and the refinement map, that each lane begins with; constants, as of a mixer that learns online alone."""

    def __init__(self) -> None:
        self.weights = np.empty((SETS, INPUTS), np.float32)
        self.weights[:] = [0.4, 0.5, 0.5, 0.8]
        self.map = (1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))).astype(np.float32)


#: By the flag of a decision: its set, and what the match says.
_FLAG = np.arange(256)
_SET = (_FLAG >> 1 & 3) + TRUST * np.minimum(np.abs((_FLAG >> 3) - (MATCH - 1)), MATCH - 1)
_SAID = np.concatenate([-SAYS[:0:-1], SAYS, np.zeros(32 - 2 * MATCH + 1, np.float32)])[_FLAG >> 3]


#: What ``flagged`` adds to a decision's code where there is no match.
UNMATCHED = np.uint32((MATCH - 1) << 27)


def flagged(codes: np.ndarray, match: np.ndarray) -> None:
    """Add the class of the match to the last byte of each decision's code; negative if the match says 0."""
    codes.view(np.uint8).reshape(-1, 4)[:, 3] += (match + np.int8(MATCH - 1)).astype(np.uint8) << 3


def mixed(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, start: Start, rate: float, refine: float, settle: float = 0) -> tuple[np.ndarray, Start]:
    """Natural log-probability of each lane, a run of decisions, and the mean of what the lanes have learnt.

    ``codes`` has four bytes for each decision: three logits, and a flag of the outcome, the trust in the longest
    context and the class of the match. All lanes move on together by ``STEP`` decisions: the weights of the set of the
    first of these mix the logits, the refinement map takes a mixed logit to how often it came true, and the outcomes
    correct the weights and the map's cells before the next step; with ``settle``, by more in the first steps. A lane's
    result depends on its own decisions alone.
    """
    order = np.argsort(-size, kind="stable")
    at, left = begin[order].astype(np.intp), size[order]
    n = len(order)
    # every run of STEP codes as one item, so that a lane's next run is moved as a whole
    windows = np.ndarray(len(codes) + 1, f"V{4 * STEP}", np.concatenate([codes, np.zeros(STEP, np.uint32)]), strides=(4,))
    full = left // STEP
    alive = (n - np.searchsorted(full[::-1], np.arange(int(full[0]) if n else 0), side="right")).tolist()
    # a set's four weights lie together, so one 16-byte number moves them
    weights, table = np.tile(start.weights, (n, 1)).view(np.complex128).ravel(), np.tile(start.map, n)
    set_of, cell_of = np.arange(n, dtype=np.intp) * SETS, np.arange(n, dtype=np.intp) * CELLS
    total = np.zeros(n)
    space, whole = np.empty((INPUTS + 1) * STEP * n, np.float32), np.empty(STEP * n, np.int32)
    scale, half, one = (np.float32(v) for v in (1 / SCALE, 0.5, 1))
    more = settle / (settle + np.arange(len(alive))) if settle else np.zeros(len(alive))
    fast, finer = ((r * (1 + h * more)).astype(np.float32) for r, h in zip((rate, refine), HASTE, strict=True))
    for t in range(len(alive) + 1):
        last = t == len(alive)  # what is left of each lane: fewer than STEP decisions
        m = n if last else alive[t]
        here = at[:m]
        x = space[: (INPUTS + 1) * STEP * m].reshape(INPUTS + 1, STEP, m)
        tmp = x[INPUTS]
        row = np.ascontiguousarray(windows[here].view(np.int32).reshape(m, STEP).T)
        byte = whole[: STEP * m].reshape(STEP, m)
        np.right_shift(row.view(np.uint32), 24, out=byte.view(np.uint32))
        flag = byte.astype(np.intp)
        bit = np.bitwise_and(byte, 1).astype(np.float32)
        for k in range(CONTEXTS):
            np.left_shift(row, 24 - 8 * k, out=byte)
            np.right_shift(byte, 24, out=byte)
            x[k] = byte
        x[:CONTEXTS] *= scale
        _SAID.take(flag, out=x[CONTEXTS], mode="clip")
        own = _SET.take(flag[0])
        own += set_of[:m]
        moved = weights.take(own)
        w = moved.view(np.float32).reshape(m, INPUTS).T.copy()
        z = w[0] * x[0]
        for k in range(1, INPUTS):
            np.multiply(w[k], x[k], out=tmp)
            z += tmp
        np.minimum(z, np.float32(7.9), out=z)
        np.maximum(z, np.float32(-7.9), out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += one
        np.divide(one, p, out=p)
        z *= np.float32(2)
        z += np.float32(16.5)
        cell = z.astype(np.intp)
        cell += cell_of[:m]
        seen = table.take(cell)
        np.subtract(one, bit, out=tmp)
        half_of = p + seen
        half_of *= half
        tmp -= half_of
        np.abs(tmp, out=tmp)  # the probability of each outcome
        if last:
            tmp[np.arange(STEP)[:, None] >= (left % STEP)] = 1
            total += np.log(np.multiply.reduce(tmp, axis=0).astype(np.float64))
            break
        # a product of STEP probabilities stays far above the least float
        total[:m] += np.log(np.multiply.reduce(tmp, axis=0).astype(np.float64))
        np.subtract(bit, p, out=p)
        p *= fast[t]
        for k in range(INPUTS):
            np.multiply(p, x[k], out=tmp)
            w[k] += tmp.sum(axis=0)
        moved.view(np.float32).reshape(m, INPUTS)[:] = w.T
        weights[own] = moved
        bit -= seen
        bit *= finer[t]
        seen += bit
        table[cell.ravel()] = seen.ravel()  # of decisions in one cell the last one moves it
        here += STEP
    out = np.empty(n)
    out[order] = total
    learnt = Start()
    if n:
        learnt.weights, learnt.map = weights.view(np.float32).reshape(n, SETS, INPUTS).mean(axis=0), table.reshape(n, CELLS).mean(axis=0)
    return out, learnt
