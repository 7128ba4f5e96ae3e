"""The binary model behind language-model scoring: code paths, hashed-context bit predictors and the gated logistic mixer.

A token is a path of binary decisions: down a Huffman tree of the most frequent training words; a word outside it takes
the tree's escape leaf and is then spelled, each byte and its end down a second tree.  A leaf of either tree is a symbol;
symbols are numbered from left to right, so that what lies below a node is a run of numbers.  Every decision has three
predictors, each the logarithm of the odds of a 1 bit:

* order 0: the tree node's own counts;
* two contexts of the symbol, for words the previous one and two words, for spelling the previous two and four bytes: the
  counts of the node's two sides among the symbols seen in the context.

A context and a symbol make a pair: CONTEXT bits of the context's hash above SYMBOL bits of the symbol.  What is gathered
are the distinct pairs' counts, as many as the texts have.

A mixer adds them up with weights that a gate selects (what is decided, how deep, how sure the longest context is).  The
weights start at order 0 alone and are refined after every STEP tokens of the document by the gradient of the coding cost.
Many documents advance side by side; each has its own weights, so the order of documents never matters.
"""

from __future__ import annotations


import numpy as np

from quarry.llm.common import fmix64, trim

#: Words of the tree up to TOKENS training tokens; beyond, they grow with the cube root (``tree_words``).
WORDS = 1 << 18
TOKENS = 1 << 22
SYMBOL = 24
CONTEXT = 64 - SYMBOL
STEP = 16
#: Steps of the weights at each gate: words, spelling.
RATE = [0.01] * 12 + [0.005] * 12
LANES = 256
#: Tokens whose decisions are held as arrays at once.
WINDOW = 1 << 15
GATES = 24
SCALE = 8.0
#: First weights of each gate, of the two contexts' differences from order 0.  Spelling leans on its contexts from the
#: start, words on theirs only where the longer one is sure.
START = [[0.0] * 12 + [0.4] * 12, [0.05, 0.2, 0.5] * 4 + [0.5] * 12]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END_OF_WORD = 256


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of ``x`` in ascending order; sorting values takes a fraction of the time of sorting places."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def counted(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often ``x`` has each of ``values``, which ascend and hold all of ``x``."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])
    out = np.zeros(len(values), np.uint32)
    out[np.searchsorted(values, x[at])] = np.diff(at, append=len(x))
    return out


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``distinct(x)``, the place in it of each of ``x``); unsigned numbers, which are looked up about in their order."""
    values, bits = distinct(x), np.uint64(len(x).bit_length())
    order = (np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    place = np.empty(len(x), np.int64)
    place[order] = np.searchsorted(values, x[order])
    return values, place


def tree_words(tokens: int) -> int:
    """How many words get leaves of their own."""
    return min((1 << SYMBOL) - 1024, max(WORDS, int(WORDS * (tokens / TOKENS) ** (1 / 3))))


def context_bits(tokens: int) -> int:
    """How many bits of a context's hash count: 32 times as many contexts as there are pairs, CONTEXT bits at most."""
    return min(CONTEXT, max(20, (2 * tokens).bit_length() + 5))


class Tree:
    """A Huffman tree: for each leaf its symbol, for each symbol its path's nodes and bits, and each node's log odds of a 1."""

    def __init__(self, counts: np.ndarray, first_node: int):
        n = len(counts)
        first = np.argsort(counts, kind="stable")
        leaf, made = counts[first].tolist(), []
        child = np.zeros((2, max(0, n - 1)), np.int64)
        i = j = 0
        # Leaves in order of their counts and the nodes made of them, whose counts ascend as well: the least two are in front.
        for k in range(n - 1):
            total = 0
            for side in (0, 1):
                if i < n and (j >= k or leaf[i] <= made[j]):
                    child[side, k] = i
                    total += leaf[i]
                    i += 1
                else:
                    child[side, k] = n + j
                    total += made[j]
                    j += 1
            made.append(total)
        value = np.concatenate((np.array(leaf, float), np.array(made, float)))
        self.odds = (np.log(value[child[1]] + 0.4) - np.log(value[child[0]] + 0.4)).astype(np.float32)
        child = np.where(child < n, first[np.minimum(child, n - 1)], child) if n > 1 else child
        k = 2 * n - 1
        parent, side, depth = np.full(2 * n, -1, np.int32), np.zeros(2 * n, np.int8), np.zeros(2 * n, np.int64)
        for s in (0, 1):
            parent[child[s]], side[child[s]] = n + np.arange(n - 1), s
        level = np.array([k - 1]) if n > 1 else np.empty(0, np.int64)
        while len(level):
            below = child[:, level - n]
            depth[below] = depth[level] + 1
            below = below.reshape(-1)
            level = below[below >= n]
        self.length = depth[:n].copy()
        self.start = np.cumsum(self.length) - self.length
        self.nodes, self.bits, self.depth = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.int8), np.zeros(int(self.length.sum()), np.int8)
        at, who = np.arange(n), np.flatnonzero(parent[:n] >= 0)
        up = 0
        while len(who):
            place = self.start[who] + self.length[who] - 1 - up
            here = at[who]
            self.nodes[place], self.bits[place] = parent[here] - n + first_node, side[here]
            self.depth[place] = self.length[who] - 1 - up
            at[who] = parent[here]
            who = who[parent[at[who]] >= 0]
            up += 1
        self.size = k - n
        # Leaves from left to right: a path's bits are a number below 1.
        code = np.zeros(n)
        for d in range(int(self.length.max(initial=0))):
            deep = np.flatnonzero(self.length > d)
            code[deep] += np.ldexp(self.bits[self.start[deep] + d].astype(float), -1 - d)
        order = np.argsort(code, kind="stable")
        self.symbol = np.empty(n, np.int64)
        self.symbol[order] = np.arange(n)
        self.length, self.start = self.length[order], self.start[order]


class Code:
    """Both trees.  ``hashes``: of the words in the tree, ascending; leaf len(hashes) is the escape.

    It travels as the counts that it is made of, a tenth of its size, and is made anew where it arrives.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, escapes: int, byte_counts: np.ndarray, bits: int = CONTEXT):
        #: The leading bits of a context's hash that count.
        self.cut = np.uint64((1 << bits) - 1) << np.uint64(64 - bits)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.made_of = (self.hashes, self.counts, escapes, byte_counts, bits)
        w = Tree(np.append(self.counts, max(1, escapes)), 0)
        b = Tree(byte_counts + 1, w.size)
        self.leaves = len(w.length)
        self.word_symbols, self.byte_symbols = w.symbol, b.symbol + self.leaves
        self.length, self.start = np.concatenate((w.length, b.length)), np.concatenate((w.start, len(w.nodes) + b.start))
        self.nodes, self.bits = np.concatenate((w.nodes, b.nodes)), np.concatenate((w.bits, b.bits))
        self.gb = np.concatenate((np.minimum(w.depth // 4, 3) * 6 + w.bits, b.bits)).astype(np.int8)
        self.odds = np.concatenate((w.odds, b.odds))
        #: Each symbol's path as the leading bits of a number.
        self.path = np.zeros(len(self.length), np.uint64)
        for d in range(min(64, int(self.length.max(initial=0)))):
            deep = np.flatnonzero(self.length > d)
            self.path[deep] |= self.bits[self.start[deep] + d].astype(np.uint64) << np.uint64(63 - d)
        del w, b
        trim()  # building takes a few times what is kept

    def __reduce__(self):
        return Code, self.made_of


class Symbols:
    """Texts as symbols.  Of each: the symbol, its part of the gate, its two pairs; of each token: its first symbol and their number."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, words: list[bytes], hashes: np.ndarray, code: Code):
        """``tokens``: numbers of ``words``; ``first``: positions within the documents."""
        k = len(code.hashes)
        leaf = np.minimum(np.searchsorted(code.hashes, hashes), max(0, k - 1))
        known = code.hashes[leaf] == hashes if k else np.zeros(len(hashes), bool)
        self.leaf, self.known = np.where(known, leaf, k), known
        odd = np.flatnonzero(~known)
        letters, gate, two, four, size, start = spelled([words[i] for i in odd], code)
        sizes, starts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        sizes[odd], starts[odd] = size, start
        self.n = 1 + sizes[tokens]
        self.first = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.symbol, self.gate = np.empty(total, np.int32), np.zeros(total, np.int8)
        self.one, self.both = np.empty(total, np.uint64), np.empty(total, np.uint64)
        self.symbol[self.first] = code.word_symbols[self.leaf[tokens]]
        for pairs, context in zip((self.one, self.both), contexts(tokens, hashes, first, code.cut), strict=True):
            pairs[self.first] = context | self.symbol[self.first].astype(np.uint64)
        other = np.flatnonzero(~known[tokens])
        here = ranges(starts[tokens[other]], sizes[tokens[other]])
        there = ranges(self.first[other] + 1, sizes[tokens[other]])
        self.symbol[there], self.gate[there] = letters[here], gate[here]
        self.one[there], self.both[there] = two[here], four[here]


def spelled(raw: list[bytes], code: Code) -> tuple[np.ndarray, ...]:
    """Symbols, gates and both pairs of the words' bytes and ends; how many symbols each word has, and its first one."""
    size = np.array([len(w) for w in raw], np.int64)
    text = np.zeros(int(size.sum()) + len(raw), np.int64)
    ends = np.cumsum(size + 1)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = np.frombuffer(b"".join(raw), np.uint8)
    text[~inner] = END_OF_WORD
    place = np.arange(len(text)) - np.repeat(ends - size - 1, size + 1)
    before = np.zeros((2, len(text)), np.uint64)
    for back in range(1, 5):  # the bytes before; 257 stands for the word's beginning
        moved = np.full(len(text), 257, np.uint64)
        moved[back:] = text[: max(0, len(text) - back)]
        moved[place < back] = 257
        for k in range(2):
            if back <= 2 + 2 * k:
                before[k] |= moved << np.uint64(9 * back)
    symbol = code.byte_symbols[text]
    pairs = [fmix64(x + np.uint64(1 + k)) & code.cut | symbol.astype(np.uint64) for k, x in enumerate(before)]
    return symbol, ((12 + np.minimum(place, 3) * 3) * 2).astype(np.int8), *pairs, size + 1, ends - size - 1


def contexts(tokens: np.ndarray, hashes: np.ndarray, first: np.ndarray, cut: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word contexts of each token: of the previous word, and of the previous two; ``first``: positions within the document."""
    h = hashes[tokens]
    one = np.zeros(len(h), np.uint64)
    one[1:] = h[:-1]
    one[first < 1] = 0
    two = np.zeros(len(h), np.uint64)
    two[2:] = h[:-2]
    two[first < 2] = 0
    return fmix64(one * _A + np.uint64(11)) & cut, fmix64((two * _B + np.uint64(7)) ^ (one * _A)) & cut


#: Logarithms of counts below this many are looked up.
LOGS = np.log(np.arange(1 << 12) + 0.4)


def _log(n: np.ndarray) -> np.ndarray:
    """The logarithms of counts, and 0.4 more each."""
    out = LOGS[np.minimum(n, len(LOGS) - 1)]
    large = np.flatnonzero(n >= len(LOGS))
    out[large] = np.log(n[large] + 0.4)
    return out


def _units(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    odds = _log(ones)
    odds -= _log(zeros)
    odds *= SCALE
    np.rint(odds, out=odds)
    return np.clip(odds, -127, 127, out=odds).astype(np.int8)


def odds_by_counts(pairs: np.ndarray, code: Code, *counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For ascending pairs and their counts, the log odds along each pair's path of the bits that it takes, as signed bytes in units of 1 / SCALE.

    From where a pair is alone in its context they are all the same.  So: (how many decisions come before, and for each of ``counts``
    what they are from there, and these decisions' odds, pair after pair).
    """
    symbol = (pairs & np.uint64((1 << SYMBOL) - 1)).astype(np.int32)
    split = np.zeros(len(pairs), np.uint8)
    begins = np.ones(len(pairs) + 1, bool)
    context = pairs >> np.uint64(SYMBOL)
    begins[1:-1] = (context[1:] != context[:-1]) | ((symbol[1:] >= code.leaves) != (symbol[:-1] >= code.leaves))
    del context
    alive = np.flatnonzero(~(begins[:-1] & begins[1:])).astype(np.int32)
    begins = begins[alive]
    # A path's next bit is the sign.
    path = code.path[symbol[alive]].view(np.int64)
    del symbol
    upto = [np.concatenate(([0], np.cumsum(n, dtype=np.int64))) for n in counts]
    found: list[tuple[np.ndarray, list[np.ndarray]]] = []
    while len(alive):
        bit = path < 0
        # A group is a run of pairs, and as symbols ascend, those that take a 0 come before those that take a 1.
        group = np.flatnonzero(begins)
        size = np.diff(group, append=len(alive))
        first = alive[group]
        last = first + size
        middle = last - np.add.reduceat(bit, group, dtype=np.int64)
        odds = []
        for total in upto:
            below = total[middle]
            own = np.repeat(_units(total[last] - below, below - total[first]), size)
            np.negative(own, out=own, where=~bit)
            odds.append(own)
        found.append((alive, odds))
        split[alive] += 1
        begins[1:] |= bit[1:] != bit[:-1]
        more = ~(begins & np.append(begins[1:], True))
        alive, begins, path = alive[more], begins[more], path[more] << 1
    del upto
    place = np.cumsum(split, dtype=np.int64) - split
    outs = [np.empty(int(split.sum(dtype=np.int64)), np.int8) for _ in counts]
    for d, (which, odds) in enumerate(found):
        at = place[which] + d
        for out, own in zip(outs, odds, strict=True):
            out[at] = own
    return split, [(_units(n, np.zeros(1, np.int64)), out) for n, out in zip(counts, outs, strict=True)]


def context_odds(pairs: np.ndarray, n: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``odds_by_counts`` of one count: (the odds from where a pair is alone, how many decisions come before, these decisions' odds)."""
    split, [(alone, odds)] = odds_by_counts(pairs, code, n)
    return alone, split, odds


def inherited(pairs: np.ndarray, split: np.ndarray, code: Code) -> np.ndarray:
    """How many decisions, from the first on, each of some ascending pairs has at the same nodes as the pair before it."""
    symbol = (pairs & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)
    out = np.zeros(len(pairs), np.int64)
    context = pairs >> np.uint64(SYMBOL)
    same = np.flatnonzero((context[1:] == context[:-1]) & ((symbol[1:] >= code.leaves) == (symbol[:-1] >= code.leaves))) + 1
    differ = code.path[symbol[same]] ^ code.path[symbol[same - 1]]
    # The exponent of a number that is cut to what a float holds is the place of its leading bit.
    common = 64 - np.frexp((differ >> np.uint64(12)).astype(np.float64))[1] - 12
    out[same] = np.minimum(common + 1, split[same])
    return out


def whole_paths(pairs: np.ndarray, alone: np.ndarray, split: np.ndarray, odds: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of whole paths, pair after pair; where each begins); ``odds``: of the decisions before ``split`` that are not inherited.

    An inherited decision has the odds of the last pair that did not inherit it, the other way round if it takes the other bit.
    """
    symbol = (pairs & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)
    length, start = code.length[symbol], code.start[symbol]
    place = np.cumsum(length) - length
    out = np.repeat(alone, length)
    split, own = split.astype(np.int64), inherited(pairs, split, code)
    out[ranges(place + own, split - own)] = odds
    alive = np.flatnonzero(split > 0)
    at, split, own, path = place[alive], split[alive], own[alive], code.path[symbol[alive]].view(np.int64)
    d = 0
    while len(at):
        later = own > d
        here = np.flatnonzero(later)
        if len(here):
            there = np.maximum.accumulate(np.where(later, 0, np.arange(len(at))))[here]
            odds = out[at[there] + d]
            np.negative(odds, out=odds, where=(path[here] < 0) != (path[there] < 0))
            out[at[here] + d] = odds
        d += 1
        more = split > d
        at, split, own, path = at[more], split[more], own[more], path[more] << 1
    return out, place


def score(text: Symbols, n_tokens: np.ndarray, code: Code, where: tuple[np.ndarray, np.ndarray], known: np.ndarray, start=START, learned: np.ndarray | None = None) -> np.ndarray:
    """Bits of each document's tokens under the mixed model; ``where``: each symbol's beginnings of both contexts' log odds in ``known``.

    ``learned``, if given, gains each document's last weights times the decisions at the gate, and these: 3 rows of gates.
    """
    starts = np.cumsum(n_tokens) - n_tokens
    bits = np.zeros(len(n_tokens))
    order = np.argsort(-n_tokens, kind="stable")
    for a in range(0, len(order), LANES):
        docs = order[a : a + LANES]
        bits[docs] = _lanes(text, starts[docs], n_tokens[docs], code, where, known, start, learned)
    return bits


def _lanes(text, starts, sizes, code, known_at, known, start, learned) -> np.ndarray:
    lanes = len(starts)
    w1, w2 = (np.tile(np.asarray(w, np.float32), lanes) for w in start)
    used = np.zeros(lanes * GATES)
    rate = np.tile(np.asarray(RATE, np.float32), lanes)
    total = np.zeros(lanes)
    step = 0
    steps = -(-int(sizes.max()) // STEP)
    while step < steps:
        # As many steps as fit a window; lanes are sorted by size, so the live ones come first.
        picked, cuts, who = [], [0], []
        held = 0
        while step < steps and (held == 0 or held < WINDOW):
            live = int(np.searchsorted(-sizes, -step * STEP, side="left"))
            n = np.minimum(sizes[:live] - step * STEP, STEP)
            picked.append(ranges(starts[:live] + step * STEP, n))
            who.append(np.repeat(np.arange(live), n))
            held += len(picked[-1])
            cuts.append(held)
            step += 1
        where, lane = np.concatenate(picked), np.concatenate(who)
        n_symbols = text.n[where]
        which = np.repeat(np.arange(len(where)), n_symbols)
        at = ranges(text.first[where], n_symbols)
        symbol = text.symbol[at]
        n = code.length[symbol]
        row = ranges(code.start[symbol], n)
        gb = code.gb[row] + np.repeat(text.gate[at], n)
        edge = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(which, cuts)]
        taken = 2 * (gb & 1) - 1
        t1, t2 = (known[ranges(x[at], n)] * taken for x in known_at)
        base = code.odds[code.nodes[row]]
        x1 = t1 * np.float32(1 / SCALE) - base
        x2 = t2 * np.float32(1 / SCALE) - base
        sure = np.abs(t2)
        owner = np.repeat(lane[which].astype(np.int32), n)
        place = (owner * GATES + (gb >> 1) + (sure > 6) + (sure > 20)).astype(np.int64)
        sign = 1 - 2 * (gb & 1).astype(np.float32)
        cost = np.empty(len(row), np.float32)
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            live = (int(lane[cuts[i + 1] - 1]) + 1) * GATES
            g, s, y1, y2 = place[a:b], sign[a:b], x1[a:b], x2[a:b]
            # The cost of a bit is log(1 + exp(z)), z the log odds of the other bit.
            z = w1[g]
            z *= y1
            z += base[a:b]
            t = w2[g]
            t *= y2
            z += t
            z *= s
            np.clip(z, -30, 30, out=z)
            e = np.exp(z)
            q = e + np.float32(1)
            cost[a:b] = np.log(q)
            e /= q
            e *= s
            for w, y in ((w1, y1), (w2, y2)):
                w[:live] -= rate[:live] * np.bincount(g, weights=e * y, minlength=live).astype(np.float32)
        total += np.bincount(owner, weights=cost, minlength=lanes)
        if learned is not None:
            used += np.bincount(place, minlength=len(used))
    if learned is not None:
        for k, w in enumerate((w1, w2, np.ones(len(used)))):
            learned[k] += (w * used).reshape(lanes, GATES).sum(0)
    return total / np.log(2)
