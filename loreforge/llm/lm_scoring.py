"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside an add-half word model.

Texts are lower-cased (A-Z) and cut into words. Each word is encoded with a blank ahead of it by a byte-level tokenizer,
and a text ends with ``end_id``; so a text's words and its ids follow from each other. A subword sequence's probability
is a lower bound of the text's own, as other sequences may spell it too.

The network has one layer of causal self-attention and one of rectified units, both with residuals. Only the scored
places ask (queries); the places ahead of them are context, and their embeddings are keys and values. It gives the next
id's class in two steps, group and member; classes beyond the most frequent ids are shared by several ids, and an id's
share of its class comes from its count in all training texts.

A text is cut into windows of ``STRIDE`` ids, each with the ``CONTEXT`` ids ahead of it, which are looked at but not
scored again: each id is scored once. Windows of many texts go through masked attention together, those that a text's
end cuts short too: what is missing is padding, which is never a target.

Training is spread over all training texts' partitions, in rounds. Each window has its turn, one of ``TURNS`` rounds (fewer, if a task would have less
than ``STEPS`` small steps to make); in a round a task goes on from the common weights and Adam's means by steps on all of its windows whose turn it is,
and the tasks' weights and means are averaged. The steps' size falls from round to round. Ahead of its steps a task takes the loss of the common
weights on windows of the texts that are kept for this (one of ``KEPT``). A round that raised it is made again with smaller steps. Once every other window
has been learned from, and, where turns are fewer than ``TURNS``, that loss no longer falls by ``GAIN``, a last round learns from the kept texts, too.
So each window of each training text gives a gradient, once in a large corpus and several times in a small one.

Word counts cover all training texts. The most frequent words, ``FREQUENT`` at most, go to each task with their counts;
all other words of a text are joined with the table of counts, so nothing is left out and no table of unbounded size is sent.

Null and blank texts count as empty and hold the end alone. Rows that repeat an id are each scored; a null id is never
held out. Without training texts, counts are zero and the network is as it was made. An empty table gives an empty result;
other columns are not read, whatever their names.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, give_back, in_arrow
from .learning import held_out
from .subwords import byte_pairs

CONTEXT, STRIDE, DEPTH, HIDDEN = 16, 32, 16, 32
PLACES = CONTEXT + STRIDE
#: Groups of classes, members of a group, and those of a group that several ids share.
GROUPS, MEMBERS, SHARED = 32, 64, 4
#: Windows that go through the network at once in scoring, and in a gradient step at least and at most.
BATCH, STEP, LONG = 384, 32, 256
#: Rounds in which all windows have their turn at most; gradient steps of a task in a round at least; ids that a task has, about; windows that a task holds at once.
TURNS, STEPS, TASK, HELD = 8, 400, 1 << 25, 1 << 18
#: Texts of which one is kept; of their windows one of so many measures the loss, or ``STEPS`` of a run; rounds at most; the least relative fall of that loss for which another round is made.
KEPT, SPARSE, ROUNDS, GAIN = 32, 128, 30, 0.002
#: The size of gradient steps, and what is left of it a round later.
RATE, FALL = 0.02, 0.7
#: The largest norm of a step's gradients; longer ones are shortened to it.
CLIP = 0.25
#: What is left of the steps' size when training goes back to earlier weights, which it does so often at most; rounds where no text is kept to measure the loss.
BACK, BACKS, BLIND = 0.5, 3, 6
#: Words whose counts go to each task at most, and words that a worker remembers beside them at most.
FREQUENT, MEMORY = 1 << 19, 300_000
#: Of the words given at first, how many are encoded at once.
LEARN = 1 << 15
#: Tasks' weights are added up in so many parts, each first within so many bundles of tasks.
PARTS, BUNDLES = 24, 1024
_PAD = GROUPS * MEMBERS
_SEEN = (np.arange(PLACES) <= CONTEXT + np.arange(STRIDE)[:, None]).astype(np.float32)


#: The end of a text as a word, which no text can hold.
_END = b" "


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary) in a row, without ends, and how many each text has. Arrow's blanks are 09-0D and 20 alone."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    words, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    some = pc.binary_length(words).to_numpy() > 0  # a blank at a text's start or end parts an empty word
    if not some.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))
        words = words.filter(pa.array(some))
    return words, counts


class Words:
    """Words' numbers and ids. The words given at first are always known, others are forgotten when there are too many of them."""

    def __init__(self, tokenizer: str, end_id: int, first: list[bytes] = (), memory: int | None = None):
        self.coder, self.end_id, self.memory = byte_pairs(tokenizer), end_id, MEMORY if memory is None else memory
        self.blank = np.array([b[:1] == b" " for b in map(self.coder.decode_single_token_bytes, range(self.coder.n_vocab))])
        self.first = len(first)
        self.words, self.flat, self.starts, self.lengths = [], np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.forget()
        for at in range(0, max(1, len(first)), LEARN):  # what learning holds beside the words stays small
            for w in first[at : at + LEARN]:
                self.places[w]
            self._learn()

    def forget(self) -> None:
        """All but the first ones."""
        new = self.new = []

        class Places(dict):
            def __missing__(self, word):
                place = self[word] = len(self)
                new.append(word)
                return place

        del self.words[self.first :]
        self.places = Places(zip(self.words, range(len(self.words)), strict=True))
        self.starts, self.lengths = self.starts[: len(self.words)], self.lengths[: len(self.words)]
        self.flat = self.flat[: int(self.lengths.sum())]

    def full(self) -> bool:
        return len(self.words) - self.first > self.memory

    def _learn(self) -> None:
        """Words without any blank, Unicode's too, are encoded in rows of many: each one's first id alone has a blank, and no part reaches
        across words. All others are encoded alone."""
        texts = [w.decode("utf-8", "replace") for w in self.new]
        alone = np.array([t.split() != [t] for t in texts])
        flat, at = [self.flat], len(self.flat)
        starts, lengths = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for row in np.split(np.flatnonzero(~alone), range(1024, len(texts), 1024)) if len(texts) else []:
            ids = np.array(self.coder.encode_ordinary("".join([" " + texts[i] for i in row.tolist()])), np.int32)
            first = np.flatnonzero(self.blank[ids])
            starts[row], lengths[row] = at + first, np.diff(first, append=len(ids))
            flat.append(ids)
            at += len(ids)
        for i in np.flatnonzero(alone).tolist():
            ids = np.array([self.end_id] if self.new[i] == _END else self.coder.encode_ordinary(" " + texts[i]), np.int32)
            starts[i], lengths[i] = at, len(ids)
            flat.append(ids)
            at += len(ids)
        self.flat, self.starts, self.lengths = np.concatenate(flat), np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.words += self.new
        self.new.clear()

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers of all texts (binary) in a row, each text with its end, and how many each text has."""
        words, counts = words_of(texts)
        coded = words.dictionary_encode()  # each distinct word is looked up once
        found = [*coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), _END]
        places = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        numbers = np.insert(places[coded.indices.to_numpy()], np.cumsum(counts), places[-1])
        if self.new:
            self._learn()
        return numbers, counts + 1

    def ids(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


_memory: dict = {}


def remembered(key, make) -> Words:
    """The worker's memory of words, which its tasks of one kind share. A new kind's takes the place of the last one's."""
    if key not in _memory:
        _memory.clear()
        give_back()
        _memory[key] = make()
    return _memory[key]


def classes(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each id. Half of the groups hold the ids that begin a word or are the end, half the others. In each half the
    most frequent ids have classes of their own, the others share classes of about equal weight; ranks are dealt over the groups."""
    out, half = np.empty(len(counts), np.int32), GROUPS // 2
    for first, own in ((0, np.flatnonzero(begins)), (half, np.flatnonzero(~begins))):
        own = own[np.argsort(-counts[own], kind="stable")]
        single, shared = half * (MEMBERS - SHARED), half * SHARED
        rank, weight = np.arange(len(own)), np.cumsum(counts[own[single:]] + 0.5)
        if len(weight):
            rank[single:] = single + np.minimum((weight / weight[-1] * shared).astype(int), shared - 1)
        out[own] = (first + rank % half) * MEMBERS + rank // half
    return out


def windows(kinds: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of all windows. kinds: the classes of all texts in a row; start: the class that is ahead of each text.

    Inputs are PLACES classes, the last STRIDE of them those right ahead of the targets; _PAD is what is missing, ahead of a
    text and past its end."""
    n, ends = -(-lengths // STRIDE), np.cumsum(lengths)
    whole = lengths + PLACES + 1
    offsets = np.cumsum(whole) - whole
    row = np.full(int(whole.sum()), _PAD, np.int32)
    row[offsets + CONTEXT] = start
    at = np.repeat(offsets + CONTEXT + 1 - (ends - lengths), lengths)
    at += np.arange(len(at))
    row[at] = kinds
    first = np.repeat(offsets - STRIDE * (np.cumsum(n) - n), n) + np.arange(0, int(n.sum()) * STRIDE, STRIDE)
    out = row[first[:, None] + np.arange(PLACES + 1)]
    return out[:, :-1], out[:, CONTEXT + 1 :]


def some_windows(ids: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, end_id: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of all windows whose numbers are chosen. ids: of all texts in a row; only chosen windows' ids are looked up in kinds."""
    ends = np.cumsum(-(-lengths // STRIDE))
    text = np.searchsorted(ends, chosen, "right")
    nth = chosen - np.concatenate([[0], ends])[text]
    at = (nth * STRIDE - CONTEXT - 1)[:, None] + np.arange(PLACES + 1)  # places in the text
    missing = (at < -1) | (at >= lengths[text, None])
    out = kinds[ids[np.clip(at + (np.cumsum(lengths) - lengths)[text, None], 0, max(0, len(ids) - 1))]]
    out[at == -1] = kinds[end_id]
    out[missing] = _PAD
    return out[:, :-1], out[:, CONTEXT + 1 :]


class Network:
    """The last column of the embeddings is 1, and stays so up to the output, so that each product has a bias."""

    #: Weights whose last column is fixed.
    FIXED = ("e", "p", "o", "w2")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def made(cls, counts: np.ndarray, seed: int = 3) -> "Network":
        """Untrained: it gives the classes' shares of counts."""
        rng, d = np.random.default_rng(seed), DEPTH
        counts = counts.reshape(GROUPS, MEMBERS) + 0.5
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {"e": draw(0.3, _PAD + 1, d), "p": draw(0.1, PLACES, d), "a": draw(0.3 / d, d, d), "o": draw(0.3 / d**0.5, d, d), "w1": draw(1 / d**0.5, d, HIDDEN), "w2": draw(0.3 / HIDDEN**0.5, HIDDEN, d)}
        w |= {"h": np.zeros((d, GROUPS), np.float32), "k": np.zeros((GROUPS, d, MEMBERS), np.float32)}
        for name in cls.FIXED:
            w[name][:, -1] = name == "e"
        w["h"][-1] = np.log(counts.sum(1) / counts.sum())
        w["k"][:, -1] = np.log(counts / counts.sum(1, keepdims=True))
        return cls(w)

    def _attend(self, x: np.ndarray):
        x = np.take(self.w["e"], x, axis=0)
        x += self.w["p"]
        q = x[:, CONTEXT:].reshape(-1, DEPTH) @ self.w["a"]
        s = q.reshape(len(x), STRIDE, DEPTH) @ x.transpose(0, 2, 1)
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= _SEEN
        c = s @ x
        total = c[..., -1:].copy()
        c /= total
        return x, q, s, total, c

    def _top(self, x: np.ndarray, c: np.ndarray):
        y = c @ self.w["o"]
        y += x
        u = y @ self.w["w1"]
        np.maximum(u, 0, out=u)
        z = u @ self.w["w2"]
        z += y
        return y, u, z

    @staticmethod
    def _exp(logits: np.ndarray) -> np.ndarray:
        np.clip(logits, -40, 40, out=logits)
        return np.exp(logits, out=logits)

    def _members(self, z: np.ndarray, kinds: np.ndarray):
        """order (by group), where each group begins in it, members and unnormalised probabilities in that order."""
        order = np.argsort((kinds // MEMBERS).astype(np.int16), kind="stable")
        own = kinds[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(own // MEMBERS, minlength=GROUPS))])
        zs, out = z[order], np.empty((len(z), MEMBERS), z.dtype)
        for g in range(GROUPS):
            if ends[g] < ends[g + 1]:
                np.matmul(zs[ends[g] : ends[g + 1]], self.w["k"][g], out=out[ends[g] : ends[g + 1]])
        return order, ends, zs, own % MEMBERS, self._exp(out)

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, of those that are not missing, in a row."""
        x, _, _, _, c = self._attend(x)
        real = np.flatnonzero(y != _PAD)
        x, c, kinds = x[:, CONTEXT:].reshape(-1, DEPTH), c.reshape(-1, DEPTH), y.ravel()
        if len(real) < len(kinds):
            x, c, kinds = x[real], c[real], kinds[real]
        z = self._top(x, c)[2]
        top, rows = self._exp(z @ self.w["h"]), np.arange(len(z))
        p = top[rows, kinds // MEMBERS] / (top @ np.ones(GROUPS, top.dtype))
        order, _, _, member, below = self._members(z, kinds)
        out = np.log(p)
        out[order] += np.log(below[rows, member] / (below @ np.ones(MEMBERS, below.dtype)))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over the targets that are not missing, and that loss."""
        w, places, flat = self.w, x, lambda m: m.reshape(-1, m.shape[-1])
        x, q, s, total, c = self._attend(x)
        s /= total
        real = np.flatnonzero(y != _PAD)
        n, kinds = max(1, len(real)), y.ravel()[real]
        own = x[:, CONTEXT:].reshape(-1, DEPTH)
        yy, u, z = self._top(own, flat(c))
        zr, rows = z[real], np.arange(len(real))
        top = self._exp(zr @ w["h"])
        top /= (top @ np.ones(GROUPS, top.dtype))[:, None]
        loss = -np.log(top[rows, kinds // MEMBERS]).sum(dtype=float)
        top[rows, kinds // MEMBERS] -= 1
        g = {"h": zr.T @ top / n, "k": np.zeros_like(w["k"])}
        dz = top @ w["h"].T
        order, ends, zs, member, below = self._members(zr, kinds)
        below /= (below @ np.ones(MEMBERS, below.dtype))[:, None]
        loss -= np.log(below[rows, member]).sum(dtype=float)
        below[rows, member] -= 1
        back = np.empty_like(zs)
        for k in range(GROUPS):
            a, b = ends[k], ends[k + 1]
            if a < b:
                g["k"][k] = zs[a:b].T @ below[a:b] / n
                np.matmul(below[a:b], w["k"][k].T, out=back[a:b])
        dz[order] += back
        full = np.zeros_like(z)
        full[real] = dz / n
        du = (full @ w["w2"].T) * (u > 0)
        g |= {"w2": u.T @ full, "w1": yy.T @ du}
        dy = full + du @ w["w1"].T
        g["o"] = flat(c).T @ dy
        dc = (dy @ w["o"].T).reshape(c.shape)
        da = dc @ x.transpose(0, 2, 1)
        dx = s.transpose(0, 2, 1) @ dc
        da -= (da * s).sum(-1, keepdims=True)
        da *= s
        dx += da.transpose(0, 2, 1) @ q.reshape(c.shape)
        dq = flat(da @ x)
        g["a"] = own.T @ dq
        dx[:, CONTEXT:] += (dy + dq @ w["a"].T).reshape(c.shape)
        g["p"] = dx.sum(0)
        at = places.reshape(-1, 1) * DEPTH + np.arange(DEPTH)
        g["e"] = np.bincount(at.ravel(), dx.ravel(), w["e"].size).reshape(w["e"].shape).astype(w["e"].dtype)
        for name in self.FIXED:
            g[name][:, -1] = 0
        return g, loss / n

    def learn(self, x: np.ndarray, y: np.ndarray, rng, moves: "Moves", high: float, low: float, passes: int = 1) -> None:
        """Adam's steps over the windows in random order, whose size goes from high to low."""
        order = np.concatenate([rng.permutation(len(x)) for _ in range(passes)])
        size = min(max(STEP, len(order) // STEPS), LONG)
        steps = -(-len(order) // size)
        for t in range(steps):
            at = order[t * size : (t + 1) * size]
            moves.step(self.w, self.gradients(x[at].astype(np.int32), y[at].astype(np.int32))[0], high + (low - high) * t / steps)


class Moves:
    """Adam's means of gradients and of their squares."""

    def __init__(self, first: dict[str, np.ndarray], second: dict[str, np.ndarray], t: int):
        self.first, self.second, self.t = first, second, t

    def step(self, weights: dict, gradients: dict, rate: float) -> None:
        self.t += 1
        rate = rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        norm = sum(float(np.vdot(g, g)) for g in gradients.values()) ** 0.5
        for name, g in gradients.items():
            g *= min(1.0, CLIP / max(norm, 1e-30))
            m, v = self.first[name], self.second[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[name] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


class Scorer:
    def __init__(self, weights: dict, kinds: np.ndarray, share: np.ndarray, end_id: int):
        self.net, self.kinds, self.share, self.start = Network(weights), kinds, share, int(kinds[end_id])

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text. ids: of all texts in a row, each with its end."""
        x, y = windows(self.kinds[ids], lengths, self.start)
        p = np.empty(len(ids))
        at = 0
        for k in range(0, len(x), BATCH):  # windows come in the order of ids
            part = self.net.log_probs(x[k : k + BATCH], y[k : k + BATCH])
            p[at : at + len(part)] = part
            at += len(part)
        p += self.share[ids]
        total = np.concatenate([[0.0], np.cumsum(p)])
        return np.diff(total[np.concatenate([[0], np.cumsum(lengths)])]) / np.log(10)


def _slices(lengths: np.ndarray, most: int = 1 << 17):
    """Runs of texts that have about so many words or ids together; a longer text is a run of its own."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most, prepend=0))
    return [s for s in np.split(np.arange(len(lengths)), cuts) if len(s)]


def gather(texts: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """What is learned from texts (text binary): rows of a text's ids (kind 0), of a word with its number (1), and of a subword with its number (2)."""

    def each(batches):
        from pyspark import TaskContext

        size, part = max(byte_pairs(tokenizer).n_vocab, end_id + 1), TaskContext.get().partitionId()
        pieces, n_texts = np.zeros(size, np.int64), 0

        def row(tag=None, ids=None, word=None, piece=None, n=None):
            k = len(next(v for v in (tag, word, piece) if v is not None))
            columns = [pa.nulls(k, kind) if v is None else pa.array(v, kind) for v, kind in ((tag, pa.int64()), (ids, pa.binary()), (word, pa.binary()), (piece, pa.int64()), (n, pa.int64()))]
            kind = pa.array(np.full(k, 0 if tag is not None else 1 if word is not None else 2, np.int32))
            return pa.RecordBatch.from_arrays([*columns, kind], names=["tag", "ids", "word", "piece", "n", "kind"])

        memory = remembered((tokenizer, end_id), lambda: Words(tokenizer, end_id))
        tf = np.zeros(len(memory.words), np.int64)

        def flush():
            there = np.flatnonzero(tf)
            for k in range(0, len(there), 1 << 16):
                at = there[k : k + (1 << 16)]
                yield row(word=[memory.words[i] for i in at.tolist()], n=tf[at])

        for batch in batches:
            bodies = batch.column(0)
            for at in range(0, len(bodies), 512):
                if memory.full():
                    yield from flush()
                    memory.forget()
                    tf = np.zeros(0, np.int64)
                numbers, counts = memory.numbers(bodies.slice(at, 512))
                tf = np.concatenate([tf, np.zeros(len(memory.words) - len(tf), np.int64)])
                tf += np.bincount(numbers, minlength=len(tf))
                ids, lengths = memory.ids(numbers, counts)
                pieces += np.bincount(ids, minlength=size)
                kept = np.split(ids.astype("<u4" if size > 1 << 16 else "<u2"), np.cumsum(lengths)[:-1])
                yield row(tag=np.arange(n_texts, n_texts + len(kept)) + (part << 33), ids=[k.tobytes() for k in kept])
                n_texts += len(kept)
        yield from flush()
        there = np.flatnonzero(pieces)
        yield row(piece=there, n=pieces[there])
        give_back()

    return in_arrow(texts, each, "tag long, ids binary, word binary, piece long, n long, kind int")


def turn(tags: np.ndarray, lengths: np.ndarray, turns: int, epoch: int) -> np.ndarray:
    """The turn of each window of texts in a row."""
    n = -(-lengths // STRIDE)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    mixed = np.repeat(tags, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (nth + (epoch << 40)).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(33)) % np.uint64(turns)


def train(bodies: DataFrame, kinds: np.ndarray, counts: np.ndarray, end_id: int, wide: bool, seed: int = 11) -> tuple[dict, list[float], list[int]]:
    """The network's weights, fitted on the ids in bodies (tag, ids), the kept windows' loss ahead of each round, and how many windows each round learned
    from whose steps are in the weights; the first of them are all windows but those of kept texts, the last those."""
    least = STEPS * STEP
    turns = int(min(TURNS, max(1, counts.sum() // (tasks(counts) * STRIDE * least))))
    weights = Network.made(np.bincount(kinds, weights=counts, minlength=_PAD)).w
    state, losses, learned = (weights, *({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))), [], []
    best, lowest, rate, backs, over = None, np.inf, RATE, 0, False
    while True:
        done = len(learned)
        closing = over or turns == TURNS == done or len(losses) >= ROUNDS
        new, seen, loss = _round(bodies, kinds, end_id, wide, seed, state, len(losses), (done % turns, turns, done // turns), rate, least, closing)
        if not seen:
            return state[0], losses, learned
        losses.append(loss)
        if state is not best:  # else it has been measured
            if loss > lowest and backs < BACKS and len(losses) < ROUNDS:  # again, from where the last round began
                state, rate, backs = best, rate * BACK, backs + 1
                learned.pop()
                continue
            if loss > lowest and done > turns:
                state, over = best, True
                learned.pop()
                continue
            enough = loss >= lowest * (1 - GAIN) or (np.isnan(loss) and done >= BLIND)
            best, lowest = state, min(loss, lowest)
            if done >= turns and enough and not closing:
                over = True
                continue
        learned.append(seen)
        if closing:
            return new[0], losses, learned
        state, rate = new, rate * FALL


def tasks(counts: np.ndarray) -> int:
    """How many tasks train on so many ids."""
    return max(1, round(counts.sum() / TASK))


def _round(bodies: DataFrame, kinds: np.ndarray, end_id: int, wide: bool, seed: int, given: tuple, nth_round: int, when: tuple, high: float, least: int, closing: bool):
    """Weights and Adam's means after the tasks' steps on the windows whose turn it is (closing: on those of kept texts), how many these are, and the
    kept windows' mean loss ahead of the steps. when: the turn, of how many, and how often all windows have had theirs."""
    shapes = {k: v.shape for k, v in given[0].items()}
    dtype = "<u4" if wide else "<u2"

    def each(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        mine, *means = ({k: v.copy() for k, v in x.items()} for x in given)
        own, moves, rng = Network(mine), Moves(*means, 1000 * nth_round), np.random.default_rng([seed, nth_round, part])
        loss, n_kept, drawn, held, seen = 0.0, 0, [], 0, 0
        for batch in batches:
            tags = batch.column(0).to_numpy()
            away = (tags * 2654435761 % 2**32 >> 8) % KEPT == 0
            for kept in (True, False):
                if closing and not kept:
                    continue
                parts = [np.frombuffer(b, dtype) for b in batch.column(1).filter(pa.array(away == kept)).to_pylist()]
                lengths = np.fromiter(map(len, parts), np.int64, len(parts))
                of = tags[away == kept]
                for run in _slices(lengths, 1 << 20):
                    flat, n = np.concatenate(parts[run[0] : run[-1] + 1]), int((-(-lengths[run] // STRIDE)).sum())
                    if kept:
                        same = np.random.default_rng(seed)  # the windows that measure are the same in each round
                        x, y = some_windows(flat, lengths[run], kinds, end_id, same.choice(n, min(n, max(-(-n // SPARSE), STEPS)), replace=False))
                        before = Network(given[0])
                        p = np.concatenate([before.log_probs(x[k : k + BATCH], y[k : k + BATCH]) for k in range(0, len(x), BATCH)])
                        loss, n_kept = loss - float(p.sum(dtype=float)), n_kept + len(p)
                    if kept == closing:
                        chosen = np.arange(n) if closing else np.flatnonzero(turn(of[run], lengths[run], *when[1:]) == when[0])
                        x, y = some_windows(flat, lengths[run], kinds, end_id, chosen)
                        drawn.append((x.astype(np.int16), y.astype(np.int16)))
                        held += len(chosen)
                    if held > HELD:  # a task of uncommon size
                        own.learn(*map(np.concatenate, zip(*drawn, strict=True)), rng, moves, high, high)
                        seen, held, drawn = seen + held, 0, []
        if held:
            x, y = map(np.concatenate, zip(*drawn, strict=True))
            own.learn(x, y, rng, moves, high, high * FALL, 1 if seen or closing else max(1, -(-least // held)))
            seen += held
        flat = np.concatenate([x[k].ravel() for x in (own.w, moves.first, moves.second) for k in shapes]).astype(float) * seen
        for k, values in enumerate(np.array_split(flat, PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([part % BUNDLES]), pa.array([k]), pa.array([float(seen)]), pa.array([loss]), pa.array([n_kept]), pa.array([values.astype(np.float32).tobytes()], pa.binary())], names=["bundle", "k", "seen", "loss", "n_kept", "weights"])
        give_back()

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(float) for b in table.column("weights").to_pylist())
        one = lambda name: [sum(table.column(name).to_pylist())]
        return pa.table({"bundle": pa.array([0]), "k": table.column("k").slice(0, 1), "seen": one("seen"), "loss": one("loss"), "n_kept": one("n_kept"), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "bundle long, k long, seen double, loss double, n_kept long, weights binary"
    sums = in_arrow(bodies, each, schema).groupBy("bundle", "k").applyInArrow(added, schema).groupBy("k").applyInArrow(added, schema)
    found = sorted(sums.collect(), key=lambda r: r["k"])  # PARTS rows, the weights once
    if not found or not found[0]["seen"]:
        return given, 0, np.nan
    flat, at, out = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in found]).astype(float) / found[0]["seen"], 0, ({}, {}, {})
    for x in out:
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            x[name], at = flat[at : at + n].reshape(shape).astype(np.float32), at + n
    return out, int(found[0]["seen"]), found[0]["loss"] / found[0]["n_kept"] if found[0]["n_kept"] else np.nan


def score(docs: DataFrame, tokenizer: str, end_id: int, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), held_out(id_col, folds, fold).alias("held_out"))
    size = max(byte_pairs(tokenizer).n_vocab, end_id + 1)
    learned = freeze(gather(texts.where("not held_out").select("text"), tokenizer, end_id), "learned", "kind")  # what rounds read again lies apart

    counts = np.zeros(size)
    of_piece = learned.where("kind = 2").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row per subword at most
    counts[of_piece.column("piece").to_numpy()] = of_piece.column("n").to_numpy()
    coder = byte_pairs(tokenizer)
    begins = np.array([i >= coder.n_vocab or coder.decode_single_token_bytes(i)[:1] == b" " for i in range(size)]) | (np.arange(size) == end_id)
    kinds = classes(counts, begins)
    bodies = learned.where("kind = 0").select("tag", "ids").coalesce(tasks(counts))
    weights, *_ = train(bodies, kinds, counts, end_id, size > 1 << 16)
    share = np.log((counts + 0.5) / np.bincount(kinds, weights=counts + 0.5, minlength=_PAD)[kinds])

    known = freeze(learned.where("kind = 1").groupBy("word").agg(F.sum("n").alias("c")), "known")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    octave = F.floor(F.log2("c") * 16)
    most, least = 0, None
    for r in sorted(known.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r["o"]):  # a thousand rows at most
        most += r["count"]
        if most > FREQUENT:
            break
        least = r["o"]
    often = known.where(octave >= least) if least is not None else known.limit(0)
    table = often.toArrow()  # FREQUENT rows at most
    frequent = spark.sparkContext.broadcast((table.column("word").to_pylist(), table.column("c").to_numpy()))
    key = uuid.uuid4().hex
    below = float(np.log10(total + 0.5 * (distinct + 1)))

    def each(batches):
        from pyspark import TaskContext

        memory = remembered(key, lambda: Words(tokenizer, end_id, frequent.value[0]))
        of_first = np.append(frequent.value[1], 0)
        scorer, tag = Scorer(weights, kinds, share, end_id), TaskContext.get().partitionId() << 33
        names = ["tag", "id", "held_out", "n_tokens", "n_known", "base", "score", "word", "tf"]
        for batch in batches:
            bodies = batch.column("text")
            for at in range(0, len(bodies), 256):
                part = bodies.slice(at, 256)
                if memory.full():
                    memory.forget()
                numbers, n = memory.numbers(part)
                c = of_first[np.minimum(numbers, len(of_first) - 1)]  # 0: rare or unknown
                owner = np.repeat(np.arange(len(part)), n)
                base = np.bincount(owner, weights=np.log10(c + 0.5), minlength=len(part)) - below * n
                n_known = np.bincount(owner, weights=c > 0, minlength=len(part)).astype(np.int64)
                ids, lengths = memory.ids(numbers, n)
                bounds, scores = np.concatenate([[0], np.cumsum(lengths)]), []
                for run in _slices(lengths):
                    scores.append(scorer.score(ids[bounds[run[0]] : bounds[run[-1] + 1]], lengths[run]))
                tags = np.arange(tag, tag + len(part))
                tag += len(part)
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(tags), batch.column("id").slice(at, k), batch.column("held_out").slice(at, k), pa.array(n), pa.array(n_known), pa.array(base), pa.array(np.concatenate(scores)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
                rare = np.flatnonzero(c == 0)
                pairs, times = np.unique(owner[rare] * len(memory.words) + numbers[rare], return_counts=True)
                if len(pairs):
                    own, number = np.divmod(pairs, len(memory.words))
                    rest = [memory.words[i] for i in number.tolist()]
                    k = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(tags[own]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(rest, pa.binary()), pa.array(times)], names=names)
        give_back()

    found = freeze(in_arrow(texts, each, "tag long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long"), "scored")
    # words outside the table of frequent ones: counted as unknown so far
    rare = found.where("word is not null").select("tag", "word", "tf").join(known, "word")
    more = F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("more")
    sums = freeze(rare.groupBy("tag").agg(more, F.sum("tf").alias("more_known")), "sums")
    out = found.where("word is null").join(sums, "tag", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
