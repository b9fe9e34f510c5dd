"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 4).

A word enters as an embedding of itself and the mean embedding of its character 3- to 5-grams, both hashed.
Two gated recurrent units read a window of words forwards and backwards, attention pools their states, and
a logistic unit scores the window. A text is scored in all its overlapping windows, and the largest window
score is the text's. The network is written and trained in numpy.

Training takes a bounded sample of labelled documents (``SAMPLE`` per class, of at most ``SAMPLE_WORDS`` words
each, the smallest hashes of their ids) to the driver. A document's label holds for at least one window, so
each toxic document teaches its highest window: by the log odds of its words at first, by the network itself
afterwards. A clean document teaches its highest window and some others.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.quality import held_out_of
from atlas.session import cut_lineage

WINDOW = 8
HIDDEN = 12
ATTENTION = 8
WORD_DIMS, CHAR_DIMS = 12, 20
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5)
FEW_GRAMS = 64
SAMPLE = 1500  # documents of a class that training sees at most
SAMPLE_WORDS = 800  # words that such a document has at most
EPOCHS = 6
LEAST_STEPS = 240  # of training, however few the documents
LEAST_SEEN = 3
OTHERS = 2  # windows of a clean document beside its highest
SEED = 11
CHUNK_WORDS = 1 << 16  # words whose texts are scored together
BLOCK = 2048  # window starts that go through the network at once, sized for the processor's cache
WORDS_KEPT = 1 << 16  # words whose gate inputs a task keeps, about 25 MB
AVERAGED = 0.4  # of the steps at the end, whose weights are averaged
TRIM = b".,!?;:\"'()[]|*#$%&"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them, those that are left empty dropped."""
    raw = text.lower().encode("utf-8", "replace").split() if text else []
    return [w for w in (r.strip(TRIM) for r in raw) if w]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of all words, and the word each belongs to."""
    marked = b"".join([b"\x01" + w + b"\x02" for w in words])
    chars = np.frombuffer(marked, np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters up to the word's end
    buckets, owners = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        code = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(1099511628211) + chars[i:len(chars) - n + 1 + i]
        fits = left[:len(code)] >= n
        code = code[fits]
        buckets.append(((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CHAR_BUCKETS))
        owners.append(owner[:len(fits)][fits])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def gram_sums(vectors: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each word's grams, which lie together. The first ``FEW_GRAMS`` are added one from each
    word at a time, which is faster than word by word; the rest of long words, word by word."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    falling, first = counts[order], starts[order]
    total = np.zeros((len(counts), vectors.shape[1]), np.float32)
    for j in range(min(FEW_GRAMS, int(falling[0]))):
        words = int(np.searchsorted(-falling, -j))
        total[:words] += vectors[grams[first[:words] + j]]
    for i in range(int(np.searchsorted(-falling, -FEW_GRAMS))):
        total[i] += vectors[grams[first[i] + FEW_GRAMS:first[i] + falling[i]]].sum(axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


def windows_of(n: int) -> range:
    """Starts of all overlapping windows of ``n`` words; a shorter text is one window."""
    return range(max(1, n - WINDOW + 1)) if n else range(0)


def squash(x: np.ndarray) -> np.ndarray:
    """The network's bounded unit, -1 to 1: like tanh, but several times cheaper in numpy. Its slope is (1 - y^2)^1.5."""
    return x / np.sqrt(1 + x * x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGRU:
    """Parameters by name in ``p``; float32 throughout."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIMS + CHAR_DIMS

        def matrix(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "words": (0.02 * rng.standard_normal((WORD_BUCKETS, WORD_DIMS))).astype(np.float32),
            "chars": (0.1 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIMS))).astype(np.float32),
            "wa": matrix(2 * h, ATTENTION), "va": matrix(ATTENTION), "wo": matrix(2 * h),
            "bo": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"wx{side}": matrix(d, 3 * h), f"wh{side}": matrix(h, 3 * h),
                       f"bx{side}": np.zeros(3 * h, np.float32), f"bh{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """A row for each word (and one of zeros at the end, for padding)."""
        n = len(words)
        bucket = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, n)
        grams, owner = grams_of(words)
        counts = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
        x = np.zeros((n + 1, WORD_DIMS + CHAR_DIMS), np.float32)
        x[:n, :WORD_DIMS] = self.p["words"][bucket]
        if len(grams):
            order = np.argsort(owner, kind="stable")
            grams, owner = grams[order], owner[order]
            x[:n, WORD_DIMS:] = gram_sums(self.p["chars"], grams, np.bincount(owner, minlength=n))
            x[:n, WORD_DIMS:] /= counts[:, None]
        return x, (bucket, grams, owner, counts)

    def states(self, projected: np.ndarray, at: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None):
        """States (window step, window, hidden) of one direction; ``projected`` are gate inputs by word."""
        steps, n = at.shape
        h = HIDDEN
        wh, bh = self.p[f"wh{side}"], self.p[f"bh{side}"]
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gx = projected[at[t]]
            gh = state @ wh + bh
            zr = 0.5 + 0.5 * squash(gx[:, :2 * h] + gh[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = squash(gx[:, 2 * h:] + r * gh[:, 2 * h:])
            update = (1 - z) * mask[t][:, None]
            following = state + update * (new - state)
            if keep is not None:
                keep.append((t, state, z, r, new, gh[:, 2 * h:]))
            out[t] = state = following
        return out

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of both directions by word."""
        return [x @ self.p[f"wx{side}"] + self.p[f"bx{side}"] for side in "fb"]

    def logits(self, x: np.ndarray | None, at: np.ndarray, mask: np.ndarray, keep: dict | None = None,
               gates: list[np.ndarray] | None = None) -> np.ndarray:
        """Scores of windows; ``at`` and ``mask`` are (step, window). Known gate inputs may stand for ``x``."""
        sides = []
        for side, projected in zip("fb", gates or self.gates(x)):
            kept: list | None = [] if keep is not None else None
            sides.append(self.states(projected, at, mask, side, kept))
            if keep is not None:
                keep[side] = kept
        both = np.concatenate(sides, axis=2)
        inner = squash(both @ self.p["wa"])
        energy = inner @ self.p["va"] + np.where(mask > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        if keep is not None:
            keep |= {"both": both, "inner": inner, "weight": weight, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, target: np.ndarray,
                  importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss over some windows."""
        p, h = self.p, HIDDEN
        x, (bucket, grams, owner, counts) = self.inputs(words)
        keep: dict = {}
        score = self.logits(x, at, mask, keep)
        dlogit = ((_sigmoid(score) - target) * importance / importance.sum()).astype(np.float32)
        g = {"wo": keep["pooled"].T @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["wo"]
        both, weight, inner = keep["both"], keep["weight"], keep["inner"]
        dboth = weight[..., None] * dpooled
        dweight = (both * dpooled).sum(axis=2)
        denergy = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = (inner * denergy[..., None]).sum(axis=(0, 1))
        dinner = denergy[..., None] * p["va"] * (1 - inner * inner) ** 1.5
        g["wa"] = np.tensordot(both, dinner, ([0, 1], [0, 1]))
        dboth = dboth + dinner @ p["wa"].T
        dx = np.zeros_like(x)
        for part, side in enumerate("fb"):
            dstate = np.zeros((at.shape[1], h), np.float32)
            g[f"wh{side}"] = np.zeros_like(p[f"wh{side}"])
            g[f"bh{side}"] = np.zeros_like(p[f"bh{side}"])
            dprojected = np.zeros((len(x), 3 * h), np.float32)
            for t, state, z, r, new, hidden in reversed(keep[side]):
                dstate = dstate + dboth[t][:, part * h:(part + 1) * h]
                m = mask[t][:, None]
                dupdate = dstate * (new - state)
                dnew = dstate * (1 - z) * m * (1 - new * new) ** 1.5
                dz = -dupdate * m * 4 * (z * (1 - z)) ** 1.5
                dr = dnew * hidden * 4 * (r * (1 - r)) ** 1.5
                dgh = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(dprojected, at[t], np.concatenate([dz, dr, dnew], axis=1))
                g[f"wh{side}"] += state.T @ dgh
                g[f"bh{side}"] += dgh.sum(axis=0)
                dstate = dstate * (1 - (1 - z) * m) + dgh @ p[f"wh{side}"].T
            g[f"wx{side}"] = x.T @ dprojected
            g[f"bx{side}"] = dprojected[:-1].sum(axis=0)
            dx += dprojected @ p[f"wx{side}"].T
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], bucket, dx[:-1, :WORD_DIMS])
        if len(grams):
            np.add.at(g["chars"], grams, dx[owner, WORD_DIMS:] / counts[owner][:, None])
        return g

    def slide(self, ids: np.ndarray, gates: list[np.ndarray]) -> np.ndarray:
        """Logits of the windows that start at every word of a row of words but the last ``WINDOW - 1``.

        The same network as ``logits``, without masks and feature by feature: at each step the inputs of all
        windows of a block are one stretch of words.
        """
        h, p, starts = HIDDEN, self.p, len(ids) - WINDOW + 1
        out = np.empty(max(starts, 0), np.float32)
        hidden = [np.ascontiguousarray(p[f"wh{side}"].T) for side in "fb"]
        bias = [p[f"bh{side}"][:, None] for side in "fb"]
        wa, va = np.ascontiguousarray(p["wa"].T), p["va"]

        def bend(x, root):  # squash, in place
            np.multiply(x, x, out=root)
            root += 1
            np.sqrt(root, out=root)
            x /= root

        for begin in range(0, starts, BLOCK):
            n = min(BLOCK, starts - begin)
            both = np.empty((WINDOW, 2 * h, n), np.float32)
            for part, known in enumerate(gates):
                x = np.ascontiguousarray(known[ids[begin:begin + n + WINDOW - 1]].T)
                x[:2 * h] += bias[part][:2 * h]
                state = np.zeros((h, n), np.float32)
                gate, root = np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
                for t in range(WINDOW) if part == 0 else range(WINDOW - 1, -1, -1):
                    np.matmul(hidden[part], state, out=gate)
                    zr, new = gate[:2 * h], gate[2 * h:]
                    zr += x[:2 * h, t:t + n]
                    bend(zr, root)
                    zr *= 0.5
                    zr += 0.5
                    new += bias[part][2 * h:]
                    new *= zr[h:]
                    new += x[2 * h:, t:t + n]
                    bend(new, root[:h])
                    following = both[t, part * h:(part + 1) * h]
                    np.subtract(state, new, out=following)
                    following *= zr[:h]
                    following += new
                    state = following
            inner = np.matmul(wa, both)
            bend(inner, np.empty_like(inner))
            energy = np.matmul(va, inner)
            energy -= energy.max(axis=0)
            np.exp(energy, out=energy)
            value = np.matmul(p["wo"], both)
            out[begin:begin + n] = (energy * value).sum(axis=0) / energy.sum(axis=0)
        return out + p["bo"][0]

    def window_scores(self, texts: list[list[bytes]], known: "WordTable | None" = None) -> list[np.ndarray]:
        """For each text the logits of its windows, by start. ``known`` holds words met before."""
        known = known or WordTable(self)
        base = np.cumsum([0, *map(len, texts)])
        ids = known.ids([w for words in texts for w in words])
        every = self.slide(ids, known.gates)
        brief = [i for i, words in enumerate(texts) if 0 < len(words) < WINDOW]
        alone = {}
        if brief:
            at, mask = window_index(ids, base, np.array(brief), np.zeros(len(brief), np.int64), 0)
            alone = dict(zip(brief, self.logits(None, at, mask, gates=known.gates)))
        return [np.array([alone[i]]) if i in alone else every[base[i]:max(base[i], base[i + 1] - WINDOW + 1)]
                for i in range(len(texts))]


class WordTable:
    """Gate inputs of the words met by a task; row 0 is padding. Full, it starts anew, so it stays bounded."""

    def __init__(self, model: BiGRU, most: int = WORDS_KEPT):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.gates = self.model.gates(np.zeros((1, WORD_DIMS + CHAR_DIMS), np.float32))

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) > self.most:
            self.clear()
        places, first = self.places, len(self.places) + 1
        ids = list(map(places.get, words))
        if None in ids:
            ids = [places.setdefault(w, len(places) + 1) if i is None else i for w, i in zip(words, ids)]
        if len(places) >= first:
            fresh = list(islice(reversed(places), len(places) - first + 1))[::-1]
            x = self.model.inputs(fresh)[0][:-1]
            self.gates = [np.concatenate([old, new]) for old, new in zip(self.gates, self.model.gates(x))]
        return np.array(ids, np.int64)


def window_index(ids, base, owner, start, padding):
    """Word rows and mask, (step, window), of the windows that begin at ``start`` of the texts ``owner``."""
    step = np.arange(WINDOW)[:, None]
    place = base[owner] + start + step
    inside = place < base[owner + 1]
    at = np.where(inside, ids[np.minimum(place, len(ids) - 1)], padding)
    return at, inside.astype(np.float32)


def _keys(word: bytes) -> set[bytes]:
    """What the first choice of windows looks at: the word and its beginnings."""
    return {word, word[:5] + b"*", word[:4] + b"*"}


def _likeliest(texts: list[list[bytes]], labels: np.ndarray) -> list[int]:
    """For each text the start of the window whose words have the highest log odds of the toxic class; what
    fewer than ``LEAST_SEEN`` toxic texts hold says nothing."""
    seen: list[Counter] = [Counter(), Counter()]
    for words, label in zip(texts, labels):
        seen[label].update({k for w in set(words) for k in _keys(w)})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    known = {k: max(0.0, np.log(c / n1) - np.log((seen[0][k] + 0.5) / n0))
             for k, c in seen[1].items() if c >= LEAST_SEEN}
    best = []
    for words in texts:
        value = np.array([max(known.get(k, 0.0) for k in _keys(w)) for w in words])
        total = np.concatenate([[0.0], np.cumsum(value ** 2)])
        starts = np.array(windows_of(len(words)))
        best.append(int(np.argmax(total[np.minimum(starts + WINDOW, len(words))] - total[starts])))
    return best


def train(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, least_steps: int = LEAST_STEPS,
          seed: int = SEED, batch: int = 64, rate: float = 0.01) -> BiGRU:
    """Fit a network to documents with toxic (1) and other (0) labels.

    Texts without words are left out. Few documents are seen more often, until ``least_steps`` steps are done.
    If a class is missing, the scores move towards the other one.
    """
    kept = [(t, y) for t, y in zip(texts, labels) if t]
    model = BiGRU(seed)
    if not kept:
        return model
    rng = np.random.default_rng(seed)
    texts, labels = [t for t, _ in kept], np.array([y for _, y in kept])
    toxic = int(labels.sum())
    weight = min(8.0, max(1.0, (len(labels) - toxic) / max(1, toxic)))  # of a toxic window
    chosen = _likeliest(texts, labels)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    steps = -(-len(texts) // batch)
    epochs = max(epochs, -(-least_steps // steps))
    by_odds = epochs // 3  # epochs before the network chooses the windows
    step, chose = 0, 0
    mean: dict[str, np.ndarray] = {}
    averaged_from = int((1 - AVERAGED) * epochs * steps)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        again = epoch >= by_odds and step - chose >= steps * (epochs // 12)
        chose = step if again else chose
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            if again:
                for r, scores in zip(rows, model.window_scores([texts[r] for r in rows])):
                    chosen[r] = int(np.argmax(scores))
            window = [(r, chosen[r]) for r in rows]
            for r in rows:
                if not labels[r]:
                    starts = windows_of(len(texts[r]))
                    window += [(r, starts[i]) for i in rng.integers(len(starts), size=OTHERS)]
            target = np.array([labels[r] for r, _ in window])
            some = [texts[r][s:s + WINDOW] for r, s in window]
            table: dict[bytes, int] = {}
            ids = np.array([table.setdefault(w, len(table)) for words in some for w in words], np.int64)
            at, mask = window_index(ids, np.cumsum([0, *map(len, some)]), np.arange(len(some)),
                                    np.zeros(len(some), np.int64), len(table))
            g = model.gradients(list(table), at, mask, target, np.where(target, weight, 1).astype(np.float32))
            step += 1
            pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / (epochs * steps))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink = min(1.0, 5.0 / max(norm, 1e-9))
            for name, v in g.items():
                v = v * shrink
                first[name] += 0.1 * (v - first[name])
                second[name] += 0.005 * (v * v - second[name])
                model.p[name] -= (pace * (first[name] / (1 - 0.9 ** step))
                                  / (np.sqrt(second[name] / (1 - 0.995 ** step)) + 1e-6)).astype(np.float32)
            if step > averaged_from:
                share = np.float32(1 / (step - averaged_from))
                for name, v in model.p.items():
                    mean[name] = mean[name] + share * (v - mean[name]) if name in mean else v.copy()
    model.p = mean or model.p
    return model


def text_scores(model: BiGRU, texts: list[str | None], known: WordTable | None = None) -> np.ndarray:
    """The largest window score of each text, 0 to 1; a text without words has score 0. ``known``: words met before.

    Texts are scored together in chunks; a long one is cut into spans that overlap by a window less a word, so
    their windows are those of the whole text.
    """
    out = np.zeros(len(texts))
    known = known or WordTable(model)
    held: list[list[bytes]] = []
    whose: list[int] = []
    size = 0

    def score():
        for i, values in zip(whose, model.window_scores(held, known)):
            if len(values):
                out[i] = max(out[i], float(_sigmoid(values.max())))

    for i, text in enumerate(texts):
        words = words_of(text)
        cuts = [words] if len(words) <= CHUNK_WORDS else [
            words[a:a + CHUNK_WORDS + WINDOW - 1] for a in range(0, len(words) - WINDOW + 1, CHUNK_WORDS)]
        for part in cuts:
            held.append(part)
            whose.append(i)
            size += len(part)
            if size >= CHUNK_WORDS:
                score()
                held, whose, size = [], [], 0
    if held:
        score()
    return out


def training_sample(docs: DataFrame, known: DataFrame, sample: int, sample_words: int) -> tuple[list, list]:
    """Words and labels of at most ``sample`` documents of each class.

    Ids are chosen from narrow rows; only the chosen ones' texts travel, and those are brief, so that the
    sample is bounded in bytes too (no text is cut).
    """
    brief = F.length("text").between(1, 12 * sample_words)
    sizes = docs.where(brief).select("doc_id").distinct().join(known, "doc_id")
    ids = None
    for label in (0, 1):
        one = sizes.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = one if ids is None else ids.unionByName(one)
    ids = cut_lineage(ids)  # at most twice ``sample`` rows
    rows = docs.where(brief).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [words_of(r["text"]) for r in rows], [r["label"] for r in rows]


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Learns from labelled rows whose crc32 of the id modulo ``parts`` is not ``held``. Null and empty texts, and
    texts of punctuation alone, have score 0. Labels that are null or neither 0 nor 1 are not learnt from; of
    repeated labels the larger one counts, of repeated ids the smallest text. Documents without an id are scored and count as not held out. An
    empty table gives no rows; without labels the network is untrained.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out_of(F.col("doc_id"), parts, held))
    texts, marks = training_sample(chosen, known.groupBy("doc_id").agg(F.max("label").alias("label")),
                                   sample, sample_words)
    model = train(texts, marks)

    def run(batches):
        known = WordTable(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_scores(model, batch.column(1).to_pylist(), known), pa.float64())],
                ["doc_id", "score"])

    return chosen.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out_of(F.col("doc_id"), parts, held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
