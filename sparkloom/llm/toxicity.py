"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling, byte_symbols, mix, word_symbols
from .common import free_worker, give_back, short_batches, text_or_empty

WINDOW, STRIDE = 64, 48
GRAM = 5
#: Pairs of a document and a form whose n-grams are counted at once.
PAIRS = 100_000
#: Rows of the tables of trained vectors, one for hashed words and one for hashed character n-grams, and the width of both.
WORD_ROWS, GRAM_ROWS, WIDTH = 1 << 14, 1 << 15, 8
#: Inputs of a word: its vector, the mean of its n-grams' vectors, and one number of counted evidence.
INPUTS = 2 * WIDTH + 1
#: Documents are trained on with evidence that was counted in other parts of the sample.
FOLDS = 5


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


@dataclass
class Tokens:
    """Words (runs of letters, digits and bytes above 127, lower-cased) of several texts, and their distinct forms."""

    of_text: np.ndarray  # index of each word's text
    form: np.ndarray  # index of each word's form
    words: np.ndarray  # hash of each form
    grams: np.ndarray  # hashes of the forms' n-grams, one form after another
    first_gram: np.ndarray  # where each form's n-grams begin


def tokens(texts: list[bytes]) -> Tokens:
    data = _lower(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8))
    letter = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    ends_of_text = np.cumsum([len(x) + 1 for x in texts])
    of_text = np.searchsorted(ends_of_text, starts, side="right")
    hashes = word_symbols(data, starts, ends)
    distinct, at, form = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    n_grams = np.maximum(e - s + 2 - GRAM + 1, 1)  # the form has one mark before and one after it
    first = np.cumsum(n_grams) - n_grams
    spelled = np.cumsum(e - s + 2) - (e - s + 2)
    flat = np.full(int((e - s + 2).sum()) + GRAM, 32, dtype=np.uint8)
    inside = np.repeat(spelled + 1 - (np.cumsum(e - s) - (e - s)), e - s) + np.arange(int((e - s).sum()))
    source = np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange(int((e - s).sum()))
    flat[inside] = data[source]
    gram_at = np.repeat(spelled - first, n_grams) + np.arange(int(n_grams.sum()))
    grams = Rolling(byte_symbols()[flat]).of(gram_at, GRAM) if len(gram_at) else np.zeros(0, dtype=np.uint64)
    return Tokens(of_text, form, distinct, grams, first)


def window_starts(of_text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of every overlapping window."""
    count = np.bincount(of_text, minlength=n_texts)
    begin = np.cumsum(count) - count
    n_win = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(n_texts), n_win)
    nth = np.arange(int(n_win.sum())) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    start = begin[text] + nth * STRIDE
    return text, start, np.minimum(WINDOW, begin[text] + count[text] - start)


@dataclass
class Odds:
    """Log odds of hashed forms, sorted by hash; those met in one document only are left out."""

    keys: np.ndarray
    value: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, hit: np.ndarray, total: np.ndarray) -> Odds:
        """From the numbers of clean and toxic documents that have each of ``keys``, and of all."""
        n = hit[0] + hit[1]
        keep = n > 1
        n, hit = n[keep], hit[:, keep]
        raw = np.log((hit[1] + 0.5) / (total[1] + 1)) - np.log((hit[0] + 0.5) / (total[0] + 1))
        return cls(keys[keep], (raw * n / (n + 6.0)).astype(np.float32), (n / (n + 3.0)).astype(np.float32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each hash and how well it is known; 0 for others."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.float32), np.zeros(len(hashes), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        same = self.keys[at] == hashes
        return np.where(same, self.value[at], np.float32(0)), np.where(same, self.known[at], np.float32(0))


@dataclass
class Evidence:
    """How much more often words and n-grams occur in toxic than in clean documents, as log odds."""

    words: Odds
    grams: Odds

    @classmethod
    def of(cls, t: Tokens, labels: np.ndarray, fold: np.ndarray) -> tuple[Evidence, np.ndarray]:
        """Counted by document, n-grams for a few documents at a time: of all documents; and the inputs of the forms by what all but each of FOLDS
        parts have."""
        n_forms = max(1, len(t.words))
        seen = np.unique(t.of_text * np.int64(n_forms) + t.form)
        text, form = seen // n_forms, seen % n_forms
        kind = labels * FOLDS + fold
        total = np.bincount(kind, minlength=2 * FOLDS).reshape(2, FOLDS)
        many = np.diff(np.append(t.first_gram, len(t.grams)))
        keys, gram = np.unique(t.grams, return_inverse=True)
        of_words, of_grams = np.zeros(2 * FOLDS * n_forms, dtype=np.int32), np.zeros(2 * FOLDS * max(1, len(keys)), dtype=np.int32)
        np.add.at(of_words, kind[text] * n_forms + form, 1)
        cuts = np.append(np.unique(np.searchsorted(text, text[::PAIRS])), len(text))  # where texts begin
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = many[form[a:b]]
            at = np.repeat(t.first_gram[form[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            once = np.unique(np.repeat(text[a:b], n) * np.int64(len(keys)) + gram[at])
            np.add.at(of_grams, kind[once // len(keys)] * len(keys) + once % len(keys), 1)
        words, grams = of_words.reshape(2, FOLDS, -1), of_grams.reshape(2, FOLDS, -1)

        def without(f: int | None) -> Evidence:
            less = lambda x: x.sum(axis=1, dtype=np.int32) - (0 if f is None else x[:, f])
            return cls(Odds.of(t.words, less(words)[:, : len(t.words)], less(total)), Odds.of(keys, less(grams)[:, : len(keys)], less(total)))

        return without(None), np.stack([without(f).inputs(t) for f in range(FOLDS)])

    def inputs(self, t: Tokens) -> np.ndarray:
        """Of each form: its own evidence as far as it is known, and for the rest that of its strongest n-gram."""
        if not len(t.words):
            return np.zeros(0, dtype=np.float32)
        word, known = self.words.find(t.words)
        strongest = np.maximum.reduceat(self.grams.find(t.grams)[0], t.first_gram)
        return (np.where(known > 0, word, 0) + (1 - known) * strongest).astype(np.float32) / 4


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` that go to the same row."""
    return np.stack([np.bincount(row, weights=v, minlength=rows) for v in values.T], axis=1).astype(values.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Vectors of hashed words and character n-grams, gated recurrent units in both directions, attention over their states, one logistic output."""

    hidden: int = 8
    seed: int = 5
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, h = np.random.default_rng(self.seed), self.hidden
        for way in "fb":
            self.p["W" + way] = rng.normal(0, 0.3, (INPUTS, 3 * h))
            self.p["U" + way] = rng.normal(0, 0.3, (h, 3 * h))
            self.p["b" + way] = np.zeros(3 * h)
        self.p |= {"words": rng.normal(0, 0.1, (WORD_ROWS, WIDTH)), "grams": rng.normal(0, 0.1, (GRAM_ROWS, WIDTH))}
        self.p |= {"A": rng.normal(0, 0.3, (2 * h, h)), "a": np.zeros(h), "v": rng.normal(0, 0.3, h), "w": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def inputs(self, t: Tokens, evidence: np.ndarray) -> np.ndarray:
        """Of each form."""
        if not len(t.words):
            return np.zeros((0, INPUTS), dtype=np.float32)
        n = np.diff(np.append(t.first_gram, len(t.grams)))[:, None]
        of_grams = np.add.reduceat(self.p["grams"][(t.grams % np.uint64(GRAM_ROWS)).astype(np.int64)], t.first_gram, axis=0) / n
        return np.concatenate((self.p["words"][(t.words % np.uint64(WORD_ROWS)).astype(np.int64)], of_grams, evidence[:, None]), axis=1).astype(np.float32)

    def vector_gradients(self, t: Tokens, g: np.ndarray) -> dict[str, np.ndarray]:
        """Of both tables, from those of the inputs of forms."""
        n = np.diff(np.append(t.first_gram, len(t.grams)))
        words = _sums((t.words % np.uint64(WORD_ROWS)).astype(np.int64), g[:, :WIDTH], WORD_ROWS)
        grams = _sums((t.grams % np.uint64(GRAM_ROWS)).astype(np.int64), np.repeat(g[:, WIDTH : 2 * WIDTH] / n[:, None], n, axis=0), GRAM_ROWS)
        return {"words": words, "grams": grams}

    def _run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, way: str, tape: list | None) -> np.ndarray:
        """States (time, window, hidden) in one direction; ``gates`` has the input's part for each form."""
        h, U = self.hidden, self.p["U" + way]
        steps, n = index.shape
        out = np.zeros((steps, n, h), dtype=np.float32)
        state = np.zeros((n, h), dtype=np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, q = gates[index[t]], state @ U
            zr = _sigmoid(x[:, : 2 * h] + q[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * q[:, 2 * h :])
            m = mask[t][:, None]
            after = np.where(m, new + z * (state - new), state)
            if tape is not None:
                tape.append((t, state, z, r, new, q[:, 2 * h :]))
            out[t] = state = after
        return out

    def logits(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Of windows; ``index`` (time, window) tells the row of ``inputs``, ``mask`` where a word is."""
        p, tapes = self.p, ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._run(inputs @ p["W" + w] + p["b" + w], index, mask, w, t) for w, t in zip("fb", tapes, strict=True)], axis=2)
        key = np.tanh(states @ p["A"] + p["a"])
        e = np.where(mask, key @ p["v"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if tape is not None:
            tape |= {"tapes": tapes, "states": states, "key": key, "weight": weight, "pooled": pooled}
        return pooled @ p["w"] + p["c"]

    def gradients(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by back-propagation through time."""
        p, h, tape = self.p, self.hidden, {}
        d = (_sigmoid(self.logits(inputs, index, mask, tape)) - labels) / len(labels)
        states, key, weight = tape["states"], tape["key"], tape["weight"]
        g = {"w": tape["pooled"].T @ d, "c": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["w"]
        d_weight = (states * d_pool).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.tensordot(d_e, key, ((0, 1), (0, 1)))
        d_key = d_e[:, :, None] * p["v"] * (1 - key**2)
        g["A"] = np.tensordot(states, d_key, ((0, 1), (0, 1)))
        g["a"] = d_key.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pool + d_key @ p["A"].T
        g["inputs"] = np.zeros_like(inputs)
        for side, way in enumerate("fb"):
            U = p["U" + way]
            gU, by_step = np.zeros_like(U), np.zeros((*index.shape, 3 * h), dtype=inputs.dtype)
            carry = np.zeros((index.shape[1], h), dtype=np.float32)
            for t, before, z, r, new, q in reversed(tape["tapes"][side]):
                m = mask[t][:, None]
                d_after = carry + d_states[t][:, side * h : side * h + h]
                live = d_after * m
                d_new = live * (1 - z) * (1 - new**2)
                d_z = live * (before - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
                gU += before.T @ d_q
                by_step[t] = d_gate
                carry = d_after * ~m + live * z + d_q @ U.T
            of_gates = _sums(index.ravel(), by_step.reshape(-1, 3 * h), len(inputs))
            g |= {"W" + way: inputs.T @ of_gates, "U" + way: gU, "b" + way: of_gates.sum(axis=0)}
            g["inputs"] += of_gates @ p["W" + way].T
        return g


def _window_index(t: Tokens, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(int(size.max(initial=1)))[:, None]
    mask = step < size
    return np.where(mask, t.form[np.minimum(start + step, max(0, len(t.form) - 1))], 0), mask


@dataclass
class Model:
    evidence: Evidence
    network: Network

    def scores(self, texts: list[bytes], at_once: int = 2048) -> np.ndarray:
        """The highest score of any window of each text; 0 for a text without words."""
        out = np.zeros(len(texts))
        t = tokens(texts)
        inputs = self.network.inputs(t, self.evidence.inputs(t))
        text, start, size = window_starts(t.of_text, len(texts))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), at_once):
            part = order[at : at + at_once]
            index, mask = _window_index(t, start[part], size[part])
            np.maximum.at(out, text[part], _sigmoid(self.network.logits(inputs, index, mask)))
        return out


def without_near_copies(texts: list[bytes]) -> np.ndarray:
    """Indexes of texts that share fewer than two of four minima of hashed five-word shingles with each earlier
    one. Words of a text that was copied often would else look like evidence."""
    seen: list[set[int]] = [set() for _ in range(4)]
    kept = []
    for i, text in enumerate(texts):
        t = tokens([text])
        of_word = t.words[t.form]
        grams = Rolling(mix(of_word)).of(np.arange(max(1, len(of_word) - 4)), min(5, len(of_word))) if len(of_word) else np.zeros(1, dtype=np.uint64)
        minima = [int(mix(grams + np.uint64(k)).min()) for k in range(4)]
        if sum(m in s for m, s in zip(minima, seen, strict=True)) < 2:
            kept.append(i)
        for m, s in zip(minima, seen, strict=True):
            s.add(m)
    return np.array(kept, dtype=np.int64)


def _part_of(t: Tokens, forms: np.ndarray) -> Tokens:
    """Some forms of ``t``, without their texts."""
    n = np.diff(np.append(t.first_gram, len(t.grams)))[forms]
    at = np.repeat(t.first_gram[forms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return Tokens(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), t.words[forms], t.grams[at], np.cumsum(n) - n)


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 3, epochs: int = 3, batch: int = 128, windows: int = 4000, least_steps: int = 60, rate: float = 0.01, decay: float = 1e-3, blind: float = 0.3, seed: int = 5) -> Model:
    """Fit on whole labelled documents, one of each group of near copies. The evidence that goes with a document is counted
    without its fold. A document is represented by one window: first the one with most evidence, in later rounds the one that the network so far finds most toxic. Clean documents
    are represented by the hardest windows of all and by random ones, too; there are ``windows`` of them at most. In a share ``blind`` of the windows the
    evidence is hidden, so that vectors learn to tell. Few windows are gone through more often, until ``least_steps`` steps a round were made."""
    rng = np.random.default_rng(seed)
    kept = without_near_copies(texts)
    texts, labels = [texts[i] for i in kept], labels[kept].astype(np.int64)
    t = tokens(texts)
    fold = np.empty(len(texts), dtype=np.int64)
    for v in (0, 1):
        of_label = rng.permutation(np.flatnonzero(labels == v))
        fold[of_label] = np.arange(len(of_label)) % FOLDS
    everything, evidence = Evidence.of(t, labels, fold)
    model = Model(everything, Network(seed=seed))
    net = model.network
    text, start, size = window_starts(t.of_text, len(texts))
    if len(set(labels.tolist())) < 2 or not len(text):
        net.p = {k: x * 0 for k, x in net.p.items()}
        net.p["c"] = np.full(1, -5.0 if not labels.any() else 5.0, dtype=np.float32)
        return model
    n_forms = len(t.words)
    total = np.concatenate(([0.0], np.cumsum(np.maximum(evidence[fold[t.of_text], t.form] - 0.25, 0))))
    worth = total[start + size] - total[start]
    clean = np.flatnonzero(labels[text] == 0)
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    for turn in range(rounds):
        best = np.lexsort((-worth, text))
        best = best[np.concatenate(([True], np.diff(text[best]) > 0))]
        some = rng.permutation(clean)[: len(best) // 2]
        hard = clean[np.argsort(-worth[clean], kind="stable")][: len(best) // 2]
        chosen = rng.permutation(np.unique(np.concatenate([best, some, hard])))[:windows]
        index, mask = _window_index(t, start[chosen], size[chosen])
        y = labels[text[chosen]].astype(np.float32)
        parts = max(1, len(chosen) // batch)
        for _ in range(max(epochs, -(-least_steps // parts))):
            for part in np.array_split(rng.permutation(len(chosen)), parts):
                step += 1
                # a row for each form and fold, and one without evidence
                row = np.where(rng.random(len(part)) < blind, FOLDS, fold[text[chosen[part]]])
                both, at = np.unique(index[:, part] + row * n_forms, return_inverse=True)
                few = _part_of(t, both % n_forms)
                seen = np.where(both < FOLDS * n_forms, evidence[np.minimum(both // n_forms, FOLDS - 1), both % n_forms], 0)
                grads = net.gradients(net.inputs(few, seen), at.reshape(index[:, part].shape), mask[:, part], y[part])
                grads |= net.vector_gradients(few, grads.pop("inputs"))
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g**2 - v)
                    change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                    net.p[k] = (net.p[k] - rate * change - (rate * decay) * net.p[k]).astype(np.float32)
        if turn + 1 < rounds:
            worth = np.zeros(len(text))
            for f in range(FOLDS):
                inputs = net.inputs(t, evidence[f])
                of_fold = np.flatnonzero(fold[text] == f)
                for at in range(0, len(of_fold), 2048):
                    part = of_fold[at : at + 2048]
                    index, mask = _window_index(t, start[part], size[part])
                    worth[part] = net.logits(inputs, index, mask)
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, toxic_rows: int = 1200, clean_rows: int = 2000, longest: int = 16_384) -> Model:
    """Train on a bounded sample: at most ``toxic_rows`` and ``clean_rows`` labelled rows in the order of a hash of
    doc_id, of texts of up to ``longest`` bytes, and none whose crc32(doc_id as text) mod 4 is ``held_out``."""
    may = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (_part() != held_out))
    each = may.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [each.where(F.col("toxic") == v).orderBy(*order).limit(2 * n) for v, n in ((1, toxic_rows), (0, clean_rows))]
    wanted = few[0].unionByName(few[1])  # of bounded size
    text = docs.where(F.octet_length(text_or_empty()) <= longest).select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")
    # one text of each doc_id, however often it repeats
    rows = text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    rows = rows.sample(frac=1.0, random_state=7)
    rows = rows[rows.groupby("toxic").cumcount() < np.where(rows["toxic"] == 1, toxic_rows, clean_rows)]
    return train([x.encode() for x in rows["text"]], rows["toxic"].to_numpy())


def _part():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 2, model: Model | None = None) -> DataFrame:
    """Score every whole text of ``docs`` (``doc_id, text``; its other columns are kept).

    A text is cut in windows of 64 words, each 48 after the last, all of which are scored; the highest
    counts. A word enters by a vector of its hash, the mean of the vectors of its hashed character n-grams (so unseen forms of a
    known stem count), both trained with the network, and one number of counted evidence. A network of gated recurrent units reads each window in both directions, and
    attention pools its states. The model is trained here, on labels outside the held-out quarter
    (``fit``), unless one is given.

    Null and empty texts, and texts without a letter or digit, have score 0. Without labels of both classes
    every text with a word gets one score. Rows with equal doc_id are scored each; a null doc_id is
    not held out. Columns of ``docs`` named like those added are replaced. An empty table gives an
    empty result. Adds ``held_out, score, predicted``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    model = fit(docs, labels, held_out) if model is None else model
    give_back()
    fitted = spark.sparkContext.broadcast(model)  # tables of the words of a bounded sample, and small matrices

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_worker()
        for batch in texts:
            yield pa.array(fitted.value.scores([x.as_buffer().to_pybytes() for x in batch]))
        free_worker()

    rest = docs.drop("held_out", "score", "predicted")
    return (
        rest.withColumn("held_out", F.coalesce(_part() == held_out, F.lit(False)))
        .withColumn("score", score(text_or_empty().cast("binary")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
