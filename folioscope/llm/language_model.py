"""Log-probabilities of texts by a log-bilinear neural model.

Words are counted over all training documents. The most frequent ones are classes
of their own; every other word, seen or not, belongs to one of TAILS classes by its
last two bytes, and within it has its smoothed share of the class's count. The
neural part predicts the next class from the two before it: the classes' vectors,
weighted by place, add up to a prediction whose products with the target vectors,
plus a bias, are scores. It is trained in numpy by noise-contrastive estimation, in
every partition over all its tokens, and the partitions' parameters are averaged by
their tokens. Scoring multiplies batches of contexts with all targets for the exact
normaliser of each pair of classes, so the probabilities of all words sum to one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written

#: Classes: two fixed ones, the most frequent words, the tails.
START, END = 0, 1
HEADS, TAILS = 446, 64
CLASSES = 2 + HEADS + TAILS
#: Numbers of a vector, noise classes and tokens of a step, rate of learning.
WIDTH, NOISE, STEP, RATE = 12, 16, 8192, 0.15
#: Words whose counts are sent to every task (about 20 bytes each); the others'
#: counts are joined.
SENT = 131_072
#: Words that a worker remembers, distinct words after which it passes counts on.
MEMORY, FLUSH = 600_000, 300_000
_READY: dict[str, object] = {}


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def tail(word: bytes) -> int:
    return 2 + HEADS + zlib.crc32(word[-2:]) % TAILS


def counts(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """``word, n`` over the training rows; the empty word is the end of a text.
    Words are summed per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(split(text.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    rows = docs.where(training).select(F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: the words sent and their counts, by falling count;
    totals; tokens and distinct words of each class."""

    name: str
    words: list[bytes]
    seen: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray


def vocabulary(counted: DataFrame, name: str) -> Vocabulary:
    """From the table of counts. The words sent are those of a count or more,
    chosen so that there are at most SENT; nothing else comes to the driver."""
    step = F.floor(4 * F.log2(F.col("n").cast("double"))).alias("step")
    steps = counted.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    room, least = SENT, None
    for r in steps:
        room -= r.words
        if room < 0:
            break
        least = r.least
    sent = counted.where(F.col("n") >= least).toArrow() if least is not None else counted.limit(0).toArrow()
    pairs = sorted(zip(sent.column(1).to_pylist(), sent.column(0).to_pylist()), key=lambda x: (-x[0], x[1]))
    ends = next((n for n, w in pairs if not w), 0)
    if not ends:  # rarer than any word sent
        found = counted.where(F.octet_length("word") == 0).first()
        ends = found.n if found else 0
    pairs = [(n, w) for n, w in pairs if w]
    cls = F.pmod(F.crc32(F.substring("word", F.greatest(F.octet_length("word") - 1, F.lit(1)), F.lit(2))), F.lit(TAILS)).alias("tail")
    by_class = counted.where(F.octet_length("word") > 0).groupBy(cls).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[END], distinct[END] = ends, ends > 0
    for r in by_class:
        tokens[2 + HEADS + r.tail], distinct[2 + HEADS + r.tail] = r.n, r.words
    total, every = int(tokens.sum()), int(distinct.sum())
    for k, (n, w) in enumerate(pairs[:HEADS]):
        tokens[2 + k], distinct[2 + k] = n, 1
        tokens[tail(w)] -= n
        distinct[tail(w)] -= 1
    return Vocabulary(name, [w for _, w in pairs], np.array([n for n, _ in pairs], np.int64), total, every, tokens, distinct)


class Codes(dict):
    """Word to code: its rank among the words sent, or their number plus its class."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.sent = len(words)

    def __missing__(self, word: bytes) -> int:
        code = self.sent + tail(word)
        if len(self) > MEMORY + self.sent:
            for w in list(self)[self.sent :]:
                del self[w]
        self[word] = code
        return code


class Coder:
    """One per worker and vocabulary: texts to codes, codes to classes."""

    def __init__(self, v: Vocabulary) -> None:
        self.codes = Codes(v.words)
        self.classes = np.concatenate([
            np.array([2 + k if k < HEADS else tail(w) for k, w in enumerate(v.words)], np.int64), np.arange(CLASSES),
        ])

    @classmethod
    def of(cls, v: Vocabulary) -> Coder:
        if v.name not in _READY:
            _READY.clear()
            _READY[v.name] = cls(v)
        return _READY[v.name]

    def code(self, words: list[bytes]) -> np.ndarray:
        """Codes of a text's words and its end."""
        out = np.empty(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        out[-1] = self.codes.sent + END
        return out

    def contexts(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token of the texts and of the two before it."""
        pad = np.array([START, START])
        rows = np.concatenate([x for c in codes for x in (pad, self.classes[c])])
        keep = np.ones(len(rows), bool)
        begin = np.cumsum([0] + [len(c) + 2 for c in codes[:-1]])
        keep[begin] = keep[begin + 1] = False
        at = np.flatnonzero(keep)
        return rows[at - 2], rows[at - 1], rows[at]


@dataclass
class Model:
    """Context vectors, weights by place, target vectors, biases."""

    r: np.ndarray
    c: np.ndarray
    t: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, shares: np.ndarray) -> Model:
        random = np.random.default_rng(0)
        vectors = lambda: random.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        return cls(vectors(), np.ones((2, WIDTH), np.float32), vectors(), np.log(shares).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.c, self.t, self.b)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        n = CLASSES * WIDTH
        r, c, t, b = np.split(flat.astype(np.float32), [n, n + 2 * WIDTH, 2 * n + 2 * WIDTH])
        return cls(r.reshape(CLASSES, WIDTH), c.reshape(2, WIDTH), t.reshape(CLASSES, WIDTH), b)

    def predict(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[far] + self.c[1] * self.r[near]


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps with rates that fall by each parameter's gradients."""

    def __init__(self, shares: np.ndarray) -> None:
        self.model, self.shares, self.random = Model.start(shares), shares, np.random.default_rng(1)
        self.sums = Model(*(np.full_like(x, 1e-2) for x in (self.model.r, self.model.c, self.model.t, self.model.b)))
        self.offset = np.log(NOISE * shares).astype(np.float32)
        self.ladder = np.cumsum(shares)

    def step(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.ladder, self.random.random(NOISE)), CLASSES - 1)
        q, t, n = m.predict(far, near), m.t[target], m.t[noise]
        real = np.einsum("ij,ij->i", q, t) + (m.b - self.offset)[target]
        false = q @ n.T
        false += m.b[noise] - self.offset[noise]
        up, down = _logistic(real), -_logistic(np.negative(false, out=false))  # how far from certain of the truth
        dq = up[:, None] * t + down @ n
        self._add("t", [(target, up[:, None] * q), (noise, down.T @ q)])
        self._add("b", [(target, up), (noise, down.sum(axis=0))])
        dc = np.stack([np.einsum("ij,ij->j", dq, m.r[x]) for x in (far, near)])
        self._add("r", [(far, dq * m.c[0]), (near, dq * m.c[1])])
        self.sums.c += dc * dc
        m.c += RATE * dc / np.sqrt(self.sums.c)

    def _add(self, name: str, slopes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        value, sums = getattr(self.model, name), getattr(self.sums, name)
        total = np.zeros(value.shape, np.float32)
        for rows, slope in slopes:
            for column, part in zip(total.T.reshape(-1, CLASSES), slope.T.reshape(-1, len(rows))):
                column += np.bincount(rows, part, CLASSES)
        sums += total * total
        value += RATE * total / np.sqrt(sums)


def shares_of(v: Vocabulary) -> np.ndarray:
    n = v.class_tokens + 1.0
    n[START] = 1e-6  # never a target
    return n / n.sum()


def train(docs: DataFrame, training: Column, v: Vocabulary, text_col: str = "text") -> Model:
    """The model averaged over partitions. What is gathered, a row per parameter
    and partition, grows with the corpus and is summed before it is shuffled."""
    shares = shares_of(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, trainer = Coder.of(v), Trainer(shares)
        held, waiting, tokens = [], 0, 0

        def learn(last: bool) -> None:
            nonlocal held, waiting
            if not held:
                return
            far, near, target = coder.contexts(held)
            for at in range(0, len(target), STEP):
                cut = slice(at, at + STEP)
                trainer.step(far[cut], near[cut], target[cut])
            held, waiting = [], 0

        for b in batches:
            for text in b.column(0):
                held.append(coder.code(split(text.as_py())))
                waiting += len(held[-1])
                tokens += len(held[-1])
                if waiting >= 16 * STEP:
                    learn(False)
        learn(True)
        if tokens:
            flat = pa.array([trainer.model.flat().astype(np.float64)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), flat], ["tokens", "flat"])

    parts = docs.where(training).select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "tokens bigint, flat array<double>")
    rows = parts.select("tokens", F.posexplode("flat").alias("at", "value"))
    mean = (F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")).alias("value")
    found = rows.groupBy("at").agg(mean).orderBy("at").toArrow().column(1).to_numpy()  # as many as parameters
    return Model.of(found) if len(found) else Model.start(shares)


class Scorer:
    """One per worker and model: log10 of class probabilities."""

    def __init__(self, model: Model) -> None:
        self.model, self.norms = model, np.full(CLASSES * CLASSES, np.nan, np.float32)

    def classes(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        m, pair = self.model, far * CLASSES + near
        missing = np.unique(pair[np.isnan(self.norms[pair])])
        for at in range(0, len(missing), STEP):
            some = missing[at : at + STEP]
            s = m.predict(some // CLASSES, some % CLASSES) @ m.t.T + m.b
            s[:, START] = -np.inf
            top = s.max(axis=1)
            self.norms[some] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        s = np.einsum("ij,ij->i", m.predict(far, near), m.t[target]) + m.b[target]
        return (s - self.norms[pair]).astype(np.float64) / np.log(10)


def score(docs: DataFrame, counted: DataFrame, v: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score``, one row per doc_id: rows
    that share an id, or have none, are parts of one document and add up. A null
    text is empty and has its end alone. Other columns are ignored."""
    n_class = (v.class_tokens + v.class_distinct + 1).astype(np.float64)
    single = np.zeros(CLASSES, bool)
    single[: 2 + HEADS] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(v)
        if "scorer" not in _READY or _READY["scorer"].model.flat().tobytes() != model.flat().tobytes():
            _READY["scorer"] = Scorer(model)
        scorer = _READY["scorer"]
        known = np.concatenate([v.seen, np.zeros(CLASSES, np.int64)])
        known[coder.codes.sent + END] = v.class_tokens[END]
        logs = np.log10(known + 1.0)
        # a word's share of its class; a word not sent gets its count by join
        inner = np.where(single[coder.classes], 0.0, logs - np.log10(n_class[coder.classes]))

        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            codes = [coder.code(words) for words in texts]
            sizes = np.array([len(c) for c in codes])
            begin = np.cumsum(sizes) - sizes
            flat = np.concatenate(codes)
            neural = scorer.classes(*coder.contexts(codes)) + inner[flat]
            per = lambda x: np.add.reduceat(x, begin)
            words, times = [], []
            for c, text in zip(codes, texts):
                rare = Counter(text[i] for i in np.flatnonzero(c[:-1] >= coder.codes.sent))
                words.append(list(rare))
                times.append(list(rare.values()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(per((known[flat] > 0).astype(np.int64))),
                    pa.array(per(logs[flat])), pa.array(per(neural)), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_tokens", "n_known", "base", "neural", "words", "times"],
            )

        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0), b.column(1)):
                ids.append(doc.as_py())
                texts.append(split(text.as_py()))
                size += len(texts[-1]) + 1
                if size >= 64 * STEP:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base double, neural double, words array<binary>, times array<bigint>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("doc_id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    log = F.col("times") * F.log10(F.col("n") + 1.0)
    joined = rare.join(counted, "word").select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.col("times").alias("n_known"), log.alias("base"), log.alias("neural"))
    whole = scored.select("doc_id", "n_tokens", "n_known", "base", "neural").union(joined)
    per_token = float(np.log10(v.tokens + v.distinct + 1))
    return whole.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        (F.sum("base") - F.sum("n_tokens") * per_token).alias("base_score"), F.sum("neural").alias("score"),
    )


def score_corpus(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model learned from those that the condition
    ``held_out`` does not hold for (or is null for). Adds ``held_out`` and
    ``train_tokens``. Without training rows every word is new."""
    training = ~F.coalesce(F.expr(held_out), F.lit(False))
    counted = written(counts(docs, training, text_col), "counts")
    v = vocabulary(counted, counted.inputFiles()[0] if counted.inputFiles() else "none")
    model = train(docs, training, v, text_col)
    return score(docs, counted, v, model, id_col, text_col).withColumns(
        {"held_out": F.coalesce(F.expr(held_out.replace(id_col, "doc_id")), F.lit(False)), "train_tokens": F.lit(v.tokens).cast("bigint")}
    )
