"""Language identification by a linear-chain conditional random field over words.

Every word has a hidden language.  Its emission scores come from hashed features - the whole word (lexicon),
prefixes and suffixes, and byte n-grams - and neighbouring words are tied by learned transition scores.
Forward-backward gives each word's marginal distribution, so code-switched texts are labelled word by word; a document's language is the one
with the largest mean marginal over its words with letters, and that mean is its score.

Training is on the driver over a bounded sample: the documents of each language that come first by a
hash of their id, whole texts, up to a number and a number of bytes, and languages only from their labels.  Their runs of words are spliced into code-switched sequences, from which
the transitions are learned.  Prediction reads the text alone.

Forward-backward runs over all texts of a slice at once: sequences are cut into blocks, each block's transfer matrix is
multiplied up in step with all others, block boundaries are solved in order, and the blocks are then filled in.  The result is
that of the plain recursion over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._text import LOWER, NON_SPACE, _power, forget_powers, mix, slices, words

BUCKETS = 1 << 16
#: Documents of a language in the sample, bytes of their texts (a first text of more is taken all the same), and languages at most.
PER_LANGUAGE, SAMPLE_BYTES, LANGUAGES = 150, 1 << 20, 256
BLOCK = 64
#: Bytes of text labelled at once; a longer single text is taken whole.
SLICE = 2 << 20
UNKNOWN = "und"
AFFIXES = (1, 2, 3, 4)
NGRAMS = (2, 3)

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters in UTF-8."""
    low = LOWER[data]
    if len(low) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of the words data[start:end]; data is lower case."""
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])

        def bucket(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = (total[b] - total[a]) * down[a] + np.uint64(kind) * np.uint64(0xD6E8FEB86659FD93)
            return (mix(h) >> np.uint64(48)).astype(np.int64)

        n = np.arange(len(start))
        out = [(n, bucket(1, start, end))]
        for k in AFFIXES:
            out.append((n, bucket(10 + k, start, np.minimum(start + k, end))))
            out.append((n, bucket(20 + k, np.maximum(end - k, start), end)))
        for k in NGRAMS:
            count = np.maximum(end - start - k + 1, 0)
            who = np.repeat(n, count)
            first = np.cumsum(count) - count
            a = start[who] + np.arange(len(who)) - first[who]
            out.append((who, bucket(30 + k, a, a + k)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _sum_rows(who: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(who, values[:, k], n) for k in range(values.shape[1])], axis=1)


def forward_backward(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, transition counts) of sequences e[first[i]:first[i + 1]] of positive emissions under transitions t.

    The state before a sequence is uniform.  Cost is in steps of BLOCK and of blocks in the longest sequence.
    """
    n, k = e.shape
    size = np.diff(first)
    keep = np.flatnonzero(size > 0)
    if not len(keep):
        return np.zeros((0, k)), np.zeros((k, k))
    size, head = size[keep], first[:-1][keep]
    blocks = -(-size // BLOCK)
    of = np.repeat(np.arange(len(keep)), blocks)
    place = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = head[of] + place * BLOCK
    length = np.minimum(size[of] - place * BLOCK, BLOCK)
    index = begin[:, None] + np.arange(BLOCK)
    valid = np.arange(BLOCK) < length[:, None]
    em = np.where(valid[:, :, None], e[np.minimum(index, n - 1)], 1.0)

    transfer = np.broadcast_to(np.eye(k), (len(of), k, k)).copy()
    for s in range(BLOCK):
        new = (transfer @ t) * em[:, s, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        transfer = np.where(valid[:, s, None, None], new, transfer)
    enter = np.full((len(of), k), 1.0 / k)  # forward state before each block
    leave = np.ones((len(of), k))  # backward state after each block
    last = np.cumsum(blocks) - 1
    order = np.argsort(-blocks, kind="stable")
    live = len(order)
    at0 = (last - blocks + 1)[order]
    counts = blocks[order]
    for s in range(1, int(blocks.max())):
        live = int(np.searchsorted(-counts, -s, "left"))
        at = at0[:live] + s
        x = np.einsum("ni,nij->nj", enter[at - 1], transfer[at - 1])
        enter[at] = x / x.sum(1, keepdims=True)
        at = last[order][:live] - s
        y = np.einsum("nij,nj->ni", transfer[at + 1], leave[at + 1])
        leave[at] = y / y.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, len(of), k))
    now = enter
    for s in range(BLOCK):
        x = (now @ t) * em[:, s]
        x /= x.sum(1, keepdims=True)
        now = np.where(valid[:, s, None], x, now)
        alpha[s] = now
    pair = np.zeros((k, k))
    out = np.empty((n, k))
    now = leave
    for s in range(BLOCK - 1, -1, -1):
        p = alpha[s] * now
        p /= p.sum(1, keepdims=True)
        ok = valid[:, s]
        out[index[ok, s]] = p[ok]
        before = alpha[s - 1] if s else enter
        step = em[:, s] * now
        joint = before[:, :, None] * t[None] * step[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pair += joint[ok].sum(0)
        x = step @ t.T
        now = np.where(ok[:, None], x / x.sum(1, keepdims=True), now)
    return out, pair


def _emissions(weights: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positive emissions, whether the word has a letter, first word of each text) of a slice."""
    start, end, first = words(data, off, NON_SPACE)
    low = _lowered(data)
    seen, inverse = _distinct(low, start, end)
    score = np.zeros((len(seen), weights.shape[1]))
    step = 1 << 15
    for a in range(0, len(seen), step):
        part = seen[a : a + step]
        who, bucket = _features(low, start[part], end[part])
        score[a : a + step] = _sum_rows(who, weights[bucket], len(part))
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    lettered = letters[end] > letters[start]
    score = score[inverse]
    score[~lettered] = 0
    score -= score.max(1, keepdims=True) if len(score) else 0
    return np.exp(np.maximum(score, -30)), lettered, first


def _distinct(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from tidemark.llm._text import span_hash

    _, seen, inverse = np.unique(span_hash(low, start, end), return_index=True, return_inverse=True)
    return seen, inverse


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7) -> dict:
    """A model from whole texts and their languages: weights by bucket, transitions, language names."""
    names = sorted(set(labels))
    k = len(names)
    if not k:
        return {"names": [], "weights": np.zeros((BUCKETS, 0)), "t": np.zeros((0, 0))}
    rng = np.random.default_rng(seed)
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, first = words(data, off, NON_SPACE)
    low = _lowered(data)
    label = np.repeat([names.index(x) for x in labels], np.diff(first))
    seen, word = _distinct(low, start, end)
    who, bucket = _features(low, start[seen], end[seen])
    begins = np.searchsorted(who_sorted := np.sort(who, kind="stable"), np.arange(len(seen) + 1))
    bucket = bucket[np.argsort(who, kind="stable")]
    del who_sorted
    # runs of 5 to 40 words, dealt anew into code-switched sequences of about 200 words
    runs, at = [], 0
    for stop in first[1:].tolist():
        while at < stop:
            size = int(rng.integers(5, 41))
            runs.append((at, min(stop, at + size)))
            at = min(stop, at + size)
    weights, slope = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-2)
    trans, trans_slope = np.zeros((k, k)), np.full((k, k), 1e-2)
    for _ in range(epochs):
        rng.shuffle(runs)
        for a in range(0, len(runs), 400):
            part = runs[a : a + 400]
            index = np.concatenate([np.arange(x, y) for x, y in part])
            cuts = np.concatenate([[0], np.cumsum([y - x for x, y in part])])[::8]
            cuts = cuts if cuts[-1] == len(index) else np.append(cuts, len(index))
            used, back = np.unique(word[index], return_inverse=True)
            count = begins[used + 1] - begins[used]
            own = np.repeat(np.arange(len(used)), count)
            feats = bucket[np.repeat(begins[used] - (np.cumsum(count) - count), count) + np.arange(len(own))]
            score = _sum_rows(own, weights[feats], len(used))[back]
            score -= score.max(1, keepdims=True)
            t = np.exp(trans - trans.max())
            marginal, pair = forward_backward(np.exp(np.maximum(score, -30)), cuts, t)
            truth = label[index]
            error = -marginal
            error[np.arange(len(index)), truth] += 1
            grad_word = _sum_rows(back, error, len(used)) / len(index)
            grad = np.zeros((BUCKETS, k))
            for j in range(k):
                grad[:, j] = np.bincount(feats, grad_word[own, j], BUCKETS)
            grad -= 1e-6 * weights
            slope += grad * grad
            weights += 0.3 * grad / np.sqrt(slope)
            joint = np.zeros((k, k))
            inner = np.ones(len(index), bool)
            inner[cuts[:-1]] = False
            np.add.at(joint, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
            np.add.at(joint, (slice(None), truth[cuts[:-1]]), 1.0 / k)
            g = (joint - pair) / len(index)
            trans_slope += g * g
            trans += 0.3 * g / np.sqrt(trans_slope)
    return {"names": names, "weights": weights.astype(np.float32), "t": np.exp(trans - trans.max())}


def fit(docs: DataFrame, train_rows: Column | None = None, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Trains on a bounded sample of the rows with text and lang (and train_rows, if given).

    The sample: for each language its per_language rows least by a hash of doc_id, as long as their texts have sample_bytes at most; repeated ids count once.
    The model has a row for each language, so more than LANGUAGES labels are refused.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if train_rows is None else rows.where(train_rows)
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("name"))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "name")
    first = rows.select("doc_id", "lang", "name", F.octet_length("text").cast("long").alias("size")).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= per_language)
    total = F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("total", total).where((F.col("n") == 1) | (F.col("total") <= sample_bytes)).select("doc_id", "lang", "name").distinct()
    langs = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if langs > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    # at most per_language rows for each of LANGUAGES, without texts
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["lang"] == chosen["lang"]) & (rows["name"] == chosen["name"])
    found = rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["doc_id", "lang", "name"])
    sample = sorted(found.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "name", "text").collect(), key=lambda r: (r.lang, r.h, r.name))
    model = train([r.text for r in sample], [r.lang for r in sample])
    forget_powers()  # the driver trains once and then only plans
    return model


def label_slice(model: dict, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word marginals, whether the word has a letter, first word of each text)."""
    e, lettered, first = _emissions(model["weights"], data, off)
    marginal, _ = forward_backward(e, first, model["t"])
    return marginal, lettered, first


def predict(docs: DataFrame, model: dict, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, then the columns named by `label` and `score`.

    Null texts, texts without a letter and all texts under a model without languages are `und` with score 0.  A very long text is labelled whole, in a slice of its own.
    Repeated rows are labelled alike; columns named as the two are replaced; an empty table gives no rows.
    The model has a bounded size and is broadcast.
    """
    own = [c for c in docs.columns if c not in (label, score)]
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in own])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            column = batch.schema.names.index("text")
            names = np.full(len(batch), UNKNOWN, object)
            scores = np.zeros(len(batch))
            for a, b, data, off in slices(batch, column, SLICE):
                if not m["names"] or not len(data):
                    continue
                marginal, lettered, first = label_slice(m, data, off)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                mass = _sum_rows(doc[lettered], marginal[lettered], b - a)
                total = mass.sum(1)
                best = mass.argmax(1)
                for i in np.flatnonzero(total > 0).tolist():
                    if any(map(str.isalpha, batch.column(column)[a + i].as_py())):
                        names[a + i] = m["names"][best[i]]
                        scores[a + i] = min(1.0, mass[i, best[i]] / total[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, label, score])

    return base.mapInArrow(run, f"{fields}, `{label}` string, `{score}` double")


def word_labels(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and runs (first word, end word, language) of every document: its words' most likely languages."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out: list[list] = [[] for _ in range(len(batch))]
            for a, _, data, off in slices(batch, 1, SLICE):
                if not m["names"] or not len(data):
                    continue
                marginal, _, first = label_slice(m, data, off)
                best = marginal.argmax(1)
                for i, (x, y) in enumerate(zip(first.tolist(), first[1:].tolist())):
                    cut = [x, *(np.flatnonzero(np.diff(best[x:y])) + x + 1).tolist(), y] if y > x else []
                    out[a + i] = [{"start": s - x, "end": e - x, "lang": m["names"][best[s]]} for s, e in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=["doc_id", "runs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,end:long,lang:string>>")
