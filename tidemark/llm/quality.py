"""Quality and toxicity by hierarchical empirical Bayes.

A document classifier (logistic regression on hashed words and a few measures) gives each document's evidence.  Sites form
a hierarchy: all documents, hosts, paths within hosts.  Each level's rate is shrunk to the level above, with a strength
k = within / between: the variance of documents within the level's sites over that of the sites' true rates, both from sums over all
sites (method of moments), so sparse sites shrink to their host and sparse hosts to the whole.  Evidence between 0 and 1 varies less
than coin flips do, so the variance within sites is measured, not taken from the rate.

A document's posterior odds are those of its evidence times the ratio of its path's odds to the overall odds: the rule of Bayes for a text and a site
that are independent given the class.  The site is judged without the document itself, so no evidence counts twice.  All counts come from grouped aggregation over every document;
labelled documents count with their label, others with their evidence.

The classifier alone is fitted on a bounded sample: the `sample` labelled documents least by a hash of their id, of those with at most LONGEST bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import ALNUM, LOWER, checkpoint, forget_powers, mix, slices, span_hash, words

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Bytes of a word's beginning that are features; the last stands for the whole word.
PREFIXES = (5, 7, 1 << 20)
#: A word is used if at least this many documents of the sample have it, so that rare words aren't learned by heart.
LEAST_DOCS = 8
#: Standard errors by which a word's share must differ between the classes.
TELLING = 5.0
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Features that are not words.
DENSE = 8 + len(MARKS)
#: Documents of the sample, and bytes of a text in it.
SAMPLE, LONGEST = 4000, 1 << 15
TARGETS = ("quality", "toxic")


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct word and word beginning of each text, and measures of each text."""
    start, end, first = words(data, off, ALNUM)
    n = len(off) - 1
    low = LOWER[data]
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes = [span_hash(low, start, np.minimum(end, start + k)) ^ np.uint64(k) for k in PREFIXES]
    bucket = (mix(np.concatenate(hashes)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    pair = np.unique(np.tile(doc, len(PREFIXES)) * BUCKETS + bucket)
    size = np.diff(off)
    kind = np.minimum(data, 128).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(n), size) * 129 + kind, minlength=n * 129).reshape(n, 129).astype(float)
    whole = np.unique(doc * (1 << 44) + (hashes[-1] >> np.uint64(20)).astype(np.int64)) >> 44
    n_words = np.maximum(np.diff(first), 1)
    distinct = np.bincount(whole, minlength=n) / n_words
    marks = count[:, MARKS] / n_words[:, None]
    capital = count[:, 0x41:0x5B].sum(1) / np.maximum(size, 1)
    mean = np.bincount(doc, end - start, n) / n_words
    dense = [np.ones(n), np.log1p(n_words) / 5, distinct * np.log1p(n_words) / 5, distinct, np.sqrt(capital), (mean - 5) / 3, np.sqrt(marks.sum(1)), count[:, 10] / n_words]
    return pair // BUCKETS, pair % BUCKETS, np.column_stack([*dense, np.sqrt(marks)])


def _score(model: dict, who: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
    z = dense @ model["dense"]
    for k in range(z.shape[1]):
        z[:, k] += np.bincount(who, model["words"][bucket, k], len(dense))
    return z


def _parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end text, *features) of runs of texts of about `most` characters, so that training holds little at once."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= most):
            size += len(texts[b])
            b += 1
        raw = [x.encode() for x in texts[a:b]]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        yield a, b, *_features(np.frombuffer(b"".join(raw), np.uint8), off)
        a = b


def _telling(with_yes: np.ndarray, with_no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Buckets whose share among texts with the target differs from that among the others by TELLING standard errors."""
    n_yes, n_no = max(n_yes, 1), max(n_no, 1)
    p = np.clip((with_yes + with_no) / (n_yes + n_no), 1e-9, 1 - 1e-9)
    z = (with_yes / n_yes - with_no / n_no) / np.sqrt(p * (1 - p) * (1 / n_yes + 1 / n_no))
    return np.flatnonzero((np.abs(z) >= TELLING) & (with_yes + with_no >= LEAST_DOCS))


def _fit_one(dense: np.ndarray, rows: np.ndarray, at: np.ndarray, n_words: int, target: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(word weights, other weights) of one target by full-batch AdaGrad on the mean log loss; NaN adds nothing."""
    known = ~np.isnan(target)
    truth = np.where(known, target, 0)
    w, d = np.zeros(n_words), np.zeros(DENSE)
    slope_w, slope_d = np.full(n_words, 1e-6), np.full(DENSE, 1e-6)
    for _ in range(steps):
        z = dense @ d + np.bincount(rows, w[at], len(dense))
        error = np.where(known, truth - 1 / (1 + np.exp(-z)), 0) / len(dense)
        gd = dense.T @ error - 1e-4 * d
        gw = np.bincount(at, error[rows], n_words) - 1e-4 * w
        slope_d += gd * gd
        slope_w += gw * gw
        d += 0.3 * gd / np.sqrt(slope_d)
        w += 0.3 * gw / np.sqrt(slope_w)
    return w, d


def train(texts: list[str], targets: np.ndarray, steps: int = 400) -> dict:
    """Logistic regression of each target over its telling words; a missing target (NaN) adds nothing."""
    k = targets.shape[1] if len(targets) else len(TARGETS)
    model = {"words": np.zeros((BUCKETS, k), np.float32), "dense": np.zeros((DENSE, k), np.float32)}
    if not len(texts):
        return model
    yes, no = np.nan_to_num(targets) >= 0.5, np.nan_to_num(targets, nan=1) < 0.5
    with_yes, with_no = np.zeros((k, BUCKETS), np.int32), np.zeros((k, BUCKETS), np.int32)
    dense = []
    for a, b, who, bucket, rest in _parts(texts):
        dense.append(rest)
        for j in range(k):
            np.add.at(with_yes[j], bucket[yes[a:b, j][who]], 1)
            np.add.at(with_no[j], bucket[no[a:b, j][who]], 1)
    dense = np.concatenate(dense)
    telling = [_telling(with_yes[j], with_no[j], int(yes[:, j].sum()), int(no[:, j].sum())) for j in range(k)]
    del with_yes, with_no
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(k)]
    for a, _, who, bucket, _ in _parts(texts):
        for j in range(k):
            at = np.searchsorted(telling[j], bucket)
            ok = at < len(telling[j])
            ok[ok] = telling[j][at[ok]] == bucket[ok]
            kept[j].append((who[ok] + a, at[ok]))
    for j in range(k):
        rows, at = (np.concatenate(x) for x in zip(*kept[j]))
        w, d = _fit_one(dense, rows, at, len(telling[j]), targets[:, j], steps)
        model["words"][telling[j], j] = w
        model["dense"][:, j] = d
    return model


def _one_label(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id, repeated labels averaged; targets that are null stay so."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(F.col(t).cast("double")).alias(f"_{t}") for t in TARGETS])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    truth = _one_label(labels)
    fits = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST))
    chosen = fits.select("doc_id").distinct().join(truth, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).collect()
    model = train([r.text for r in rows], np.array([[np.nan if r[f"_{t}"] is None else r[f"_{t}"] for t in TARGETS] for r in rows], float).reshape(len(rows), len(TARGETS)))
    forget_powers()  # the driver trains once and then only plans
    return model


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """docs with e_quality and e_toxic, the classifier's probabilities; text is left out.  Null text is empty."""
    own = [c for c in docs.columns if c != "text"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select("text", *[F.col(f"`{c}`") for c in own])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.full((len(batch), len(TARGETS)), 0.5)
            for a, b, data, off in slices(batch, 0):
                p[a:b] = 1 / (1 + np.exp(-_score(held.value, *_features(data, off))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(p[:, k]) for k in range(len(TARGETS)))], names=[*own, *(f"e_{t}" for t in TARGETS)])

    return base.mapInArrow(run, f"{fields}, " + ", ".join(f"e_{t} double" for t in TARGETS))



def strengths(groups: DataFrame, mean: dict[str, str]) -> dict[str, float]:
    """For each target, how many documents the level above counts for: within / between variance over all groups of a level.

    groups: n documents, s_ and q_ (sums of their values and of the squares), and the column `mean` names for the level above.  Held in [0.01, 1e6].
    """
    sums = [F.count("*").alias("groups"), F.sum("n").alias("n")]
    for t, m in mean.items():
        sums.append(F.sum(F.col(f"q_{t}") - F.col(f"s_{t}") * F.col(f"s_{t}") / F.col("n")).alias(f"in_{t}"))
        sums.append(F.sum(F.col("n") * F.pow(F.col(f"s_{t}") / F.col("n") - F.col(m), 2)).alias(f"gap_{t}"))
    r = groups.where("n > 0").agg(*sums).first()
    out = {}
    for t in mean:
        within = r[f"in_{t}"] / (r["n"] - r["groups"]) if r["groups"] and r["n"] > r["groups"] else 0.0
        between = (r[f"gap_{t}"] - r["groups"] * within) / r["n"] if r["groups"] else 0.0
        out[t] = min(max(within / between, 0.01), 1e6) if between > 1e-9 else 1e6
    return out


def shrunk(n: Column | str, s: Column | str, mean: Column | str, k: float) -> Column:
    """The posterior rate of s in n around `mean`, which counts for k documents."""
    n, s, mean = (F.col(x) if isinstance(x, str) else x for x in (n, s, mean))
    return (s + k * mean) / (n + k)


def url_sites(url: Column) -> tuple[Column, Column]:
    """(host, first part of the path) of a URL; null for what it lacks."""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.nullif(F.split_part(F.try_parse_url(url, F.lit("PATH")), F.lit("/"), F.lit(2)), F.lit(""))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, model: dict | None = None) -> DataFrame:
    """doc_id, and for each target e_ (evidence), host_ and path_ (site posteriors) and p_ (document posterior).

    A null host or path is a site of its own.  Null and empty texts have the evidence of an empty text; a very long text is measured whole.  Repeated rows each count and each return.
    Without labels every probability is 0.5.  An empty table gives no rows; columns other than doc_id, text, host and path are ignored.
    """
    own = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("_host"), F.coalesce(F.concat(F.lit("="), F.col(f"`{path}`").cast("string")), F.lit("")).alias("_path"))
    scored = evidence(own, model or fit(docs, labels, sample)).join(_one_label(labels), "doc_id", "left")
    for t in TARGETS:
        scored = scored.withColumn(f"c_{t}", F.coalesce(f"_{t}", f"e_{t}"))
    scored = checkpoint(scored.drop(*[f"_{t}" for t in TARGETS]))
    sums = [f(c).alias(f"{k}_{t}") for t in TARGETS for k, f, c in (("s", F.sum, F.col(f"c_{t}")), ("q", F.sum, F.col(f"c_{t}") * F.col(f"c_{t}")))]
    # one row for each path, read by every level
    paths = checkpoint(scored.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), *sums))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), *[F.sum(f"{k}_{t}").alias(f"{k}_{t}") for t in TARGETS for k in "sq"])
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), *[F.coalesce(F.sum(f"s_{t}"), F.lit(0.0)).alias(t) for t in TARGETS]).first()
    rate = {t: whole[t] / whole["n"] if whole["n"] else 0.5 for t in TARGETS}
    hosts = hosts.withColumns({f"all_{t}": F.lit(rate[t]) for t in TARGETS})
    k_host = strengths(hosts, {t: f"all_{t}" for t in TARGETS})
    hosts = hosts.withColumns({f"host_{t}": shrunk("n", f"s_{t}", f"all_{t}", k_host[t]) for t in TARGETS})
    above = hosts.select("_host", F.col("n").alias("n_host"), *[F.col(f"s_{t}").alias(f"sh_{t}") for t in TARGETS], *[f"host_{t}" for t in TARGETS])
    paths = paths.join(above, "_host")
    k_path = strengths(paths, {t: f"host_{t}" for t in TARGETS})
    paths = paths.withColumns({f"path_{t}": shrunk("n", f"s_{t}", f"host_{t}", k_path[t]) for t in TARGETS})
    out = scored.join(paths.drop(*[f"q_{t}" for t in TARGETS]), ["_host", "_path"])

    def logit(p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.ln(p / (1 - p))

    columns = []
    for t in TARGETS:
        c = F.col(f"c_{t}")  # the document leaves its site before the site judges it
        rest = F.lit((whole[t] if whole["n"] > 1 else 0.0))
        all_ = (rest - c) / (whole["n"] - 1) if whole["n"] > 1 else F.lit(0.5)
        at_host = shrunk(F.col("n_host") - 1, F.col(f"sh_{t}") - c, all_, k_host[t])
        at_path = shrunk(F.col("n") - 1, F.col(f"s_{t}") - c, at_host, k_path[t])
        z = logit(F.col(f"e_{t}")) + logit(at_path) - logit(all_)
        columns += [F.col(f"e_{t}"), F.col(f"host_{t}"), F.col(f"path_{t}"), (1 / (1 + F.exp(-z))).alias(f"p_{t}")]
    return out.select("doc_id", *columns)
