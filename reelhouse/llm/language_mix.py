"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased text, counted over all
training documents. A document is a mixture: expectation-maximisation estimates the share of
each language in its trigrams, beside a noise component (a uniform distribution) that takes
what no language explains. The language set is chosen by penalised likelihood: nested sets,
largest shares first, each paying ``PENALTY`` times the log of the text's length per language; they
end where the next language's share could no longer pay. The prediction is the
language of the largest share in the chosen set.

The model has ``BUCKETS`` numbers per language, whatever the corpus is; it is gathered from
counts aggregated by Spark over all training rows and sent to the tasks. All documents of a
run of texts are estimated together as flat arrays.

Defined cases: text that is null or has no letter is ``und`` with score 0, as is every text if
nothing could be learned; rows without a language, or with no text, teach nothing; repeated
rows count each; a document without an id is never held out and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

BUCKETS, SMOOTH, PENALTY, ROUNDS, TOLERANCE = 1 << 15, 0.5, 1.0, 25, 2e-3
UNDETERMINED = "und"
#: Overlapping trigrams say about a third of what independent ones would.
OVERLAP = 3.0
#: Bytes of text that a task works on at once; its arrays take about a hundred times as much.
WORK_BYTES = 1 << 18


def _grams(data: bytes) -> np.ndarray:
    """Bucket of each trigram."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint16)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(32 - 15)).astype(np.uint16)


def _plain(text: str | None) -> bytes:
    return f" {text.lower()} ".encode() if text else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language over a task's rows."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for x, y in slices(b.column(1), WORK_BYTES):
            part, texts = b.slice(x, y - x), {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                texts.setdefault(lang, []).append(_plain(text))
            for lang, ts in texts.items():  # the texts' ends are blanks, so no trigram crosses into a word
                held = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(_grams(b"".join(ts)), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                                         names=["lang", "gram", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, trigram probabilities: BUCKETS x languages) from labelled ``docs``."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNDETERMINED))
    counts = (rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # at most BUCKETS rows a language
    langs = sorted(counts["lang"].unique())
    if not langs:
        return [], np.empty((BUCKETS, 0))
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    col = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (counts["gram"].to_numpy(), counts["lang"].map(col).to_numpy()), counts["n"].to_numpy())
    return langs, table / table.sum(0)


def mixtures(p: np.ndarray, c: np.ndarray, starts: np.ndarray, doc: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: (shares, log-likelihood).

    ``p``: trigram probabilities by component, ``c``: how often the document has the trigram,
    ``starts``/``doc``: where documents begin and which one a row is of, ``use``: the
    components each document may use. A document is done when its shares settle, whatever
    the others do."""
    n = np.add.reduceat(c, starts)
    share = use / use.sum(1, keepdims=True)
    live, one = np.arange(len(starts)), np.ones(p.shape[1])
    st, dd, pp, cc = starts, doc, p, c
    moving = np.ones(len(starts), bool)
    for _ in range(ROUNDS):
        r = share[live][dd] * pp
        r *= (cc / (r @ one))[:, None]
        new = np.add.reduceat(r, st, axis=0) / n[live][:, None]
        step = np.abs(new - share[live]).max(1)
        share[live[moving]] = new[moving]
        moving &= step > TOLERANCE
        if not moving.any():
            break
        if moving.mean() < 0.7:  # go on with the documents that still change
            keep = moving[dd]
            live, pp, cc = live[moving], pp[keep], cc[keep]
            renum = np.cumsum(moving) - 1
            dd = renum[dd[keep]]
            st = np.searchsorted(dd, np.arange(len(live)))
            moving = np.ones(len(live), bool)
    fit = np.add.reduceat(c * np.log((share[doc] * p) @ one), starts)
    return share, fit


def infer(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares by language and noise, chosen set as booleans, score) of plain texts with at
    least one trigram each."""
    k = model.shape[1]
    probs = np.concatenate((model, np.full((len(model), 1), 1 / len(model))), 1)
    us, cs = [], []
    for t in texts:
        g = np.sort(_grams(t), kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        us.append(g[edge])
        cs.append(np.diff(edge, append=len(g)))
    size = np.array([len(u) for u in us])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    doc = np.repeat(np.arange(len(us)), size)
    p, c = probs[np.concatenate(us)], np.concatenate(cs).astype(float)
    n = np.add.reduceat(c, starts)

    alone = np.add.reduceat(c[:, None] * np.log(p[:, :k]), starts, axis=0) / OVERLAP
    full, _ = mixtures(p, c, starts, doc, np.ones((len(us), k + 1)))
    order = np.argsort(-full[:, :k], axis=1, kind="stable")
    price = PENALTY * np.log(np.maximum(n / OVERLAP, 2))
    best = np.full(len(us), -np.inf)
    share, chosen = np.zeros((len(us), k + 1)), np.zeros((len(us), k), bool)
    todo = np.arange(len(us))
    for size_ in range(1, k + 1):
        if size_ > 1:  # a share this small can't win back the price of a further language
            todo = todo[np.take_along_axis(full, order, 1)[todo, size_ - 1] * n[todo] / OVERLAP > price[todo] / np.log(BUCKETS)]
        if not len(todo):
            break
        use = np.zeros((len(todo), k + 1))
        np.put_along_axis(use, order[todo, :size_], 1, 1)
        use[:, k] = 1
        rows = np.isin(doc, todo) if len(todo) < len(us) else slice(None)
        dd = np.searchsorted(todo, doc[rows])
        got, fit = mixtures(p[rows], c[rows], np.searchsorted(dd, np.arange(len(todo))), dd, use)
        value = fit / OVERLAP - size_ * price[todo]
        win = value > best[todo]
        at = todo[win]
        best[at], share[at], chosen[at] = value[win], got[win], use[win][:, :k] > 0
    lead = np.where(chosen, share[:, :k], -1).argmax(1)
    margin = alone - alone[np.arange(len(us)), lead][:, None]
    odds = 1 / np.exp(np.clip(margin, -700, 700)).sum(1)      # of the lead against the others alone
    with np.errstate(invalid="ignore"):
        part = share[np.arange(len(us)), lead]
    return share, chosen, np.clip(np.maximum(part, odds * (1 - share[:, k])), 0, 1)


def _predict(langs: list[str], sent, with_text: bool):
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, x, y in ((b, x, y) for b in batches for x, y in slices(b.column(0), WORK_BYTES)):
            b = whole.slice(x, y - x)
            texts = b.column(0).to_pylist()
            n = len(texts)
            pred, score, noise = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            mix = [[] for _ in range(n)]
            at = [i for i, t in enumerate(texts) if t and langs and letter.search(t)]
            if at:
                share, chosen, s = infer([_plain(texts[i]) for i in at], sent.value)
                for i, sh, ch, v in zip(at, share, chosen, s):
                    mix[i] = sorted(((langs[j], float(sh[j])) for j in np.flatnonzero(ch)), key=lambda m: (-m[1], m[0]))
                    pred[i], score[i], noise[i] = mix[i][0][0], v, sh[-1]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            made = [pa.array(pred, pa.string()), pa.array(score), pa.array(noise),
                    pa.array([[{"lang": a, "share": v} for a, v in m] for m in mix], kind)]
            kept = b.schema.names[0 if with_text else 1:]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + made, names=kept + ["lang_pred", "score", "noise", "mixture"])
    return run


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus lang_pred, score, noise (share that no language
    explains) and mixture (language, share) of the chosen set, largest first."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    with_text = text in keep  # then it moves to the tasks and back once
    picked = docs.select(F.col(text).alias(text if with_text else "__text"), *[c for c in keep if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[0 if with_text else 1:])
    found = picked.mapInArrow(_predict(langs, sent, with_text), ", ".join(filter(None, (
        schema, "lang_pred string, score double, noise double, mixture array<struct<lang:string,share:double>>"))))
    return found.select(*keep, "lang_pred", "score", "noise", "mixture")


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = predict(docs, langs, model, keep=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "noise",
                        F.size("mixture").alias("n_langs"))


QUERIES = {"op1_language_mix": op1_language_mix}
ORACLES: dict[str, str] = {}
