"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, in spans of ``span`` bytes
whose states start at zero. A direction's cell is a gated recurrent unit; a byte enters
through a row of its own for each gate:

    z = s(A_z[x] + h U_z)    r = s(A_r[x] + h U_r)    c = g(A_c[x] + r * (h U_c))
    h' = c + z * (h - c)     g(v) = v / (1 + |v|),    s(v) = (1 + g(v)) / 2

Both states at a byte give it one probability per language (softmax), so every
position of every text is labelled; a document's probabilities are the mean over its
positions, its language is the likeliest. ``g`` stands for tanh, which it resembles at
a fifth of the cost in numpy.

Training. Per language, up to ``documents`` distinct texts are drawn by a hash of the text from
the labelled documents that are not held out, and ``windows`` spans of each at hashed places.
This bounded sample goes to one task, which trains by backpropagation through time with
Adam from a fixed seed on the mean cross-entropy over positions. The weights, a few
ten thousand numbers, come back as one row. A prediction sees the text alone.

Prediction streams: a task lays the spans of a batch of documents side by side,
steps through all of them at once and adds the positions' probabilities up by document.
Nothing is shuffled, memory is bounded by a batch of documents.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0;
so is every text if no labelled row may be learned from. A null id counts as the empty
string for the hold-out and is returned as null; rows that repeat an id or a whole row
are predicted one by one alike; very long texts are read whole; of equally
likely languages the first by name is taken; a single learned language is always
predicted, with score 1; an empty table gives an empty result; columns other
than id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .textcols import text_of

UNKNOWN = "und"
_PAD = 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class LanguageId:
    hidden: int = 8
    span: int = 96
    #: Bound of the training sample: texts a language, spans a text.
    documents: int = 600
    windows: int = 2
    epochs: int = 8
    batch: int = 128
    rate: float = 0.02
    seed: int = 7
    #: Spans that step together when predicting.
    lanes: int = 1024


# --- the network ----------------------------------------------------------------

def new_network(languages: int, p: LanguageId) -> dict[str, np.ndarray]:
    """Weights: A (gate, direction, byte or padding, unit), U (gate, direction, unit, unit), W and b to the languages."""
    rng = np.random.default_rng(p.seed)
    h = p.hidden
    return {"A": (rng.normal(size=(3, 2, 257, h)) * 0.4).astype(np.float32),
            "U": (rng.normal(size=(3, 2, h, h)) / h ** 0.5).astype(np.float32),
            "W": (rng.normal(size=(2, h, languages)) / h ** 0.5).astype(np.float32),
            "b": np.zeros(languages, np.float32)}


def _soft(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def states(net: dict[str, np.ndarray], bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (step, direction, lane, unit) of ``bytes_`` (step, direction, lane); ``keep`` collects what learning needs."""
    steps, _, lanes = bytes_.shape
    hidden = net["U"].shape[-1]
    table = net["A"].reshape(3, 2 * 257, hidden)
    at = bytes_ + np.array([0, 257])[:, None]
    out = np.empty((steps, 2, lanes, hidden), net["A"].dtype)
    h = np.zeros((2, lanes, hidden), out.dtype)
    gates, spare2 = np.empty((2, 2, lanes, hidden), out.dtype), np.empty((2, 2, lanes, hidden), out.dtype)
    c, q, spare = (np.empty((2, lanes, hidden), out.dtype) for _ in range(3))
    for t in range(steps):
        np.take(table[0], at[t], axis=0, out=gates[0], mode="clip")
        np.take(table[1], at[t], axis=0, out=gates[1], mode="clip")
        np.take(table[2], at[t], axis=0, out=c, mode="clip")
        np.matmul(h, net["U"][:2], out=spare2)
        gates += spare2
        _soft(gates, spare2)
        gates += 1
        gates *= 0.5
        np.matmul(h, net["U"][2], out=q)
        np.multiply(gates[1], q, out=spare)
        c += spare
        _soft(c, spare)
        if keep is not None:
            keep.append((at[t], h.copy(), gates.copy(), c.copy(), q.copy()))
        h -= c
        h *= gates[0]
        h += c
        out[t] = h
    return out


def _mirror(sizes: np.ndarray, steps: int) -> np.ndarray:
    """For each position (row) of each lane the backward step that has just read it; the last step for padding."""
    return np.where(np.arange(steps)[:, None] < sizes, sizes - 1 - np.arange(steps)[:, None], steps - 1)


def lay_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """(step, direction, lane): each span forward, and backward from its own end; padding after it."""
    k = np.arange(steps)[:, None]
    inside = k < sizes
    forward = np.where(inside, data[np.where(inside, starts + k, 0)], _PAD)
    back = np.where(inside, data[np.where(inside, starts + sizes - 1 - k, 0)], _PAD)
    return np.stack((forward, back), axis=1)


def probabilities(net: dict[str, np.ndarray], h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(language, position, lane) from the states; positions beyond a lane's size mean nothing."""
    steps, _, lanes, hidden = h.shape
    part = [np.matmul(net["W"][d].T, np.ascontiguousarray(h[:, d]).reshape(-1, hidden).T).reshape(-1, steps, lanes) for d in (0, 1)]
    short = np.flatnonzero(sizes < steps)
    logits = part[0] + part[1][:, ::-1]
    if len(short):
        mirrored = part[1][:, _mirror(sizes[short], steps), short]
        logits[:, :, short] = part[0][:, :, short] + mirrored
    logits += net["b"][:, None, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def gradients(net: dict[str, np.ndarray], bytes_: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions and its derivatives, by backpropagation through time."""
    steps, _, lanes = bytes_.shape
    hidden = net["U"].shape[-1]
    kept: list = []
    h = states(net, bytes_, kept)
    prob = probabilities(net, h, sizes)
    inside = (np.arange(steps)[:, None] < sizes).astype(prob.dtype)
    total = inside.sum()
    loss = -float((np.log(prob[label, :, np.arange(lanes)].T + 1e-12) * inside).sum() / total)
    d = prob
    d[label, :, np.arange(lanes)] -= 1
    d *= inside / total
    g = {k: np.zeros_like(v) for k, v in net.items()}
    g["b"] = d.sum(axis=(1, 2))
    mirror = _mirror(sizes, steps)
    d_back = np.zeros_like(d)   # by backward step: within a span the mirror is its own inverse
    d_back[:] = np.take_along_axis(d, np.broadcast_to(mirror, d.shape), axis=1) * inside
    down = np.empty_like(h)
    for k, part in enumerate((d, d_back)):
        flat = part.reshape(part.shape[0], -1)
        g["W"][k] = np.ascontiguousarray(h[:, k]).reshape(-1, hidden).T @ flat.T
        down[:, k] = (net["W"][k] @ flat).T.reshape(steps, lanes, hidden)
    table = g["A"].reshape(3, 2 * 257, hidden)
    dh = np.zeros_like(h[0])
    for t in range(steps - 1, -1, -1):
        at, before, gates, c, q = kept[t]
        dh += down[t]
        z, r = gates
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dh * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dq = dc * r
        dh = dh * z
        for k, (own, through) in enumerate(((dz, dz), (dr, dr), (dc, dq))):
            np.add.at(table[k], at, own)
            g["U"][k] += before.transpose(0, 2, 1) @ through
            dh += through @ net["U"][k].transpose(0, 2, 1)
    return loss, g


def train(spans: list[bytes], labels: np.ndarray, languages: int, p: LanguageId) -> dict[str, np.ndarray]:
    """A network fitted to labelled spans by Adam with a falling rate."""
    net = new_network(languages, p)
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(p.seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    per_epoch = -(-len(spans) // p.batch)
    for step in range(p.epochs * per_epoch):
        if step % per_epoch == 0:
            order = rng.permutation(len(spans))
        own = order[step % per_epoch * p.batch:][:p.batch]
        _, g = gradients(net, lay_out(data, starts[own], sizes[own], p.span), sizes[own], labels[own])
        rate = p.rate * (1 - step / (p.epochs * per_epoch))
        for k, x in g.items():
            x *= min(1.0, 1.0 / (float(np.sqrt((x * x).sum())) + 1e-12))
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            net[k] -= rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-8)
    return net


def document_probabilities(net: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                           p: LanguageId) -> np.ndarray:
    """(document, language): the mean over the positions of each document; 0 for one without bytes."""
    spans = -(-sizes // p.span)
    owner = np.repeat(np.arange(len(sizes)), spans)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    begin = starts[owner] + nth * p.span
    length = np.minimum(sizes[owner] - nth * p.span, p.span)
    total = np.zeros((len(sizes), len(net["b"])))
    for k in range(0, len(owner), p.lanes):
        at = slice(k, k + p.lanes)
        prob = probabilities(net, states(net, lay_out(data, begin[at], length[at], p.span)), length[at])
        short = length[at] < p.span
        if short.any():
            prob[:, :, short] *= np.arange(p.span)[:, None] < length[at][short]
        np.add.at(total, owner[at], prob.sum(axis=1, dtype=np.float64).T)
    return total / np.maximum(sizes, 1)[:, None]


# --- Spark ------------------------------------------------------------------------

def _remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, p: LanguageId) -> DataFrame:
    """(lang, h, spans): at most ``p.documents`` distinct labelled texts of each language, as spans of bytes."""
    text = F.col(text_col)
    known = docs.where((_remainder(id_col) != 2) & F.col(lang_col).isNotNull() & _has_letter(text))
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, h long, spans array<binary>")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 3.0 * p.documents / r.n))])
    h, raw = F.xxhash64(text), text.cast("binary")
    room = F.greatest(F.octet_length(text) - p.span, F.lit(0)) + 1
    spans = F.array(*[F.substring(raw, F.pmod(F.xxhash64(h, F.lit(k)), room).cast("int") + 1, F.lit(p.span)) for k in range(p.windows)])
    drawn = known.where(F.pmod(h, F.lit(1 << 30)) < F.element_at(share, F.col(lang_col)) * (1 << 30)) \
        .select(F.col(lang_col).alias("lang"), h.alias("h"), spans.alias("spans")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("nth", nth).where(F.col("nth") <= p.documents).drop("nth")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        p: LanguageId = LanguageId()) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """(languages, network), trained in one task on the bounded sample; None without labelled rows."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, h, tuple(spans)) for b in batches for lang, h, spans in zip(*(c.to_pylist() for c in b.columns)))
        if rows:
            names = sorted({r[0] for r in rows})
            pairs = [(s, names.index(lang)) for lang, _, spans in rows for s in spans]
            net = train([s for s, _ in pairs], np.array([k for _, k in pairs]), len(names), p)
            held = io.BytesIO()
            np.savez(held, **net)
            yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([held.getvalue()])], names=["names", "net"])

    found = sample(docs, id_col, text_col, lang_col, p).repartition(1).mapInArrow(run, "names array<string>, net binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(bytes(found[0].net))) as held:
        return list(found[0].names), {k: held[k] for k in held.files}


def predict(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]] | None, id_col: str = "doc_id",
            text_col: str = "text", p: LanguageId = LanguageId()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    ship_package(docs.sparkSession)
    letter = _has_letter(F.col(text_col))
    shown = docs.select(F.col(id_col).cast("long").alias("doc_id"), (_remainder(id_col) == 2).alias("held_out"),
                        F.when(letter, text_of(text_col)).cast("binary").alias("raw"))
    if model is None:
        return shown.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names, net = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw")
            sizes = np.array([len(x) if x is not None else 0 for x in (v.as_buffer() for v in raw)], np.int64)
            data = np.frombuffer(b"".join(v.as_buffer() for v in raw if v.is_valid), np.uint8)
            if not sizes.any():
                data = np.zeros(1, np.uint8)
            prob = document_probabilities(net, data, np.cumsum(sizes) - sizes, sizes, p)
            best = prob.argmax(axis=1)
            read = sizes > 0
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"),
                pa.array([names[k] if r else UNKNOWN for k, r in zip(best.tolist(), read.tolist())]),
                pa.array(np.where(read, np.minimum(prob[np.arange(len(best)), best], 1.0), 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return shown.mapInArrow(run, SCHEMA)


def language_report(docs: DataFrame, p: LanguageId = LanguageId()) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return predict(docs, fit(docs, p=p), p=p)
