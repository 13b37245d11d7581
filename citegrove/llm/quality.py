"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import chunks, text_buffers

WIDTH, STRIDE, HALF, FILTERS, HIDDEN = 8, 2, 256, 24, 16
PAD = 256
STEPS = HALF // STRIDE


def byte_features() -> np.ndarray:
    """Fixed inputs of each byte value: its eight bits and its kind; padding is all zeros."""
    b = np.arange(256)
    kinds = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), np.isin(b, [9, 10, 13, 32]), b >= 128,
             (b > 32) & (b < 127) & ~np.array([chr(x).isalnum() for x in b])]
    table = np.column_stack([(b[:, None] >> np.arange(8)) & 1, *kinds]).astype(np.float32)
    return np.vstack([table - 0.25, np.zeros((1, table.shape[1]), np.float32)])


TABLE = byte_features()


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, each padded to whole halves with at least WIDTH pads at its end, and the halves of each row."""
    size = np.diff(offsets)
    halves = (size + WIDTH + HALF - 1) // HALF
    start = (np.cumsum(halves) - halves) * HALF
    out = np.full(int(halves.sum()) * HALF, PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = data
    return out, halves


def windows(line: np.ndarray, first: int, last: int) -> np.ndarray:
    """Inputs of every filter position of halves first..last: the WIDTH bytes that end there. Those before a row are the
    pads that end the row before."""
    a = first * HALF - WIDTH + STRIDE
    part = line[max(a, 0):last * HALF]
    if a < 0:
        part = np.concatenate([np.full(-a, PAD, np.int16), part])
    x = TABLE[part]
    wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[::STRIDE]
    return np.ascontiguousarray(wide.transpose(0, 2, 1)).reshape(len(wide), -1)


class Network:
    """Filters with ReLU; largest and mean response in each half; a chunk is two neighbouring halves, so chunks overlap by
    one half; a hidden layer gives each chunk a value; the largest and mean value of a row's chunks give one probability."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = WIDTH * TABLE.shape[1]
        self.p = {"w": r.normal(0, (2 / d) ** 0.5, (d, FILTERS)), "b": np.zeros(FILTERS), "h": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
                  "c": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN ** -0.5, HIDDEN), "o": np.array([1.0, 1.0, 0.0])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def halves(self, line: np.ndarray, keep: bool = False, block: int = 256):
        """Largest and mean response of every filter in every half."""
        n, out, kept = len(line) // HALF, [], []
        for s in range(0, n, block):
            x = windows(line, s, min(n, s + block))
            act = np.maximum(x @ self.p["w"] + self.p["b"], 0).reshape(-1, STEPS, FILTERS)
            out.append(np.concatenate([act.max(1), act.mean(1)], 1))
            if keep:
                kept.append((x, act))
        return (np.concatenate(out) if out else np.zeros((0, 2 * FILTERS), np.float32)), kept

    def heads(self, half: np.ndarray, count: np.ndarray):
        """Probability of each row and what the backward pass needs."""
        stop = np.cumsum(count)
        first = np.setdiff1d(np.arange(len(half)), (stop - 1)[count > 1])
        second = np.where(np.isin(first, (stop - 1)[count == 1]), first, first + 1)
        row = np.searchsorted(stop, first, "right")
        f = FILTERS
        x = np.concatenate([np.maximum(half[first, :f], half[second, :f]), (half[first, f:] + half[second, f:]) / 2], 1)
        hidden = np.maximum(x @ self.p["h"] + self.p["c"], 0)
        z = hidden @ self.p["v"]
        of = np.bincount(row, minlength=len(count))
        starts = np.cumsum(of) - of
        top = np.maximum.reduceat(z, starts)
        mean = np.add.reduceat(z, starts) / of
        logit = self.p["o"][0] * top + self.p["o"][1] * mean + self.p["o"][2]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (first, second, row, x, hidden, z, of, top, mean)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        line, count = padded(data, offsets)
        return self.heads(self.halves(line)[0], count)[0].astype(np.float64)

    def gradients(self, data, offsets, label, weight) -> dict[str, np.ndarray]:
        line, count = padded(data, offsets)
        half, kept = self.halves(line, keep=True)
        prob, (first, second, row, x, hidden, z, of, top, mean) = self.heads(half, count)
        p, f = self.p, FILTERS
        d = (prob - label) * weight / weight.sum()
        g = {"o": np.array([d @ top, d @ mean, d.sum()])}
        dz = (d * p["o"][1] / of)[row]
        is_top = z == top[row]
        dz += np.where(is_top, (d * p["o"][0])[row] / np.bincount(row, is_top)[row], 0)
        g["v"] = hidden.T @ dz
        dh = dz[:, None] * p["v"] * (hidden > 0)
        g["h"], g["c"] = x.T @ dh, dh.sum(0)
        dx = dh @ p["h"].T
        d_half = np.zeros(half.shape, np.float64)
        from_first = half[first, :f] >= half[second, :f]
        np.add.at(d_half, first, np.concatenate([np.where(from_first, dx[:, :f], 0), dx[:, f:] / 2], 1))
        np.add.at(d_half, second, np.concatenate([np.where(from_first, 0, dx[:, :f]), dx[:, f:] / 2], 1))
        g["w"], g["b"], s = np.zeros(p["w"].shape), np.zeros(f), 0
        for cols, act in kept:
            part = d_half[s:s + len(act)]
            s += len(act)
            d_act = np.repeat((part[:, None, f:] / STEPS), STEPS, 1)
            at = act.argmax(1)
            i, j = np.indices(at.shape)
            d_act[i, at, j] += part[:, :f]
            d_act = (d_act * (act > 0)).reshape(-1, f).astype(np.float32)
            g["w"] += cols.T @ d_act
            g["b"] += d_act.sum(0)
        return g


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 4e-3) -> Network:
    """Adam over batches of whole texts; the same rows give the same network."""
    net, r = Network(), np.random.default_rng(11)
    m = {k: np.zeros(v.shape) for k, v in net.p.items()}
    s = {k: np.zeros(v.shape) for k, v in net.p.items()}
    coded, step, steps = [t.encode("utf-8", "replace") for t in texts], 0, max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = r.permutation(len(coded))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            offsets = np.concatenate([[0], np.cumsum([len(coded[i]) for i in rows])])
            g = net.gradients(np.frombuffer(b"".join(coded[i] for i in rows), np.uint8), offsets, labels[rows], weights[rows])
            step += 1
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                move = rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
                net.p[k] = (net.p[k] - move).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label",
        rows_per_label: int = 1000) -> Network:
    """A network for P(label = 1) of docs' texts, fitted on at most rows_per_label rows of `labels` for each label 0 and 1
    (those of smallest hashed id), weighted so that the labels keep their shares among all of `labels`. Only this sample's
    texts reach the driver. Labels that are null or without document are ignored, null texts count as empty, repeated rows
    count once; without any labelled row the network is as initialised."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label IN (0, 1) AND _id IS NOT NULL").distinct()
    counts = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = known.limit(0)
    for value in sorted(counts):
        chosen = chosen.unionByName(known.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_label))
    got = (docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
           .join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_label", "_text").distinct().toPandas())
    got = got.sort_values(["_doc", "_label", "_text"]).reset_index(drop=True)
    each = got["_label"].map({k: n / max(1, int((got["_label"] == k).sum())) for k, n in counts.items()})
    return train(got["_text"].tolist(), got["_label"].to_numpy(np.float64), each.to_numpy(np.float64))


def scores(network: Network, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score) of every row: the probability of label 1 from the whole text; null counts as empty, which has a score
    too. Scores have six decimals, so that rows are scored alike wherever they stand; an empty table gives no rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                got = shared.value.score(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got.round(6))], [id_col, "score"])

    return docs.select(id_col, text).mapInArrow(score, f"`{id_col}` {id_type}, score double")
