"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import CHUNK_BYTES, chunks, mix, stored, text_buffers

ORDER = 4
_TOP = 0x32000  # no character above it is a letter
_LETTER = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(_TOP)] + [False])
_MASK = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-grams, row of each, letters of each row). Letters are lower-cased; any run of other characters is one
    separator 0; each row starts after three separators and ends with one. Letters beyond U+FFFF share 65521 symbols."""
    rows = len(texts)
    body = "\n".join(pc.utf8_lower(texts).to_pylist()) + "\n"
    code = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = code == 10
    row = np.cumsum(lines) - lines
    if row[-1] + 1 != rows:
        raise ValueError("line breaks must be replaced before")
    low = np.where(code > 0xFFFF, code % 65521, code)
    s = np.where(_LETTER[np.minimum(code, _TOP)], low, 0).astype(np.uint64)
    before = np.zeros_like(s)
    before[1:] = np.where(row[1:] == row[:-1], s[:-1], 0)
    keep = (s != 0) | (before != 0)
    s, row = s[keep], row[keep]
    padded = np.zeros(len(s) + (ORDER - 1) * rows, np.uint64)
    at = np.arange(len(s)) + (ORDER - 1) * (row + 1)
    padded[at] = s
    key = np.zeros(len(s), np.uint64)
    for i in range(ORDER - 1, -1, -1):
        key = key << np.uint64(16) | padded[at - i]
    return key, row, np.bincount(row[s != 0], minlength=rows)


def _slices(column: pa.Array):
    """Row ranges and their texts: null as empty, line breaks as blanks. Only the texts of one range are copied at a time."""
    _, offsets = text_buffers(column)
    for a, b in chunks(offsets, CHUNK_BYTES // 2):
        yield a, pc.replace_substring(pc.fill_null(column.slice(a, b - a).cast(pa.large_string()), ""), "\n", " ")


def gram_counts(labelled: DataFrame, most_held: int = 1 << 20) -> DataFrame:
    """(lang, gram, n) of all texts; each task combines the counts of its batches before it sends them, once it holds
    most_held of them or has read everything."""
    def combined(found: dict[str, list]):
        for lang, parts in found.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def count(batches):
        found: dict[str, list] = {}
        held = 0
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, texts in _slices(batch.column(1)):
                key, row, _ = symbols(texts)
                of = langs[a:a + len(texts)]
                for lang in set(of.tolist()):
                    part = np.unique(key[(of == lang)[row]], return_counts=True)
                    found.setdefault(lang, []).append(part)
                    held += len(part[0])
                if held > most_held:
                    yield from combined(found)
                    found, held = {}, 0
        yield from combined(found)
    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Sorted 64-bit hashes with a table of where each leading-bits bucket starts; finds many keys at once."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in the sorted array, or -1."""
        h = mix(keys)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class KneserNey:
    """One language: counts of 4-grams, continuation counts below them, one absolute discount per order."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, alphabet: int):
        self.uniform, self.grams, self.contexts = 1 / alphabet, {}, {}
        for order in range(ORDER, 0, -1):
            table = HashArray(grams)
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.grams[order] = (table, n[table.order].astype(np.float64))
            heads, back = np.unique(grams >> np.uint64(16), return_inverse=True)
            total = np.bincount(back, n)
            kinds = np.bincount(back)
            where = HashArray(heads)
            self.contexts[order] = (where, total[where.order], (discount * kinds / total)[where.order], discount)
            if order > 1:
                grams, n = np.unique(grams & _MASK[order - 1], return_counts=True)

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), self.uniform)
        lower = self.probability(keys & _MASK[order - 1], order - 1)
        where, total, left_over, discount = self.contexts[order]
        at = where.find(keys >> np.uint64(16))
        seen = np.flatnonzero(at >= 0)
        table, n = self.grams[order]
        gram = table.find(keys[seen])
        count = np.where(gram >= 0, n[gram], 0)
        lower[seen] = np.maximum(count - discount, 0) / total[at[seen]] + left_over[at[seen]] * lower[seen]
        return lower


class Models:
    """All languages; log-probabilities of every 4-gram seen in any of them stand in one sorted hash array."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, self.limits = langs, {}
        union = np.unique(np.concatenate(grams)) if langs else np.zeros(0, np.uint64)
        alphabet = len(np.unique(union & _MASK[1])) + 1
        self.models = [KneserNey(g, n, alphabet) for g, n in zip(grams, counts, strict=True)]
        self.table = HashArray(union)
        self.logs = self._logs(union[self.table.order]).astype(np.float32)

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        return np.log(np.column_stack([m.probability(keys) for m in self.models])) if self.models else np.zeros((len(keys), 0))

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a symbol under each language, symbols, letters) of each row."""
        key, row, letters = symbols(texts)
        at = self.table.find(key)
        logs = self.logs[at] if len(self.logs) else np.zeros((len(key), len(self.langs)), np.float32)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            distinct, back = np.unique(key[missed], return_inverse=True)
            logs[missed] = self._logs(distinct)[back]
        size = np.bincount(row, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(size)
        if len(full) and self.langs:
            total[full] = np.add.reduceat(logs, (np.cumsum(size) - size)[full], axis=0, dtype=np.float64)
        return -total / np.maximum(size, 1)[:, None], size, letters


def fit(labelled: DataFrame, most_grams: int = 1 << 19) -> Models:
    """Models of every non-null lang of `labelled`, from all its texts.

    The counts are made by Spark over all rows. What the driver takes is bounded: where a language has more than
    most_grams 4-grams, its rarest counts (all of them alike) are left to the back-off."""
    counts = gram_counts(labelled.filter("lang IS NOT NULL")).cache()
    steps = (counts.groupBy("lang", F.least("n", F.lit(1000)).alias("n")).count().toPandas().sort_values("n", ascending=False))
    least = {}
    for lang, part in steps.groupby("lang"):
        fits = part[part["count"].cumsum() <= most_grams]
        least[lang] = int(fits.n.min()) if len(fits) else 1001
    langs, grams, numbers = sorted(least), [], []
    for lang in langs:
        got = counts.filter((F.col("lang") == lang) & (F.col("n") >= least[lang])).select("gram", "n").toPandas()
        got = got.sort_values("gram")
        grams.append(got.gram.to_numpy(np.int64).view(np.uint64))
        numbers.append(got.n.to_numpy(np.int64))
    counts.unpersist()
    kept = [i for i in range(len(langs)) if len(grams[i])]
    return Models([langs[i] for i in kept], [grams[i] for i in kept], [numbers[i] for i in kept])


def calibrate(models: Models, labelled: DataFrame, margin: float = 1.5) -> Models:
    """Sets the cross-entropy up to which a language is believed, from all labelled rows not used for fitting; equal rows count
    once. The rows are scored and summed up in Spark, and the driver takes one row a language.

    A text of n symbols is accepted up to (1 + margin/4) * m + margin * t / sqrt(n), where m is the median of its language
    and t the largest excess over m, times sqrt(n), that a labelled row shows. A language without such rows is held to the
    widest m and t of the others; if there are none at all, everything is accepted."""
    usable = labelled.filter("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    scored = predictions(models, usable.select(F.struct("lang", F.xxhash64("text").alias("hash")).alias("row"), "text"), "row")
    right = scored.filter("row.lang = lang_pred AND symbols > 0").select("row.lang", "row.hash", "entropy", "symbols").distinct()
    right = stored(right.select("lang", "entropy", "symbols"), "calibration")
    middles = right.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 1_000_000).alias("middle"))
    excess = F.max((F.col("entropy") - F.col("middle")) * F.sqrt("symbols"))
    found = right.join(middles, "lang").groupBy("lang").agg(F.first("middle").alias("middle"), excess.alias("excess")).collect()
    models.limits = {r.lang: (r.middle * (1 + margin / 4), margin * max(0.5, r.excess)) for r in found}
    if found:
        widest = tuple(max(x) for x in zip(*models.limits.values(), strict=True))
        models.limits |= {lang: widest for lang in models.langs if lang not in models.limits}
    return models


def predictions(models: Models, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, entropy, symbols, accepted.

    lang_pred has the lowest cross-entropy a symbol (ties: first in alphabetical order); it is `und`, with score 0 and not
    accepted, where the text is null or has no letter, or nothing was learned. score: the share of lang_pred among all
    languages when at most 64 symbols count as evidence. accepted: the cross-entropy is within the calibrated limit.
    Texts are read whole; repeated rows are predicted alike; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches):
        m = shared.value
        for batch in batches:
            for a, texts in _slices(batch.column(1)):
                h, size, letters = m.entropies(texts)
                known = (letters > 0) & bool(m.langs)
                best = h.argmin(1) if m.langs else np.zeros(len(texts), int)
                low = h.min(1) if m.langs else np.zeros(len(texts))
                share = 1 / np.exp(-(h - low[:, None]) * np.minimum(size, 64)[:, None]).sum(1) if m.langs else low
                names = np.array([*m.langs, "und"], object)[np.where(known, best, len(m.langs))]
                limit = np.array([sum(x * y for x, y in zip(m.limits.get(name, (np.inf, 0)), (1, k ** -0.5), strict=True)) if ok else -1
                                  for name, k, ok in zip(names, np.maximum(size, 1).tolist(), known, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(names.tolist(), pa.string()), pa.array(np.where(known, share, 0.0)),
                     pa.array(low), pa.array(size), pa.array(known & (low <= limit))],
                    [id_col, "lang_pred", "score", "entropy", "symbols", "accepted"])

    return docs.select(id_col, text).mapInArrow(
        predict, f"`{id_col}` {id_type}, lang_pred string, score double, entropy double, symbols long, accepted boolean")


def accepted_rows(models: Models, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text is accepted as of a learned language; columns are unchanged, and no row is moved. Rows without
    a letter go; if nothing was learned, all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def decide(column: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for _, texts in _slices(column):
            h, size, letters = m.entropies(texts)
            best = [m.langs[i] for i in h.argmin(1)] if m.langs else [""] * len(texts)
            limits = [m.limits.get(x, (np.inf, 0)) for x in best]
            low = h.min(1) if m.langs else np.zeros(len(texts))
            out.append((letters > 0) & (low <= np.array([a + b * max(k, 1) ** -0.5 for (a, b), k in zip(limits, size.tolist(), strict=True)])))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(F.arrow_udf(decide, "boolean")(F.col(text)))
