"""Language ID by prediction by partial matching.

Each language has a context tree over bytes: every context of up to `order` bytes counts the bytes that
followed it in the language's sample. The tree is then frozen. A byte after a context is coded at the longest
context of the tree that has seen it; each context passed on the way costs its escape probability (method C: of
n occurrences with d distinct followers, a follower seen c times has c / (n + d), the escape d / (n + d)); below
the empty context all bytes are alike. The language with the shortest code for the whole text wins.

Because the statistics are frozen, the code length of a byte depends on the `order` bytes before it alone. The
trees are therefore compiled to one table over byte classes (bytes in no sample behave alike and share one),
and the code length of a text is a sum of table rows over all its bytes. If that table is too large for many
languages or bytes, only contexts of one byte get a table; longer ones keep, for each context and string that a
language has seen, what it adds to the code length of the next shorter context.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sleuthflow.functions.ranking import top_k
from sleuthflow.llm.common import extended, slices

ORDER = 2
#: Bounds of the sample of each language: rows, and bytes after which no further row is taken. Rows count whole.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 1_000_000
#: Cells (contexts times bytes times languages) up to which the model is one table.
CELLS = 1 << 24
#: A text that costs less per byte than this in some language is in it; above, held-out texts decide, if there are enough.
MOST_BITS, LEAST_HELD_OUT = 8.0, 10
#: Share of a language's letters from which a script is one of its own.
OWN_SCRIPT = 0.01
#: Bytes of a text that are looked up at once.
RUN = 1 << 20
NO_LANGUAGE = "und"


@dataclass
class Sparse:
    """keys, sorted; those of row k have values[ends[k] : ends[k + 1]] in the languages of the same places."""

    keys: np.ndarray
    ends: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    def sums(self, asked: np.ndarray, counts: np.ndarray, languages: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, asked), max(0, len(self.keys) - 1))
        hit = self.keys[at] == asked if len(self.keys) else np.zeros(len(asked), bool)
        at, counts = at[hit], counts[hit]
        sizes = self.ends[at + 1] - self.ends[at]
        flat = np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.languages[flat], self.values[flat] * np.repeat(counts, sizes), languages)


@dataclass
class Model:
    """languages; class of each byte; bits[(c2 * K + c1) * K + c, language]: code length of c after c2, c1.

    With `layers`, bits stops at contexts of one byte, and each layer has what the contexts of one byte more (their
    escapes) and the strings seen after them add.
    """

    languages: list[str]
    classes: np.ndarray
    bits: np.ndarray
    order: int
    layers: list[tuple[Sparse, Sparse]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return int(self.classes.max()) + 1


@dataclass
class Limits:
    """most[language, k]: bits per byte up to which a text of k bits of length is in the language; scripts of the samples."""

    most: dict[tuple[str, int], float]
    scripts: set[str]


def _code_lengths(texts: list[bytes], classes: np.ndarray, size: int, order: int) -> np.ndarray:
    """Bits of every (context, byte) of one language, by context tree from the empty context up."""
    bits = np.full(size, np.log2(256.0))
    for depth in range(order + 1):
        counts = np.zeros(size ** (depth + 1), np.int64)
        for text in texts:
            kinds = classes[np.frombuffer(text, np.uint8)].astype(np.int64)
            if len(kinds) > depth:
                gram = np.zeros(len(kinds) - depth, np.int64)
                for k in range(depth + 1):
                    gram = gram * size + kinds[k : len(kinds) - depth + k]
                counts += np.bincount(gram, minlength=len(counts))
        counts = counts.reshape(-1, size)
        total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        # Row of the shorter context: the same last depth - 1 classes, or the one row below the empty context.
        shorter = np.tile(bits.reshape(-1, size), (len(counts) // max(1, bits.size // size), 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(counts / (total + distinct))
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
        bits = np.where(counts > 0, seen, shorter + escape).ravel()
    return bits


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Frozen trees of all languages from their sample texts."""
    languages = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for text in texts:
            seen[np.frombuffer(text, np.uint8)] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.uint8)
    size = int(classes.max()) + 1
    whole = order if order < 2 or size ** (order + 1) * len(languages) <= CELLS else 1
    columns = [_code_lengths(samples[x], classes, size, whole).astype(np.float32) for x in languages]
    bits = np.stack(columns, axis=1) if columns else np.zeros((size ** (whole + 1), 0), np.float32)
    layers = _layers([samples[x] for x in languages], classes, size, order, bits) if whole < order else []
    return Model(languages, classes, bits, order, layers)


def _grams(kinds: np.ndarray, size: int, depth: int) -> np.ndarray:
    gram = np.zeros(max(0, len(kinds) - depth), np.int64)
    for k in range(depth + 1):
        gram = gram * size + kinds[k : k + len(gram)]
    return gram


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    """One table of the (keys, values) of each language."""
    keys = np.concatenate([k for k, _ in parts])
    names = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    found, start = np.unique(keys[order], return_index=True)
    values = np.concatenate([v for _, v in parts])[order].astype(np.float32)
    return Sparse(found, np.append(start, len(keys)), names[order].astype(np.int32), values)


def _layers(samples: list[list[bytes]], classes: np.ndarray, size: int, order: int, bits: np.ndarray) -> list[tuple[Sparse, Sparse]]:
    """What contexts of two bytes and more add, from the table `bits` of contexts of one byte."""
    layers, shorter = [], [(np.arange(size**2), bits[:, n]) for n in range(len(samples))]
    for depth in range(2, order + 1):
        escapes, strings = [], []
        for n, texts in enumerate(samples):
            found = [_grams(classes[np.frombuffer(t, np.uint8)].astype(np.int64), size, depth) for t in texts]
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            contexts, at, distinct = np.unique(keys // size, return_inverse=True, return_counts=True)
            both = np.bincount(at, counts, len(contexts)) + distinct
            escape, seen = -np.log2(distinct / both), -np.log2(counts / both[at])
            # The end of a string that was seen was seen too.
            held, values = shorter[n]
            below = values[np.searchsorted(held, keys % size**depth)]
            escapes.append((contexts, escape))
            strings.append((keys, seen - escape[at] - below))
            shorter[n] = (keys, seen)
        layers.append((_merged(escapes), _merged(strings)))
    return layers


def code_lengths(model: Model, text: bytes) -> np.ndarray:
    """Bits of the whole text under each language; the first bytes lack a context and are coded after class 0."""
    total = np.zeros(len(model.languages))
    size, order = model.size, model.order
    before = np.zeros(order, np.int32)
    for low in range(0, len(text), RUN):
        kinds = np.concatenate([before, model.classes[np.frombuffer(text[low : low + RUN], np.uint8)].astype(np.int32)])
        if model.layers:
            counts = np.bincount(_grams(kinds[order - 1 :].astype(np.int64), size, 1), minlength=size**2)
            some = counts.nonzero()[0]
            total += counts[some] @ model.bits[some].astype(np.float64)
            for depth, (escapes, strings) in enumerate(model.layers, 2):
                keys, counts = np.unique(_grams(kinds[order - depth :].astype(np.int64), size, depth), return_counts=True)
                total += escapes.sums(keys // size, counts, len(total)) + strings.sums(keys, counts, len(total))
        else:
            gram = kinds[: len(kinds) - order]
            for k in range(1, order + 1):
                gram = gram * size + kinds[k : len(kinds) - order + k]
            total += model.bits.take(gram, axis=0).sum(axis=0, dtype=np.float64)
        before = kinds[len(kinds) - order :]
    return total


def scripts(text: str) -> Counter[str]:
    """Letters of a text by script, as the first word of their names says it."""
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "?").split(" ")[0].split("-")[0]] += n
    return found


def limits(samples: dict[str, list[bytes]], order: int = ORDER) -> Limits:
    """Bits per byte of texts that the model has not seen: every fifth sample text, scored by a model of the others.

    A limit lies as far above the highest held-out text of about the same length as that lies above the median,
    and nowhere below MOST_BITS. Too few held-out texts give none.
    """
    model = train({x: [t for k, t in enumerate(texts) if k % 5] for x, texts in samples.items()}, order)
    most, own = {}, set()
    for n, name in enumerate(model.languages):
        costs: dict[int, list[float]] = {}
        for text in filter(None, samples[name][::5]):
            costs.setdefault(len(text).bit_length(), []).append(float(code_lengths(model, text)[n] / len(text)))
        for length, found in costs.items():
            if len(found) >= LEAST_HELD_OUT:
                most[name, length] = max(MOST_BITS, 2 * max(found) - float(np.median(found)))
        letters = scripts("".join(t.decode(errors="ignore") for t in samples[name]))
        own |= {x for x, count in letters.items() if count >= OWN_SCRIPT * letters.total()}
    return Limits(most, own)


def sample(docs: DataFrame, language: str = "lang", key: str = "doc_id", text: str = "text") -> dict[str, list[bytes]]:
    """Whole texts of at most SAMPLE_TEXTS rows of every language that labels name.

    Rows are chosen by a hash of the key, so every labelled row has the same chance; the choice reads keys
    and labels only. Of these, rows are taken in that order until SAMPLE_BYTES are reached, texts of more than an
    eighth of it after the others, so that few long texts do not stand for a language. No text is cut; a language
    takes less than SAMPLE_BYTES and one text more.
    """
    labelled = docs.where(F.col(language).isNotNull() & F.col(key).isNotNull())
    at = F.xxhash64(F.lit("sample"), F.col(key))
    slim = labelled.select(F.col(language).alias("lang"), F.col(key).alias("key"), at.alias("at"))
    # Hashes are even, so the first SAMPLE_TEXTS of n lie in the lowest few SAMPLE_TEXTS / n of the range; with
    # the others left out beforehand, the ranking reads a bounded number of rows whatever the table's size.
    reach = (F.lit(4.0 * SAMPLE_TEXTS) / F.col("count") * F.lit(2.0**64) - F.lit(2.0**63)).cast("long")
    reach = F.when(F.col("count") <= 4 * SAMPLE_TEXTS, F.lit(2**63 - 1)).otherwise(reach)
    counts = slim.groupBy("lang").count().select("lang", reach.alias("reach"))
    slim = slim.join(F.broadcast(counts), "lang").where(F.col("at") <= F.col("reach"))
    keys = top_k(slim, ["lang"], [F.asc("at"), F.asc("key")], SAMPLE_TEXTS).select("key").distinct()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = labelled.select(F.col(language).alias("lang"), F.col(key).alias("key"), at.alias("at"), body.alias("body"))
    rows = rows.join(F.broadcast(keys), "key", "left_semi")
    size = F.octet_length("body")
    order = Window.partitionBy("lang").orderBy(size > SAMPLE_BYTES // 8, "rn")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = top_k(rows, ["lang"], [F.asc("at"), F.asc("body")], SAMPLE_TEXTS).withColumn("before", before)
    found: dict[str, list[bytes]] = {}
    for row in sorted(first.where(F.col("before") < SAMPLE_BYTES).toLocalIterator(), key=lambda r: (r["lang"], r["rn"])):
        found.setdefault(row["lang"], []).append(bytes(row["body"]))
    return {x: texts for x, texts in found.items() if any(texts)}


def _standing(within: Limits | None, language: str, text: bytes, cost: float) -> str:
    if within is None or cost <= MOST_BITS:
        return "in"
    letters = scripts(text.decode(errors="ignore"))
    if 2 * sum(n for x, n in letters.items() if x not in within.scripts) > letters.total():
        return "foreign"
    return "in" if cost <= within.most.get((language, len(text).bit_length()), np.inf) else "out"


def predict(
    df: DataFrame,
    model: Model,
    text: str = "text",
    language: str = "lang_pred",
    score: str = "score",
    bits_per_byte: str = "bits_per_byte",
    within: Limits | None = None,
    standing: str = "standing",
) -> DataFrame:
    """`df` with the predicted language of whole texts, its score and the bits per byte of the winner.

    score is the winner's share of probability among the languages, from the code lengths. A text that is
    null or has no letter is `und` with score 0 and null bits; so is every text if no language was learned.
    Ties go to the first language by name. Equal texts get equal results; other columns stay, those named like
    an output are replaced; an empty table gives an empty one. With limits, standing says whether the text is
    `in` the language, `foreign` (most letters are of scripts that no language was learned in) or `out`.
    """
    held = df.sparkSession.sparkContext.broadcast((model, within))
    names = (language, score, bits_per_byte, standing if within else "_letter", "_letter")
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.StringType())[: 4 if within else 3]
    asked = df.drop(*[n for n in names if n != text]).withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, within = held.value
        for batch in batches:
            for part in slices(batch, text):
                found = []
                for value, letter in zip(part.column(text).cast(pa.binary()), part.column("_letter").to_pylist()):
                    if not letter or not model.languages:
                        found.append((NO_LANGUAGE, 0.0, None, "out"))
                        continue
                    body = value.as_py()
                    bits = code_lengths(model, body)
                    best = int(bits.argmin())
                    share = 1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()
                    cost = float(bits[best] / len(body))
                    found.append((model.languages[best], float(share), cost, _standing(within, model.languages[best], body, cost)))
                kept = {n: part.column(n) for n in part.schema.names if n != "_letter"}
                added = [pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.float64(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_pydict({**kept, **dict(zip(names, added))})

    schema = extended(asked.drop("_letter"), [T.StructField(n, k) for n, k in zip(names, kinds)])
    return asked.mapInArrow(run, schema)
