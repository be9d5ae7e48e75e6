"""Language identification by a small byte convolutional network.

A text is lower-cased, encoded as UTF-8 and cut into windows of `WINDOW` bytes, the last one padded with spaces. Bytes are
embedded, filters of 2, 3 and 4 bytes run over each window, every filter keeps its maximum (and at least zero), and a
softmax over the learned languages follows. The probability of a text is the mean over all its windows, weighted by their
bytes, so whole texts count.

Training is numpy on the driver, on a bounded sample of labelled rows: of every language the `docs_per_lang` documents
that come first by a hash of the row, with at most `windows_per_doc` windows each, spaced evenly. Languages are counted
first, so that only half as many documents again leave their tasks for that choice. In prediction the
embedding and the filters are folded into tables by byte pairs, so a filter of four bytes is the sum of two look-ups.

Defined results: a text that is null or has no letter is `und` with score 0. Rows without a text or without a language
teach nothing. With no usable training row at all every text is `und`. Repeated rows and ties are judged each by its text
alone (of equally likely languages the first by name). Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.batches import small_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSIONS = 8
DOCS_PER_LANG = 800
WINDOWS_PER_DOC = 6
EPOCHS = 6
BATCH = 64
RATE = 0.01
SLAB = 512  # windows predicted at once
UNKNOWN = "und"

Model = dict[str, np.ndarray | list[str]]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes; an empty text has one window of spaces."""
    data = text.lower().encode("utf-8", "replace")
    count = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(count * WINDOW), np.uint8).reshape(count, WINDOW)


def training_windows(docs: DataFrame, docs_per_lang: int, windows_per_doc: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bytes, class numbers and class names of the bounded sample."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, data = [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if has_letter(text):
                    found = windows(text)
                    for at in sorted(set(np.linspace(0, len(found) - 1, windows_per_doc).astype(int).tolist())):
                        langs.append(lang)
                        data.append(found[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "data"])

    known = small_batches(docs).filter("text is not null and lang is not null")
    spot = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) / (1 << 30)  # between 0 and 1, by the whole row
    share = known.groupBy("lang").agg((F.lit(docs_per_lang * 1.5) / F.count("*")).alias("share"))
    # one row for each language; the model has a class for each, so there are few
    few = known.select("text", "lang", spot.alias("spot")).join(F.broadcast(share), "lang").filter("spot < share")
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text")))
    sample = ranked.filter(f"n <= {docs_per_lang}").select("text", "lang").mapInArrow(cut, "lang string, data binary").toArrow()
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist()))
    names = sorted({lang for lang, _ in rows})
    data = np.frombuffer(b"".join(d for _, d in rows), np.uint8).reshape(-1, WINDOW)
    return data, np.array([names.index(lang) for lang, _ in rows], np.int64), names


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, seed: int = 1) -> Model:
    """A model from the columns text and lang; classes weigh alike."""
    return fit(*training_windows(docs, docs_per_lang, windows_per_doc), seed=seed)


def fit(data: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 1, epochs: int = EPOCHS) -> Model:
    """Adam on the cross entropy; gradients pass only through the positions that won the pooling."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {"bytes": rng.normal(0, 0.5, (256, DIMENSIONS))}
    for width in WIDTHS:
        p[f"w{width}"] = rng.normal(0, 1 / np.sqrt(width * DIMENSIONS), (width * DIMENSIONS, FILTERS))
        p[f"b{width}"] = np.zeros(FILTERS)
    p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))
    p["bias"] = np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    share = np.bincount(labels, minlength=len(names)).astype(np.float32)
    weight = len(labels) / np.maximum(share, 1) / max(len(names), 1)
    step = 0
    for _ in range(epochs if len(names) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            step += 1
            for k, g in gradients(p, data[picked], labels[picked], weight).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return {**p, "names": names}


def gradients(p: dict[str, np.ndarray], data: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    n = len(data)
    embedded = p["bytes"][data]
    pooled, won = [], []
    for width in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)  # n, place, dimension, tap
        patches = patches.transpose(0, 1, 3, 2).reshape(n, -1, width * DIMENSIONS)
        response = patches @ p[f"w{width}"]
        best = response.argmax(axis=1)
        won.append((best, patches[np.arange(n)[:, None], best]))
        pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0] + p[f"b{width}"])
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    chance = softmax(hidden @ p["out"] + p["bias"])
    delta = chance
    delta[np.arange(n), labels] -= 1
    delta *= (weight[labels] / n)[:, None]
    grads = {"out": hidden.T @ delta, "bias": delta.sum(axis=0), "bytes": np.zeros_like(p["bytes"])}
    back = (delta @ p["out"].T) * (hidden > 0)
    for i, width in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        best, patch = won[i]
        grads[f"w{width}"] = np.einsum("nfd,nf->df", patch, g)
        grads[f"b{width}"] = g.sum(axis=0)
        spread = (g[:, :, None] * p[f"w{width}"].T).reshape(n, FILTERS, width, DIMENSIONS)
        places = data[np.arange(n)[:, None, None], best[:, :, None] + np.arange(width)]
        np.add.at(grads["bytes"], places.ravel(), spread.reshape(-1, DIMENSIONS))
    return grads


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pair_tables(model: Model) -> dict[str, np.ndarray]:
    """Responses to a byte or a byte pair at its place in a filter."""
    tables = {}
    for width in WIDTHS:
        taps = [(model["bytes"] @ model[f"w{width}"].reshape(width, DIMENSIONS, FILTERS)[t]).astype(np.float32) for t in range(width)]
        for t in range(0, width - 1, 2):
            tables[f"{width}.{t}"] = (taps[t][:, None] + taps[t + 1][None]).reshape(65536, FILTERS)
        if width % 2:
            tables[f"{width}.{width - 1}"] = taps[-1]
    return tables


def window_chances(model: Model, tables: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """Probabilities (n, classes) of windows."""
    pairs = data[:, :-1].astype(np.int32) << 8 | data[:, 1:]
    pooled = []
    for width in WIDTHS:
        places = WINDOW - width + 1
        response = tables[f"{width}.0"][pairs[:, :places]]
        for t in range(2, width, 2):
            part = pairs[:, t : t + places] if t + 1 < width else data[:, t : t + places]
            response += tables[f"{width}.{t}"][part]
        pooled.append(response.max(axis=1) + model[f"b{width}"])
    return softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ model["out"] + model["bias"])


@lru_cache(maxsize=2)
def _tables_for(key: bytes) -> tuple[Model, dict[str, np.ndarray]]:
    import pickle

    model = pickle.loads(key)
    return model, pair_tables(model)


def judge(texts: Iterator[str | None], model: Model, tables: dict[str, np.ndarray]) -> list[tuple[str, float]]:
    """(language, score) of each text; windows of all texts share batches."""
    names = model["names"]
    found: list[tuple[str, float]] = []
    sums: list[np.ndarray | None] = []
    held, owners, sizes, count = [], [], [], 0

    def flush() -> None:
        nonlocal held, owners, sizes, count
        if held:
            data = np.concatenate(held)
            chances = np.concatenate([window_chances(model, tables, data[i : i + SLAB]) for i in range(0, len(data), SLAB)])
            ends = np.cumsum([len(x) for x in held])[:-1]
            for owner, part, size in zip(owners, np.split(chances, ends), sizes):
                full = np.full(len(part), WINDOW, np.float64)
                full[-1] = size
                sums[owner] = sums[owner] + full @ part
        held, owners, sizes, count = [], [], [], 0

    for text in texts:
        if not names or not has_letter(text):
            sums.append(None)
            continue
        cut = windows(text)
        sums.append(np.zeros(len(names)))
        for at in range(0, len(cut), 64 * SLAB):  # very long texts pass in pieces
            piece = cut[at : at + 64 * SLAB]
            last = len(text.lower().encode("utf-8", "replace")) - (len(cut) - 1) * WINDOW if at + len(piece) == len(cut) else WINDOW
            held.append(piece)
            owners.append(len(sums) - 1)
            sizes.append(max(1, last))
            count += len(piece)
            if count >= 16 * SLAB:
                flush()
    flush()
    for total in sums:
        if total is None:
            found.append((UNKNOWN, 0.0))
        else:
            best = int(total.argmax())
            found.append((names[best], float(np.clip(total[best] / total.sum(), 0, 1))))
    return found


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score."""
    import pickle

    key = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = _tables_for(key)
        for batch in batches:
            judged = judge((t.as_py() for t in batch.column(place)), own, tables)
            columns = [pa.array([x for x, _ in judged], pa.string()), pa.array([x for _, x in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, lang_col, score_col])

    rest = [c for c in docs.columns if c not in (lang_col, score_col)]
    place = rest.index(text_col)
    picked = small_batches(docs).select(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(run, f"{schema}, {lang_col} string, {score_col} double")
