"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its text blocks. Each block is a vector: the mean of
the embeddings of its hashed tag path, the mean of the embeddings of its hashed
words, and a few counts. A bidirectional LSTM in numpy reads the sequence, so
every block is judged with all blocks before and after it in view, and the
blocks judged to be of the article are joined in page order.

The labeller is trained in a task of its own, once a session, on synthetic
pages with known labels whose number is the parameter `synthetic_pages`; no
page of the corpus is used, so its size does not depend on the input. The
trained weights have a fixed size and are broadcast.

Null or empty html gives an empty text, and so does a page without a block.
Pages are judged one by one, so repeated pages give equal results; pages of
any length are read whole, and other columns play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .htmlblocks import N_NUMBERS, PATH_SLOTS, WORD_SLOTS, Memory, Pages, blocks_of, numbers_of

PATH_DIM, WORD_DIM, HIDDEN = 16, 8, 16
INPUT = PATH_DIM + WORD_DIM + N_NUMBERS


def fresh(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    weights = {
        "path": r.normal(0, 0.3, (PATH_SLOTS, PATH_DIM)), "word": r.normal(0, 0.1, (WORD_SLOTS, WORD_DIM)),
        "out": r.normal(0, 0.3, (2 * HIDDEN,)), "out_bias": np.zeros(1),
    }
    for way in ("forward", "backward"):
        weights[way] = r.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN + 1, 4 * HIDDEN))
        weights[way][-1, HIDDEN : 2 * HIDDEN] = 1.0  # the forget gates begin open
    return {k: v.astype(np.float32) for k, v in weights.items()}


def bags(lists: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, the bag of each, and the weight of each: one by the size of its bag."""
    sizes = np.array([len(x) for x in lists], np.int64)
    members = np.fromiter((m for x in lists for m in x), np.int64, int(sizes.sum()))
    return members, np.repeat(np.arange(len(lists)), sizes), np.repeat(1 / np.maximum(sizes, 1), sizes).astype(np.float32)


def means(embedding: np.ndarray, bag: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    members, of, weight = bag
    out = np.empty((n, embedding.shape[1]), np.float32)
    for k in range(embedding.shape[1]):
        out[:, k] = np.bincount(of, embedding[members, k] * weight, minlength=n)
    return out


def features(blocks: list, memory: Memory) -> tuple:
    """Path bags, word bags and numbers of blocks."""
    paths = bags([memory.path_slots(p) for p, *_ in blocks])
    words = bags([tuple(map(memory.word_slot, text.split())) for _, text, *_ in blocks])
    return paths, words, np.array([numbers_of(t, l, tag) for _, t, l, tag in blocks], np.float32).reshape(len(blocks), N_NUMBERS)


def vectors(weights: dict, found: tuple) -> np.ndarray:
    paths, words, numbers = found
    n = len(numbers)
    return np.concatenate((means(weights["path"], paths, n), means(weights["word"], words, n), numbers), 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_lstm(weights: np.ndarray, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (steps, rows, HIDDEN) of inputs (steps, rows, INPUT); rows end with zeros where they are short."""
    steps, rows, _ = x.shape
    outer = x.reshape(steps * rows, -1) @ weights[:INPUT] + weights[-1]
    outer = outer.reshape(steps, rows, -1)
    inner = weights[INPUT:-1]
    h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    states, memory = np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        z = outer[t] + h @ inner
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[t] = h
        if keep:
            memory.append((i, f, o, g, before, h_before, squashed))
    return states, memory


def unroll(weights: np.ndarray, x: np.ndarray, memory: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weights and of the inputs, by back-propagation through the steps."""
    steps, rows, _ = x.shape
    inner = weights[INPUT:-1]
    dz_all = np.empty((steps, rows, 4 * HIDDEN), np.float32)
    d_inner = np.zeros_like(inner)
    dh_next, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, h_before, squashed = memory[t]
        dh = d_states[t] + dh_next
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)), 1)
        dz_all[t] = dz
        d_inner += h_before.T @ dz
        dh_next = dz @ inner.T
        dc = dc * f
    flat = dz_all.reshape(steps * rows, -1)
    d_weights = np.concatenate((x.reshape(steps * rows, -1).T @ flat, d_inner, flat.sum(0, keepdims=True)))
    return d_weights, (flat @ weights[:INPUT].T).reshape(x.shape)


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of the given sizes, one after another: row of each block, its step, and its step from the row's end."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, step, sizes[row] - 1 - step


def scores(weights: dict, blocks: list, sizes: np.ndarray, memory: Memory, most: int = 1 << 18) -> np.ndarray:
    """Log odds of every block to be article text; pages of like length go through the steps together."""
    out = np.zeros(len(blocks), np.float32)
    if not blocks:
        return out
    x = vectors(weights, features(blocks, memory))
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        # A group's area, rows times its longest page, is bounded unless one page alone is larger.
        b = a + 1
        while b < len(order) and (b + 1 - a) * sizes[order[b]] <= most and b - a < 512:
            b += 1
        group = order[a:b]
        a = b
        n = sizes[group]
        if not n.max():
            continue
        row, step, back = layout(n)
        at = np.repeat(first[group], n) + step
        for way, when, w in (("forward", step, weights["out"][:HIDDEN]), ("backward", back, weights["out"][HIDDEN:])):
            padded = np.zeros((int(n.max()), len(group), INPUT), np.float32)
            padded[when, row] = x[at]
            out[at] += run_lstm(weights[way], padded)[0][when, row] @ w
    return out + weights["out_bias"][0]


def train(pages: int = 3600, epochs: int = 5, rows: int = 16, rate: float = 0.01, seed: int = 20) -> dict[str, np.ndarray]:
    """Weights of the labeller, by Adam on `pages` synthetic pages."""
    maker, examples, memory_ = Pages(seed), [], Memory()
    while len(examples) < pages:
        html, truth = maker.page()
        blocks = blocks_of(html, memory_)
        # The reader must find the blocks that were written, or there are no labels; a page may have none at all.
        if [b[1] for b in blocks] != [t for t, _ in truth]:
            raise AssertionError("the block reader disagrees with a generated page")
        if blocks:
            examples.append((blocks, np.array([main for _, main in truth], np.float32)))
    examples.sort(key=lambda e: len(e[0]))
    batches = []
    for a in range(0, pages, rows):
        part = examples[a : a + rows]
        sizes = np.array([len(b) for b, _ in part])
        batches.append((features([b for bs, _ in part for b in bs], memory_), layout(sizes), np.concatenate([y for _, y in part]), sizes))
    weights = fresh(seed)
    moment, square = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}
    r, step_no = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for b in r.permutation(len(batches)).tolist():
            found, (row, step, back), y, sizes = batches[b]
            x = vectors(weights, found)
            logit = np.full(len(y), weights["out_bias"][0], np.float32)
            kept = {}
            for way, when, w in (("forward", step, weights["out"][:HIDDEN]), ("backward", back, weights["out"][HIDDEN:])):
                padded = np.zeros((int(sizes.max()), len(sizes), INPUT), np.float32)
                padded[when, row] = x
                states, memory = run_lstm(weights[way], padded, keep=True)
                kept[way] = padded, states[when, row], memory, when, w
                logit += kept[way][1] @ w
            error = (sigmoid(logit) - y) / len(y)
            grads = {"out_bias": np.array([error.sum()]), "out": np.concatenate([kept[w][1].T @ error for w in ("forward", "backward")])}
            dx = np.zeros_like(x)
            for way, (padded, _, memory, when, w) in kept.items():
                d_states = np.zeros((*padded.shape[:2], HIDDEN), np.float32)
                d_states[when, row] = error[:, None] * w
                grads[way], d_padded = unroll(weights[way], padded, memory, d_states)
                dx += d_padded[when, row]
            for name, (members, of, weight), part in (("path", found[0], dx[:, :PATH_DIM]), ("word", found[1], dx[:, PATH_DIM : PATH_DIM + WORD_DIM])):
                grad = np.zeros_like(weights[name])
                for k in range(part.shape[1]):
                    grad[:, k] = np.bincount(members, part[of, k] * weight, minlength=len(grad))
                grads[name] = grad
            step_no += 1
            now = rate * (1 - epoch / epochs * 0.8)
            for k, g in grads.items():
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.01 * (g * g - square[k])
                weights[k] = weights[k] - np.float32(now / (1 - 0.9**step_no)) * moment[k] / (np.sqrt(square[k] / (1 - 0.99**step_no)) + 1e-8).astype(np.float32)
    return {k: v.astype(np.float32) for k, v in weights.items()}


#: Weights that a session has trained, by the session's application and the number of pages.
_trained: dict[tuple[str, int], dict[str, np.ndarray]] = {}


def trained(spark: SparkSession, pages: int) -> dict[str, np.ndarray]:
    """The weights of `train`, fitted in one task; what comes back has a fixed size."""
    key = (spark.sparkContext.applicationId, pages)
    if key not in _trained:

        def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = train(pages)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found)), pa.array([list(x.shape) for x in found.values()], pa.list_(pa.int64())), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["name", "shape", "data"]
            )

        rows = spark.range(0, 1, 1, 1).mapInArrow(run, "name string, shape array<long>, data binary").collect()
        _trained[key] = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in rows}
    return _trained[key]


def main_texts(weights: dict, htmls: list[str | None], memory: Memory, slab: int = 1 << 22) -> list[str]:
    out, i = [], 0
    while i < len(htmls):
        found, sizes, size = [], [], 0
        while i < len(htmls) and size < slab:
            page = htmls[i] or ""
            blocks = blocks_of(page, memory)
            found += blocks
            sizes.append(len(blocks))
            size += len(page)
            i += 1
        main = scores(weights, found, np.array(sizes, np.int64), memory) > 0
        at = 0
        for n in sizes:
            out.append("\n".join(found[k][1] for k in range(at, at + n) if main[k]))
            at += n
    return out


def extract(pages: DataFrame, synthetic_pages: int = 3600) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    weights = spark.sparkContext.broadcast(trained(spark, synthetic_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for b in batches:
            texts = main_texts(weights.value, b.column(2).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
