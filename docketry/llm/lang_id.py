"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training document. The regression is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
documents, and a temperature, fitted on a part of the sample that the regression has not seen,
calibrates its probabilities. Features are hashed to a fixed number of places.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import crc_remainder, materialise

#: Places of hashed n-grams, and the n-grams' lengths.
BITS, ORDERS = 15, (1, 2, 3)
PLACES = 1 << BITS
UNKNOWN = "und"


def letters_only(text: pa.Array) -> pa.Array:
    """Lower case, with every run of ASCII other than letters as one space."""
    return pc.replace_substring_regex(pc.utf8_lower(text), "[\\x00-`{-\\x7f]+", " ")


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed places of each n-gram length at every character, and where each text begins.

    A text stands between two spaces before and one behind, so no n-gram reaches into another
    text's characters.
    """
    points = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    first = np.cumsum([0, *(len(t) + 3 for t in texts)])
    found, running = [], np.zeros(len(points), np.uint64)
    ahead = np.concatenate([points, np.full(max(ORDERS), 32, np.uint64)])
    for n in range(1, max(ORDERS) + 1):
        running = running * np.uint64(0x100000001B3) + ahead[n - 1 : n - 1 + len(points)]
        if n in ORDERS:
            mixed = (running ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return found, first


def _groups(texts: list[str], limit: int = 300_000) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t) + 3
    if at < len(texts):
        yield at, len(texts)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(PLACES, np.int64), 0
    for batch in batches:
        texts = letters_only(batch.column("text")).to_pylist()
        docs += len(texts)
        for lo, hi in _groups(texts):
            found, first = ngrams(texts[lo:hi])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                seen = np.zeros(PLACES, bool)
                for places in found:
                    seen[places[a:b]] = True
                total += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([docs, *total[at].tolist()], pa.int64())], names=["place", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = letters_only(batch.column("text")).to_pylist()
        rows: list[list[bytes]] = [[], []]
        for text in texts:
            places, counts = np.unique(np.concatenate(ngrams([text])[0]), return_counts=True)
            rows[0].append(places.astype(np.int32).tobytes())
            rows[1].append(counts.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), *(pa.array(x, pa.binary()) for x in rows)], names=["lang", "rank", "places", "counts"])


@dataclass
class LanguageModel:
    """Languages, or numbers of models for groups of them, a table of weight times idf for each place and language with the idf itself, biases, temperature."""

    languages: list[str | int]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities by text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi in _groups(texts):
            found, first = ngrams(texts[lo:hi])
            rows = self.table[found[0]]
            for places in found[1:]:
                rows += self.table[places]
            sums = np.add.reduceat(rows, first[:-1], axis=0, dtype=np.float64)
            out[lo:hi] = softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + self.bias) / self.temperature)
        return out


@dataclass
class LabelTree:
    """Models whose labels are languages or models before them; the last is the root."""

    models: list[LanguageModel]

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Each text's language and its probability: the likeliest child from the root down, and the product along the way."""
        out, scores = [None] * len(texts), np.ones(len(texts))
        waiting = {len(self.models) - 1: np.arange(len(texts))}
        while waiting:
            node, at = waiting.popitem()
            model = self.models[node]
            p = model.probabilities([texts[i] for i in at])
            best = p.argmax(axis=1)
            scores[at] *= p.max(axis=1)
            for c in np.unique(best).tolist():
                mine, child = at[best == c], model.languages[c]
                if isinstance(child, str):
                    for i in mine.tolist():
                        out[i] = child
                else:
                    waiting[child] = mine
        return out, scores


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; examples are (class, places, values). Coordinates within the L1 penalty are zero."""
    z, n = np.zeros((PLACES + 1, classes)), np.zeros((PLACES + 1, classes))

    def weights(places: np.ndarray) -> np.ndarray:
        zi, free = z[places], (places == PLACES)[:, None]
        small = np.abs(zi) - np.where(free, 0.0, l1)
        return -np.sign(zi) * np.maximum(small, 0) / ((beta + np.sqrt(n[places])) / alpha + np.where(free, 0.0, l2))

    for _ in range(epochs):
        for label, places, values in examples:
            places, x = np.append(places, PLACES), np.append(values, 1.0)
            w = weights(places)
            error = softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            grown = n[places] + g * g
            z[places] += g - (np.sqrt(grown) - np.sqrt(n[places])) / alpha * w
            n[places] = grown
    w = weights(np.arange(PLACES + 1))
    return w[:-1], w[-1]


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm.

    One error among n + 2 is taken for granted, so that a sample without errors gives no certainty.
    """
    if not len(labels) or margins.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)
    target = np.full(margins.shape, doubt / (margins.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(t: float) -> float:
        return -float((np.log(softmax(margins / math.exp(t)) + 1e-300) * target).sum(axis=1).mean())

    lo, hi, ratio = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


#: Serial numbers of equal rows are dealt out in runs of so many.
RUN = 4096
#: Labels, or groups of them, that one regression tells apart; examples that one above the lowest takes in all.
FAN, UPPER_EXAMPLES = 64, 30_000


def draw(labelled: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """(doc_id, lang, text, rank) of labelled(doc_id, text, lang): at most `per_language` rows of each language, of the smallest ranks.

    The rank hashes id, text and a number among the rows that are equal in both: null and repeated
    ids are drawn like any other, and how the table is dealt out makes no difference. Equal rows are
    counted, numbered in runs, and only the texts of drawn ones are read again.
    """
    spark, steps = labelled.sparkSession, 1 << 40
    shares = [(k, int(steps * 1.1 * per_language / n) + 1) for k, n in sizes.items()]
    keyed = labelled.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    same = keyed.groupBy("lang", "row_hash").agg(F.count("*").alias("n")).join(F.broadcast(spark.createDataFrame(shares, "lang string, share long")), "lang")
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}")))).repartition("row_hash", "run")
    inside = F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    ranked = runs.select("lang", "row_hash", "share", F.explode(inside).alias("serial")).withColumn("rank", F.pmod(F.xxhash64("row_hash", "serial"), F.lit(steps)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "row_hash"))
    drawn = materialise(ranked.filter(F.col("rank") < F.col("share")).withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "row_hash", "rank"), "language-draw")
    wanted = keyed.join(drawn.select("lang", "row_hash").distinct(), ["lang", "row_hash"], "left_semi")
    texts = wanted.groupBy("lang", "row_hash").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    return drawn.join(texts, ["lang", "row_hash"]).select("doc_id", "lang", "text", "rank")


FOLDS = 256


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each label, its examples' n-grams by the last bits of their places."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, places, counts in zip(batch.column("lang").to_pylist(), batch.column("places").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = sums.setdefault(lang, np.zeros(FOLDS))
            own += np.bincount(np.frombuffer(places, np.int32) % FOLDS, np.frombuffer(counts, np.int32), FOLDS)
    yield pa.RecordBatch.from_pydict({"lang": list(sums), "folds": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("folds", pa.list_(pa.float64()))]))


def _alike(rows: np.ndarray) -> np.ndarray:
    """An order of rows in which similar ones stand near each other: along the direction of their largest spread."""
    rows = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1e-9)
    rows = rows - rows.mean(axis=0)
    direction = np.linalg.svd(rows, full_matrices=False)[2][0]
    along = np.round(rows @ (direction * np.sign(direction[np.abs(direction).argmax()])), 9)
    return np.argsort(along, kind="stable")


def label_tree(languages: list[str], examples: DataFrame, fan: int) -> list[list[str | int]]:
    """Nodes as lists of children, labels or numbers of nodes; the last node is the root. Up to `fan` labels make one node.

    More labels are ordered by the likeness of their n-grams and cut into nodes of `fan` at most; so are these nodes, if they are more.
    """
    if len(languages) <= fan:
        return [list(languages)]
    found = examples.select("lang", "places", "counts").mapInArrow(_folded, "lang string, folds array<double>").select("lang", F.posexplode("folds").alias("at", "x"))
    sums = {r["lang"]: r["v"] for r in found.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("v")).collect()}
    level: list[str | int] = list(languages)
    rows = np.array([sums.get(k, [0.0] * FOLDS) for k in languages])
    nodes: list[list[str | int]] = []
    while len(level) > 1:
        order = _alike(rows) if len(level) > fan else np.arange(len(level))
        cuts = np.array_split(order, -(-len(level) // fan))
        nodes += [[level[i] for i in cut] for cut in cuts]
        level, rows = list(range(len(nodes) - len(cuts), len(nodes))), np.array([rows[cut].sum(axis=0) for cut in cuts])
    return nodes


def _fit(group: pa.Table, classes: dict[int, int], idf: np.ndarray, scale: float, options: dict) -> pa.Table:
    """One node's regression and temperature, on its examples in the order of their ranks."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("rank", "lang", "places", "counts", "class")), strict=True))
    node = group.column("node")[0].as_py()
    examples = []
    for _, _, places, counts, label in rows:
        at = np.frombuffer(places, np.int32).astype(np.int64)
        x = np.frombuffer(counts, np.int32) * idf[at]
        examples.append((label, at, scale * x / x.sum()))
    kept_back = examples[::5] if len(examples) >= 50 else []
    used = [e for i, e in enumerate(examples) if i % 5] if kept_back else examples
    w, bias = fit_ftrl(used, classes[node], **options)
    margins = np.array([x @ w[places] + bias for _, places, x in kept_back])
    temperature = fit_temperature(margins, np.array([k for k, _, _ in kept_back], np.int64))
    table = np.concatenate([scale * idf[:, None] * w, idf[:, None]], axis=1).astype(np.float32)
    return pa.table({"node": pa.array([node], pa.int32()), "table": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary()), "bias": pa.array([bias.tobytes()], pa.binary()), "temperature": pa.array([temperature])})


def train(
    labelled: DataFrame, per_language: int = 500, max_languages: int | None = None, epochs: int = 6,
    alpha: float = 2.0, beta: float = 0.1, l1: float = 1e-3, l2: float = 1e-3, scale: float = 30.0, fan: int = FAN,
) -> LabelTree | None:
    """Fit on labelled(doc_id, text, lang), all non-null; None without any row.

    Document frequencies count every row. The fit takes `per_language` documents of each language at
    most (see `draw`); a fifth of them only sets the temperature. Up to `fan` labels are told apart by
    one regression. More are put into a tree of regressions (see `label_tree`), each fitted by a task
    of its own; one above the lowest takes the same number of each label's documents, about 30,000 in
    all. With `max_languages`, that many labels of most documents are learnt, of equal ones the
    first by name. The model holds 130 kB for each label; only its tables reach the driver.
    """
    most = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    most = most.orderBy(F.desc("n"), "lang").limit(max_languages) if max_languages else most
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return None
    spark, languages = labelled.sparkSession, sorted(sizes)
    frequencies = labelled.select("text").mapInArrow(_document_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(PLACES)
    docs = 0
    for place, n in frequencies:
        if place < 0:
            docs = n
        else:
            df[place] = n
    idf = np.log((1 + docs) / (1 + df)) + 1
    drawn = draw(labelled, sizes, per_language)
    examples = materialise(drawn.select("lang", "rank", "text").mapInArrow(_examples, "lang string, rank long, places binary, counts binary"), "language-examples")
    nodes = label_tree(languages, examples, fan)
    under: list[list[str]] = []
    for children in nodes:
        under.append([k for c in children for k in ([c] if isinstance(c, str) else under[c])])
    paths = []
    for node, children in enumerate(nodes):
        quota = per_language if all(isinstance(c, str) for c in children) else min(per_language, max(1, UPPER_EXAMPLES // len(under[node])))
        paths += [(k, node, i, quota) for i, c in enumerate(children) for k in ([c] if isinstance(c, str) else under[c])]
    place = F.row_number().over(Window.partitionBy("node", "lang").orderBy("rank", "places", "counts"))
    dealt = examples.join(F.broadcast(spark.createDataFrame(paths, "lang string, node int, class int, quota int")), "lang").withColumn("place", place).filter("place <= quota")
    classes, options = {i: len(c) for i, c in enumerate(nodes)}, {"epochs": epochs, "alpha": alpha, "beta": beta, "l1": l1, "l2": l2}

    def work(group: pa.Table) -> pa.Table:
        return _fit(group, classes, idf, scale, options)

    fitted = dealt.select("node", "class", "lang", "rank", "places", "counts").groupBy("node").applyInArrow(work, "node int, table binary, bias binary, temperature double")
    models = {}
    for r in fitted.toLocalIterator():
        children = nodes[r["node"]]
        table = np.frombuffer(zlib.decompress(r["table"]), np.float32).reshape(PLACES, len(children) + 1)
        models[r["node"]] = LanguageModel(children, table, np.frombuffer(r["bias"]), r["temperature"])
    return LabelTree([models[i] for i in range(len(nodes))])


#: Rows that are predicted, and handed on, at a time.
SLICE = 512


def _predict(batches: Iterator[pa.RecordBatch], model, text_at: int, given: int) -> Iterator[pa.RecordBatch]:
    """The first `given` columns as they stand, then prediction and score by the text, which is column `text_at`."""
    fitted: LabelTree | None = pickle.loads(model.value)
    for whole in batches:
        for lo in range(0, max(whole.num_rows, 1), SLICE):
            batch = whole.slice(lo, SLICE)
            text = pc.fill_null(batch.column(text_at), "")
            lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            languages, scores = np.where(lettered, None, UNKNOWN), np.zeros(len(text))
            at = np.flatnonzero(lettered)
            if fitted and len(at):
                languages[at], scores[at] = fitted.classify(letters_only(text.take(pa.array(at))).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:given], pa.array(languages.tolist(), pa.string()), pa.array(scores)], names=[f"c{i}" for i in range(given + 2)])


def held_out(doc_id: Column) -> Column:
    """Rows that the model never learns from."""
    return crc_remainder(doc_id, 3) == 1


def identify_languages(docs: DataFrame, keep_columns: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), **options) -> DataFrame:
    """`keep_columns` (doc_id if None) with prediction and score, under `names`, for every row of docs(doc_id, text, lang).

    `options` go to `train`. Columns that are kept under the same names as the results must be told apart by other `names`.

    The model learns from rows that are not held out and have text and lang. A text that is
    null or has no letter is `und` with score 0; when there is nothing to learn from, any other
    text has a null lang_pred and score 0. Repeated rows and ids are learnt and predicted as they stand; a null id counts
    as the empty text in the fold. lang and doc_id take no part in a prediction.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    model = train(labelled.filter(~held_out(F.col("doc_id"))).filter("lang is not null and text is not null"), **options)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    # Columns travel under names of their own, so that none of docs can clash, and are named by their place, so that any name will do.
    given = keep_columns or ["doc_id"]
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = docs.select(*(column(c) for c in given))
    text_at = given.index("text") if "text" in given else len(given)
    sent_columns = [*given, *(["text"] if text_at == len(given) else [])]
    rows = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(sent_columns)))
    kinds = [*(f.dataType.simpleString() for f in kept.schema), "string", "double"]
    found = rows.mapInArrow(partial(_predict, model=sent, text_at=text_at, given=len(given)), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return found.toDF(*kept.columns, *names)
