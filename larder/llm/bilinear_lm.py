"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Whole texts are counted and coded in blocks: a block holds about BLOCK_BYTES of text, its distinct
words are counted over the corpus by one shuffle on the word (a word has one row a block, so that the
most frequent word has no more rows than there are blocks), and come back to the block as the word's
corpus count and unit. Units are the end of a text, the most frequent words, and the most frequent
endings of the other words (one unit is for all other endings): WORDS and ENDINGS times the cube root
of the training tokens, so that the model grows with the corpus. A word without a unit of its own has
its unit's probability times its add-one share of the unit's training tokens, one unseen word counted
in each, so that the probabilities of all known words and of unseen ones sum to one.

The model predicts the next unit from the CONTEXT units before it: the sum of their vectors, each
scaled by a vector of its place, meets the vector and bias of a unit. So that normalised scores stay
cheap, units lie in groups of like frequency, about as many as the root of their number, that have
vectors and biases too: a unit's probability is its group's among the groups, times its own among
the group's units. Both sides are trained by noise-contrastive estimation over all of their kind, and
scored by batched matrix products.

Training passes over all training tokens: each task continues from a common start (fitted to at most
WARM_TOKENS tokens of the block of the smallest id), and their parameters are averaged by weight; so
scores depend a little on how the rows are dealt to tasks.

Null texts count as empty (the end alone); null ids count as the empty id; repeated rows are scored
each; a text of any length is scored whole, its contexts crossing no batch; of words, or endings, that
tie for the last units the smaller bytes win; an empty table gives an empty one; other columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialize, release

WORDS, ENDINGS, CONTEXT, WIDTH, NOISE, BATCH, RATE = 8, 2, 3, 16, 32, 2048, 0.2
BLOCK_BYTES, SLICE_BYTES, WARM_TOKENS = 12 << 20, 2 << 20, 400_000
#: Parameters of a row when they are averaged; logits held at a time, few enough for a core's cache.
PART, LOGITS = 1 << 14, 1 << 16
#: Logits up to so much on either side can be taken to the power of e, and summed, in single precision as they are.
SAFE = 75.0
END = b"\n"  # no word holds white space


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of binary texts, the end first; all tokens as places among them; each text's number of tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = split.flatten()
    kept = pc.binary_length(words).to_numpy() > 0  # nothing stands before leading or after trailing white space
    until = np.append(0, np.cumsum(kept))
    lengths = np.diff(until[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]) + 1
    found = (words if kept.all() else words.filter(pa.array(kept))).dictionary_encode()
    tokens, ends = np.zeros(lengths.sum(), np.int32), np.cumsum(lengths) - 1
    word = np.ones(len(tokens), bool)
    word[ends] = False
    tokens[word] = found.indices.to_numpy() + 1
    return pa.concat_arrays([pa.array([END]), found.dictionary.view(pa.binary())]), tokens, lengths


def merged(coded: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What coded_words gives of several runs of texts, as of one."""
    every = pa.concat_arrays([words for words, _, _ in coded]).dictionary_encode()
    firsts = np.cumsum([0, *(len(words) for words, _, _ in coded)])
    places = every.indices.to_numpy()
    return every.dictionary, np.concatenate([places[k:][tokens] for k, (_, tokens, _) in zip(firsts.tolist(), coded, strict=False)]), np.concatenate([lengths for _, _, lengths in coded])


def one_row(value: object, kind: pa.DataType) -> pa.Array:
    """A column of the value alone, of arrays as a list."""
    if isinstance(value, pa.Array | np.ndarray):
        return pa.ListArray.from_arrays([0, len(value)], pa.array(value).cast(kind.value_type))
    return pa.array([value], kind)


def blocks(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """A row for each block: its distinct words, their counts in training texts, and its texts as places of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, trained, coded, size = [], [], [], 0

        def ended() -> pa.RecordBatch:
            words, tokens, lengths = merged(coded)
            counts = np.bincount(tokens[np.repeat(np.array(trained, bool), lengths)], minlength=len(words))
            row = [part << 24 | number, words, counts, ids, trained, lengths, zlib.compress(tokens.tobytes(), 1)]
            return pa.RecordBatch.from_arrays([one_row(v, f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            text = batch.column("text").cast(pa.binary()).fill_null(b"")
            sizes, at = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64), 0
            while at < len(text):
                done = int(sizes[at - 1]) if at else 0
                end = min(len(text), 1 + int(np.searchsorted(sizes, done + min(SLICE_BYTES, BLOCK_BYTES - size))))
                ids += batch.column("doc_id").slice(at, end - at).to_pylist()
                trained += batch.column("training").slice(at, end - at).to_pylist()
                coded.append(coded_words(text.slice(at, end - at)))
                size, at = size + int(sizes[end - 1]) - done, end
                if size >= BLOCK_BYTES:
                    yield ended()
                    ids, trained, coded, size, number = [], [], [], 0, number + 1
        if ids:
            yield ended()

    arrow = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), training.alias("training"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "block bigint, words array<binary>, counts array<bigint>, ids array<bigint>, training array<boolean>, lengths array<bigint>, tokens binary")


def corpus_counts(table: DataFrame) -> DataFrame:
    """(block, place, word, total, first): each block's words with their corpus count; first marks one row a word."""
    rows = table.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("word")
    # both without an order, so that one sort serves them; a block has a word once
    return rows.select("block", "place", "word", F.sum("n").over(same).alias("total"), (F.min("block").over(same) == F.col("block")).alias("first"))


def ending(word: Column) -> Column:
    return F.substring(word, -3, 3)


class Units:
    """What the model predicts, most frequent first; uses and masses are arrays over the units."""

    def __init__(self, tokens: int, distinct: int, words: list[tuple[bytes, int]], endings: list[tuple[bytes, int, int]], rest: tuple[int, int]):
        """words: each with its count; endings, and the rest: each with the count and the add-one mass of its words."""
        found = [(n, 0, w, 0) for w, n in words] + [(n, 1, e, m) for e, n, m in endings] + [(rest[0], 2, b"", rest[1])]
        found.sort(key=lambda u: -u[0])
        self.tokens, self.distinct = tokens, distinct
        self.words = {u[2]: i for i, u in enumerate(found) if u[1] == 0}
        self.endings = {u[2]: i for i, u in enumerate(found) if u[1] == 1}
        self.rest = next(i for i, u in enumerate(found) if u[1] == 2)
        self.uses = np.array([u[0] for u in found], np.float64)
        self.shared = np.array([u[1] > 0 for u in found])
        self.masses = np.array([u[3] for u in found], np.float64)
        # each group holds about the same sum of roots of counts
        roots = np.cumsum(np.sqrt(self.uses + 1))
        group = np.minimum((roots - roots[0]) / roots[-1] * ceil(len(found) ** 0.5), len(found)).astype(np.int64)
        self.starts = np.flatnonzero(np.diff(group, prepend=-1))
        self.kind = "<u2" if len(found) <= 1 << 16 else "<u4"

    @property
    def end(self) -> int:
        return self.words[END]


def vocabulary(counted: DataFrame) -> Units:
    """The units of the corpus; as many rows as there are units come to the driver."""
    spark = counted.sparkSession
    known = counted.where("first AND total > 0").select("word", "total")
    tokens, distinct = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    scale = tokens ** (1 / 3)
    words = known.where(F.col("word") != F.lit(END))
    head = [(bytes(r["word"]), r["total"]) for r in words.orderBy(F.desc("total"), "word").limit(ceil(WORDS * scale)).collect()]
    named = F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in head], "word binary"))
    by_ending = words.join(named, "word", "left_anti").groupBy(ending(F.col("word")).alias("ending")).agg(F.sum("total").alias("n"), F.sum(F.col("total") + 1).alias("mass"))
    by_ending = materialize(by_ending, "lm-endings")
    endings = [(bytes(r["ending"]), r["n"], r["mass"]) for r in by_ending.orderBy(F.desc("n"), "ending").limit(ceil(ENDINGS * scale)).collect()]
    n, mass = by_ending.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0))).first()
    release(by_ending)
    ends = known.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    rest = n - sum(x for _, x, _ in endings), mass - sum(x for _, _, x in endings)
    return Units(tokens, distinct, [(END, ends), *head], endings, rest)


def code(table: DataFrame, counted: DataFrame, units: Units) -> DataFrame:
    """A row for each block: the unit of every token, and the sums over each text that need no model."""
    spark = table.sparkSession
    words = spark.createDataFrame([(bytearray(w), i) for w, i in units.words.items()], "word binary, own int")
    endings = spark.createDataFrame([(bytearray(e), i) for e, i in units.endings.items()], "ending binary, shared int")
    # as many rows as there are units
    coded = counted.join(F.broadcast(words), "word", "left").withColumn("ending", ending(F.col("word"))).join(F.broadcast(endings), "ending", "left")
    unit = F.coalesce("own", "shared", F.lit(units.rest))
    # empty values, not nulls: runs of null arrays make Arrow's writer rescan the batch for every row
    rows = coded.select("block", "place", "total", unit.cast("int").alias("unit"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<boolean>").alias("training"), F.array().cast("array<bigint>").alias("lengths"), F.lit(b"").alias("tokens"))
    texts = table.select("block", F.lit(-1).alias("place"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("unit"), "ids", "training", "lengths", "tokens")
    shared, masses, kind = units.shared, units.masses, units.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, places, totals, owns = None, None, [], [], []

        def ended() -> pa.RecordBatch:
            # rows come in any order; the text's place is -1, so that its row falls behind the words
            place = np.concatenate(places)
            total, own = np.empty(len(place), np.int64), np.empty(len(place), np.int32)
            total[place], own[place] = np.concatenate(totals), np.concatenate(owns)
            total, own = total[:-1], own[:-1]
            tokens = np.frombuffer(zlib.decompress(text["tokens"]), np.int32)
            lengths = np.array(text["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            word_log = np.log10(total + 1.0)
            share_log = np.where(shared[own], word_log - np.log10(masses[own] + 1.0), 0.0)
            summed = lambda x: np.add.reduceat(x[tokens], starts)
            row = [at, own.astype(kind)[tokens].tobytes(), text["ids"], text["training"], lengths, summed((total > 0).astype(np.int64)), summed(word_log), summed(share_log)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if block[a] != at:
                    if at is not None:
                        yield ended()
                    at, text, places, totals, owns = int(block[a]), None, [], [], []
                places.append(batch.column("place").slice(a, b - a).to_numpy())
                for k in (np.flatnonzero(places[-1] < 0) + a).tolist():
                    text = batch.select(["ids", "training", "lengths", "tokens"]).slice(k, 1).to_pylist()[0]
                totals.append(batch.column("total").slice(a, b - a).to_numpy())
                owns.append(batch.column("unit").slice(a, b - a).to_numpy())
        if at is not None:
            yield ended()

    arrow = pa.schema([("block", pa.int64()), ("units", pa.binary()), ("ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("word_log", pa.list_(pa.float64())), ("share_log", pa.list_(pa.float64()))])
    blocks_of = table.select((F.shiftright("block", 24)).alias("part")).agg(F.count("*"), F.coalesce(F.max("part"), F.lit(0))).first()
    tasks = max(1, blocks_of[0])
    # the blocks of a task follow one another in steps of the tasks, so that nearly every one gets a task of its own
    to = (F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1) * (blocks_of[1] + 1)) % tasks
    # one number to sort by, which needs no comparisons
    together = rows.union(texts).repartitionById(tasks, to.cast("int")).sortWithinPartitions("block")
    return together.mapInArrow(run, "block bigint, units binary, ids array<bigint>, training array<boolean>, lengths array<bigint>, known array<bigint>, word_log array<double>, share_log array<double>")


def contexts(units: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT units before each token of its text, nearest first; the end stands before a text."""
    out = np.full((len(units), CONTEXT), end, units.dtype)
    starts = np.cumsum(lengths) - lengths
    for j in range(CONTEXT):
        out[j + 1 :, j] = units[: max(0, len(units) - j - 1)]
        for k in range(j + 1):  # the first tokens of a text see none of the text before
            out[starts[lengths > k] + k, j] = end
    return out


def spans(lengths: np.ndarray, tokens: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about so many tokens, one text at least."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + tokens)))
        yield first, last
        first = last


def log_softmax_at(logits: np.ndarray, own: np.ndarray, most: float = np.inf) -> np.ndarray:
    """Log of each row's softmax at its own column; overwrites logits, of which none is beyond most on either side."""
    at = logits[np.arange(len(logits)), own].astype(np.float64)
    if most > SAFE:
        shift = logits.max(axis=1, keepdims=True)
        logits -= shift
        at -= shift[:, 0]
    np.exp(logits, out=logits)
    return at - np.log((logits @ np.ones(logits.shape[1], np.float32)).astype(np.float64))


def longest(rows: np.ndarray) -> float:
    """The largest Euclidean length of the rows."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


class LogBilinear:
    """Vectors of context and predicted units, scales of the context's places, vectors of groups, biases."""

    def __init__(self, uses: np.ndarray, starts: np.ndarray, seed: int = 0):
        """starts: the first unit of each group."""
        rng = np.random.default_rng(seed)
        self.starts, self.sizes = starts, np.diff(np.append(starts, len(uses)))
        self.group = np.repeat(np.arange(len(starts)), self.sizes)
        self.noise = (uses + 1) / (uses + 1).sum()
        self.group_noise = np.add.reduceat(self.noise, starts)
        # what each step of noise needs: its sums, to draw by, and the logs of its expected counts
        self.drawing = [(np.cumsum(n), n.sum(), np.log(NOISE * n).astype(np.float32)) for n in (self.noise, self.group_noise)]
        draw = lambda n: rng.normal(0, 0.3, (n, WIDTH)).astype(np.float32)
        self.before = draw(len(uses))
        # vectors of units and of groups, each with its bias as the last column, which meets a one
        self.predicted = [np.column_stack([draw(len(n)), np.log(n).astype(np.float32)]) for n in (self.noise, self.group_noise)]
        (self.after, self.bias), (self.groups, self.group_bias) = ((p[:, :WIDTH], p[:, WIDTH]) for p in self.predicted)
        self.places = np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in (self.before, *self.predicted, self.places)]
        # what steps write over again and again: fresh memory of this size costs more than the sums
        self.slopes = np.empty((BATCH, NOISE), np.float32)
        self.place = np.empty(len(uses), np.int64)

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.after, self.groups, self.places, self.bias, self.group_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def predict(self, seen: list[np.ndarray]) -> np.ndarray:
        """The sum of the scaled vectors seen at each place, and a one for the bias."""
        out = np.ones((len(seen[0]), WIDTH + 1), np.float32)
        q = seen[0] * self.places[0]
        for j in range(1, CONTEXT):
            q += seen[j] * self.places[j]
        out[:, :WIDTH] = q
        return out

    def _step(self, p: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rows: np.ndarray) -> None:
        """Move rows of a part against the gradient, by the root of the squares so far."""
        sums = squares.take(rows, axis=0)
        sums += gradient * gradient
        squares[rows] = sums
        p[rows] = p.take(rows, axis=0) - RATE * gradient / np.sqrt(sums)

    def _contrast(self, q: np.ndarray, own: np.ndarray, kind: int, rng: np.random.Generator) -> np.ndarray:
        """A noise-contrastive step of predicted units (kind 0) or groups (1); the slope at q. The noise is shared by the batch."""
        table, squares, (sums, whole, offset), n = self.predicted[kind], self.squares[1 + kind], self.drawing[kind], len(own)
        drawn = np.searchsorted(sums, rng.random(NOISE) * whole).clip(max=len(sums) - 1)
        true, false = table.take(own, axis=0), table.take(drawn, axis=0)
        d_true = -1 / (1 + np.exp(np.einsum("ij,ij->i", q, true) - offset.take(own)))
        against = -false
        against[:, WIDTH] += offset[drawn]
        d_false = np.matmul(q, against.T, out=self.slopes[:n])
        np.exp(d_false, out=d_false)
        d_false += 1
        np.divide(1, d_false, out=d_false)
        rows, at = self._touched(np.concatenate([own, drawn]))
        g = scatter(at, np.concatenate([d_true[:, None] * q, (q.T @ d_false).T]), len(rows))
        true *= d_true[:, None]
        true += d_false @ false
        g /= n
        self._step(table, squares, g, rows)
        return true[:, :WIDTH]

    def _touched(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ids, and the place of each id among them."""
        here = np.zeros(len(self.place), bool)
        here[ids] = True
        rows = np.flatnonzero(here)
        self.place[rows] = np.arange(len(rows))
        return rows, self.place.take(ids)

    @np.errstate(over="ignore")  # a power beyond single precision gives a slope of zero, as it should
    def train(self, ctx: np.ndarray, nxt: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps, of units among all units and of groups among all groups."""
        for k in range(0, len(nxt), BATCH):
            c, w = ctx[k : k + BATCH].T.astype(np.int64, order="C"), nxt[k : k + BATCH].astype(np.int64)
            seen = [self.before.take(ids, axis=0) for ids in c]
            q = self.predict(seen)
            d_q = (self._contrast(q, w, 0, rng) + self._contrast(q, self.group.take(w), 1, rng)) / len(w)
            ids, slopes = shared_contexts(c, [d_q * place for place in self.places])
            rows, at = self._touched(ids)
            d_before = scatter(at, slopes, len(rows))
            d_places = np.stack([np.einsum("ij,ij->j", d_q, s) for s in seen])
            self._step(self.before, self.squares[0], d_before, rows)
            self._step(self.places, self.squares[3], d_places, np.arange(CONTEXT))

    def log10(self, ctx: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each next unit."""
        n, own = len(nxt), self.group.take(nxt)
        order = np.argsort(own.astype(np.uint16) if len(self.starts) <= 1 << 16 else own, kind="stable")
        cuts = np.searchsorted(own.take(order), np.arange(len(self.starts) + 1))
        q, out = np.empty((n, WIDTH + 1), np.float32), np.empty(n)
        # no logit is beyond the longest q times the longest vector
        most, far, step = 0.0, longest(self.predicted[1]), max(1, LOGITS // len(self.groups))
        for k in range(0, n, step):
            some = self.predict([self.before.take(ids, axis=0) for ids in ctx[k : k + step].T])
            q[k : k + step], length = some, longest(some)
            out[k : k + step] = log_softmax_at(some @ self.predicted[1].T, own[k : k + step], length * far)
            most = max(most, length)
        for g in np.flatnonzero((np.diff(cuts) > 0) & (self.sizes > 1)):
            first, size = self.starts[g], self.sizes[g]
            vectors = self.predicted[0][first : first + size]
            reach, step = most * longest(vectors), max(1, LOGITS // size)
            for k in range(cuts[g], cuts[g + 1], step):
                at = order[k : min(k + step, cuts[g + 1])]
                out[at] += log_softmax_at(q.take(at, axis=0) @ vectors.T, nxt.take(at) - first, reach)
        return out / np.log(10)


def shared_contexts(ctx: np.ndarray, slopes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and slopes of all places, added up where a place's id is, as in running text, that of the place before at the token before."""
    ids, rows = [], []
    for j in range(len(slopes) - 1, 0, -1):
        same = ctx[j, 1:] == ctx[j - 1, :-1]
        slopes[j - 1][:-1] += slopes[j][1:] * same.astype(np.float32)[:, None]
        rest = np.append(0, np.flatnonzero(~same) + 1)
        ids.append(ctx[j].take(rest))
        rows.append(slopes[j].take(rest, axis=0))
    return np.concatenate([ctx[0], *ids]), np.concatenate([slopes[0], *rows])


def scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows at each place."""
    width = rows.shape[1]
    out, columns = np.zeros((size, width), np.float32), np.arange(width)
    for k in range(0, len(at), BATCH):
        np.add.at(out.reshape(-1), (at[k : k + BATCH, None] * width + columns).ravel(), rows[k : k + BATCH].ravel())
    return out


def _training_tokens(row: dict, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own, lengths, training = np.frombuffer(row["units"], units.kind), np.array(row["lengths"], np.int64), np.array(row["training"], bool)
    starts = np.cumsum(lengths) - lengths
    for a, b in spans(lengths):
        part, used = own[starts[a] : starts[b - 1] + lengths[b - 1]], np.repeat(training[a:b], lengths[a:b])
        yield contexts(part, lengths[a:b], units.end)[used], part[used]


def _warm_start(coded: DataFrame, units: Units) -> LogBilinear:
    """Fitted, three times over, to at most WARM_TOKENS training tokens of the block of the smallest id."""
    model, rng = LogBilinear(units.uses, units.starts), np.random.default_rng(1)
    least = coded.agg(F.min("block")).first()[0]
    if least is None:
        return model
    row = coded.where(F.col("block") == least).select("units", "training", "lengths").first().asDict()
    parts, left = [], WARM_TOKENS
    for ctx, nxt in _training_tokens(row, units):
        parts.append((ctx[:left], nxt[:left]))
        left -= len(parts[-1][1])
        if left <= 0:
            break
    for _ in range(3):
        for ctx, nxt in parts:
            model.train(ctx, nxt, rng)
    return model


def fit(coded: DataFrame, units: Units) -> np.ndarray:
    """Parameters after a warm start and one pass over all training tokens."""
    warm = _warm_start(coded, units)
    start = coded.sparkSession.sparkContext.broadcast((warm.flat(), warm.squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, squares = start.value
        model, tokens = LogBilinear(units.uses, units.starts).load(flat), 0
        model.squares = [s.copy() for s in squares]
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng(row["block"])
                for ctx, nxt in _training_tokens(row, units):
                    model.train(ctx, nxt, rng)
                    tokens += len(nxt)
        if tokens:
            whole = model.flat() * tokens
            cuts = range(0, len(whole), PART)
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array([whole[k : k + PART].tobytes() for k in cuts], pa.binary()), pa.array([tokens] * len(cuts), pa.int64())], names=["at", "weighted", "tokens"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for at, raw, tokens in zip(*(batch.column(c).to_pylist() for c in ("at", "weighted", "tokens")), strict=True):
                total, seen = sums.get(at, (0.0, 0))
                sums[at] = total + np.frombuffer(raw), seen + tokens
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(t / n).tobytes() for t, n in sums.values()], pa.binary())], names=["at", "mean"])

    parts = coded.select("block", "units", "training", "lengths").mapInArrow(run, "at bigint, weighted binary, tokens bigint")
    rows = parts.repartition("at").mapInArrow(averaged, "at bigint, mean binary").collect()  # the parameters
    return np.concatenate([np.frombuffer(r["mean"]) for r in sorted(rows, key=lambda r: r["at"])]) if rows else warm.flat()


def score(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """For each row of docs (doc_id, text): training, n_tokens, n_known, train_tokens, base_score and score (log10), learning from the rows for which training is true."""
    coded, units = read(docs, training, text)
    return score_coded(coded, units, fit(coded, units))


def read(docs: DataFrame, training: Column, text: str = "text") -> tuple[DataFrame, Units]:
    """The coded blocks of docs and the units of its training rows."""
    table = materialize(blocks(docs, training, text), "lm-blocks")
    counted = materialize(corpus_counts(table), "lm-counts")
    units = vocabulary(counted)
    coded = materialize(code(table, counted, units), "lm-coded")
    release(table)
    release(counted)
    return coded, units


def score_coded(coded: DataFrame, units: Units, parameters: np.ndarray) -> DataFrame:
    """The scores of coded blocks by a model's parameters."""
    flat = coded.sparkSession.sparkContext.broadcast(parameters)
    size = np.log10(units.tokens + units.distinct + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(units.uses, units.starts).load(flat.value)
        for batch in batches:
            for row in batch.to_pylist():
                own, lengths = np.frombuffer(row["units"], units.kind), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                by_unit = np.empty(len(lengths))
                for a, b in spans(lengths):
                    part = own[ends[a] - lengths[a] : ends[b - 1]].astype(np.int32)
                    logs = model.log10(contexts(part, lengths[a:b], units.end), part)
                    by_unit[a:b] = np.add.reduceat(logs, np.cumsum(lengths[a:b]) - lengths[a:b])
                columns = [row["ids"], row["training"], lengths, row["known"], np.array(row["word_log"]) - lengths * size, by_unit + np.array(row["share_log"])]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    scored = coded.mapInArrow(run, "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(int(units.tokens)).cast("bigint"))
