"""Operator 4: language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Texts are kept as blocks: a block's words once, and its tokens as numbers of those. Counts of
all words in the training texts come from one shuffle of the blocks' word lists and go back to
the blocks by number. The classes of a log-bilinear model over the two tokens before are the most
frequent words and, for all others, groups of words with like endings; a word of a group is its
share of it by count, so both levels are normalised. Both kinds of class grow with the square root
of the vocabulary. Each task trains its copy of the parameters on its blocks and the copies are
averaged, round by round, until every training token has been learned from once. For scores, the
sums over all classes of a block's different contexts are matrix products of exponentials of words,
so every probability is normalised over all classes.
"""

import math
import zlib

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.common import pieces, prepare, stored, text_bytes

#: Tokens after which a block is closed (at the end of a text).
BLOCK_TOKENS = 2_000_000
#: Least number of words that are classes by themselves; dimensions of the vectors.
CLASSES, DIMENSIONS = 256, 32
#: Bytes at the end of a word that choose its group.
ENDING = 3
#: Rounds of training and averaging; the training tokens are dealt to the rounds in turn.
ROUNDS = 2
BATCH, NOISE, RATE = 2_048, 64, 0.3
#: Words whose scores of all classes are in memory at a time when scoring.
TILE = 1_024
#: The word that ends a text; no real word is empty.
END = b""
SMOOTHING = 0.1

_BLOCK = "block long, words array<binary>, counts array<long>, doc_id array<long>, held_out array<boolean>, length array<int>, ids binary"
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
    ("held_out", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("ids", pa.binary()),
])


def blocks_of(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """From (doc_id, held_out, text): blocks of whole texts, lower case in A-Z, each text with its end."""
    prepare(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        doc_ids, held, ids, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            lengths = np.array([len(x) for x in ids], np.int32)
            learned = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[learned], minlength=len(known))
            values = [(part << 32) + number, list(known), counts, doc_ids, held, lengths, pack.compress(tokens.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

        for batch in batches:
            for some in pieces(batch, 1_000):
                for doc_id, out, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), text_bytes(some.column(2))):
                    words = text.lower().split()
                    words.append(END)
                    ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    doc_ids.append(doc_id)
                    held.append(out)
                    total += len(words)
                    if total >= block_tokens:
                        yield block()
                        known.clear()
                        number, total = number + 1, 0
                        doc_ids, held, ids = [], [], []
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("held_out"), F.col("text").cast("string")).mapInArrow(encode, _BLOCK)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(block, number, c, first, ending): the training count of each word of each block; ``first`` marks
    one place of each word, ``ending`` is a checksum of its last bytes. A word is in a block's list once, so no key has more rows than there are blocks."""
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select(
        "block", "number", F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    places = Window.partitionBy("word")  # one sort; a join with the sums would sort and read the words twice
    return listed.select(
        "block", "number", F.sum("n").over(places).alias("c"), (F.col("block") == F.min("block").over(places)).alias("first"), F.crc32(F.substring("word", -ENDING, ENDING)).alias("ending")
    )


class Classes:
    """The class of each word: its own for the frequent ones, then the groups by ending."""

    def __init__(self, frequent: list[bytes], groups: int):
        self.own = {word: k for k, word in enumerate(frequent)}
        self.groups = groups
        self.n = len(frequent) + groups

    def of(self, words: list[bytes]) -> np.ndarray:
        own, base, groups = self.own.get, len(self.own), self.groups
        found = ((own(w), w) for w in words)
        return np.fromiter((base + zlib.crc32(w[-ENDING:]) % groups if k is None else k for k, w in found), np.int32, len(words))


class Parameters:
    """Context vectors, target vectors, position weights and target biases, as one table of rows.

    Rows: the frequent words by rank, then the groups, then (in contexts only) the place before a text.
    """

    def __init__(self, classes: int, dimensions: int, noise: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.d, self.noise = classes, dimensions, noise  # noise: share of each class
        self.context = rng.normal(0, 0.1, (classes + 1, dimensions)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (classes, dimensions)).astype(np.float32)
        self.place = np.ones((2, dimensions), np.float32)
        self.bias = np.log(noise).astype(np.float32)

    def rows(self) -> np.ndarray:
        bias = np.zeros(-(-self.n // self.d) * self.d, np.float32)
        bias[: self.n] = self.bias
        return np.concatenate((self.context, self.target, self.place, bias.reshape(-1, self.d)))

    def load(self, rows: np.ndarray) -> "Parameters":
        a, b = self.n + 1, 2 * self.n + 1
        self.context, self.target, self.place = (rows[x:y].astype(np.float32) for x, y in ((0, a), (a, b), (b, b + 2)))
        self.bias = rows[b + 2 :].reshape(-1)[: self.n].astype(np.float32)
        return self

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        near = self.context.take(one, axis=0)
        near *= self.place[0]
        far = self.context.take(two, axis=0)
        far *= self.place[1]
        near += far
        return near

    def train(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rng: np.random.Generator, squares: dict) -> None:
        """One pass of noise-contrastive estimation in mini-batches with common noise words, by AdaGrad."""
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        steps = np.cumsum(self.noise)
        steps[-1] = 1.0
        narrow = np.uint16 if self.n < 1 << 16 else np.int64
        for at in range(0, len(word), BATCH):
            a, b, w = one[at : at + BATCH], two[at : at + BATCH], word[at : at + BATCH]
            # rows are taken and changed in place: temporary tables cost more than the arithmetic
            far, near, target = self.context.take(b, axis=0), self.context.take(a, axis=0), self.target.take(w, axis=0)
            h = near * self.place[0]
            h += far * self.place[1]
            false = np.searchsorted(steps, rng.random(NOISE))
            noise = self.target[false]
            # the derivative of the objective by the score of the true and of the noise words
            true_by = 1 - _sigmoid(np.einsum("ij,ij->i", h, target) + self.bias[w] - log_noise[w])
            false_by = h @ noise.T
            false_by += self.bias[false] - log_noise[false]
            false_by = _sigmoid(false_by)
            np.negative(false_by, out=false_by)
            target *= true_by[:, None]
            by_h = false_by @ noise
            by_h += target
            by_target = np.zeros((len(w) + NOISE, self.d + 2 - self.d % 2), np.float32)  # the bias is one more dimension
            np.multiply(true_by[:, None], h, out=by_target[: len(w), : self.d])
            by_target[: len(w), self.d] = true_by
            np.matmul(false_by.T, h, out=by_target[len(w) :, : self.d])
            false_by.sum(axis=0, out=by_target[len(w) :, self.d])
            by_context = np.empty((2 * len(w), self.d), np.float32)
            np.multiply(by_h, self.place[0], out=by_context[: len(w)])
            np.multiply(by_h, self.place[1], out=by_context[len(w) :])
            changes = {
                "target": (np.concatenate((w, false)), by_target),
                "context": (np.concatenate((a, b)), by_context),
                "place": (np.array([0, 1]), np.stack((np.einsum("ij,ij->j", by_h, near), np.einsum("ij,ij->j", by_h, far)))),
            }
            for name, (rows, change) in changes.items():
                order = np.argsort(rows.astype(narrow), kind="stable")  # a radix sort for 16 bits
                rows = rows[order]
                cuts = np.flatnonzero(np.diff(rows, prepend=-1))
                own, total = rows[cuts], _run_sums(change.take(order, axis=0), cuts) / np.float32(len(w))
                for table, part in ((name, total),) if name != "target" else (("target", total[:, : self.d]), ("bias", total[:, self.d])):
                    square = squares[table][own] + part * part
                    squares[table][own] = square
                    getattr(self, table)[own] += RATE * part / np.sqrt(square)

    def fresh_squares(self) -> dict:
        return {name: np.full_like(getattr(self, name), 1e-6) for name in ("target", "bias", "context", "place")}

    def log_totals(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithm of the sum over all classes for each context, given in ascending order of (one, two).

        A class's score is a sum of a part for each of the two words, so its exponential is a product
        and the sums of many contexts are one matrix product: exponentials are taken for words and
        classes, not for contexts and classes. Tables hold ``TILE`` words at a time.
        """
        def parts(words: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
            scores = (self.context[words] * self.place[place]) @ self.target.T + (self.bias if place else 0)
            top = scores.max(axis=1)
            scores -= top[:, None]
            return np.exp(scores, out=scores), top

        out = np.empty(len(one), np.float32)
        starts = np.arange(0, self.n + 1, TILE)
        for at, end in zip(*np.searchsorted(one, (starts, starts + TILE))):
            if at == end:
                continue
            ones, row = np.unique(one[at:end], return_inverse=True)
            near, near_top = parts(ones, 0)
            order = np.argsort((two[at:end] // TILE).astype(np.uint16), kind="stable")
            cuts = np.searchsorted(two[at:end][order] // TILE, np.arange(len(starts) + 1))
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                own = order[low:high]
                twos, column = np.unique(two[at:end][own], return_inverse=True)
                far, far_top = parts(twos, 1)
                r = row[own]
                if len(own) * 8 > len(ones) * len(twos):
                    sums = (near @ far.T)[r, column]
                else:
                    sums, some = np.empty(len(own), np.float32), max(1, (1 << 18) // self.n)
                    for k in range(0, len(own), some):
                        sums[k : k + some] = np.einsum("ij,ij->i", near[r[k : k + some]], far[column[k : k + some]])
                with np.errstate(divide="ignore"):
                    out[at + own] = np.log(sums) + near_top[r] + far_top[column]
                # The greatest scores of the two words lie so far apart that products may have vanished.
                for k in np.array_split(own[sums < 1e-20], -(-np.count_nonzero(sums < 1e-20) * self.n // (1 << 20)) or 1):
                    scores = self.hidden(one[at + k], two[at + k]) @ self.target.T + self.bias
                    top = scores.max(axis=1, initial=-np.inf)
                    out[at + k] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out

    def log_probability(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised natural logarithms; each different context is computed once."""
        width = self.n + 1
        codes, where = np.unique(one.astype(np.int64) * width + two, return_inverse=True)
        h = self.hidden(codes // width, codes % width)
        total = self.log_totals(codes // width, codes % width)
        out = np.empty(len(word), np.float64)
        for at in range(0, len(word), 65_536):
            k, w = where[at : at + 65_536], word[at : at + 65_536]
            out[at : at + 65_536] = np.einsum("ij,ij->i", h.take(k, axis=0), self.target.take(w, axis=0)) + self.bias[w] - total[k]
        return out


def _run_sums(table: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; two columns are added at a time, as one complex number."""
    if table.shape[1] % 2:
        return np.add.reduceat(table, cuts, axis=0)
    return np.add.reduceat(table.view(np.complex64), cuts, axis=0).view(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Written into the table given."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Block:
    """Tokens of one block row as classes, with their contexts."""

    def __init__(self, words: list[bytes], lengths: list[int], ids: bytes, classes: Classes):
        import zstandard

        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.int32)
        self.lengths = np.array(lengths, np.int64)
        self.local = classes.of(words)
        self.word = self.local[self.ids]
        first = np.cumsum(self.lengths) - self.lengths
        start = classes.n
        self.one = np.concatenate(([start], self.word[:-1]))
        self.one[first] = start
        self.two = np.concatenate(([start], self.one[:-1]))
        self.two[first] = start


def learned(blocks: DataFrame, classes: Classes, model: Parameters, number: int, rounds: int) -> DataFrame:
    """(row, weight, p0, ...): the parameters of each task after its share of round ``number``, times
    the tokens it has learned from. Block by block, in an order that depends on the block alone."""
    spark = prepare(blocks)
    n = classes.n
    schema = pa.schema([("row", pa.int32()), ("weight", pa.float64())] + [(f"p{k}", pa.float64()) for k in range(DIMENSIONS)])
    shared = spark.sparkContext.broadcast((classes, model))  # like the square root of the vocabulary

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, now = shared.value
        own = Parameters(n, DIMENSIONS, now.noise).load(now.rows())
        squares, seen = own.fresh_squares(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                block, words, held, lengths, ids = (batch.column(c)[k].as_py() for c in range(5))
                b = Block(words, lengths, ids, classes)
                places = np.flatnonzero(np.repeat(~np.array(held, bool), b.lengths))[number::rounds]
                rng = np.random.default_rng((block, number))
                rng.shuffle(places)
                own.train(b.one[places], b.two[places], b.word[places], rng, squares)
                seen += len(places)
        if seen:
            rows = own.rows().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(seen)))] + [pa.array(rows[:, k]) for k in range(DIMENSIONS)], schema=schema
            )

    kind = "row int, weight double, " + ", ".join(f"p{k} double" for k in range(DIMENSIONS))
    return blocks.select("block", "words", "held_out", "length", "ids").mapInArrow(learn, kind)


def train(blocks: DataFrame, classes: Classes, noise: np.ndarray, rounds: int = ROUNDS) -> Parameters:
    """Every training token is learned from in one of the rounds. Parameters are averaged over tasks by
    the tokens each has learned from; one table of two rows a class reaches the driver a round."""
    model = Parameters(classes.n, DIMENSIONS, noise)
    columns = [f"p{k}" for k in range(DIMENSIONS)]
    for number in range(rounds):
        tasks = learned(blocks, classes, model, number, rounds)
        mean = tasks.groupBy("row").agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in columns])
        table = mean.orderBy("row").toPandas()
        if not len(table):
            break
        model = Parameters(classes.n, DIMENSIONS, noise).load(table[columns].to_numpy())
    return model


def score(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """From (doc_id, held_out, text): (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows held out teach nothing. Null texts are empty: one end. Each row is a text of its own,
    repeated ones too; other columns are not read. Without any training text all counts are 0.
    ``base_score`` smooths counts by 0.1 for every known word and one unknown; ``score`` is the
    log10 probability of the text by the model, which shares out a group's probability the same way,
    with one unknown word in each group. ``classes`` is the least number of frequent words with a class
    of their own; with n known words there are max(classes, √n) of them and √n groups.
    """
    prepare(docs)
    blocks = stored(blocks_of(docs, block_tokens), "lm-blocks")
    counts = stored(word_counts(blocks), "lm-counts")
    known = counts.filter("first and c > 0")
    row = known.agg(F.sum("c"), F.count("*")).first()
    n_train, n_words = row[0] or 0, row[1]
    root = max(1, math.isqrt(n_words))
    top = known.orderBy(F.desc("c"), "block", "number").limit(max(classes, root))
    words = top.join(blocks.select("block", "words"), "block").select(F.col("words")[F.col("number")].alias("word"), "c").collect()
    ranked = sorted(((r["c"], bytes(r["word"])) for r in words), key=lambda x: (-x[0], x[1]))
    all_classes = Classes([word for _, word in ranked], root)
    grouped = np.zeros((root, 2))  # tokens and words of each group, the frequent words taken off
    for r in known.groupBy((F.col("ending") % root).cast("int").alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        grouped[r["g"]] = r["c"], r["n"]
    for c, word in ranked:
        grouped[zlib.crc32(word[-ENDING:]) % root] -= c, 1
    share = np.concatenate((np.array([c for c, _ in ranked], np.float64), grouped[:, 0])) + SMOOTHING
    model = train(blocks, all_classes, share / share.sum(), rounds)

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((all_classes, model))
    log_base = float(np.log10(n_train + SMOOTHING * (n_words + 1)))
    log_group = np.log10(grouped[:, 0] + SMOOTHING * (grouped[:, 1] + 1))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def block_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        classes, model = shared.value
        out = []
        number, count = right["number"].to_numpy(), right["c"].to_numpy()
        for k in range(left.num_rows):
            words, doc_id, held, lengths, ids = (left[c][k].as_py() for c in ("words", "doc_id", "held_out", "length", "ids"))
            b = Block(words, lengths, ids, classes)
            c = np.zeros(len(words), np.int64)
            c[number] = count
            logs = np.log10(c + SMOOTHING)
            group = b.local - len(classes.own)
            inside = np.where(group >= 0, logs - log_group[np.maximum(group, 0)], 0.0)
            by_token = np.stack(((c > 0)[b.ids].astype(np.float64), logs[b.ids] - log_base, model.log_probability(b.one, b.two, b.word) / np.log(10) + inside[b.ids]), axis=1)
            sums = np.add.reduceat(by_token, np.cumsum(b.lengths) - b.lengths, axis=0)
            out.append(pa.Table.from_arrays([
                pa.array(doc_id, pa.int64()), pa.array(held, pa.bool_()), pa.array(b.lengths), pa.array(sums[:, 0].astype(np.int64)),
                pa.array(np.full(len(held), n_train, np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    own = blocks.drop("counts").groupBy("block")
    return own.cogroup(counts.select("block", "number", "c").groupBy("block")).applyInArrow(block_scores, kind)
