"""Language-model scores from subword lattices.

The vocabulary of an existing model file, with its scores, spans a lattice over
each word; all segmentations count, weighted by the product of their pieces'
probabilities, and a forward recursion in log space sums them.  Passes of
expectation-maximisation over the distinct training words, started from the
file's own scores, fit the probabilities to the corpus (to words, not to
occurrences, for they have to account for words that are yet unseen).  A word of
the training texts is an arc over its whole lattice, too, weighted by its share
of their words; ``novel`` is the share of the arcs of the vocabulary, the most
likely one when each training occurrence is told by the others alone:

    p(word) = (1 - novel) * c / words + novel * sum over paths of prod q(piece) * stop

A text is a sequence of words and one end.  Words come in bursts: the next word
is one of the text's own so far, or one by p, in the proportion of their number
to ``CACHE`` words.  So the probability of a text, whatever the order of its n
words, k of each, is

    p_end * (1 - p_end)^n * prod over words of [a (a + 1) ... (a + k - 1)], a = CACHE * p(word)
          / [CACHE (CACHE + 1) ... (CACHE + n - 1)]

What is gathered (a count for each distinct word) is grouped with map-side
counting and stays a table.  Scores of the most frequent words, at most
``HOT_WORDS`` of at most ``HOT_BYTES`` bytes, are sent to every worker; all
other words of each document are joined to the table.  Lattices are computed
once for each distinct word, many words at a time; those of words beyond
``LONG`` characters one by one, with memory of a few numbers a character.

Defined results: a null text is empty, its only token is the end; words longer
than any piece, and characters that no piece has, go through byte pieces; with
no training text nothing is known and only subwords and the file's scores count.
Repeated rows are scored each for itself; only the named columns are read, so no
other's name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bounds of what is sent to every worker.
HOT_WORDS, HOT_BYTES = 300_000, 48
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Characters of words whose lattices are computed together; words above LONG go alone, in parts of PART.
BATCH_CHARS, LONG, PART = 300_000, 120, 20_000
#: Passes of expectation-maximisation, and shares of new words among which the most likely is chosen.
PASSES, SHARES = 3, np.geomspace(1e-4, 0.999, 60)
#: Words of the corpus that weigh as much as all words of a text so far, see above.
CACHE = 1000.0
MARK = "▁"


class Pieces:
    """An existing vocabulary: its pieces' automaton, lengths, and the scores that it comes with."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        self.size = model.get_piece_size()
        self.lengths = np.zeros(self.size, np.int64)
        self.automaton = ahocorasick.Automaton()
        self.bytes = np.zeros(256, np.int64)
        start = np.full(self.size, -np.inf)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                start[i] = -2.0 * math.log(self.size)
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.automaton.add_word(piece, i)
                self.lengths[i] = len(piece)
                # a merge-type file scores a piece by its rank; ranks follow Zipf's law
                start[i] = -math.log(10.0 - model.get_score(i))
        self.automaton.make_automaton()
        self.longest = int(self.lengths.max())
        self.start = start - np.log(np.exp(start).sum())

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of many words over one row of nodes.

        Returns first and last node of each word, and start node, end node and
        piece of each arc; pieces below 0 stand for a character's byte pieces.
        """
        text = "\n".join([MARK + w for w in words])
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
        flat = np.array([x for pair in self.automaton.iter(text) for x in pair], np.int64).reshape(-1, 2)
        end, piece = flat[:, 0] + 1, flat[:, 1]
        start = end - self.lengths[piece]
        covered = np.zeros(len(text) + 1, bool)
        covered[end[self.lengths[piece] == 1]] = True
        covered[first] = True  # the nodes at which no character of a word ends
        bare = np.flatnonzero(~covered)
        bare = bare[bare <= last[-1]] if len(last) else bare
        if len(bare):
            codes = np.array([ord(text[e - 1]) for e in bare], np.int64)
            start, end, piece = np.concatenate([start, bare - 1]), np.concatenate([end, bare]), np.concatenate([piece, -1 - codes])
        return first, last, start, end, piece

    def weights(self, piece: np.ndarray, logq: np.ndarray) -> np.ndarray:
        out = logq[np.maximum(piece, 0)]
        for k in np.flatnonzero(piece < 0):
            out[k] = logq[self.bytes[list(chr(-1 - piece[k]).encode("utf-8", "surrogatepass"))]].sum()
        return out

    def marginals(self, words: list[str], logq: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log of the sum over all segmentations of each word; with counts also the expected uses of each piece."""
        if len(words) == 1 and len(words[0]) > LONG:
            total, used = self.long_marginal(words[0], logq, counts is not None)
            return np.array([total]), None if used is None else used * counts[0]
        first, last, start, end, piece = self.arcs(words)
        score = self.weights(piece, logq)
        nodes = int(last[-1]) + 1
        word = np.repeat(np.arange(len(words)), last - first + 1)  # of each node
        alpha = _sweep(nodes, first, start, end, score, end - first[word[end]])
        total = alpha[last]
        if counts is None:
            return total, None
        beta = _sweep(nodes, last, end, start, score, last[word[start]] - start)
        share = np.exp(alpha[start] + score + beta[end] - total[word[end]]) * counts[word[end]]
        used = np.bincount(piece[piece >= 0], share[piece >= 0], self.size)
        for k in np.flatnonzero(piece < 0):
            np.add.at(used, self.bytes[list(chr(-1 - piece[k]).encode("utf-8", "surrogatepass"))], share[k])
        return total, used


    def parts(self, text: str, backward: bool = False) -> Iterator[list[tuple[int, int]]]:
        """(end, piece) of the arcs of a long text, by end, part after part from the front or from behind."""
        starts = range(0, len(text), PART)
        for a in reversed(starts) if backward else starts:
            b, ahead = min(a + PART, len(text)), max(0, a - self.longest)
            found, single = [], set()
            for end, piece in self.automaton.iter(text[ahead:b]):
                end += ahead + 1
                if end > a:
                    found.append((end, piece))
                    if self.lengths[piece] == 1:
                        single.add(end)
            found += [(e, -1 - ord(text[e - 1])) for e in range(a + 1, b + 1) if e not in single]
            found.sort(reverse=backward)
            yield found

    def long_marginal(self, word: str, logq: np.ndarray, counted: bool) -> tuple[float, np.ndarray | None]:
        """``marginals`` of one word of any length: what is held is two numbers a character, and the arcs of one part."""
        text, known, lengths = MARK + word, logq.tolist(), self.lengths.tolist()
        bare: dict[int, float] = {}

        def score(piece: int) -> float:
            if piece >= 0:
                return known[piece]
            if piece not in bare:
                bare[piece] = float(self.weights(np.array([piece]), logq)[0])
            return bare[piece]

        def join(x: float, y: float) -> float:
            low, high = (x, y) if x < y else (y, x)
            return high if low == -math.inf else high + math.log1p(math.exp(low - high))

        alpha = array("d", [-math.inf]) * (len(text) + 1)
        alpha[0] = 0.0
        for part in self.parts(text):
            for end, piece in part:
                start = end - (lengths[piece] if piece >= 0 else 1)
                alpha[end] = join(alpha[end], alpha[start] + score(piece))
        total = alpha[-1]
        if not counted:
            return total, None
        used = np.zeros(self.size)
        beta = array("d", [-math.inf]) * (len(text) + 1)
        beta[-1] = 0.0
        for part in self.parts(text, backward=True):
            uses: dict[int, float] = {}
            for end, piece in part:
                start, onward = end - (lengths[piece] if piece >= 0 else 1), score(piece) + beta[end]
                beta[start] = join(beta[start], onward)
                uses[piece] = uses.get(piece, 0.0) + math.exp(min(0.0, alpha[start] + onward - total))
            for piece, n in uses.items():
                if piece >= 0:
                    used[piece] += n
                else:
                    np.add.at(used, self.bytes[list(chr(-1 - piece).encode("utf-8", "surrogatepass"))], n)
        return total, used


def _sweep(nodes: int, origin: np.ndarray, near: np.ndarray, far: np.ndarray, score: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log sums of all paths from the origins, node by node outward, all words abreast."""
    out = np.full(nodes, -np.inf)
    out[origin] = 0.0
    order = np.lexsort((far, level))
    near, far, score, level = near[order], far[order], score[order], level[order]
    cuts = np.searchsorted(level, np.arange(1, int(level[-1]) + 2)) if len(level) else np.zeros(1, int)
    heads = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(far) else np.zeros(0, int)
    bounds = np.searchsorted(heads, cuts)
    for a, b, h, g in zip(cuts, cuts[1:], bounds, bounds[1:]):
        if b > a:
            own = heads[h:g]
            out[far[own]] = np.logaddexp.reduceat(out[near[a:b]] + score[a:b], own - a)
    return out


_pieces: dict[str, Pieces] = {}


def pieces_of(model_path: str) -> Pieces:
    if model_path not in _pieces:
        _pieces[model_path] = Pieces(model_path)
    return _pieces[model_path]


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Indexes of words that go together: of like length, and of a bounded sum."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    start, held = 0, 0
    for k, i in enumerate(order):
        if k > start and (held + sizes[i] > BATCH_CHARS or sizes[i] > LONG):
            yield order[start:k]
            start, held = k, 0
        held += int(sizes[i]) + 2
    if start < len(order):
        yield order[start:]


@dataclass
class Model:
    """A fitted model: its word table and the few numbers besides."""

    words: DataFrame  # word (binary), c (training count), n (count in all texts), lattice (natural log of the paths' sum)
    tokens: int  # N: training tokens, ends among them
    types: int  # V: distinct training tokens
    ends: int  # training texts
    novel: float
    hot_from: int  # words that occur so often in all texts are sent to every worker
    model_path: str
    pieces: np.ndarray  # log probability of each piece on a path, the chance of going on included
    shift: float  # what turns a lattice's sum into the log of a word's probability

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def base_column(self, c: Column) -> Column:
        return F.log10((c + 0.5) / F.lit(self.tokens + 0.5 * (self.types + 1)))

    @property
    def end(self) -> float:
        return (self.ends + 0.5) / (self.tokens + 1.0)

    def whole(self, c):
        """The share of a word's own arc."""
        return (1.0 - self.novel) / max(1, self.tokens - self.ends) * c

    def log_p(self, c, lattice):
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(self.whole(c)), lattice + math.log(self.novel))

    def log_p_column(self, c: Column, lattice: Column) -> Column:
        whole, paths = self.whole(c.cast("double")), lattice + F.lit(math.log(self.novel))
        # ln(whole + e^paths), without underflow of long words' paths
        return F.when(whole > 0, F.log(whole) + F.log1p(F.exp(F.least(paths - F.log(whole), F.lit(700.0))))).otherwise(paths)


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and cuts at the six ASCII white-space characters."""
    return (raw or b"").lower().split()


def count_words(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """word, c, n, texts: occurrences in training texts and in all; the null word's row counts training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64()]
        all_, own, ends = Counter(), Counter(), 0

        def out(words, c, n):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((words, c, n), kinds)], ["word", "c", "n"])

        def flush():
            words = list(all_)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield out(part, [own.get(w, 0) for w in part], [all_[w] for w in part])
            all_.clear()
            own.clear()

        for batch in batches:
            for raw, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(raw.as_py())
                all_.update(words)
                if learn:
                    own.update(words)
                    ends += 1
                if len(all_) > HELD_WORDS:
                    yield from flush()
        yield from flush()
        yield out([None], [ends], [0])

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("raw"), train.alias("learn"))
    return rows.mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column, model_path: str, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    words = stored(count_words(docs, train, text_col), "lm-words")
    facts = words.agg(
        F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends"),
        F.sum(F.when(F.col("word").isNotNull(), F.col("c"))).alias("seen"),
        F.count_if(F.col("word").isNotNull() & (F.col("c") > 0)).alias("types"),
    ).first()
    ends, seen, types = (int(facts[k] or 0) for k in ("ends", "seen", "types"))
    words = words.where(F.col("word").isNotNull())
    # Counts in eighths of a power of two: a small histogram that bounds how many words are hot.
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int").alias("step")
    hot_from, held = 1, 0
    for row in words.where(F.octet_length("word") <= HOT_BYTES).groupBy(step).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect():
        held += row["k"]
        if held > HOT_WORDS:
            break
        hot_from = int(row["least"])
    else:
        hot_from = 1
    logq, pieces = pieces_of(model_path).start, 0.0
    for _ in range(PASSES):
        logq, pieces = expectation(words.where("c > 0"), model_path, logq)
    stop = min(max(types / pieces, 1e-3), 0.999) if pieces else 0.5
    given = logq + math.log1p(-stop)  # a path of k pieces has the factor (1 - stop)^(k - 1) * stop
    shift = math.log(stop) - math.log1p(-stop)
    table = stored(_with_lattices(words, model_path, given, shift), "lm-lattices")
    return Model(table, seen + ends, types + (ends > 0), ends, share_of_new(table.where("c > 0"), seen), hot_from, model_path, given, shift)


def share_of_new(table: DataFrame, seen: int) -> float:
    """The share of new words that makes training occurrences, each told by all the others, most likely: one aggregate."""
    if not seen:
        return 1.0
    c, path = F.col("c").cast("double"), F.exp("lattice")
    told = [F.sum(F.when(c > 1, c * F.log(F.lit((1 - x) / max(1, seen - 1)) * (c - 1) + F.lit(float(x)) * path))).alias(f"s{k}") for k, x in enumerate(SHARES)]
    row = table.agg(F.count_if(c == 1).alias("once"), *told).first()
    likely = [(row[f"s{k}"] or 0.0) + row["once"] * math.log(x) for k, x in enumerate(SHARES)]
    return float(SHARES[int(np.argmax(likely))])


def expectation(words: DataFrame, model_path: str, start: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass of expectation-maximisation; also the expected number of pieces in all words."""
    shared = words.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, used = pieces_of(model_path), None
        for batch in batches:
            texts = [w.decode() for w in batch.column(0).to_pylist()]
            for own in batches_of(texts):
                _, some = lattice.marginals([texts[i] for i in own], shared.value, np.ones(len(own)))
                used = some if used is None else used + some
        if used is not None:
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at])], ["piece", "used"])

    got = words.select("word").mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
    used = np.zeros(len(start))
    used[got.column("piece").to_numpy()] = got.column("used").to_numpy()
    total = float(used.sum())
    # the file's own scores act as one observation for every piece, so that none gets probability 0
    prior = np.exp(pieces_of(model_path).start)
    return np.log((used + prior * len(start) + 1e-12 * (prior > 0)) / (total + len(start)) + 1e-300), total


def _with_lattices(words: DataFrame, model_path: str, logq: np.ndarray, shift: float) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(logq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces_of(model_path)
        for batch in batches:
            texts = [w.decode() for w in batch.column(0).to_pylist()]
            out = np.zeros(len(texts))
            for own in batches_of(texts):
                out[own] = lattice.marginals([texts[i] for i in own], shared.value)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out + shift)], ["word", "c", "n", "lattice"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, lattice double")


class Hot:
    """The frequent words in a worker: index, and arrays of what they add to a text's sums."""

    held: dict[str, Hot] = {}

    def __init__(self, table: pa.Table):
        self.index = {w: i for i, w in enumerate(table.column("word").to_pylist())}
        self.known = table.column("c").to_numpy() > 0
        self.base, self.log_p = table.column("base").to_numpy(), table.column("log_p").to_numpy()

    @classmethod
    def of(cls, name: str, shared: Broadcast) -> Hot:
        if name not in cls.held:
            cls.held.clear()
            cls.held[name] = cls(pa.ipc.open_stream(shared.value).read_all())
        return cls.held[name]


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", unseen: bool = True) -> DataFrame:
    """Returns id, n_tokens, n_known, train_tokens, base_score and score (both log10), a row for each row of ``docs``.

    With ``unseen``, words that the model's table lacks get their lattices here;
    it isn't needed for texts that the model was fitted on (held out or not).
    """
    import uuid

    spark = docs.sparkSession
    hot = model.words.where((F.col("n") >= model.hot_from) & (F.octet_length("word") <= HOT_BYTES)).select("word", "c", "lattice").toArrow()
    c, lattice = hot.column("c").to_numpy(), hot.column("lattice").to_numpy()
    table = pa.table({"word": hot.column("word"), "c": hot.column("c"), "base": model.base(c), "log_p": model.log_p(c, lattice)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared, name = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    end_known, end_base, end_p, go_on = int(model.ends > 0), float(model.base(np.float64(model.ends))), math.log(model.end), math.log1p(-model.end)
    rises, all_ = math.lgamma, math.lgamma(CACHE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Hot.of(name, shared)
        get = index.index.get
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for raw in batch.column(1):
                    words = words_of(raw.as_py())
                    counts = Counter(words)
                    places = [get(w, -1) for w in counts]
                    where = np.array(places, np.int64)
                    times = np.fromiter(counts.values(), np.int64, len(counts))
                    there = where >= 0
                    at_, t = where[there], times[there]
                    rare = [{"word": w, "times": n} for (w, n), p in zip(counts.items(), places) if p < 0]
                    log_a = index.log_p[at_] + math.log(CACHE)
                    burst = sum(rises(a + k) - rises(a + 1) for a, k in zip(np.exp(log_a[t > 1]).tolist(), t[t > 1].tolist()))
                    score = end_p + len(words) * go_on + float(log_a.sum()) + burst + all_ - rises(len(words) + CACHE)
                    rows.append((len(words) + 1, int(t @ index.known[at_]) + end_known, float(t @ index.base[at_]) + end_base, score, rare))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)]], ["id", "n_tokens", "n_known", "base", "score", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    schema = "id long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, times: long>>"
    partly = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-partly")
    # A rare word is rare in all texts together, so the join has no hot key.
    rare, words = partly.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times"), model.words
    if unseen:
        new = rare.select("word").distinct().join(words, "word", "left_anti").select("word", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("n"))
        words = words.unionByName(_with_lattices(new, model.model_path, model.pieces, model.shift))
    log_a = model.log_p_column(F.col("c"), F.col("lattice")) + F.lit(math.log(CACHE))
    rare = rare.join(words, "word").withColumn("log_a", log_a)
    burst = F.aggregate(F.sequence(F.lit(1), F.col("times").cast("int") - 1), F.lit(0.0), lambda acc, j: acc + F.log(j + F.exp("log_a")))
    added = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * model.base_column(F.col("c"))).alias("more_base"),
        F.sum(F.col("log_a") + F.when(F.col("times") > 1, burst).otherwise(F.lit(0.0))).alias("more_score"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias
    return partly.drop("rare").join(added, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        plus("n_known", "known")("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base")("base_score"),
        (plus("score", "more_score")("x") / F.lit(math.log(10))).alias("score"),
    )
