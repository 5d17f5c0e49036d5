"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, discount their counts and back off to counts that both classes share: a
class's words (by the number of words before them) to the words of both, and those to word beginnings (STEM bytes); a
class's word pairs to the pairs of both, scaled by how much likelier the class makes the word. So a rare expression gets
nearly the same share of either class. The discount of pairs is the usual estimate or a larger one, up to leaving all of a
class's pairs to the shared ones: the largest that predicts rows which the models didn't see about as well as the best.

A text's evidence is the difference of the two log-likelihoods by word: over the whole text, and over its worst passages of
a few lengths, since an insult in a long text is a passage. Words that no sampled text has say nothing. A logistic curve over
these, fitted on the rows that the models didn't see, gives the score; its slopes are 0 or more, so evidence of toxicity never
lowers a score.

Fitting uses every labelled row outside the held-out fifth: three fourths for the models, the rest for the curve. All their
n-grams are counted and kept, rare ones too. Counts, discounts and backoff weights are Spark aggregates; the tables of shares
are written to the shared folder and read there by the workers, which hold a table of up to HELD_BYTES and stream through a
larger one for each STREAM_BYTES of text. The curve's sums are taken in tasks, so the driver sees totals alone. Scoring covers
every whole text and reads nothing but the text.

Words are runs of letters, digits and bytes beyond ASCII, A-Z folded, told apart by 64-bit hashes. Defined results: null,
empty and wordless texts have no evidence and get the curve's value at zero; ids without or with null labels only get
scores; an id labelled twice counts as toxic if either says so; without rows of both classes every score is the share of
toxic rows (0.5 without labels); a column of the score's name is replaced (the name is a parameter), others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kinespark.llm.common import delete, filesystem, lower_ascii, mixed, span_hashes, stored, temporary, text_or_empty, text_slices, word_spans

STEM, PASSAGES, SEED, FOLDS = 4, (1, 8, 32, 128), 7, 5
#: Discounts of a class's pairs to choose from beside the estimate; the last leaves all pairs to the shared counts.
DISCOUNTS = (2.0, 8.0, None)
#: Bytes of text that are scored at once.
SCORE_BYTES = 1 << 19
#: Turns that pairs are counted in, so that a share of them is on the way at once.
COUNT_TURNS = 2
#: Bytes of a table that a worker holds; bytes of text for which it streams through a larger one once.
HELD_BYTES, STREAM_BYTES = 64 << 20, 8 << 20
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_START = np.uint64(0x5BD1E9955BD1E995)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of the words before them (a fixed value at a text's start), of their stems; rows' first words."""
    folded = lower_ascii(data)
    starts, lens, rows = word_spans(folded, offsets, _BREAK)
    here = span_hashes(folded, starts, lens)
    before = np.empty_like(here)
    before[1:] = here[:-1]
    firsts = rows[:-1]
    before[firsts[firsts < len(here)]] = _START
    return here, before, span_hashes(folded, starts, np.minimum(lens, STEM)), rows


def pair(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) ^ here)


_READ: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Table:
    """A table of the shared folder: numbers by 64-bit keys. A key of two columns is that of the pair. Files are in its order."""

    def __init__(self, path: str, key: Sequence[str], values: Sequence[str]) -> None:
        self.path, self.key, self.values = path, key, values
        fs, root = filesystem(path)
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        self.files = [pq.ParquetFile(fs.open_input_file(f)) for f in names]
        self.rows = sum(f.metadata.num_rows for f in self.files)
        self.held = self.rows * (8 + 4 * len(values)) <= HELD_BYTES

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_: object) -> None:
        for f in self.files:
            f.close()

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys in order, and their values side by side, some rows at a time."""
        for f in self.files:
            for batch in f.iter_batches(1 << 16, columns=[*self.key, *self.values]):
                keys = [batch.column(c).to_numpy().view(np.uint64) for c in self.key]
                yield (keys[0] if len(keys) == 1 else pair(*keys)).view(np.int64), np.stack([batch.column(c).to_numpy().astype(np.float32) for c in self.values], 1)


def read_table(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """This worker's copy of a table, read once: its keys in order and, side by side, its values."""
    if table.path not in _READ:
        keys, found, at = np.empty(table.rows, np.int64), np.empty((table.rows, len(table.values)), np.float32), 0
        for part, values in table.parts():
            keys[at : at + len(part)], found[at : at + len(part)] = part, values
            at += len(part)
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, found = keys[order], found[order]
        _READ[table.path] = keys, found
        pa.default_memory_pool().release_unused()
    return _READ[table.path]


def looked_up(path: str, key: Sequence[str], values: Sequence[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of wanted keys, side by side (0 for those that the table lacks), and which it has."""
    some, which = np.unique(wanted.view(np.int64), return_inverse=True)
    found, hit = np.zeros((len(some), len(values)), np.float32), np.zeros(len(some), bool)

    def take(keys: np.ndarray, rows: np.ndarray) -> None:
        if not len(keys):
            return
        # both are in order, so neighbours touch the same part of either
        a, b = np.searchsorted(some, keys[0]), np.searchsorted(some, keys[-1], "right")
        at = np.searchsorted(keys, some[a:b])
        good = np.flatnonzero(keys[at] == some[a:b])
        found[a + good], hit[a + good] = rows[at[good]], True

    if path not in _READ:
        with Table(path, key, values) as table:
            if table.held:
                read_table(table)
            else:
                for part in table.parts():
                    take(*part)
    if path in _READ:
        take(*_READ[path])
    return found[which], hit[which]


WORD, COUNTS = ("p0", "p1", "shared"), ("n0", "n1")


@dataclass
class Model:
    """Where the tables are, the discounts of pairs to choose from (by class, with their place in the table of contexts), the
    choice, and the curve. The last choice, None, leaves all to the shared pairs, whose share is the same for both classes."""

    words: str
    contexts: str
    pairs: str
    shared_discount: float
    choices: list[np.ndarray | None]
    choice: int = 0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(1 + 1 + len(PASSAGES)))

    def settle(self) -> None:
        """Let go of what this worker holds of other models, and of tables that the choice doesn't need."""
        for path in set(_READ) - {self.words, *(() if self.choices[self.choice] is None else (self.contexts, self.pairs))}:
            del _READ[path]

    def limit(self) -> int:
        """Bytes of text to score at once: more where a table is streamed through."""
        needed = [(self.words, ("here",), WORD)] + ([] if self.choices[self.choice] is None else [(self.contexts, ("before",), self.context), (self.pairs, ("before", "here"), COUNTS)])
        for at in needed:
            if at[0] not in _READ:
                with Table(*at) as table:
                    if not table.held:
                        return STREAM_BYTES
        return SCORE_BYTES

    @property
    def context(self) -> list[str]:
        return ["t0", "t1", "rest", *(f"rest{k}{c}" for k, d in enumerate(self.choices) if d is not None for c in (0, 1))]

    def ratios_of(self, here: np.ndarray, before: np.ndarray, choices: Sequence[int]) -> list[np.ndarray]:
        """By choice: log P(word | toxic) - log P(word | ordinary) for each word."""
        table, hit = looked_up(self.words, ("here",), WORD, here)
        known = np.flatnonzero(hit)
        p = table[known, :2].astype(float)
        if any(self.choices[k] is not None for k in choices):
            contexts, hit = looked_up(self.contexts, ("before",), self.context, before[known])
            some = np.flatnonzero(hit)
            contexts = contexts[some]
            n, _ = looked_up(self.pairs, ("before", "here"), COUNTS, pair(before[known[some]], here[known[some]]))
            t = contexts[:, :2].astype(float)
            likelier = np.maximum(n.sum(1) - self.shared_discount, 0) / t.sum(1) / table[known[some], 2] + contexts[:, 2]
        made = []
        for k in choices:
            q, discount, found = p.copy(), self.choices[k], np.zeros(len(here))
            if discount is not None:
                q[some] = np.maximum(n - discount, 0) / np.maximum(t, 1) + contexts[:, 3 + 2 * k : 5 + 2 * k] * p[some] * likelier[:, None]
            found[known] = np.log(q[:, 1]) - np.log(q[:, 0])
            made.append(found)
        return made

    def ratios(self, here: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.ratios_of(here, before, [self.choice])[0]

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By row: mean ratio over the text, and over its worst passage of each length (a shorter text is one passage)."""
        return self.evidence_of(data, offsets, [self.choice])[:, 0]

    def evidence_of(self, data: np.ndarray, offsets: np.ndarray, choices: Sequence[int]) -> np.ndarray:
        """By row and choice: evidence()."""
        here, before, _, rows = words(data, offsets)
        made = np.zeros((len(offsets) - 1, len(choices), 1 + len(PASSAGES)))
        if not len(here):
            return made
        first, last = rows[:-1], rows[1:]
        n = last - first
        some = np.flatnonzero(n)
        for at, ratios in enumerate(self.ratios_of(here, before, choices)):
            found = made[:, at]
            total = np.concatenate([[0.0], np.cumsum(ratios)])
            found[some, 0] = (total[last[some]] - total[first[some]]) / n[some]
            for k, length in enumerate(PASSAGES, 1):
                found[:, k] = found[:, 0]
                wide = np.flatnonzero(n > length)
                if len(wide):
                    means = (total[length:] - total[:-length]) / length
                    # passages that would run into the next text are none
                    means = np.append(means, np.full(length, -np.inf))
                    bounds = np.stack([first[wide], last[wide] - length + 1], 1).ravel()
                    found[wide, k] = np.maximum.reduceat(means, bounds)[::2]
        return made

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -40, 40)))


#: Sums over all rows of what a function gives for some of them: (figures by row and choice, labels, weights, folds) -> numbers.
Ask = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def curves(ask: Ask, width: int, fits: Sequence[tuple[int, int | None]], ridge: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Logistic regressions by projected Newton steps, slopes at least 0: more evidence never lowers a score.

    A fit is a choice and the fold that it leaves out. All take their steps side by side, one round of sums a step. The ridge
    on slopes (of figures in units of their deviation) is the same whatever the number of rows, so it counts for more the
    fewer there are.
    """
    m, d = len(fits), width + 1

    def of(fit: tuple[int, int | None], x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, left_out = fit
        keep = np.ones(len(x), bool) if left_out is None else fold != left_out
        return x[keep, k], keep

    def moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return np.concatenate([np.r_[len(z), z.sum(0), (z * z).sum(0)] for z in (of(fit, x, fold)[0] for fit in fits)])

    found = (np.zeros(m * (2 * width + 1)) + ask(moments)).reshape(m, -1)
    mean, square = (found[:, 1 + a * width : 1 + (a + 1) * width] / np.maximum(found[:, :1], 1) for a in (0, 1))
    spread = square - mean * mean
    scale = np.where(spread > 1e-12 * square, np.sqrt(np.maximum(spread, 0)), 1.0)
    hold = np.r_[1e-6, np.full(width, ridge)]
    b, trial = np.zeros((m, d)), np.zeros((m, d))
    step, size, now, live = np.zeros((m, d)), np.ones(m), np.full(m, np.inf), list(range(m))
    for _ in range(rounds):
        if not live:
            break

        def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
            made = []
            for i in live:
                z, keep = of(fits[i], x, fold)
                z, w, t = np.column_stack([np.ones(len(z)), z / scale[i]]), weight[keep], y[keep]
                v = z @ trial[i]
                p = 1 / (1 + np.exp(-np.clip(v, -30, 30)))
                made += [[(w * np.logaddexp(0, np.where(t == 1, -1, 1) * v)).sum()], z.T @ (w * (t - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(made)

        for i, made in zip(list(live), (np.zeros(len(live) * (1 + d + d * d)) + ask(sums)).reshape(len(live), -1), strict=True):
            loss = made[0] + (hold * trial[i] ** 2).sum() / 2
            if loss <= now[i] + 1e-12 * abs(loss) or size[i] < 1e-6:
                b[i], now[i], size[i] = trial[i], loss, 1.0
                slope = hold * b[i] - made[1 : 1 + d]
                # slopes at 0 that would go below stay there
                free = np.flatnonzero((b[i] > 0) | (slope < 0) | (np.arange(d) == 0))
                step[i] = 0
                step[i, free] = -np.linalg.solve(made[1 + d :].reshape(d, d)[np.ix_(free, free)] + np.diag(hold[free]), slope[free])
            else:
                size[i] /= 2
            trial[i] = b[i] + size[i] * step[i]
            trial[i, 1:] = np.maximum(trial[i, 1:], 0)
            if np.abs(trial[i] - b[i]).max() < 1e-8:
                live.remove(i)
    return np.column_stack([b[:, 0], b[:, 1:] / scale])


def in_memory(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Ask:
    return lambda f: f(x, y, weight, fold)


def in_tasks(seen: DataFrame, n: int, width: int) -> Ask:
    """Sums over a written table (toxic, fold, x0, x1, ...), a row of them a task."""

    def ask(f: Callable[..., np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.stack([batch.column(f"x{k}").to_numpy() for k in range(n * width)], 1).reshape(-1, n, width)
                    made = f(x, (batch.column("toxic").to_numpy() == 1).astype(float), np.ones(len(x)), batch.column("fold").to_numpy())
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        return np.sum([r.sums for r in seen.mapInArrow(run, "sums array<double>").collect()], 0)

    return ask


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """curves() of rows at hand."""
    return curves(in_memory(x[:, None], y, weight, np.zeros(len(y))), x.shape[1], [(0, None)], ridge)[0]


def remainder(id_col: Column) -> Column:
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 5


def fit_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, toxic, fold) of all labelled rows outside the held-out fifth: those to count, and the fourth of them for the curve.

    Labels are looked up where the texts lie, so no text moves.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(remainder(F.col("doc_id")) != 0)
    # whole numbers are their own keys
    whole = all(isinstance(t.schema["doc_id"].dataType, IntegralType) for t in (docs, labels))
    ident = F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string"))
    path = folder_of(in_order(known.select(ident.alias("id"), "toxic"), "id", "toxic-labels", keep=False))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, hit = looked_up(path, ("id",), ("toxic",), batch.column("id").to_numpy())
            some = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([some.column("text"), pa.array(toxic[hit, 0].astype(np.int32)), some.column("fold")], names=["text", "toxic", "fold"])
        _READ.pop(path, None)

    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    texts = lambda part: docs.filter(remainder(F.col("doc_id")).isin(*part)).select(ident.alias("id"), text_or_empty().alias("text"), fold.alias("fold"))
    counted, curve = (texts(part).mapInArrow(labelled, "text string, toxic int, fold int") for part in ((2, 3, 4), (1,)))
    return counted, curve


def count_pairs(rows: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """Of the pairs whose key falls to this turn: (before, here, stem, n0, n1): word pairs by class, counted in the tasks before they are dealt out; stem is null but in some of a word's.

    Each partition is in the order of the pairs' keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches):
            here, before, stems, firsts = words(data, offsets)
            toxic = np.repeat(np.asarray(part.column("toxic").to_pylist(), np.int64), np.diff(firsts))
            keys, at, which = np.unique(pair(before, here), return_index=True, return_inverse=True)
            n1 = np.bincount(which, toxic, len(keys)).astype(np.int32)
            n = np.bincount(which, minlength=len(keys)).astype(np.int32)
            # a word's stem goes along once, not with each of its pairs
            spare = np.ones(len(keys), bool)
            spare[np.unique(here[at], return_index=True)[1]] = False
            mine = np.flatnonzero(keys % np.uint64(turns) == turn)
            at, spare, n, n1 = at[mine], spare[mine], n[mine], n1[mine]
            yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(here[at].view(np.int64)), pa.array(stems[at].view(np.int64), mask=spare), pa.array(n - n1), pa.array(n1)], names=["before", "here", "stem", "n0", "n1"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, here = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "here"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair(before, here).view(np.int64))], names=["before", "here", "stem", "n0", "n1", "key"])

    counted = rows.select("text", "toxic").mapInArrow(run, "before long, here long, stem long, n0 int, n1 int")
    counted = counted.groupBy("before", "here").agg(F.max("stem").alias("stem"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return counted.mapInArrow(keyed, "before long, here long, stem long, n0 long, n1 long, key long").sortWithinPartitions("key").drop("key")


def _totals(table: DataFrame, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """By column: the sum of the counts, and the discount n1 / (n1 + 2 n2) from how many are 1 and 2."""
    asked = [x for c in columns for x in (F.sum(c), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]
    total, ones, twos = np.array([x or 0 for x in table.agg(*asked).first()], float).reshape(len(columns), 3).T
    return total, np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)


def _share(count: str, discount: float, total: float) -> Column:
    return F.greatest(F.col(count) - F.lit(float(discount)), F.lit(0.0)) / F.lit(float(total))


def _rest(table: DataFrame, *shares: Column) -> list[float]:
    """What the shares leave to the backoff."""
    return [1 - (x or 0.0) for x in table.agg(*(F.sum(x) for x in shares)).first()]


def fit_counts(pairs: DataFrame, discounts: tuple[float | None, ...] = DISCOUNTS) -> Model | None:
    """The model of stored pair counts; None without both classes. Keeps its tables in the shared folder."""
    counts = pairs
    pairs = pairs.withColumn("n", F.col("n0") + F.col("n1"))
    seen = lambda c: F.count_if(F.col(c) > 0).alias(c)
    words_of = stored(pairs.groupBy("here").agg(F.max("stem").alias("stem"), seen("n0"), seen("n1"), seen("n")), "toxic-words")
    stems_of = stored(words_of.groupBy("stem").agg(F.count("*").alias("n")), "toxic-stems")
    total2, d2 = _totals(pairs, "n0", "n1", "n")
    total1, d1 = _totals(words_of, "n0", "n1", "n")
    total0, d0 = _totals(stems_of, "n")
    if not total2.all():
        return None
    # words of both classes: the share of the stem among words, evenly
    stem = _share("n", d0[0], total0[0])
    even = F.lit(_rest(stems_of, stem)[0] / stems_of.count())
    stems = stems_of.select("stem", ((stem + even) / F.col("n")).alias("even"))
    own = [_share(c, d, t) for c, d, t in zip(("n0", "n1", "n"), d1, total1, strict=True)]
    rest = [F.lit(x) for x in _rest(words_of, *own)]
    shared = own[2] + rest[2] * F.col("even")
    known = words_of.join(stems, "stem").select("here", *((own[c] + rest[c] * shared).cast("float").alias(f"p{c}") for c in (0, 1)), shared.cast("float").alias("shared"))
    known = in_order(known, "here", "toxic-word-shares")
    # pairs: what each discount leaves to the shared pairs
    choices = [d2[:2], *(None if d is None else np.full(2, d) for d in discounts)]
    left = [F.sum(F.least(F.col("n"), F.lit(float(d2[2])))).alias("left")]
    left += [F.sum(F.least(F.col(f"n{c}"), F.lit(float(d[c])))).alias(f"left{k}{c}") for k, d in enumerate(choices) if d is not None for c in (0, 1)]
    contexts = pairs.groupBy("before").agg(*(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)), *left)
    rests = [F.when(F.col(f"t{c}") > 0, F.col(f"left{k}{c}") / F.col(f"t{c}")).otherwise(1.0).cast("float").alias(f"rest{k}{c}") for k, d in enumerate(choices) if d is not None for c in (0, 1)]
    contexts = contexts.select("before", *(F.col(f"t{c}").cast("float") for c in (0, 1)), (F.col("left") / (F.col("t0") + F.col("t1"))).cast("float").alias("rest"), *rests)
    contexts = in_order(contexts, "before", "toxic-contexts")
    return Model(folder_of(known), folder_of(contexts), folder_of(counts), float(d2[2]), choices)


def in_order(table: DataFrame, key: str, name: str, keep: bool = True) -> DataFrame:
    """The table written in the key's order, so that workers need not sort it."""
    return stored(table.repartitionByRange(key).sortWithinPartitions(key), name, keep)


def folder_of(table: DataFrame) -> str:
    """The folder that a table of stored() lies in."""
    return table.inputFiles()[0].rpartition("/")[0]


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model, or the share of toxic rows where one class is missing."""
    with temporary(docs.sparkSession):
        counted, curve = fit_rows(docs, labels)
        first, *rest = (count_pairs(counted, k, COUNT_TURNS) for k in range(COUNT_TURNS))
        model = fit_counts(stored(first, "toxic-counts", keep=True, more=rest))
        if model is None:
            share = counted.unionByName(curve).agg(F.avg("toxic")).first()[0]
            return 0.5 if share is None else float(share)

        width, n = 1 + len(PASSAGES), len(model.choices)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in text_slices(batches, limit=model.limit()):
                x = model.evidence_of(data, offsets, range(n)).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), *(pa.array(c) for c in x.T)], names=["toxic", "fold", *(f"x{k}" for k in range(x.shape[1]))])
            _READ.clear()  # the workers live on; the next stages need the room

        # together, since each task streams through the tables
        texts = stored(curve, "toxic-curve")
        seen = stored(texts.mapInArrow(run, "toxic int, fold int, " + ", ".join(f"x{k} double" for k in range(n * width))), "toxic-evidence")
        ask = in_tasks(seen, n, width)
        both = seen.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
        if not 0 < both[0] < both[1]:
            model.curve = np.r_[-4.0, 0.0, np.ones(len(PASSAGES))]
            return model
        model.choice = choose(ask, n, width)
        model.curve = curves(ask, width, [(model.choice, None)])[0]
        if model.choices[model.choice] is None:
            delete([model.contexts, model.pairs])
    return model


def choose(ask: Ask, n: int, width: int) -> int:
    """The largest discount whose loss on rows that its curve wasn't fitted on is within a standard error of the least.

    Larger discounts trust rare counts less, so of discounts that the rows can't tell apart the largest is taken.
    """
    sizes = (np.zeros(2 * FOLDS) + ask(lambda x, y, weight, fold: np.r_[np.bincount(fold, minlength=FOLDS), np.bincount(fold, y, FOLDS)])).reshape(2, FOLDS)
    folds = np.flatnonzero(sizes[0])
    known, toxic = (sizes.sum(1)[:, None] - sizes)[:, folds]
    if not ((toxic > 0) & (toxic < known)).all():
        return 0
    made = np.zeros((FOLDS, n, 1 + width))
    made[folds] = curves(ask, width, [(k, int(f)) for f in folds for k in range(n)]).reshape(len(folds), n, -1)

    def losses(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
        at = made[fold, :, 0] + (x * made[fold, :, 1:]).sum(2)
        loss = weight[:, None] * np.logaddexp(0, at * np.where(y == 1, -1, 1)[:, None])
        return np.r_[loss.sum(0), (loss.T @ loss).ravel()]

    total, rows = ask(losses), sizes[0].sum()
    total, square = total[:n], total[n:].reshape(n, n)
    least = total.argmin()
    worse = total - total[least]
    spread = np.maximum((np.diag(square) - 2 * square[least] + square[least, least]) / rows - (worse / rows) ** 2, 0)
    return int(np.flatnonzero(worse <= np.sqrt(spread * rows))[-1])


def best_choice(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> int:
    """choose() of rows at hand."""
    return choose(in_memory(x, y, weight, fold), x.shape[1], x.shape[2])


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """docs' columns and the score: 0 to 1, higher for texts that are likelier toxic. Texts are read where they lie."""
    if isinstance(model, float):
        return docs.withColumn(into, F.lit(model))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model.settle()
        limit = model.limit()
        for text in texts:
            batch = pa.RecordBatch.from_arrays([text], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0), *(model.scores(model.evidence(d, o)) for _, d, o in text_slices(iter([batch]), limit=limit))]))
        _READ.clear()  # the workers live on; the next stages need the room
        pa.default_memory_pool().release_unused()

    return docs.withColumn(into, scored(text_or_empty(text_col)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
