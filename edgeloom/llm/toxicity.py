"""Abusive, hateful or sexual passages: a factorization machine over hashed terms of normalised passages.

A document is a bag of passages (sentences, lines, windows of long ones); it is a case if one of them is. Labels are
per document, so training picks in each round the passages that explain a label (multiple-instance learning). The
linear part holds what a term says alone; no pair of words has a weight of its own. What words say only together, such
as an insult with a group mention, is left to the pairwise part of the machine.

A passage is its set of distinct words, a word the sum of its terms (normal form and letter groups). So a word's share of
the score is computed once per task, and a passage is scored by adding up a few numbers per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import key_hash
from edgeloom.session import cut
from edgeloom.sources.tables import load

BUCKETS = 1 << 17
FACTORS = 8
MAX_LABELLED = 20_000  # documents the model is fitted on, the ones with the smallest hash
WINDOW = 40  # words of a passage at most; longer ones are read in overlapping windows
STEP = 30
PIECE = 64  # characters of a word at most; longer ones are read in overlapping pieces
KNOWN_WORDS = 1 << 18  # words a task remembers the shares of

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = str.maketrans(
    "аеорсухіѕјкмтвнгԁһӏёїαεορτυνικχηωβ",
    "aeopcyxisjkmtbhrdhleiaeoptuvikxnwb",
)
# Signs that stand for letters inside a word.
_SIGNS = str.maketrans("013457@$!€", "oieastasie")
# One-letter words of the languages at hand, which may stand before a spaced-out word.
_LONE = frozenset("aeiouy")

_PASSAGE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·]){2,}[^\W_](?![^\W_])")
_URL = re.compile(r"https?://\S+")
_WORD = re.compile(r"[^\W_](?:[\w@$!*€'’\-.]*[\w*])?")
_SQUEEZE = re.compile(r"(.)\1+")
_MASKED = re.compile(r"[a-z]+\*+[a-z]*|[a-z]+[#%&_]{2,}[a-z]*")
_NO_WORD = re.compile(r"[^\w]|_")
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Cf}]+")
_SIGNED = re.compile(r"(?=.*[^\W\d_])(?=.*[013457@$!€])")
_NO_LATIN = re.compile(r"[^a-z_]+")
_NO_LETTER = re.compile(r"[^\w]+")


def plain(text: str) -> str:
    """Case, accents, invisible characters and look-alike letters undone."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKD", text)
    if not s.isascii():
        s = _INVISIBLE.sub("", s)
    s = s.casefold()
    return s if s.isascii() else s.translate(_LOOK_ALIKE)


def _join_spaced(m: re.Match) -> str:
    """Letters apart as one word; once more without the first where that may be a word by itself."""
    w = _NO_WORD.sub("", m[0])
    return f" {w} {w[1:]} " if w[0] in _LONE else f" {w} "


@lru_cache(maxsize=100_000)
def word_parts(w: str) -> tuple[str, ...]:
    """The normal form of one raw word, the parts of a compound of '_' or '-' too; '<...>' and '*...' are marks.

    A part has a term for itself, unless it runs to more than 24 letters, and, being no mark, one per letter group.
    """
    if w.isalpha():
        return (_SQUEEZE.sub(r"\1", w),)
    if w.isdigit():
        return ("<0>",)
    if _MASKED.fullmatch(w):
        return ("*", f"*{w[0]}", f"*{w[0]}{w[-1]}{len(w)}")
    base = _NO_LATIN.sub("", w.translate(_SIGNS)) if _SIGNED.match(w) else _NO_LETTER.sub("", w)
    if base.isalpha() and "-" not in w:
        return (_SQUEEZE.sub(r"\1", base),)
    parts = [_SQUEEZE.sub(r"\1", p) for p in base.split("_") if p]
    out = ["<name>", *parts] if len(parts) > 1 else parts
    if "-" in w:
        out += [x for p in w.split("-") if 2 < len(p) < len(w) for x in word_parts(p)]
    return tuple(dict.fromkeys(out)) or ("<0>",)


_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number
_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))


def _to_bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 17)).astype(np.int64) & (BUCKETS - 1)


def term_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms of each word, and where each word's terms start (one more than words).

    Terms are hashed by arithmetic on all characters at once: a part as a whole, and its groups of four, ends included.
    """
    parts = [word_parts(w) for w in words]
    flat = [p for r in parts for p in r]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    word = np.repeat(np.arange(len(parts)), [len(r) for r in parts])
    size = np.array([len(p) for p in flat])
    mark = np.array([p[0] in "<*" for p in flat])
    code = np.frombuffer("".join([f"^{p}$" for p in flat]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = _starts(size + 2)
    at = np.arange(len(code)) - np.repeat(start[:-1], size + 2)
    whole = np.add.reduceat(code * _POWERS[at & 255], start[:-1])
    whole = np.where((size > 24) & ~mark, np.uint64(1), whole)
    group = np.flatnonzero((at < np.repeat(size - 1, size + 2)) & np.repeat((size >= 4) & ~mark, size + 2))
    four = np.full(len(group), 7, np.uint64)
    for k in range(4):
        four = four * _BASE + code[group + k]
    owner = np.r_[word, np.repeat(word, size + 2)[group]]
    order = np.argsort(owner, kind="stable")
    return np.r_[_to_bucket(whole), _to_bucket(four)][order], _starts(np.bincount(owner, minlength=len(parts)))


def passages(text: str | None) -> list[list[str]]:
    """The distinct raw words of each passage of the whole text; none for null, empty or wordless texts."""
    if not text:
        return []
    s = plain(text)
    if "://" in s:
        s = _URL.sub(" <url> ", s)
    s = _SPACED.sub(_join_spaced, s)
    out = []
    for part in _PASSAGE.split(s):
        raw = _WORD.findall(part)
        if not raw:
            continue
        if len(part) > PIECE and len(max(raw, key=len)) > PIECE:
            raw = [w[i : i + PIECE] for w in raw for i in range(0, max(1, len(w) - 3), PIECE - 3)]
        if len(raw) <= WINDOW:
            out.append(list(dict.fromkeys(raw)))
        else:
            out += [list(dict.fromkeys(raw[a : a + WINDOW])) for a in range(0, len(raw) - (WINDOW - STEP), STEP)]
    return out


class Bags(NamedTuple):
    """Documents as passages of words, all of them numbered: ragged rows as flat arrays with the start of each row."""

    terms: np.ndarray  # buckets of the words' terms
    term_start: np.ndarray  # per word and one more
    words: np.ndarray  # word numbers of the passages
    word_start: np.ndarray  # per passage and one more
    start: np.ndarray  # first passage of each document and one more

    @classmethod
    def of(cls, docs: Sequence[Sequence[Sequence[str]]]) -> Bags:
        """Passages that a document repeats are taken once."""
        number: dict[str, int] = {}
        once = [list({tuple(p): None for p in d}) for d in docs]
        words = np.array([number.setdefault(w, len(number)) for d in once for p in d for w in p], np.int64)
        return cls(
            *term_buckets(list(number)), words, _starts([len(p) for d in once for p in d]), _starts([len(d) for d in once]),
        )

    def pick(self, docs: np.ndarray) -> Bags:
        """The same words, only these documents."""
        p, start = _rows(np.arange(len(self.word_start) - 1), self.start, docs)
        words, word_start = _rows(self.words, self.word_start, p)
        return self._replace(words=words, word_start=word_start, start=start)


def _starts(sizes: Sequence[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int64)


def _rows(flat: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named ragged rows and their starts."""
    n = start[rows + 1] - start[rows]
    at = _starts(n)
    return flat[np.repeat(start[rows] - at[:-1], n) + np.arange(at[-1])], at


def _sum(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ragged rows, none of them empty."""
    return np.add.reduceat(x, start[:-1], axis=0) if len(x) else np.zeros((0, *x.shape[1:]), x.dtype)


class FactorizationMachine:
    """score(x) = b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j with x_i = 1 / sqrt(terms of the passage).

    ``factors`` = 0 leaves the linear part only.
    """

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.b = np.float32(-2.0)
        self.w = np.zeros(buckets, np.float32)
        self.v = (rng.standard_normal((buckets, factors)) * 0.1).astype(np.float32)
        self.gw = np.full(buckets, 1e-2, np.float32)
        self.gv = np.full((buckets, factors), 1e-2, np.float32)

    def shares(self, terms: np.ndarray, term_start: np.ndarray) -> np.ndarray:
        """[word, (terms, sum of w, sum of |v|^2, sum of v...)]: what a word adds to a passage."""
        v = self.v[terms]
        n = np.diff(term_start).astype(np.float32)
        return np.column_stack([n, _sum(self.w[terms], term_start), _sum((v * v).sum(1), term_start), _sum(v, term_start)]).astype(np.float32)

    def from_shares(self, total: np.ndarray) -> np.ndarray:
        """Scores of passages from the sums of their words' shares."""
        s = total[:, 3:]
        return self.b + total[:, 1] / np.sqrt(total[:, 0]) + 0.5 * ((s * s).sum(1) - total[:, 2]) / total[:, 0]

    def scores(self, bags: Bags) -> np.ndarray:
        """One per passage."""
        table = self.shares(bags.terms, bags.term_start)
        out = [np.zeros(0, np.float32)]
        for a in range(0, len(bags.word_start) - 1, 4096):
            at = bags.word_start[a : a + 4097]
            out.append(self.from_shares(_sum(table[bags.words[at[0] : at[-1]]], at - at[0])))
        return np.concatenate(out)

    def step(self, bags: Bags, chosen: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, l2: float) -> None:
        """One AdaGrad step of weighted log loss on the chosen passages."""
        words, at = _rows(bags.words, bags.word_start, chosen)
        known, word = np.unique(words, return_inverse=True)
        terms, term_at = _rows(bags.terms, bags.term_start, known)
        total = _sum(self.shares(terms, term_at)[word], at)
        g = ((1 / (1 + np.exp(-self.from_shares(total))) - y) * weight).astype(np.float32)
        # per passage: the factor of dw, of v and the sum vector; then per word, then per term
        gx, gq = g / np.sqrt(total[:, 0]), g / total[:, 0]
        per = np.column_stack([gx, gq, gq[:, None] * total[:, 3:]])[np.repeat(np.arange(len(chosen)), np.diff(at))]
        per = _grouped(per, word)[np.repeat(np.arange(len(known)), np.diff(term_at))]
        uniq, inv = np.unique(terms, return_inverse=True)
        d = _grouped(per, inv)
        dw = d[:, 0] + l2 * self.w[uniq]
        self.gw[uniq] += dw * dw
        self.w[uniq] -= rate * dw / np.sqrt(self.gw[uniq])
        v = self.v[uniq]
        dv = d[:, 2:] - d[:, 1:2] * v + l2 * v
        self.gv[uniq] += dv * dv
        self.v[uniq] = v - 0.5 * rate * dv / np.sqrt(self.gv[uniq])
        self.b -= np.float32(0.05 * rate * g.sum() / max(1.0, float(weight.sum())))


def _grouped(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group 0, 1, ..., none of them empty."""
    o = np.argsort(group, kind="stable")
    return np.add.reduceat(x[o], np.r_[0, np.flatnonzero(np.diff(group[o])) + 1], axis=0)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _log_odds(bags: Bags, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the terms by document, the start of the linear part."""
    words, at = _rows(bags.words, bags.word_start, np.arange(len(bags.word_start) - 1))
    doc = np.repeat(np.repeat(np.arange(len(y)), np.diff(bags.start)), np.diff(at))
    pair = _distinct(doc * np.int64(len(bags.term_start)) + words)
    doc, words = pair // len(bags.term_start), pair % len(bags.term_start)
    terms, at = _rows(bags.terms, bags.term_start, words)
    pair = _distinct(np.repeat(doc, np.diff(at)) * np.int64(BUCKETS) + terms)
    doc, terms = pair // BUCKETS, pair % BUCKETS
    pos, neg = np.bincount(terms, y[doc], BUCKETS), np.bincount(terms, 1 - y[doc], BUCKETS)
    p, n = max(1.0, float(y.sum())), max(1.0, float((1 - y).sum()))
    return np.where(pos + neg > 0, np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1)), 0.0)


LINEAR_START = 0.7  # share of the log odds the linear part starts from; the rest is left to the pairwise part
SETTLED = 0.01  # a calm passage with a likelihood below this teaches nothing in a round


def fit(bags: Bags, y: np.ndarray, trust: np.ndarray | None = None, rounds: int = 12, rate: float = 0.1, l2: float = 2e-4, factors: int = FACTORS, seed: int = 42) -> FactorizationMachine:
    """Fit on bags of passages; y is the share of raters that saw a case. Without both classes all scores are low.

    ``trust`` weighs the documents; without it a label that the model comes to contradict weighs less.
    """
    fm = FactorizationMachine(factors=factors, seed=seed)
    if not len(y) or y.max() < 0.5 or y.min() > 0.5:
        fm.v[:] = 0
        return fm
    fm.w[:] = LINEAR_START * _log_odds(bags, y)
    keep = np.flatnonzero((np.diff(bags.start) > 0) & (y != 0.5))  # an even vote teaches nothing
    if not len(keep):
        return fm
    bags, case = bags.pick(keep), y[keep] > 0.5
    owner = np.repeat(np.arange(len(keep)), np.diff(bags.start))
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        s = fm.scores(bags)
        top = np.maximum.reduceat(s, bags.start[:-1])
        # a positive document teaches through its likeliest passages, a negative one through all that could be cases
        best = s >= top[owner] - (0.5 if r else 0.25)
        if trust is not None:
            by_doc = trust[keep]
        else:
            prob = 1 / (1 + np.exp(-top))
            by_doc = np.where(case, 0.3 + 0.7 * prob, 0.3 + 0.7 * (1 - prob)) if r > 2 else np.ones(len(keep))
        open_ = 1 / (1 + np.exp(-s)) > SETTLED if r else True
        chosen = np.flatnonzero(np.where(case[owner], best, open_))
        mine = owner[chosen]
        n_chosen = np.bincount(mine, minlength=len(keep))
        weight = by_doc[mine] * np.where(case[mine], 2.0 / np.maximum(n_chosen[mine], 1), 1.0)
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), 256):
            o = order[a : a + 256]
            fm.step(bags, chosen[o], case[mine[o]].astype(np.float32), weight[o], rate, l2)
    return fm


def document_scores(fm: FactorizationMachine, bags: Bags) -> np.ndarray:
    """The highest passage of each document; minus infinity without any."""
    out = np.full(len(bags.start) - 1, -np.inf)
    full = np.diff(bags.start) > 0
    if full.any():
        out[full] = np.maximum.reduceat(fm.scores(bags), bags.start[:-1][full])
    return out


FOLDS = 3
RATER_ERROR = 0.1  # how often a rater is wrong, about
BLUR = 0.5  # how far a document's score moves between fits, about


def held_out_scores(bags: Bags, y: np.ndarray, seed: int = 42, **how) -> np.ndarray:
    """Each document's score by a machine that was not fitted on it."""
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    s = np.full(len(y), -99.0)
    for k in range(FOLDS):
        mine = fold == k
        if mine.any() and not mine.all():
            fm = fit(bags.pick(np.flatnonzero(~mine)), y[~mine], seed=seed, **how)
            s[mine] = np.maximum(document_scores(fm, bags.pick(np.flatnonzero(mine))), -99.0)
    return s


def case_likelihood(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How likely a document is a case, given its held-out score and the votes of raters who err at RATER_ERROR."""
    votes = np.round(y * n)
    odds = np.clip(s, -6, 6) + (2 * votes - n) * np.log((1 - RATER_ERROR) / RATER_ERROR)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def threshold(s: np.ndarray, case: np.ndarray, beta: float = 1.0) -> float:
    """Where to call a document a case: the best F-beta on held-out scores ``s``; a larger beta finds more and errs more.

    Both what is a case (a likelihood) and what is flagged (by degrees around the threshold) are counted in parts, so
    that single documents and wrong votes do not move it. 0 where there is nothing to choose by.
    """
    if not len(s) or case.max() < 0.5 or case.min() > 0.5:
        return 0.0
    at = np.linspace(-2, 2, 81)
    flag = 1 / (1 + np.exp(np.clip((at[:, None] - s[None, :]) / BLUR, -50, 50)))
    f = (1 + beta**2) * (flag * case).sum(1) / (beta**2 * case.sum() + flag.sum(1))
    return float(at[int(np.argmax(f))])


def fit_labelled(bags: Bags, y: np.ndarray, n: np.ndarray, seed: int = 42, **how) -> FactorizationMachine:
    """The machine in use: labels weighed by how likely they are right, the score moved so that above 0 is a case."""
    s = held_out_scores(bags, y, seed, **how)
    likely = case_likelihood(s, y, n)
    fm = fit(bags, y, np.where(y > 0.5, likely, 1 - likely), seed=seed, **how)
    fm.b -= np.float32(threshold(s, likely))
    return fm


def rater_shares(labels: DataFrame, key: str = "doc_id", rater: str = "rater_id", label: str = "toxic") -> DataFrame:
    """(key, y, n): the share of raters that saw a case, and how many raters. Repeated rows of a rater count once; undecided ones do not count."""
    once = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, rater, label).distinct()
    return once.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))


def labelled_bags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, seed: int = 42) -> tuple[Bags, np.ndarray, np.ndarray]:
    """(bags, y, n) of at most ``max_labelled`` labelled documents, the ones whose keys hash lowest.

    Passages are read on the executors; the driver gets the words of a bounded number of documents.
    """
    picked = rater_shares(labels, key).orderBy(key_hash(seed, key)).limit(max_labelled)
    # max_labelled rows of three numbers
    rows = docs.select(key, text).join(F.broadcast(picked), key).select(key, "y", "n", text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = pa.array([passages(t) for t in b.column(3).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), bags], ["id", "y", "n", "bags"])

    got = rows.mapInArrow(read, "id bigint, y double, n bigint, bags array<array<string>>").toArrow().sort_by("id")
    return Bags.of(got.column("bags").to_pylist()), got.column("y").to_numpy(), got.column("n").to_numpy()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, seed: int = 42, **how) -> FactorizationMachine:
    """A machine fitted on the labelled documents and moved so that a score above 0 is a case. ``how`` goes to ``fit``."""
    return fit_labelled(*labelled_bags(docs, labels, key, text, max_labelled, seed), seed=seed, **how)


class _Scorer:
    """Scores of documents; remembers the shares of at most KNOWN_WORDS words."""

    def __init__(self, fm: FactorizationMachine) -> None:
        self.fm, self.number = fm, {}
        self.table = np.zeros((0, 3 + fm.v.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.number) + len(words) > KNOWN_WORDS:
            self.number, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.number]
        if new:
            rows = self.fm.shares(*term_buckets(new))
            self.number.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        docs = [passages(t) for t in texts]
        self.learn({w for d in docs for p in d for w in p})
        number, out = self.number, np.zeros(len(docs))
        size = np.array([len(d) for d in docs])
        if size.any():
            words = np.array([number[w] for d in docs for p in d for w in p], np.int64)
            s = self.fm.from_shares(_sum(self.table[words], _starts([len(p) for d in docs for p in d])))
            out[size > 0] = 1 / (1 + np.exp(-np.maximum.reduceat(s, _starts(size)[:-1][size > 0]).astype(float)))
        return out


def score(docs: DataFrame, fm: FactorizationMachine, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``: the likelihood in 0..1 that a passage of the text is a case.

    The whole text counts, its highest passage decides. Null, empty and wordless texts score 0.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((fm.b, fm.w, fm.v))  # BUCKETS * (FACTORS + 1) numbers, whatever the data
    src = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", score double"
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorizationMachine(0, 0)
        m.b, m.w, m.v = model.value
        scorer = _Scorer(m)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scorer(part.column(len(keep)).to_pylist()))], names)

    return src.mapInArrow(run, schema)


def _scored(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    docs = load(spark, d, "documents")
    return score(docs, train(docs, load(spark, d, "review_labels")), keep)


def _case() -> F.Column:
    return F.col("score") > 0.5


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, flagged, rate)."""
    out = scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(_case(), 1)).alias("flagged"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, ["doc_id"]).where(_case()).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for every document."""
    return _scored(spark, d, ["doc_id", "source"]).select("doc_id", "source", F.round("score", 6).alias("score"), _case().alias("flagged"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, how many are flagged, and the rate."""
    return source_rates(_scored(spark, d, ["source"]))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source, what must hold of the scores: every document has one, in 0..1; the rate is that of the scores."""
    docs = load(spark, d, "documents")
    scored = cut(score(docs, train(docs, load(spark, d, "review_labels")), ["doc_id", "source"]).withColumn("flag", _case()))
    per = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_id").alias("ids"), F.count(F.when((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull(), 1)).alias("outside"),
        F.count(F.when(F.col("flag"), 1)).alias("hits"),
    )
    j = per.alias("a").join(source_rates(scored).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    same = (F.col("hits") == F.col("flagged")) & (F.abs(F.col("rate") - F.col("hits") / F.col("a.documents")) < 1e-6)
    return j.select("a.source", "a.documents", "ids", "outside", same.alias("rate_agrees"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_check": p8_check}
ORACLE: dict[str, str] = {
    "p8_check": "select source, count(*) documents, count(distinct doc_id) ids, 0::bigint outside, true rate_agrees from documents group by 1",
}
