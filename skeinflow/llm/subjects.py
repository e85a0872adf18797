"""Problem 8: the subject areas of each document, from labelling functions combined by an accuracy-learning latent model.

1. Units. The texts are read once: sentences, or names and comments of code, become sets of hashed words, kept as a table in the shared folder with the
   section each stands in, whether it is a heading, and the words of the document's addresses (its path and links). All later passes read that table.
2. Lexicon. Documents labelled with one subject (a bounded sample) and the words of the subjects' descriptions give a first lexicon; in each of ``ROUNDS``
   passes over all units those it is sure of, and undecided ones in documents that mostly deal with one subject, are counted by word and subject;
   words that occur almost only with one subject make the next lexicon.
3. Labelling functions, each voting a level on a (document, subject): the share of units that the lexicon gives to the subject; the share that a naive
   Bayes classifier of the labelled sample gives to it; the share of sections that deal with it, each taken as a whole; the headings and the addresses, which speak for
   it or abstain; the source's usual subjects; the annotators, who abstain on documents without labels.
4. Latent model. Votes are counted by pattern and subject over the corpus; expectation maximisation learns how often each function votes each level where the subject
   is dealt with and where it isn't, apart for each subject with the rates of all subjects as a prior; the posterior decides. The prior
   beliefs say only what the problem does: a subject is dealt with from about a quarter of the units on.

Bounds: ``LABELLED`` labelled documents; patterns are bounded by the product of the levels; all counts cover all documents. The lexicon holds every pure word: up to
``LEXICON_ROWS`` words every task holds it, a larger one is joined to the words as a table. The subjects themselves are a fixed small table.

Cases: null, empty and blank texts and texts without known words have no row; labels in other case or with blanks are tidied, unknown and null ones ignored; no labels at all
leave the descriptions; repeated document rows give one row per id; fenced blocks and boilerplate deal with nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.session import cut, kept, small

LABELLED, ROUNDS = 20_000, 2
#: A word of the lexicon occurs at least so often and so purely with one subject; a description's word that is in more than ``COMMON`` of the units says nothing.
MIN_COUNT, PURITY, COMMON = 4, 0.7, 0.01
#: In the few labelled documents fewer occurrences do; their weight is small, so that several such words must agree.
LABELLED_COUNT = 1
#: Words up to which every task holds the lexicon (16 bytes each).
LEXICON_ROWS = 4_000_000
#: Words of which a task remembers the parts.
REMEMBERED = 500_000
#: What the problem says: the share of units from which on a document deals with a subject.
QUARTER = 0.25
#: Edges of the levels that shares are voted in; no level begins or ends at a learned value.
SHARES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)
SECTIONS = (0.0, 0.15, 0.25, 0.35, 0.6)
USUAL = (0.0, 0.02, 0.1, 0.25, 0.4)
FUNCTIONS = ("lexicon", "bayes", "section", "heading", "address", "source", "annotator")
LEVELS = (len(SHARES) + 1, len(SHARES) + 1, len(SECTIONS) + 1, 2, 2, len(USUAL) + 1, 3)
#: Functions that abstain at level 0, and the weights of the functions' log odds: those besides the lexicon read the same texts, so they count half.
ABSTAIN, WEIGHTS = (3, 4, 6), (1.0, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0)
#: Labelled documents together weigh so many times what all others do when rates are learned.
ANCHOR = 3.0

_CJK = re.compile(r"[぀-ヿ一-鿿]")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_LEAD = re.compile(r"^\s*(?://+|#+|--+|/\*+|\*+|[-+>]|\d+[.)])\s*")
_END = re.compile(r"(?<=[.!?])[\"')\]*]*\s+|(?<=[。！？])")
_COMMENT = re.compile(r"^\s*(?://|#|--|/\*|\*|<!--|\"\"\"|''')")
_LINK = re.compile(r"https?://\S+|`[\w./-]+/[\w./-]+`")

UNITS = "doc_id long, source string, code boolean, words array<long>, ends array<int>, section array<int>, head array<boolean>, address array<long>, address_ends array<int>"
#: code of a word -> (subject, weight), as arrays sorted by code
Lexicon = tuple[np.ndarray, np.ndarray, np.ndarray]


def parts_of(token: str) -> list[str]:
    """Lower-case words of three letters and more in a run of letters: camel case taken apart; Chinese and Japanese as pairs of characters."""
    out = []
    for w in _SPLIT.split(token):
        w = w.lower()
        if not w.isascii() and _CJK.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        elif len(w) > 2:
            out.append(w)
    return out


def code_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Coder:
    """Codes of the words of a text; the parts of a run of letters are looked up once."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        out: dict[int, None] = {}
        known = self.known
        for t in _WORD.findall(text):
            codes = known.get(t)
            if codes is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                codes = known[t] = tuple(code_of(w) for w in parts_of(t))
            for c in codes:
                out[c] = None
        return list(out)


def units(text: str | None, code: bool, words: Callable[[str], list]) -> Iterator[tuple[list, int, bool]]:
    """(distinct words, number of the section, whether a title or heading) of each unit of a text; a section ends at a blank line or a heading."""
    fenced, section, begun = False, 0, False
    for n, line in enumerate((text or "").split("\n")):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not s:
            section, begun = section + begun, False
            continue
        if code and not _COMMENT.match(line):
            if w := words(s):
                begun = True
                yield w, section, False
            continue
        head = s.startswith("#") and not code or (s.startswith("**") and s.endswith("**"))
        if head and begun:
            section, begun = section + 1, False
        for k, part in enumerate(_END.split(_LEAD.sub("", s))):
            if w := words(part):
                begun = True
                yield w, section, head or (n == k == 0 and not code)


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64))], pa.int32()), pa.array(values, kind))


def read_units(docs: DataFrame) -> DataFrame:
    """The units of each document with a text, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                b = batch.slice(at, 2_000)
                words, n_words, ends, sections, heads, n_units, addresses, n_addresses, address_ends, n_links = [], [], [], [], [], [], [], [], [], []
                text, kind, path = (b.column(c).to_pylist() for c in ("text", "doc_kind", "file_path"))
                code = [k == "code" for k in kind]
                for t, c, p in zip(text, code, path):
                    n = u = 0
                    for w, section, head in units(t, c, coder):
                        words += w
                        n += len(w)
                        u += 1
                        ends.append(n)
                        sections.append(section)
                        heads.append(head)
                    n_words.append(n)
                    n_units.append(u)
                    n = u = 0
                    for a in [p or "", *_LINK.findall(t or "")]:
                        if w := coder(a):
                            addresses += w
                            n += len(w)
                            u += 1
                            address_ends.append(n)
                    n_addresses.append(n)
                    n_links.append(u)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        b.column("source"),
                        pa.array(code, pa.bool_()),
                        _lists(words, n_words, pa.int64()),
                        _lists(ends, n_units, pa.int32()),
                        _lists(sections, n_units, pa.int32()),
                        _lists(heads, n_units, pa.bool_()),
                        _lists(addresses, n_addresses, pa.int64()),
                        _lists(address_ends, n_links, pa.int32()),
                    ],
                    names=[c.split()[0] for c in UNITS.split(", ")],
                )

    return docs.select("doc_id", "source", "text", "doc_kind", "file_path").mapInArrow(run, UNITS)


class Batch:
    """The units of a batch of documents as flat arrays: the document and the section of each unit, the unit of each word."""

    def __init__(self, b: pa.RecordBatch, words: str = "words", ends: str = "ends"):
        self.docs = b.num_rows
        w, e = b.column(words), b.column(ends)
        self.words = w.flatten().to_numpy(zero_copy_only=False)
        ends_ = e.flatten().to_numpy(zero_copy_only=False)
        units_of = np.diff(e.offsets.to_numpy())
        self.doc = np.repeat(np.arange(self.docs), units_of)
        first = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(self.doc) else np.zeros(0, bool)
        before = np.where(first, 0, np.r_[0, ends_[:-1]][: len(ends_)])
        self.size = ends_ - before
        self.unit = np.repeat(np.arange(len(ends_)), self.size)
        self.units = len(ends_)

    def add(self, lexicon: Lexicon, k: int, least: float = 0.0) -> np.ndarray:
        """(units, k): weights of the lexicon's words by unit and subject."""
        codes, subject, weight = lexicon
        if not len(codes):
            return np.zeros((self.units, k))
        at = np.searchsorted(codes, self.words)
        at[at == len(codes)] = 0
        hit = (codes[at] == self.words) & (weight[at] > least)
        at = at[hit]
        return np.bincount(self.unit[hit] * k + subject[at], weights=weight[at], minlength=self.units * k).reshape(self.units, k)


def decide(score: np.ndarray, floor: float = 1.0) -> np.ndarray:
    """The subject of each row of scores, -1 where none is above the floor and clearly first."""
    if not len(score):
        return np.zeros(0, dtype=np.int64)
    best = score.argmax(axis=1)
    top = score[np.arange(len(score)), best]
    rest = score.copy()
    rest[np.arange(len(score)), best] = 0.0
    return np.where((top > floor) & (top > 1.2 * rest.max(axis=1)), best, -1)


def by_document(decided: np.ndarray, of: np.ndarray, docs: int, k: int) -> np.ndarray:
    """(docs, k): how many of the decided things each document has of each subject."""
    fine = decided >= 0
    return np.bincount(of[fine] * k + decided[fine], minlength=docs * k).reshape(docs, k)


_COUNTED = "word long, subject int, n long"


def _added(word: np.ndarray, subject: np.ndarray) -> pa.RecordBatch:
    n = pd.DataFrame({"word": word, "subject": subject}).groupby(["word", "subject"], sort=False).size().reset_index()
    return pa.RecordBatch.from_arrays([pa.array(n["word"].to_numpy(), pa.int64()), pa.array(n["subject"].to_numpy(), pa.int32()), pa.array(n[0].to_numpy(), pa.int64())], names=["word", "subject", "n"])


def count_known(known: DataFrame) -> DataFrame:
    """(word, subject, n): words by the subject of their labelled document (column ``known``), pre-added in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = Batch(b)
            yield _added(x.words, b.column("known").to_numpy(zero_copy_only=False)[x.doc][x.unit])

    return known.select("words", "ends", "known").mapInArrow(run, _COUNTED).groupBy("word", "subject").agg(F.sum("n").alias("n"))


def count_decided(table: DataFrame, lexicon: DataFrame, k: int) -> DataFrame:
    """(word, subject, n): words by the subject the lexicon gives to their unit, -1 for none; in a document of which most units are of one subject the others count for it too, if nothing speaks against it."""
    rows, own = at_hand(table, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = Batch(b)
            score = x.add(own(b), k)
            said = decide(score, floor=1.5)
            n = by_document(said, x.doc, x.docs, k)
            sizes = np.bincount(x.doc, minlength=x.docs)
            main = np.where((n.max(axis=1) * 2 > sizes) & (sizes > 1), n.argmax(axis=1), -1)
            said = np.where((said < 0) & (score.max(axis=1, initial=0.0) <= 0), main[x.doc], said)
            yield _added(x.words, said[x.unit])

    return rows.select("words", "ends", *(c for c in ("hits",) if c in rows.columns)).mapInArrow(run, _COUNTED).groupBy("word", "subject").agg(F.sum("n").alias("n"))


def pure_words(counts: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(word, subject, weight, raw) of the words of summed counts; subject is null for those that no subject has to itself.

    Counts are scaled as if all subjects were met equally often, so a sentence in passing in a common subject's documents doesn't become that subject's.
    """
    totals = {r.subject: r.n for r in counts.groupBy("subject").agg(F.sum("n").alias("n")).collect()}  # one per subject
    if not totals:
        return counts.select("word", F.lit(0).alias("subject"), F.lit(0.0).alias("weight"), F.col("n").alias("raw")).limit(0)
    mean = sum(totals.values()) / len(totals)
    scale = F.create_map(*(x for s, n in totals.items() for x in (F.lit(s), F.lit(mean / n))))
    scaled = counts.withColumn("c", F.col("n") * F.element_at(scale, F.col("subject")))
    best = scaled.groupBy("word").agg(F.sum("n").alias("raw"), F.sum("c").alias("total"), F.max(F.when(F.col("subject") >= 0, F.struct("c", F.col("subject")))).alias("best"))
    c = F.col("best.c")
    pure = (F.col("raw") >= least) & (c >= PURITY * F.col("total"))
    return best.select("word", F.when(pure, F.col("best.subject")).cast("int").alias("subject"), F.log((c + 0.5) / (F.col("total") - c + 0.5)).alias("weight"), "raw")


def as_lexicon(words: DataFrame, seeds: dict[int, int]) -> DataFrame:
    """(word, subject, weight) of the pure words of a corpus, and the seeds it doesn't show to be others'."""
    pure = words.filter("subject is not null").select("word", "subject", "weight")
    if not seeds:
        return cut(pure)
    first = words.sparkSession.createDataFrame([(w, s, 2.0) for w, s in seeds.items()], "word long, subject int, weight double")
    seen = words.filter((F.col("raw") >= MIN_COUNT) | F.col("subject").isNotNull()).select("word")
    return cut(pure.unionByName(first.join(seen, "word", "left_anti")))


def _sorted(words: np.ndarray, subject: np.ndarray, weight: np.ndarray) -> Lexicon:
    codes, first = np.unique(words.astype(np.int64), return_index=True)
    return codes, subject[first].astype(np.int64), weight[first].astype(np.float64)


def at_hand(table: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], Lexicon]]:
    """``table``, and how a task comes by the words of the lexicon: it holds them all up to ``LEXICON_ROWS``; beyond, each row of the table has its own in the column ``hits``."""
    if lexicon.count() <= LEXICON_ROWS:
        rows = lexicon.toPandas()
        every = _sorted(rows.word.to_numpy(), rows.subject.to_numpy(), rows.weight.to_numpy())
        return table, lambda b: every
    numbered = kept(table.withColumn("row", F.monotonically_increasing_id()))
    each = numbered.select("row", F.explode(F.array_distinct(F.concat("words", "address"))).alias("word")).join(lexicon, "word")
    found = each.groupBy("row").agg(F.collect_list(F.struct("word", "subject", "weight")).alias("hits"))  # no more than the document's own words
    joined = numbered.join(found, "row", "left").drop("row")

    def own(b: pa.RecordBatch) -> Lexicon:
        flat = b.column("hits").flatten()
        return _sorted(*(flat.field(c).to_numpy(zero_copy_only=False) for c in ("word", "subject", "weight")))

    return joined, own


def seed_words(table: DataFrame, subjects: DataFrame, names: list[str]) -> dict[int, int]:
    """code -> subject of the words that only one subject's name and description have and that aren't common in the corpus."""
    heard: dict[int, set[int]] = defaultdict(set)
    coder = Coder()
    for r in subjects.filter("subject is not null").select("subject", "description").collect():
        for c in coder(f"{r.subject} {r.description or ''}"):
            heard[c].add(names.index(r.subject))
    alone = np.array(sorted(c for c, s in heard.items() if len(s) == 1), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = Batch(b)
            hit = x.words[np.isin(x.words, alone)]
            yield _added(np.r_[hit, np.full(x.units, 0)], np.r_[np.zeros(len(hit), np.int64), np.full(x.units, 1)])

    n = {(r.word, r.subject): r.n for r in table.select("words", "ends").mapInArrow(run, _COUNTED).groupBy("word", "subject").agg(F.sum("n").alias("n")).collect()}  # a row per word of the descriptions
    every = n.get((0, 1), 0)
    return {int(c): min(heard[int(c)]) for c in alone if n.get((int(c), 0), 0) <= max(COMMON * every, 1)}


def bayes_table(counts: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, log of how much more often each subject has the word than all have it), smoothed, of the labelled sample's words."""
    if counts.empty:
        return np.zeros(0, np.int64), np.zeros((0, k))
    codes, at = np.unique(counts.word.to_numpy(np.int64), return_inverse=True)
    n = np.zeros((len(codes), k))
    np.add.at(n, (at, counts.subject.to_numpy(np.int64)), counts.n.to_numpy(np.float64))
    fine = n.sum(axis=1) >= 2
    codes, n = codes[fine], n[fine]
    total = n.sum(axis=0)
    rate = (n + 0.1) / (total + 0.1 * max(1, len(codes)))
    whole = rate[:, total > 0].mean(axis=1, keepdims=True) if (total > 0).any() else rate.mean(axis=1, keepdims=True)
    logs = np.log(rate / whole)
    logs[:, total <= 0] = -5.0
    return codes, logs


def _level(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    """0 for nothing, else one more than the number of the last edge that x reaches."""
    return np.where(x > 0, np.searchsorted(np.array(edges), x, side="right"), 0)


_FOUND = "doc_id long, source string, subject int, share double, v0 int, v1 int, v2 int, v3 int, v4 int"


def features(table: DataFrame, lexicon: DataFrame, bayes: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(doc_id, source, subject, share, v0..v4) of each document and each subject that any function but the source's speaks for."""
    codes, logs = bayes
    table, own_of = at_hand(table, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, links = Batch(b), Batch(b, "address", "address_ends")
            own = own_of(b)
            code = b.column("code").to_numpy(zero_copy_only=False).astype(bool)
            score = x.add(own, k)
            said = decide(score)
            n = by_document(said, x.doc, x.docs, k)
            of = np.maximum(1, np.where(code, n.sum(axis=1), np.bincount(x.doc, minlength=x.docs)))[:, None]  # names like those of loops and logs deal with nothing
            share = n / of
            # naive Bayes of each unit against the whole; words the sample doesn't have say nothing
            odds = np.zeros((x.units, k))
            if len(codes):
                at = np.searchsorted(codes, x.words)
                at[at == len(codes)] = 0
                hit = codes[at] == x.words
                for s in range(k):
                    odds[:, s] = np.bincount(x.unit[hit], weights=logs[at[hit], s], minlength=x.units)
            guess = decide(np.maximum(odds, 0.0), floor=2.0)
            m = by_document(guess, x.doc, x.docs, k)
            of_guess = np.maximum(1, np.where(code, m.sum(axis=1), np.bincount(x.doc, minlength=x.docs)))[:, None]
            # sections, by all their words together
            number = b.column("section").flatten().to_numpy(zero_copy_only=False)
            new = np.r_[True, (np.diff(x.doc) != 0) | (np.diff(number) != 0)] if x.units else np.zeros(0, bool)
            pooled = np.add.reduceat(score, np.flatnonzero(new), axis=0) if x.units else np.zeros((0, k))
            of_section = x.doc[new]
            # a section deals with each subject that has a quarter of its weight
            weighty = (pooled > 1.0) & (pooled >= QUARTER * pooled.sum(axis=1, keepdims=True))
            sections = np.zeros((x.docs, k))
            np.add.at(sections, of_section, weighty)
            sections /= np.maximum(1, np.bincount(of_section, minlength=x.docs))[:, None]
            head = b.column("head").flatten().to_numpy(zero_copy_only=False).astype(bool)
            heads = by_document(said[head], x.doc[head], x.docs, k)
            where = by_document(decide(links.add(own, k)), links.doc, x.docs, k)
            doc, subject = np.nonzero((n > 0) | (m > 0) | (sections > 0) | (heads > 0) | (where > 0))

            votes = (_level(share, SHARES), _level(m / of_guess, SHARES), _level(sections, SECTIONS), (heads > 0).astype(int), (where > 0).astype(int))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), b.column("source").take(pa.array(doc)), pa.array(subject, pa.int32()), pa.array(share[doc, subject]), *(pa.array(v[doc, subject], pa.int32()) for v in votes)],
                names=[c.split()[0] for c in _FOUND.split(", ")],
            )

    return table.mapInArrow(run, _FOUND)


def votes(found: DataFrame, annotated: DataFrame) -> DataFrame:
    """``found`` with the votes of the source (v5) and of the annotators (v6: 1 for, 2 for others only, 0 for documents without labels)."""
    usual = found.groupBy(F.col("source").alias("s"), F.col("subject").alias("t")).agg(F.sum("share").alias("here"))
    whole = usual.groupBy(F.col("s").alias("w")).agg(F.sum("here").alias("all"))
    part = F.col("here") / F.col("all")
    level = F.lit(0)
    for i, edge in enumerate(USUAL):
        level = F.when((part >= edge) & (part > 0), F.lit(i + 1)).otherwise(level)
    usual = usual.join(whole, F.col("s").eqNullSafe(F.col("w"))).select("s", "t", level.alias("v5"))
    joined = found.join(small(cut(usual)), F.col("source").eqNullSafe(F.col("s")) & (F.col("subject") == F.col("t")), "left")
    said = F.when(F.col("named").isNull(), 0).when(F.array_contains("named", F.col("subject")), 1).otherwise(2)
    return joined.join(F.broadcast(annotated), F.col("doc_id") == F.col("labelled_id"), "left").select("doc_id", "subject", "share", *(f"v{i}" for i in range(5)), F.coalesce("v5", F.lit(0)).alias("v5"), said.alias("v6"))


def first_beliefs() -> tuple[np.ndarray, ...]:
    """Of each function the rates [y, level] that the problem's own words suggest; they only begin and smooth what is learned."""

    def shares(edges: tuple[float, ...], sharp: float) -> np.ndarray:
        middle = np.array([0.0, *((a + b) / 2 for a, b in zip(edges, [*edges[1:], 1.0]))])
        yes = 1 / (1 + np.exp(-sharp * (middle - QUARTER)))
        return np.stack([(1 - yes) / (1 - yes).sum(), yes / yes.sum()])

    spoken = np.array([[0.95, 0.05], [0.7, 0.3]])
    return (shares(SHARES, 30.0), shares(SHARES, 15.0), shares(SECTIONS, 10.0), spoken, spoken, np.full((2, LEVELS[5]), 1 / LEVELS[5]), np.array([[0.9, 0.01, 0.09], [0.9, 0.09, 0.01]]))


#: Weights of the beliefs, and of the rates of all subjects in those of one, as counted votes.
PSEUDO, PSEUDO_SUBJECT = 20.0, 200.0


def learn_accuracies(v: np.ndarray, subject: np.ndarray, n: np.ndarray, k: int, steps: int = 60) -> tuple[np.ndarray, list[np.ndarray]]:
    """(prior of each subject, of each function its rates [subject, y, level]) by expectation maximisation over counted patterns.

    The first step looks at labelled documents only, or at the beliefs where there are none; later ones at all.
    """
    believed = first_beliefs()
    prior = np.full(k, 0.5)
    rates = [np.repeat(b[None], k, axis=0) for b in believed]
    told = v[:, 6] > 0
    weight = np.where(told, n * max(1.0, ANCHOR * n[~told].sum() / max(1.0, n[told].sum())), n)
    for step in range(steps):
        if step == 0 and told.any():
            post, w = np.where(v[:, 6] == 1, 0.95, 0.05), np.where(told, n, 0.0)
        else:
            post, w = posterior(v, subject, prior, rates), weight
        prior = (np.bincount(subject, weights=w * post, minlength=k) + 1.0) / (np.bincount(subject, weights=w, minlength=k) + 2.0)
        for j, b in enumerate(believed):
            levels = b.shape[1]
            votes = np.where(told, n, 0.0) if j == 6 else w
            for y in (0, 1):
                mass = votes * (post if y else 1 - post)
                whole = np.bincount(v[:, j], weights=mass, minlength=levels) + PSEUDO * b[y]
                each = np.bincount(subject * levels + v[:, j], weights=mass, minlength=k * levels).reshape(k, levels) + PSEUDO_SUBJECT * whole / whole.sum()
                rates[j][:, y] = each / each.sum(axis=1, keepdims=True)
    return prior, rates


def posterior(v: np.ndarray, subject: np.ndarray, prior: np.ndarray, rates: list[np.ndarray]) -> np.ndarray:
    """Probability that the subject is dealt with, of each vote pattern."""
    odds = np.log(prior[subject]) - np.log(1 - prior[subject])
    for j, r in enumerate(rates):
        told = np.log(r[subject, 1, v[:, j]]) - np.log(r[subject, 0, v[:, j]])
        odds = odds + WEIGHTS[j] * (np.where(v[:, j] > 0, told, 0.0) if j in ABSTAIN else told)
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def annotations(labels: DataFrame, names: list[str]) -> DataFrame:
    """(labelled_id, named): the subjects that annotators give to each document of the bounded sample."""
    known = F.coalesce(*(F.when(F.lower(F.trim("subject")) == n.strip().lower(), F.lit(i)) for i, n in enumerate(names)))
    by = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), known.cast("int").alias("s")).filter("s is not null and labelled_id is not null").groupBy("labelled_id").agg(F.sort_array(F.collect_set("s")).alias("named"))
    return by.orderBy("labelled_id").limit(LABELLED)


def label_documents(docs: DataFrame, subjects: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, probability, share) of each document and each subject it may deal with."""
    spark = docs.sparkSession
    names = [r.subject for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").collect()]  # the small table of subjects
    schema = "doc_id long, subject string, probability double, share double"
    if not names:
        return spark.createDataFrame([], schema)
    k = len(names)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", "doc_kind", "file_path").filter("doc_id is not null and text is not null")
    table = kept(read_units(base))
    annotated = cut(annotations(labels, names))
    sample = annotated.filter(F.size("named") == 1).select("labelled_id", F.col("named")[0].alias("known"))
    counts = cut(count_known(table.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("words", "ends", "known")))  # at most LABELLED documents
    bayes = bayes_table(counts.toPandas(), k)
    seeds = seed_words(table, subjects, names)
    lexicon = as_lexicon(pure_words(counts, LABELLED_COUNT), seeds)
    for _ in range(rounds):
        lexicon = as_lexicon(pure_words(cut(count_decided(table, lexicon, k))), seeds)
    found = cut(votes(cut(features(table, lexicon, bayes, k)), annotated))
    columns = [f"v{i}" for i in range(len(FUNCTIONS))]
    counted = found.groupBy("subject", *columns).count().toPandas()  # bounded by the product of the levels
    if counted.empty:
        return spark.createDataFrame([], schema)
    v, of, n = counted[columns].to_numpy(np.int64), counted["subject"].to_numpy(np.int64), counted["count"].to_numpy(np.float64)
    counted["probability"] = posterior(v, of, *learn_accuracies(v, of, n, k))
    decided = spark.createDataFrame(counted[["subject", *columns, "probability"]])
    decided = decided.select(*(F.col(c).cast("int").alias(c) for c in ("subject", *columns)), "probability")
    name = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("subject") + 1)
    return found.join(small(decided, k * math.prod(LEVELS)), ["subject", *columns]).groupBy("doc_id", name.alias("subject")).agg(F.round(F.max("probability"), 6).alias("probability"), F.round(F.max("share"), 6).alias("share"))


def subject_areas(labelled_docs: DataFrame) -> DataFrame:
    """(doc_id, subject) of the subjects a document deals with: those more likely than not."""
    return labelled_docs.filter(F.col("probability") >= 0.5).select("doc_id", "subject")


def composition(areas: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, documents, share) over the corpus; a document of several areas counts in each."""
    total = docs.select(F.count_distinct("doc_id").alias("all"))
    return areas.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents")).crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"))
